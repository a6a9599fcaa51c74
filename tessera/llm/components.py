"""Connected components by alternating large-star and small-star steps.

Edges hook every node onto smaller neighbours until each component is a star
around its smallest node; the number of rounds grows with the logarithm of the
longest path.  A hub is never gathered: minima are pre-aggregated map-side and
joined back to its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with v < u -> the edges after one large-star or small-star step."""
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(lowest, "u")
    if large:
        hooked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hooked = joined.select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
    return hooked.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): the smallest node of each edge's component."""
    now = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, state = None, _state(now)
    while state != before and state[0]:
        now = cut_lineage(_star(_star(now, large=True), large=False))
        before, state = state, _state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
