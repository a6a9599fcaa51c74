"""Deterministic pseudo-random draws from md5 of (seed, key...).

md5 gives the same hex text in Spark and DuckDB, is independent of how data is
partitioned, and is uniform, so its leading hex digits form balanced buckets.
That last property lets per-group ordinal numbers (splits, permutations) be
computed without sorting any whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(seed, *parts: Column | str) -> Column:
    cols = [F.lit(str(seed))] + [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def uniform(seed, *parts: Column | str) -> Column:
    """u in [0, 1) from the first 32 bits of md5(seed:parts)."""
    h = md5_key(seed, *parts)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fine_uniform(seed, *parts: Column | str) -> Column:
    """u in [0, 1) from the first 52 bits of md5(seed:parts): shares down to 2^-52 are drawn."""
    h = md5_key(seed, *parts)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(seed, *parts: Column | str) -> Column:
    """Standard normal by Box-Muller from two independent md5 uniforms."""
    u1 = uniform(seed, *parts, F.lit("u1"))
    u2 = uniform(seed, *parts, F.lit("u2"))
    u1 = F.greatest(u1, F.lit(1e-12))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * 3.141592653589793) * u2)


def ordinal_by_hash(df: DataFrame, groups: Sequence[str], h: str, out: str = "ord", digits: int = 2) -> DataFrame:
    """1-based position of each row inside its group when ordered by the md5
    hex column ``h`` (ties broken by nothing: md5 of distinct keys differ).

    Skew-safe: rows are split into 16**digits buckets by the leading hex
    digits (uniform, so balanced even for a group holding a third of all
    rows); bucket counts (a small table) give offsets, and a window inside
    (group, bucket) finishes the numbering.
    """
    groups = list(groups)
    b = df.withColumn("_hb", F.substring(F.col(h), 1, digits))
    counts = b.groupBy(*groups, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_hb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*groups, "_hb").orderBy(h)
    return (
        b.join(offsets, groups + ["_hb"])
        .withColumn(out, (F.col("_off") + F.row_number().over(within)).cast("bigint"))
        .drop("_hb", "_off")
    )
