"""Prefix scans of any length: running sums, minima, maxima and numbers without
one task sorting a whole group.

Rows are dealt by range over (keys, order), so each piece holds consecutive rows;
a window finishes the scan inside a piece, the pieces' last values (a table of
pieces, not rows) are scanned per key, and each row combines what came before its
piece with its own running value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

_KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], outs: Mapping[str, tuple[str, Column] | tuple[str, Column, str]]) -> DataFrame:
    """``df`` with one column per entry of ``outs``: (kind, value) summed (``sum``), or
    the least (``min``) or greatest (``max``), over the rows of the same keys up to
    and with this one in ``order``; (kind, value, "before") leaves this one out.

    ``order`` should tell the rows of a key apart.  Null values are passed over;
    where nothing came before, the result is null.
    """
    keys = list(keys)
    kinds = {n: _KINDS[o[0]] for n, o in outs.items()}
    ranged = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("_piece", F.spark_partition_id())
    fixed = cut_lineage(ranged.withColumns({f"_v_{n}": o[1] for n, o in outs.items()}))
    own = Window.partitionBy(*keys, "_piece").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {f"_w_{n}": agg(f"_v_{n}").over(upto) for n, (agg, _) in kinds.items()}
    before = [n for n, o in outs.items() if len(o) == 3]
    columns |= {f"_x_{n}": kinds[n][0](f"_v_{n}").over(own.rowsBetween(Window.unboundedPreceding, -1)) for n in before}
    columns["_n"] = F.row_number().over(own)
    inside = cut_lineage(fixed.withColumns(columns))
    # the last running value of a piece, so that sums add up in the same order on both sides of a border
    last = inside.groupBy(*keys, "_piece").agg(*[F.max_by(f"_w_{n}", "_n").alias(f"_l_{n}") for n in outs])
    pieces = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_k_{k}" for k in [*keys, "_piece"]}
    offset = last.select(*[F.col(k).alias(n) for k, n in names.items()], *[agg(f"_l_{n}").over(pieces).alias(f"_b_{n}") for n, (agg, _) in kinds.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    joined = inside.join(offset, same)
    got = joined.withColumns({n: both(F.col(f"_b_{n}"), F.col(f"{'_x' if n in before else '_w'}_{n}")) for n, (_, both) in kinds.items()})
    return got.drop("_piece", "_n", *names.values(), *[f"{p}_{n}" for n in outs for p in ("_v", "_w", "_x", "_b")])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with the 1-based place of each row among those of its keys."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("long"))})
