"""Sums of products of every feature pair of two tables, as blocked matrix products.

Each sample is one row per table, an array over the features; the two meet once
on the sample.  A task multiplies batches of such rows and adds the products up,
so what is shuffled after the join is one number per feature pair and task, never
a row per sample and feature pair.  Where a block of feature pairs would exceed
``BLOCK_BYTES``, the first table's features are cut into slices and each task
holds the pairs of one slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds.
BLOCK_BYTES = 32 << 20
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _feature_numbers(features: DataFrame) -> tuple[DataFrame, int]:
    """(feature, i) and how many there are: as wide as the schema, whatever the rows."""
    names = sorted(r[0] for r in features.select("feature").distinct().collect())
    return features.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "feature string, i int"), len(names)


def _arrays(long: DataFrame, numbers: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out_i, out_v): feature numbers and values of each sample; null values are absent."""
    entries = long.filter(F.col("value").isNotNull()).join(F.broadcast(numbers), "feature")
    held = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.col("value").cast("double").alias("v")))).alias("e"))
    return held.select(key, F.col("e.i").alias(f"{out}_i"), F.col("e.v").alias(f"{out}_v"))


def _dense(numbers: pd.Series, values: pd.Series, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where absent) and presence of features first .. first + width - 1."""
    x, m = np.zeros((len(numbers), width)), np.zeros((len(numbers), width))
    row = np.repeat(np.arange(len(numbers)), [len(e) for e in numbers])
    at, v = np.concatenate(numbers.tolist()) - first, np.concatenate(values.tolist())
    inside = (at >= 0) & (at < width)
    x[row[inside], at[inside]], m[row[inside], at[inside]] = v[inside], 1.0
    return x, m


def cross_moments(
    a: DataFrame, b: DataFrame, key: str = "sample_id", centre: float = 0.0, features: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(feature_a, feature_b, n, sa, sb, saa, sbb, sab) over the samples that have both values.

    ``a`` and ``b`` are (key, feature, value); sums are of values less ``centre``.
    ``features`` are tables to read the feature names from, if that is cheaper.
    """
    (number_a, count_a), (number_b, count_b) = (_feature_numbers(x) for x in features or (a, b))
    width = max(1, min(max(count_a, 1), BLOCK_BYTES // (8 * len(_SUMS) * max(count_b, 1))))
    slices = -(-count_a // width)
    met = _arrays(a, number_a, key, "xa").join(_arrays(b, number_b, key, "xb"), key)
    if slices > 1:
        salt = F.pmod(F.xxhash64(key), F.lit(32))
        met = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("salt", salt)
        met = met.repartition("slice", "salt").sortWithinPartitions("slice")
    else:
        met = met.withColumn("slice", F.lit(0))

    def rows_of(part: int, sums: np.ndarray) -> pd.DataFrame:
        ia, ib = np.nonzero(sums[0])
        cols = {"ia": ia + part * width, "ib": ib} | {c: s[ia, ib] for c, s in zip(_SUMS, sums)}
        return pd.DataFrame(cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = -1, None
        for batch in batches:
            for part, rows in batch.groupby("slice", sort=False):
                if part != now:
                    if sums is not None:
                        yield rows_of(now, sums)
                    now, sums = int(part), np.zeros((len(_SUMS), width, count_b))
                for k in range(0, len(rows), 512):
                    some = rows.iloc[k : k + 512]
                    xa, ma = _dense(some["xa_i"], some["xa_v"], now * width, width)
                    xb, mb = _dense(some["xb_i"], some["xb_v"], 0, count_b)
                    xa, xb = xa - centre * ma, xb - centre * mb
                    products = (ma, mb), (xa, mb), (ma, xb), (xa * xa, mb), (ma, xb * xb), (xa, xb)
                    for s, (left, right) in zip(sums, products):
                        s += left.T @ right
        if sums is not None:
            yield rows_of(now, sums)

    schema = "ia long, ib long, " + ", ".join(f"{c} double" for c in _SUMS)
    parts = met.select("slice", "xa_i", "xa_v", "xb_i", "xb_v").mapInPandas(run, schema)
    total = parts.groupBy("ia", "ib").agg(*[F.sum(c).alias(c) for c in _SUMS]).withColumn("n", F.col("n").cast("long"))
    named_a = number_a.select(F.col("feature").alias("feature_a"), F.col("i").alias("ia"))
    named_b = number_b.select(F.col("feature").alias("feature_b"), F.col("i").alias("ib"))
    return total.join(F.broadcast(named_a), "ia").join(F.broadcast(named_b), "ib").select("feature_a", "feature_b", *_SUMS)


def correlation(moments: DataFrame) -> DataFrame:
    """(feature_a, feature_b, n, rho): null where either side is constant."""
    n = F.col("n").cast("double")
    var_a, var_b = n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    # what is left of a constant's variance after rounding is none
    varies = (var_a > 1e-12 * n * F.col("saa")) & (var_b > 1e-12 * n * F.col("sbb"))
    rho = F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(var_a) * F.sqrt(var_b))
    return moments.select("feature_a", "feature_b", "n", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))
