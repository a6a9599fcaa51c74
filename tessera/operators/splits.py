"""Reproducible splits and folds (SPL family).

Membership comes from md5(seed:id) order, so it is independent of
partitioning and re-computable in SQL.  Per-stratum positions use
:func:`tessera.functions.draws.ordinal_by_hash` (balanced md5 buckets), so a
stratum holding a third of all samples is still numbered by many tasks.
Per-stratum sizes and quotas live in small tables (one row per stratum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import md5_key, ordinal_by_hash

RARE = "_rare_"


def random_split(ids: DataFrame, val_fraction: float, seed: int, key: str = "sample_id") -> DataFrame:
    """(key, role): the first ceil(f * n) ids in md5(seed:id) order are 'val'."""
    h = ids.select(key).distinct().withColumn("_h", md5_key(seed, key))
    n = h.select(F.count(F.lit(1)).alias("n")).scalar()
    o = ordinal_by_hash(h, [], "_h", "_ord")
    k = F.ceil(F.lit(val_fraction) * n)
    return o.select(key, F.when(F.col("_ord") <= k, F.lit("val")).otherwise(F.lit("train")).alias("role"))


def merge_rare_strata(df: DataFrame, label: str, min_size: int) -> DataFrame:
    """Add ``stratum``: labels with fewer than ``min_size`` rows -> '_rare_'."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes, label).withColumn(
        "stratum", F.when(F.col("_n") < min_size, F.lit(RARE)).otherwise(F.col(label))
    ).drop("_n")


def stratified_split(
    labelled: DataFrame, label: str, val_fraction: float, seed: int, min_stratum_size: int = 2, key: str = "sample_id"
) -> DataFrame:
    """(key, stratum, role).  Strata still under 2 members go to train; the
    others share ceil(f * n_eligible) validation slots by largest remainder."""
    keyed = merge_rare_strata(labelled, label, min_stratum_size)
    sizes = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_s"))
    elig = sizes.withColumn("elig", F.when(F.col("n_s") < 2, F.lit(0)).otherwise(F.col("n_s")))
    k_total = elig.select(F.ceil(F.lit(val_fraction) * F.sum("elig")).cast("bigint")).scalar()
    n_elig = elig.select(F.sum("elig")).scalar()
    share = F.col("elig").cast("double") * F.col("k") / F.col("ne")
    q1 = (
        elig.withColumn("k", k_total).withColumn("ne", n_elig)
        .withColumn("base", F.floor(share)).withColumn("frac", share - F.floor(share))
    )
    # small table (one row per stratum): a global window is fine here
    extra = F.row_number().over(Window.orderBy(F.col("frac").desc(), "stratum")) <= F.col("k") - F.sum("base").over(Window.partitionBy())
    quota = q1.filter(F.col("elig") > 0).select("stratum", (F.col("base") + F.when(extra, 1).otherwise(0)).cast("bigint").alias("quota"))
    ordered = ordinal_by_hash(keyed.withColumn("_h", md5_key(seed, key)), ["stratum"], "_h", "_ord")
    return ordered.join(quota, "stratum", "left").select(
        key, "stratum", F.when(F.col("_ord") <= F.coalesce(F.col("quota"), F.lit(0)), F.lit("val")).otherwise(F.lit("train")).alias("role")
    )


def stratified_kfold(strata: DataFrame, stratum: str, k: int, seed: int, key: str = "sample_id") -> DataFrame:
    """(fold, key, role) for K folds; strata smaller than K are pinned to
    train in every fold; each other sample is 'val' in exactly one fold."""
    if k < 2:
        raise ValueError("stratified K-fold needs K >= 2")
    sizes = strata.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn("_off", (F.dense_rank().over(Window.orderBy(stratum)) - 1).cast("bigint"))
    ordered = ordinal_by_hash(strata.withColumn("_h", md5_key(seed, key)), [stratum], "_h", "_ord")
    j = ordered.join(offs, stratum)
    folds = j.select(key, "_n", "_ord", "_off", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    val = (F.col("_n") >= k) & (F.pmod(F.col("_ord") - 1 + F.col("_off"), F.lit(k)) == F.col("fold"))
    return folds.select(F.col("fold").cast("bigint").alias("fold"), key, F.when(val, F.lit("val")).otherwise(F.lit("train")).alias("role"))


def missing_lists(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, list): samples of one modality that lack the other, to be imputed."""
    only_b = b.select(key).join(a.select(key), key, "left_anti").select(key, F.lit("missing_a").alias("list"))
    only_a = a.select(key).join(b.select(key), key, "left_anti").select(key, F.lit("missing_b").alias("list"))
    return only_b.unionByName(only_a)
