"""Indices of named feature sets (AGG13): a sample's weighted sum over each set's features.

Defined cases: a sample without any feature of a set has an index of 0, its share
is null if the sample's values add up to 0; null values are passed over; a feature
may be in many sets; equal (set, feature, weight) rows count once, a null weight is
1, rows without a set or a feature are left out; features that no set names only
count in the sample's sum; an empty table of sets gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import maybe_broadcast


def set_indices(long: DataFrame, sets: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, set, total, share, n_seen, n_members), a row for every sample and set.

    ``long`` is (key, feature, value), ``sets`` (set, feature, weight).  ``total`` is
    the weighted sum, ``share`` the unweighted sum of the set's values over that of
    all the sample's values, ``n_seen`` how many of the set's ``n_members`` features are
    above 0.  Rows are summed per (sample, set) before they are shuffled.
    """
    named = sets.filter("set is not null and feature is not null")
    named = named.select("set", "feature", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).distinct()
    # a feature's weights in a set add up, so that it meets its values once
    named = named.groupBy("set", "feature").agg(F.sum("weight").alias("weight"))
    hits = long.join(maybe_broadcast(named), "feature").groupBy(key, "set").agg(
        F.sum(F.col("value") * F.col("weight")).alias("total"),
        F.sum("value").alias("part"),
        F.count(F.when(F.col("value") > 0, 1)).alias("n_seen"),
    )
    size = named.groupBy("set").agg(F.count(F.lit(1)).alias("n_members"))
    # the sets' names and sizes: one value that every sample's row unfolds
    every = size.select(F.collect_list(F.struct("set", "n_members"))).scalar()
    samples = long.groupBy(key).agg(F.sum("value").alias("whole"))
    rows = samples.withColumn("s", F.explode(every)).select(key, "whole", "s.set", "s.n_members")
    zero = F.lit(0.0)
    return rows.join(hits, [key, "set"], "left").select(
        key,
        "set",
        F.coalesce("total", zero).alias("total"),
        F.try_divide(F.coalesce("part", zero), F.col("whole")).alias("share"),
        F.coalesce("n_seen", F.lit(0).cast("long")).alias("n_seen"),
        "n_members",
    )


def set_contrast(indices: DataFrame, upper: str, lower: str, key: str = "sample_id") -> DataFrame:
    """(key, upper, lower, log_ratio): two sets' totals of each sample; the natural log of
    their quotient is null unless both are above 0."""
    of = {n: F.coalesce(F.max(F.when(F.col("set") == s, F.col("total"))), F.lit(0.0)).alias(n) for n, s in (("upper", upper), ("lower", lower))}
    both = indices.filter(F.col("set").isin(upper, lower)).groupBy(key).agg(*of.values())
    ratio = F.when((F.col("upper") > 0) & (F.col("lower") > 0), F.log("upper") - F.log("lower"))
    return both.withColumn("log_ratio", ratio)
