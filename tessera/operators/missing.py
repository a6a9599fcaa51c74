"""Missingness profiling (MIS family) on the long layout.

A modality is *present* for a sample when at least one of its cells is
non-null; an absent sample simply has no non-null cell.  Every profile is a
group-by (partial aggregation first), never a driver loop over columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import exact_quantiles


def presence(samples: DataFrame, long: DataFrame, name: str, key: str = "sample_id") -> DataFrame:
    """(key, <name>) boolean: NOT all cells null.  Samples without rows -> false."""
    obs = long.groupBy(key).agg((F.count("value") > 0).alias(name))
    return samples.select(key).join(obs, key, "left").select(key, F.coalesce(F.col(name), F.lit(False)).alias(name))


def presence_table(samples: DataFrame, modalities: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """One row per sample with one presence flag per modality and ``complete``."""
    out = samples.select(key)
    for name, long in modalities.items():
        out = out.join(presence(samples, long, name, key), key)
    return out.withColumn("complete", F.expr(" AND ".join(modalities)))


def nulls_per_feature(samples: DataFrame, long: DataFrame, key: str = "sample_id", decimals: int = 2) -> DataFrame:
    """(feature, n_missing, pct_missing) over all samples: a sample without a
    row for the feature counts as null.  Sorted by n_missing desc, feature."""
    n_total = samples.select(F.count(F.lit(1)).alias("n")).scalar()
    per = long.groupBy("feature").agg(F.count("value").alias("n_obs"))
    return (
        per.withColumn("n_total", n_total)
        .select(
            "feature",
            (F.col("n_total") - F.col("n_obs")).alias("n_missing"),
            F.round((F.col("n_total") - F.col("n_obs")) * 100.0 / F.col("n_total"), decimals).alias("pct_missing"),
        )
        .orderBy(F.col("n_missing").desc(), "feature")
    )


def nulls_per_row(samples: DataFrame, long: DataFrame, n_features, key: str = "sample_id") -> DataFrame:
    """(key, n_missing): features without a non-null value, per sample."""
    obs = long.groupBy(key).agg(F.count("value").alias("n_obs"))
    return samples.select(key).join(obs, key, "left").select(
        key, (F.lit(n_features) - F.coalesce(F.col("n_obs"), F.lit(0))).cast("bigint").alias("n_missing")
    ) if isinstance(n_features, int) else samples.select(key).join(obs, key, "left").withColumn("_nf", n_features).select(
        key, (F.col("_nf") - F.coalesce(F.col("n_obs"), F.lit(0))).cast("bigint").alias("n_missing")
    )


def row_missing_summary(per_row: DataFrame) -> DataFrame:
    """mean / min / quartiles (linear interpolation) / max of n_missing."""
    x = F.col("n_missing")
    q = exact_quantiles(per_row, [], "n_missing", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    ends = per_row.agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")).withColumn("_k", F.lit(1))
    return ends.join(q.withColumn("_k", F.lit(1)), "_k").select("mean", "min", "q25", "q50", "q75", "max")


def completeness_by_group(flags: DataFrame, meta: DataFrame, group: str, modalities: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Per group (null group dropped): n, full_<m>, missing_<m>."""
    j = flags.join(meta.select(key, group), key).filter(F.col(group).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in modalities:
        aggs += [F.count_if(F.col(m)).alias(f"full_{m}"), F.count_if(~F.col(m)).alias(f"missing_{m}")]
    return j.groupBy(group).agg(*aggs)


def meta_complete(meta: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(sample_id, meta_complete): no null in any of ``cols``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return meta.select("sample_id", cond.alias("meta_complete"))


def nulls_in_columns_by_group(meta: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per category: number of nulls in each chosen column."""
    return meta.groupBy(group).agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
