"""Differential abundance / concentration tables (STA5-STA9, SRT2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.compose import clr_replace, closure, halfmin_pseudocount
from tessera.operators.ranking import bh_fdr, exact_quantiles
from tessera.operators.stats import RANK_DECIMALS, contrast_rows, mann_whitney
from tessera.session import cut_lineage

KEYS = ["contrast", "feature"]


def differential_abundance(
    vectors: DataFrame,
    meta: DataFrame,
    control: str,
    group: str = "grp",
    buckets: int | None = None,
) -> DataFrame:
    """Per contrast x feature: n_case, n_control, u, p, rank_biserial,
    clr_diff, log2fc, fdr (BH within contrast), method.

    vectors: (sample_id, features, vec) raw abundances.  Rows are re-closed,
    CLR uses half the smallest positive proportion for zeros; log2 fold change
    of mean proportions uses the same half-minimum as epsilon.
    """
    closed = vectors.select("sample_id", "features", closure(F.col("vec")).alias("p"))
    eps = halfmin_pseudocount(closed, "p")
    labelled = closed.withColumn("_eps", eps).withColumn("clr", clr_replace(F.col("p"), F.col("_eps"))).join(
        meta.select("sample_id", group), "sample_id"
    )
    long = labelled.select(
        "sample_id",
        group,
        "_eps",
        F.inline(F.arrays_zip(F.col("features").alias("feature"), "p", "clr")),
    )
    # reused by the contrast list, the ranks and the means: compute once
    long = cut_lineage(long)
    rows = contrast_rows(long, group, control).withColumn("rv", F.round("clr", RANK_DECIMALS))
    mw = mann_whitney(rows, KEYS, "rv", F.col("is_case"), buckets=buckets)
    case, ctrl = F.col("is_case"), ~F.col("is_case")
    means = rows.groupBy(*KEYS).agg(
        F.avg(F.when(case, F.col("p"))).alias("m1"),
        F.avg(F.when(ctrl, F.col("p"))).alias("m0"),
        F.avg(F.when(case, F.col("clr"))).alias("c1"),
        F.avg(F.when(ctrl, F.col("clr"))).alias("c0"),
        F.first("_eps").alias("eps"),
    )
    out = mw.join(means, KEYS).select(
        *KEYS,
        "n_case",
        "n_control",
        "u",
        "p",
        "rank_biserial",
        (F.col("c1") - F.col("c0")).alias("clr_diff"),
        F.log2((F.col("m1") + F.col("eps")) / (F.col("m0") + F.col("eps"))).alias("log2fc"),
        "method",
    )
    return bh_fdr(out, ["contrast"], "p", tiebreak=["feature"])


def differential_concentration(long: DataFrame, meta: DataFrame, control: str, group: str = "grp", buckets: int | None = None) -> DataFrame:
    """Metabolite version: log2 fold change of medians (no epsilon), median
    difference, rank-biserial, p, fdr; Mann-Whitney on the raw values."""
    rows = contrast_rows(long.join(meta.select("sample_id", group), "sample_id"), group, control)
    rows = cut_lineage(rows)  # ranked twice: pooled, and per side for the medians
    mw = mann_whitney(rows, KEYS, "value", F.col("is_case"), buckets=buckets)
    half = exact_quantiles(rows, [*KEYS, "is_case"], "value", {"md": 0.5}, buckets)
    med = half.groupBy(*KEYS).agg(
        F.max(F.when(F.col("is_case"), F.col("md"))).alias("md1"), F.max(F.when(~F.col("is_case"), F.col("md"))).alias("md0")
    )
    out = mw.join(med, KEYS).select(
        *KEYS,
        "n_case",
        "n_control",
        F.log2(F.try_divide(F.col("md1"), F.col("md0"))).alias("log2fc"),
        (F.col("md1") - F.col("md0")).alias("median_diff"),
        "rank_biserial",
        "p",
    )
    return bh_fdr(out, ["contrast"], "p", tiebreak=["feature"])


def both_ends(df: DataFrame, family: str, order: str, k: int, tiebreak: str = "feature") -> DataFrame:
    """Per family: the k lowest and the k highest rows by ``order`` (head + tail)."""
    lo = Window.partitionBy(family).orderBy(F.col(order).asc(), F.col(tiebreak).asc())
    hi = Window.partitionBy(family).orderBy(F.col(order).desc(), F.col(tiebreak).desc())
    ranked = df.withColumn("_lo", F.row_number().over(lo)).withColumn("_hi", F.row_number().over(hi))
    end = F.when(F.col("_lo") <= k, F.lit("low")).otherwise(F.lit("high"))
    return ranked.filter((F.col("_lo") <= k) | (F.col("_hi") <= k)).withColumn("end", end).drop("_lo", "_hi")


def top_by_sign(df: DataFrame, family: str, order: str, k: int, tiebreak: str = "feature") -> DataFrame:
    """Per family: the k largest positive and the k smallest negative rows, ``sign`` +1 / -1."""
    signed = df.withColumn("sign", F.signum(order).cast("int")).filter("sign <> 0")
    w = Window.partitionBy(family, "sign").orderBy(F.abs(order).desc(), tiebreak)
    return signed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def strongest(df: DataFrame, order: str, k: int, *tiebreak: str) -> DataFrame:
    """The k rows of the largest absolute value (top 25 pairs, strongest 6 links)."""
    return df.orderBy(F.abs(order).desc(), *tiebreak).limit(k)
