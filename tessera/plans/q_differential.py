"""Differential abundance family: STA3-5, STA7, STA9, WIN1-2, SRT2-3, AGG8, SET4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators.differential import both_ends, differential_abundance, top_by_sign
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.plans.sqlkit import CLOSE_CLR_HALFMIN, bh_sql, mwu_ctes
from tessera.sources import fixtures as fx

CONTROL = fx.CONTROL_GROUP


def da_table(spark, sf):
    return differential_abundance(fx.a_vectors(spark, sf), fx.meta(spark, sf), CONTROL)


DA_COLS = ["contrast", "feature", "n_case", "n_control", "u", "p", "rank_biserial", "clr_diff", "log2fc", "fdr", "method"]


def _da_report(df):
    return df.select(
        "contrast", "feature", "n_case", "n_control",
        rnd(F.col("u")).alias("u"), rnd(F.col("p")).alias("p"), rnd(F.col("rank_biserial")).alias("rank_biserial"),
        rnd(F.col("clr_diff")).alias("clr_diff"), rnd(F.col("log2fc")).alias("log2fc"), rnd(F.col("fdr")).alias("fdr"),
        "method",
    )


_DA_SQL_CTES = (
    CLOSE_CLR_HALFMIN.format(src="fx_a")
    + """,
lab AS (SELECT c.*, m.grp FROM clr c JOIN fx_meta m USING (sample_id) WHERE m.grp IS NOT NULL),
rows AS (SELECT l.*, k.contrast, l.grp <> '8' AS is_case, round(l.clr, 9) AS rv
         FROM lab l JOIN (SELECT DISTINCT grp AS contrast FROM lab WHERE grp <> '8') k
           ON l.grp = k.contrast OR l.grp = '8'),
"""
    + mwu_ctes("rows", "contrast, feature", "rv").lstrip()
    + """,
means AS (SELECT contrast, feature,
                 avg(CASE WHEN is_case THEN p END) AS m1, avg(CASE WHEN NOT is_case THEN p END) AS m0,
                 avg(CASE WHEN is_case THEN clr END) AS c1, avg(CASE WHEN NOT is_case THEN clr END) AS c0
          FROM rows GROUP BY contrast, feature),
da0 AS (SELECT r.*, c1 - c0 AS clr_diff, log2((m1 + (SELECT e FROM eps)) / (m0 + (SELECT e FROM eps))) AS log2fc
        FROM mw_res r JOIN means USING (contrast, feature)),
da AS ("""
    + bh_sql("da0", "contrast")
    + ")"
)

_DA_SELECT = """SELECT contrast, feature, n_case, n_control, round(u, 6) AS u, round(p, 6) AS p,
       round(rank_biserial, 6) AS rank_biserial, round(clr_diff, 6) AS clr_diff,
       round(log2fc, 6) AS log2fc, round(fdr, 6) AS fdr, method"""

DA_SQL = with_fixtures(f"{_DA_SELECT} FROM da", "fx_meta", "fx_a", extra=_DA_SQL_CTES.strip())


@register("sta7_differential_abundance", DA_SQL)
def sta7_differential_abundance(spark, sf):
    """CLR (half-minimum zeros) + Mann-Whitney per contrast x feature + effect
    sizes + BH within contrast, all contrasts in one plan."""
    return _da_report(da_table(spark, sf))


@register(
    "srt2_top_bottom_k",
    with_fixtures(
        """SELECT contrast, feature, round(clr_diff, 6) AS clr_diff, round(log2fc, 6) AS log2fc,
       round(rank_biserial, 6) AS rank_biserial, round(fdr, 6) AS fdr,
       CASE WHEN lo <= 8 THEN 'low' ELSE 'high' END AS "end"
FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY clr_diff, feature) AS lo,
                row_number() OVER (PARTITION BY contrast ORDER BY clr_diff DESC, feature DESC) AS hi FROM da) q
WHERE lo <= 8 OR hi <= 8""",
        "fx_meta",
        "fx_a",
        extra=_DA_SQL_CTES.strip(),
    ),
)
def srt2_top_bottom_k(spark, sf):
    """Per contrast the 8 most depleted and 8 most enriched features by CLR difference."""
    t = both_ends(da_table(spark, sf), "contrast", "clr_diff", 8)
    return t.select(
        "contrast", "feature", rnd(F.col("clr_diff")).alias("clr_diff"), rnd(F.col("log2fc")).alias("log2fc"),
        rnd(F.col("rank_biserial")).alias("rank_biserial"), rnd(F.col("fdr")).alias("fdr"), "end",
    )


@register(
    "srt2_top_by_sign",
    with_fixtures(
        """SELECT contrast, feature, CAST(sign(clr_diff) AS INTEGER) AS sign, round(clr_diff, 6) AS clr_diff FROM (
  SELECT *, row_number() OVER (PARTITION BY contrast, sign(clr_diff) ORDER BY abs(clr_diff) DESC, feature) AS r FROM da WHERE clr_diff <> 0) q WHERE r <= 5""",
        "fx_meta",
        "fx_a",
        extra=_DA_SQL_CTES.strip(),
    ),
)
def srt2_top_by_sign(spark, sf):
    """Per contrast the five strongest effects of each sign."""
    t = top_by_sign(da_table(spark, sf), "contrast", "clr_diff", 5)
    return t.select("contrast", "feature", "sign", rnd(F.col("clr_diff")).alias("clr_diff"))


@register(
    "agg8_contrast_summary",
    with_fixtures(
        """SELECT contrast, max(n_case) AS n, count_if(fdr < 0.05) AS n_sig,
       count_if(fdr < 0.05 AND clr_diff > 0) AS n_enriched, count_if(fdr < 0.05 AND clr_diff < 0) AS n_depleted
FROM da GROUP BY contrast""",
        "fx_meta",
        "fx_a",
        extra=_DA_SQL_CTES.strip(),
    ),
)
def agg8_contrast_summary(spark, sf):
    sig = F.col("fdr") < 0.05
    return da_table(spark, sf).groupBy("contrast").agg(
        F.max("n_case").alias("n"),
        F.count_if(sig).alias("n_sig"),
        F.count_if(sig & (F.col("clr_diff") > 0)).alias("n_enriched"),
        F.count_if(sig & (F.col("clr_diff") < 0)).alias("n_depleted"),
    )


@register(
    "sta9_volcano",
    with_fixtures(
        """SELECT contrast, feature, round(log2fc, 6) AS log2fc,
       round(-log10(greatest(fdr, 1e-300)), 6) AS neg_log10_fdr, fdr < 0.05 AS significant
FROM da""",
        "fx_meta",
        "fx_a",
        extra=_DA_SQL_CTES.strip(),
    ),
)
def sta9_volcano(spark, sf):
    t = da_table(spark, sf)
    return t.select(
        "contrast", "feature", rnd(F.col("log2fc")).alias("log2fc"),
        rnd(-F.log10(F.greatest(F.col("fdr"), F.lit(1e-300)))).alias("neg_log10_fdr"),
        (F.col("fdr") < 0.05).alias("significant"),
    )


@register(
    "set4_significant_union",
    with_fixtures("SELECT DISTINCT feature FROM da WHERE fdr < 0.05", "fx_meta", "fx_a", extra=_DA_SQL_CTES.strip()),
)
def set4_significant_union(spark, sf):
    """Features significant in at least one contrast (sorted for display)."""
    return da_table(spark, sf).filter(F.col("fdr") < 0.05).select("feature").distinct().orderBy("feature")


@register(
    "srt3_order_by_max_abs",
    with_fixtures(
        """SELECT feature, round(max(abs(CASE WHEN fdr < 0.05 THEN clr_diff END)), 6) AS max_abs_effect
FROM da GROUP BY feature""",
        "fx_meta",
        "fx_a",
        extra=_DA_SQL_CTES.strip(),
    ),
)
def srt3_order_by_max_abs(spark, sf):
    """Significant-masked effects (FLT8), rows ordered by the max absolute
    effect across contrasts."""
    masked = F.when(F.col("fdr") < 0.05, F.col("clr_diff"))
    return (
        da_table(spark, sf)
        .groupBy("feature")
        .agg(rnd(F.max(F.abs(masked))).alias("max_abs_effect"))
        .orderBy(F.col("max_abs_effect").desc_nulls_last(), "feature")
    )
