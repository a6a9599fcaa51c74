"""Group statistics and associations: STA1-4, STA6, STA8, STA10-14, WIN1-2,
AGG5, AGG7, AGG9-11."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators import compose as C
from tessera.operators.correlate import (
    binned_mutual_information,
    correlated,
    ranked,
    residualize,
    spearman_pairs,
    t_two_sided_p,
)
from tessera.operators.differential import differential_concentration
from tessera.operators.ranking import bh_fdr, exact_quantiles
from tessera.operators.stats import RANK_DECIMALS, alpha_diversity, contrast_rows, kruskal_wallis, mann_whitney
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.plans.sqlkit import CLOSE_CLR_HALFMIN, bh_sql, kw_ctes, mwu_ctes, t_p_sql
from tessera.session import cut_lineage
from tessera.sources import fixtures as fx

CONTROL = fx.CONTROL_GROUP
METRICS = ["shannon", "simpson", "richness"]


def _alpha(spark, sf):
    v = fx.a_vectors(spark, sf).select("sample_id", C.closure(F.col("vec")).alias("p"))
    d = alpha_diversity(F.col("p"))
    return v.select("sample_id", *[d[m].alias(m) for m in METRICS])


_ALPHA_SQL = """closed AS (SELECT sample_id, feature, CASE WHEN s = 0 THEN NULL ELSE value / s END AS p
  FROM (SELECT *, sum(value) OVER (PARTITION BY sample_id) AS s FROM fx_a) q),
alpha AS (SELECT sample_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS shannon, 1 - sum(p * p) AS simpson,
                 CAST(count_if(p > 0) AS BIGINT) AS richness FROM closed GROUP BY sample_id),
al AS (SELECT a.sample_id, m.grp, 'shannon' AS metric, a.shannon AS value FROM alpha a JOIN fx_meta m USING (sample_id)
       UNION ALL SELECT a.sample_id, m.grp, 'simpson', a.simpson FROM alpha a JOIN fx_meta m USING (sample_id)
       UNION ALL SELECT a.sample_id, m.grp, 'richness', CAST(a.richness AS DOUBLE) FROM alpha a JOIN fx_meta m USING (sample_id)),
alr AS (SELECT *, round(value, 9) AS rv FROM al WHERE grp IS NOT NULL)"""


@register(
    "sta1_alpha_diversity",
    with_fixtures(
        "SELECT sample_id, round(shannon, 6) AS shannon, round(simpson, 6) AS simpson, richness FROM alpha",
        "fx_meta",
        "fx_a",
        extra=_ALPHA_SQL,
    ),
)
def sta1_alpha_diversity(spark, sf):
    """Shannon, Simpson and richness per sample of the closed composition."""
    a = _alpha(spark, sf)
    return a.select("sample_id", rnd(F.col("shannon")).alias("shannon"), rnd(F.col("simpson")).alias("simpson"), "richness")


def _alpha_long(spark, sf):
    a = _alpha(spark, sf).withColumn("richness", F.col("richness").cast("double"))
    long = a.unpivot(["sample_id"], METRICS, "metric", "value")
    return long.join(fx.meta(spark, sf).select("sample_id", "grp"), "sample_id").filter(F.col("grp").isNotNull()).withColumn(
        "rv", F.round("value", RANK_DECIMALS)
    )


@register(
    "sta2_kruskal_wallis",
    with_fixtures(
        "SELECT metric, n, k, round(h, 6) AS h, round(p, 6) AS p FROM kw_res",
        "fx_meta",
        "fx_a",
        extra=_ALPHA_SQL + "," + kw_ctes("alr", "metric", "rv", "grp"),
    ),
)
def sta2_kruskal_wallis(spark, sf):
    """Kruskal-Wallis across all groups for each alpha metric."""
    kw = kruskal_wallis(_alpha_long(spark, sf), ["metric"], "rv", "grp")
    return kw.select("metric", "n", "k", rnd(F.col("h")).alias("h"), rnd(F.col("p")).alias("p"))


_STA8_SQL = (
    _ALPHA_SQL
    + """,
rows AS (SELECT l.*, c.contrast, l.grp <> '8' AS is_case FROM alr l
         JOIN (SELECT DISTINCT grp AS contrast FROM alr WHERE grp <> '8') c ON l.grp = c.contrast OR l.grp = '8'),"""
    + mwu_ctes("rows", "metric, contrast", "rv")
    + """,
med AS (SELECT metric, contrast, median(CASE WHEN is_case THEN value END) AS median_case,
               median(CASE WHEN NOT is_case THEN value END) AS median_control FROM rows GROUP BY metric, contrast),
r8 AS (SELECT * FROM mw_res JOIN med USING (metric, contrast)),
f8 AS ("""
    + bh_sql("r8", "metric", tiebreak="contrast")
    + ")"
)


@register(
    "sta8_alpha_contrasts",
    with_fixtures(
        """SELECT metric, contrast, round(median_case, 4) AS median_case, round(median_control, 4) AS median_control,
       round(p, 6) AS p, round(fdr, 6) AS fdr FROM f8""",
        "fx_meta",
        "fx_a",
        extra=_STA8_SQL,
    ),
)
def sta8_alpha_contrasts(spark, sf):
    """Each group vs control per alpha metric: medians (4 dp), Mann-Whitney p,
    BH within metric."""
    rows = contrast_rows(_alpha_long(spark, sf), "grp", CONTROL)
    mw = mann_whitney(rows, ["metric", "contrast"], "rv", F.col("is_case"))
    half = exact_quantiles(rows, ["metric", "contrast", "is_case"], "value", {"md": 0.5})
    side = lambda case, name: F.max(F.when(F.col("is_case") == case, F.col("md"))).alias(name)
    med = half.groupBy("metric", "contrast").agg(side(True, "median_case"), side(False, "median_control"))
    out = bh_fdr(mw.join(med, ["metric", "contrast"]), ["metric"], "p", tiebreak=["contrast"])
    return out.select(
        "metric", "contrast", F.round("median_case", 4).alias("median_case"), F.round("median_control", 4).alias("median_control"),
        rnd(F.col("p")).alias("p"), rnd(F.col("fdr")).alias("fdr"),
    )


_B_ROWS = """rows AS (SELECT b.sample_id, b.feature, b.value, m.grp, c.contrast, m.grp <> '8' AS is_case
  FROM fx_b b JOIN fx_meta m USING (sample_id)
  JOIN (SELECT DISTINCT grp AS contrast FROM fx_meta WHERE grp <> '8' AND b_present) c ON m.grp = c.contrast OR m.grp = '8'
  WHERE m.grp IS NOT NULL),"""


@register(
    "sta3_4_mann_whitney",
    with_fixtures(
        """SELECT contrast, feature, n_case, n_control, round(u, 6) AS u, round(p, 6) AS p,
       round(rank_biserial, 6) AS rank_biserial, round(fdr, 6) AS fdr, method FROM f3""",
        "fx_meta",
        "fx_b",
        extra=_B_ROWS + mwu_ctes("rows", "contrast, feature", "value") + ",\nf3 AS (" + bh_sql("mw_res", "contrast") + ")",
    ),
)
def sta3_4_mann_whitney(spark, sf):
    """Mann-Whitney U (two-sided, asymptotic) + rank-biserial for every
    concentration feature, each group vs control, BH within contrast (WIN2)."""
    b = fx.b_long(spark, sf).join(fx.meta(spark, sf).select("sample_id", "grp"), "sample_id")
    rows = contrast_rows(b, "grp", CONTROL)
    mw = bh_fdr(mann_whitney(rows, ["contrast", "feature"], "value", F.col("is_case")), ["contrast"], "p", tiebreak=["feature"])
    return mw.select(
        "contrast", "feature", "n_case", "n_control", rnd(F.col("u")).alias("u"), rnd(F.col("p")).alias("p"),
        rnd(F.col("rank_biserial")).alias("rank_biserial"), rnd(F.col("fdr")).alias("fdr"), "method",
    )


_STA6_SQL = (
    _B_ROWS
    + mwu_ctes("rows", "contrast, feature", "value")
    + """,
med AS (SELECT contrast, feature, median(CASE WHEN is_case THEN value END) AS md1,
               median(CASE WHEN NOT is_case THEN value END) AS md0 FROM rows GROUP BY contrast, feature),
r6 AS (SELECT r.*, CASE WHEN md0 = 0 THEN NULL ELSE log2(md1 / md0) END AS log2fc, md1 - md0 AS median_diff
       FROM mw_res r JOIN med USING (contrast, feature)),
f6 AS ("""
    + bh_sql("r6", "contrast")
    + ")"
)


def _sta6(spark, sf):
    return differential_concentration(fx.b_long(spark, sf), fx.meta(spark, sf), CONTROL)


@register(
    "sta6_median_fold_change",
    with_fixtures(
        """SELECT contrast, feature, round(log2fc, 6) AS log2fc, round(median_diff, 6) AS median_diff,
       round(rank_biserial, 6) AS rank_biserial, round(p, 6) AS p, round(fdr, 6) AS fdr FROM f6""",
        "fx_meta",
        "fx_b",
        extra=_STA6_SQL,
    ),
)
def sta6_median_fold_change(spark, sf):
    """Metabolite-style table: log2 of the median ratio, median difference,
    rank-biserial, p, BH fdr within contrast."""
    t = _sta6(spark, sf)
    return t.select(
        "contrast", "feature", rnd(F.col("log2fc")).alias("log2fc"), rnd(F.col("median_diff")).alias("median_diff"),
        rnd(F.col("rank_biserial")).alias("rank_biserial"), rnd(F.col("p")).alias("p"), rnd(F.col("fdr")).alias("fdr"),
    )


@register(
    "agg9_consistency_score",
    with_fixtures(
        """SELECT feature, CAST(sum(CASE WHEN fdr < 0.05 THEN sign(log2fc) ELSE 0 END) AS BIGINT) AS score,
       round(avg(abs(log2fc)), 6) AS mean_abs_l2fc FROM f6 GROUP BY feature""",
        "fx_meta",
        "fx_b",
        extra=_STA6_SQL,
    ),
)
def agg9_consistency_score(spark, sf):
    """(#contrasts significantly up) - (#significantly down) and the mean
    absolute effect over all contrasts; sorted desc, desc."""
    t = _sta6(spark, sf)
    return (
        t.groupBy("feature")
        .agg(
            F.sum(F.when(F.col("fdr") < 0.05, F.signum("log2fc")).otherwise(0.0)).cast("bigint").alias("score"),
            rnd(F.avg(F.abs("log2fc"))).alias("mean_abs_l2fc"),
        )
        .orderBy(F.col("score").desc(), F.col("mean_abs_l2fc").desc())
    )


@register(
    "win1_average_ranks",
    with_fixtures(
        """SELECT sample_id, feature, rank() OVER (PARTITION BY feature ORDER BY round(value, 9))
       + (count(*) OVER (PARTITION BY feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS rank FROM fx_b""",
        "fx_meta",
        "fx_b",
    ),
)
def win1_average_ranks(spark, sf):
    """Average-tie ranks per feature (skew-safe bucketed ranking)."""
    return ranked(fx.b_long(spark, sf)).select("sample_id", "feature", "rank")


@register(
    "agg5_group_median_mean",
    with_fixtures(
        """SELECT grp, feature, round(median(value), 6) AS median, round(avg(value), 6) AS mean
FROM fx_b JOIN fx_meta USING (sample_id) GROUP BY grp, feature""",
        "fx_meta",
        "fx_b",
    ),
)
def agg5_group_median_mean(spark, sf):
    b = fx.b_long(spark, sf).join(fx.meta(spark, sf).select("sample_id", "grp"), "sample_id")
    b = cut_lineage(b)  # read for the ranks and for the means
    med = exact_quantiles(b, ["grp", "feature"], "value", {"median": 0.5})
    mean = b.groupBy("grp", "feature").agg(F.avg("value").alias("mean"))
    return mean.join(med, ["grp", "feature"]).select("grp", "feature", rnd(F.col("median")).alias("median"), rnd(F.col("mean")).alias("mean"))


@register(
    "agg7_null_tolerant_stats",
    with_fixtures(
        """SELECT center, round(avg(bmi), 6) AS mean, round(median(bmi), 6) AS median, round(stddev_pop(bmi), 6) AS std_pop,
       round(avg(CASE WHEN bmi IS NULL THEN NULL WHEN bmi > 30 THEN 1.0 ELSE 0.0 END), 6) AS frac_above_30
FROM fx_meta GROUP BY center""",
        "fx_meta",
    ),
)
def agg7_null_tolerant_stats(spark, sf):
    """nan-mean / nan-median / population std / share above a threshold."""
    b = F.col("bmi")
    m = fx.meta(spark, sf)
    med = exact_quantiles(m, ["center"], "bmi", {"median": 0.5})  # a group of nulls has no row here
    stats = m.groupBy("center").agg(
        rnd(F.avg(b)).alias("mean"), rnd(F.stddev_pop(b)).alias("std_pop"), rnd(F.avg((b > 30).cast("double"))).alias("frac_above_30")
    )
    return stats.join(med, "center", "left").select("center", "mean", rnd(F.col("median")).alias("median"), "std_pop", "frac_above_30")


# ---- cross-table associations ------------------------------------------------------------
def _common(spark, sf):
    """(CLR of A, B) in long form over complete samples; each modality is read once."""
    a, b = cut_lineage(fx.a_vectors(spark, sf)), cut_lineage(fx.b_vectors(spark, sf))
    both = a.join(b.select("sample_id"), "sample_id", "left_semi").withColumn("p", C.closure(F.col("vec")))
    both = both.withColumn("_e", C.halfmin_pseudocount(both, "p")).withColumn("clr", C.clr_replace(F.col("p"), F.col("_e")))
    clr = both.select("sample_id", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("clr").alias("value"))))
    other = b.join(a.select("sample_id"), "sample_id", "left_semi")
    return clr, other.select("sample_id", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("vec").alias("value"))))


_SP_SQL = (
    "ca AS (SELECT * FROM fx_a WHERE sample_id IN (SELECT sample_id FROM fx_b)),"
    + CLOSE_CLR_HALFMIN.format(src="ca")
    + """,
ra AS (SELECT sample_id, feature AS feature_a, rank() OVER (PARTITION BY feature ORDER BY round(clr, 9))
          + (count(*) OVER (PARTITION BY feature, round(clr, 9)) - 1) / CAST(2 AS DOUBLE) AS ra FROM clr),
rb AS (SELECT sample_id, feature AS feature_b, rank() OVER (PARTITION BY feature ORDER BY round(value, 9))
          + (count(*) OVER (PARTITION BY feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS rb
       FROM fx_b WHERE sample_id IN (SELECT sample_id FROM fx_a)),
sp AS (SELECT feature_a, feature_b, count(*) AS n, corr(ra, rb) AS rho FROM ra JOIN rb USING (sample_id) GROUP BY feature_a, feature_b)"""
)


def _spearman(spark, sf):
    return spearman_pairs(*_common(spark, sf), aligned=True)


@register(
    "sta10_spearman_rho",
    with_fixtures("SELECT feature_a, feature_b, n, round(rho, 6) AS rho FROM sp", "fx_meta", "fx_a", "fx_b", extra=_SP_SQL),
)
def sta10_spearman_rho(spark, sf):
    """Spearman rho for every A (CLR) x B feature pair over complete samples."""
    return _spearman(spark, sf).select("feature_a", "feature_b", "n", rnd(F.col("rho")).alias("rho"))


def _spearman_tested(spark, sf):
    s = _spearman(spark, sf).withColumn("p", t_two_sided_p(F.col("rho"), F.col("n")))
    return bh_fdr(s, [], "p", tiebreak=["feature_a", "feature_b"], long=True).withColumn("abs_rho", F.abs("rho"))


_TESTED_SQL = _SP_SQL + f""",
spp AS (SELECT *, {t_p_sql("rho", "n")} AS p FROM sp),
spt AS ({bh_sql("(SELECT *, 1 AS _all FROM spp)", "_all", "p", "feature_a, feature_b")})"""


@register(
    "sta10_spearman_tested",
    with_fixtures(
        "SELECT feature_a, feature_b, n, round(rho, 6) AS rho, round(p, 6) AS p, round(fdr, 6) AS fdr, round(abs(rho), 6) AS abs_rho FROM spt",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_TESTED_SQL,
    ),
)
def sta10_spearman_tested(spark, sf):
    """rho, t-approximation p (n - 2 df, pandas UDF on the small pair table),
    BH over all pairs, |rho|."""
    return _spearman_tested(spark, sf).select(
        "feature_a", "feature_b", "n", rnd(F.col("rho")).alias("rho"), rnd(F.col("p")).alias("p"), rnd(F.col("fdr")).alias("fdr"), rnd(F.col("abs_rho")).alias("abs_rho")
    )


@register(
    "agg10_hub_counts",
    with_fixtures(
        """SELECT feature, links, side FROM (
  SELECT *, row_number() OVER (PARTITION BY side ORDER BY links DESC, feature) AS r FROM (
    SELECT feature_a AS feature, count(*) AS links, 'a' AS side FROM spt WHERE fdr < 0.05 GROUP BY feature_a
    UNION ALL SELECT feature_b, count(*), 'b' FROM spt WHERE fdr < 0.05 GROUP BY feature_b) u) q WHERE r <= 10""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_TESTED_SQL,
    ),
)
def agg10_hub_counts(spark, sf):
    """Significant links per feature on both sides, top 10 each (name tie-break)."""
    s = _spearman_tested(spark, sf).filter(F.col("fdr") < 0.05)
    a = s.groupBy(F.col("feature_a").alias("feature")).agg(F.count(F.lit(1)).alias("links")).withColumn("side", F.lit("a"))
    b = s.groupBy(F.col("feature_b").alias("feature")).agg(F.count(F.lit(1)).alias("links")).withColumn("side", F.lit("b"))
    from pyspark.sql import Window

    w = Window.partitionBy("side").orderBy(F.col("links").desc(), "feature")
    return a.unionByName(b).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 10).drop("r")


@register(
    "agg11_threshold_profile",
    with_fixtures(
        """SELECT count(*) AS n_pairs, count_if(fdr < 0.05) AS n_sig, count_if(abs(rho) > 0.3) AS n_gt_03, count_if(abs(rho) > 0.4) AS n_gt_04,
       count_if(abs(rho) > 0.5) AS n_gt_05, round(max(abs(rho)), 6) AS max_abs_rho FROM spt""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_TESTED_SQL,
    ),
)
def agg11_threshold_profile(spark, sf):
    """n pairs, n significant, n with |rho| above 0.3 / 0.4 / 0.5, max |rho|."""
    s = _spearman_tested(spark, sf)
    a = F.col("abs_rho")
    return s.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("fdr") < 0.05).alias("n_sig"),
        F.count_if(a > 0.3).alias("n_gt_03"), F.count_if(a > 0.4).alias("n_gt_04"), F.count_if(a > 0.5).alias("n_gt_05"),
        rnd(F.max(a)).alias("max_abs_rho"),
    )


_RESID_SQL = """cv AS (SELECT sample_id, CAST(age AS DOUBLE) AS x1, CAST(gender AS DOUBLE) AS x2 FROM fx_meta WHERE age IS NOT NULL AND gender IS NOT NULL),
{name}_j AS (SELECT s.sample_id, s.feature, s.value, cv.x1, cv.x2 FROM {src} s JOIN cv USING (sample_id)),
{name}_s AS (SELECT feature, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12,
             sum(x2 * x2) AS s22, sum(value) AS sy, sum(x1 * value) AS s1y, sum(x2 * value) AS s2y FROM {name}_j GROUP BY feature),
{name}_d AS (SELECT *, n * (s11 * s22 - s12 * s12) - s1 * (s1 * s22 - s12 * s2) + s2 * (s1 * s12 - s11 * s2) AS det FROM {name}_s),
{name}_b AS (SELECT feature,
   (sy * (s11 * s22 - s12 * s12) - s1 * (s1y * s22 - s12 * s2y) + s2 * (s1y * s12 - s11 * s2y)) / det AS b0,
   (n * (s1y * s22 - s12 * s2y) - sy * (s1 * s22 - s12 * s2) + s2 * (s1 * s2y - s1y * s2)) / det AS b1,
   (n * (s11 * s2y - s1y * s12) - s1 * (s1 * s2y - s1y * s2) + sy * (s1 * s12 - s11 * s2)) / det AS b2 FROM {name}_d),
{name}_r AS (SELECT sample_id, feature, value - b0 - b1 * x1 - b2 * x2 AS value FROM {name}_j JOIN {name}_b USING (feature))"""


@register(
    "sta11_partial_spearman",
    with_fixtures(
        """SELECT feature_a, feature_b, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM
(SELECT sample_id, feature AS feature_a, rank() OVER (PARTITION BY feature ORDER BY round(value, 9))
        + (count(*) OVER (PARTITION BY feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS ra FROM ga_r) x
JOIN (SELECT sample_id, feature AS feature_b, rank() OVER (PARTITION BY feature ORDER BY round(value, 9))
        + (count(*) OVER (PARTITION BY feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS rb FROM gb_r) y USING (sample_id)
GROUP BY feature_a, feature_b""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_SP_SQL
        + ",\nclr_l AS (SELECT sample_id, feature, clr AS value FROM clr),\nb_l AS (SELECT * FROM fx_b WHERE sample_id IN (SELECT sample_id FROM fx_a)),\n"
        + _RESID_SQL.format(name="ga", src="clr_l")
        + ",\n"
        + _RESID_SQL.format(name="gb", src="b_l").replace("cv AS (SELECT sample_id, CAST(age AS DOUBLE) AS x1, CAST(gender AS DOUBLE) AS x2 FROM fx_meta WHERE age IS NOT NULL AND gender IS NOT NULL),\n", ""),
    ),
)
def sta11_partial_spearman(spark, sf):
    """Residualise every feature on [1, age, gender] (complete covariates,
    closed-form OLS per feature), then Spearman of the residuals."""
    meta = fx.meta(spark, sf)
    a, b = _common(spark, sf)
    s = spearman_pairs(residualize(a, meta, "age", "gender"), residualize(b, meta, "age", "gender"), aligned=True)
    return s.select("feature_a", "feature_b", "n", rnd(F.col("rho")).alias("rho"))


@register(
    "sta12_spearman_of_scores",
    with_fixtures(
        """SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (
  SELECT rank() OVER (ORDER BY round(ml, 9)) + (count(*) OVER (PARTITION BY round(ml, 9)) - 1) / CAST(2 AS DOUBLE) AS ra,
         rank() OVER (ORDER BY round(mg, 9)) + (count(*) OVER (PARTITION BY round(mg, 9)) - 1) / CAST(2 AS DOUBLE) AS rb
  FROM (SELECT g.feature, l.m AS ml, g.m AS mg FROM
        (SELECT feature, avg(value) AS m FROM fx_a GROUP BY feature) g JOIN
        (SELECT feature, avg(value) AS m FROM fx_a JOIN fx_meta USING (sample_id) WHERE center = 'AMERICA' GROUP BY feature) l
        USING (feature)) q) r""",
        "fx_meta",
        "fx_a",
    ),
)
def sta12_spearman_of_scores(spark, sf):
    """Spearman between two per-feature result columns (sub-cohort vs whole)."""
    a = fx.a_long(spark, sf)
    g = a.groupBy("feature").agg(F.avg("value").alias("value"))
    loc = a.join(fx.meta(spark, sf).filter(F.col("center") == "AMERICA").select("sample_id"), "sample_id").groupBy("feature").agg(
        F.avg("value").alias("value")
    )
    one = F.lit("all")
    rg = ranked(g.withColumn("sample_id", F.col("feature")).withColumn("feature", one)).select(F.col("sample_id").alias("f"), F.col("rank").alias("rb"))
    rl = ranked(loc.withColumn("sample_id", F.col("feature")).withColumn("feature", one)).select(F.col("sample_id").alias("f"), F.col("rank").alias("ra"))
    return rl.join(rg, "f").agg(F.count(F.lit(1)).alias("n"), rnd(correlated("ra", "rb")).alias("rho"))


@register(
    "sta13_binned_mutual_information",
    with_fixtures(
        """SELECT feature_a, feature_b, round(sum(CAST(nab AS DOUBLE) / n * ln(CAST(nab AS DOUBLE) * n / (CAST(na AS DOUBLE) * nb))), 6) AS mi FROM (
  SELECT *, sum(nab) OVER (PARTITION BY feature_a, feature_b) AS n,
            sum(nab) OVER (PARTITION BY feature_a, feature_b, bin_a) AS na,
            sum(nab) OVER (PARTITION BY feature_a, feature_b, bin_b) AS nb FROM (
    SELECT feature_a, feature_b, bin_a, bin_b, count(*) AS nab FROM
      (SELECT sample_id, feature AS feature_a, CAST(least(3, floor((rk - 1) * 4 / nf)) AS BIGINT) AS bin_a FROM
         (SELECT *, rank() OVER (PARTITION BY feature ORDER BY round(clr, 9)) + (count(*) OVER (PARTITION BY feature, round(clr, 9)) - 1) / CAST(2 AS DOUBLE) AS rk,
                 count(*) OVER (PARTITION BY feature) AS nf FROM clr) q) x
      JOIN
      (SELECT sample_id, feature AS feature_b, CAST(least(3, floor((rk - 1) * 4 / nf)) AS BIGINT) AS bin_b FROM
         (SELECT *, rank() OVER (PARTITION BY feature ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS rk,
                 count(*) OVER (PARTITION BY feature) AS nf FROM fx_b WHERE sample_id IN (SELECT sample_id FROM fx_a)) q) y
      USING (sample_id) GROUP BY feature_a, feature_b, bin_a, bin_b) j) k
GROUP BY feature_a, feature_b""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_SP_SQL,
    ),
)
def sta13_binned_mutual_information(spark, sf):
    """Mutual information of 4 equal-frequency bins per feature (a binned
    estimator replacing the reference's nearest-neighbour one)."""
    mi = binned_mutual_information(*_common(spark, sf), bins=4)
    return mi.select("feature_a", "feature_b", rnd(F.col("mi")).alias("mi"))


@register(
    "sta13_within_table",
    with_fixtures(
        """SELECT feature_a, feature_b, CASE WHEN feature_a <> feature_b THEN
  round(sum(CAST(nab AS DOUBLE) / n * ln(CAST(nab AS DOUBLE) * n / (CAST(na AS DOUBLE) * nb))), 6) END AS mi FROM (
  SELECT *, sum(nab) OVER (PARTITION BY feature_a, feature_b) AS n,
            sum(nab) OVER (PARTITION BY feature_a, feature_b, bin_a) AS na,
            sum(nab) OVER (PARTITION BY feature_a, feature_b, bin_b) AS nb FROM (
    SELECT x.feature AS feature_a, y.feature AS feature_b, x.bin AS bin_a, y.bin AS bin_b, count(*) AS nab FROM bn x JOIN bn y USING (sample_id)
    GROUP BY x.feature, y.feature, x.bin, y.bin) j) k
GROUP BY feature_a, feature_b""",
        "fx_meta",
        "fx_b",
        extra="""bn AS (SELECT sample_id, feature, CAST(least(3, floor((rk - 1) * 4 / nf)) AS BIGINT) AS bin FROM
  (SELECT *, rank() OVER (PARTITION BY feature ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS rk,
          count(*) OVER (PARTITION BY feature) AS nf FROM fx_b) q)""",
    ),
)
def sta13_within_table(spark, sf):
    """Mutual information between the features of one table, diagonal nulled."""
    b = fx.b_long(spark, sf)
    mi = binned_mutual_information(b, b, bins=4)
    return mi.select("feature_a", "feature_b", F.when(F.col("feature_a") != F.col("feature_b"), rnd(F.col("mi"))).alias("mi"))


@register(
    "sta14_box_stats",
    with_fixtures(
        """SELECT grp, quantile_cont(age, 0.0) AS q0, quantile_cont(age, 0.25) AS q25, quantile_cont(age, 0.5) AS q50,
       quantile_cont(age, 0.75) AS q75, quantile_cont(age, 1.0) AS q100 FROM fx_meta WHERE age IS NOT NULL GROUP BY grp""",
        "fx_meta",
    ),
)
def sta14_box_stats(spark, sf):
    """Box statistics of age per group (exact, linear interpolation)."""
    m = fx.meta(spark, sf).filter(F.col("age").isNotNull())
    return exact_quantiles(m, ["grp"], "age", {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})
