"""Checkpoint selection over training histories (WIN3-6) and prediction
scoring (MOD3, EVL1-3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators.scan import running
from tessera.operators.splits import random_split
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.sources import fixtures as fx
from tessera.sources.tables import table

MIN_EPOCHS, PATIENCE = 10, 20


def _hist(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").cast("double").alias("val_mse"))


_SCORED_SQL = """scored AS (
  SELECT run, epoch, metric, score FROM (
    SELECT run, epoch, 'val_mse' AS metric, -val_mse AS score FROM fx_hist
    UNION ALL SELECT run, epoch, 'per_feature_r', CASE WHEN epoch % 7 = 0 THEN NULL WHEN epoch % 11 = 0 THEN 'nan'::DOUBLE ELSE sin(epoch) END FROM fx_hist
    UNION ALL SELECT run, epoch, 'mantel', CASE WHEN epoch % 5 = 0 THEN cos(epoch) END FROM fx_hist) u
  WHERE score IS NOT NULL AND NOT isnan(score))"""


def best_checkpoint(history, metric: str):
    """(run, best_epoch, best_score): the first epoch that reaches the run's
    highest score.  Scores are -val_mse, mantel or per_feature_r; a null or NaN
    score never improves on anything, so a run of only such has no row."""
    score = -F.col("val_mse") if metric == "val_mse" else F.col(metric)
    known = history.select("run", "epoch", score.alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return known.groupBy("run").agg(
        F.min_by("epoch", F.struct(-F.col("score"), F.col("epoch"))).alias("best_epoch"), F.max("score").alias("best_score")
    )


@register(
    "win3_best_checkpoint",
    with_fixtures(
        """SELECT s.metric, s.run, min(s.epoch) AS best_epoch, round(b.score, 6) AS best_score
FROM scored s JOIN (SELECT metric, run, max(score) AS score FROM scored GROUP BY metric, run) b
  ON s.metric = b.metric AND s.run = b.run AND s.score = b.score
GROUP BY s.metric, s.run, b.score""",
        "fx_hist",
        extra=_SCORED_SQL,
    ),
)
def win3_best_checkpoint(spark, sf):
    """Best epoch per run for each selection metric; the stand-in history has
    null and NaN scores in it."""
    e = F.col("epoch")
    h = _hist(spark, sf).withColumns(
        {
            "per_feature_r": F.when(e % 7 == 0, F.lit(None)).when(e % 11 == 0, F.lit(float("nan"))).otherwise(F.sin(e.cast("double"))),
            "mantel": F.when(e % 5 == 0, F.cos(e.cast("double"))),
        }
    )
    out = None
    for metric in ("val_mse", "per_feature_r", "mantel"):
        best = best_checkpoint(h, metric).select(F.lit(metric).alias("metric"), "run", "best_epoch", rnd(F.col("best_score")).alias("best_score"))
        out = best if out is None else out.unionByName(best)
    return out


@register(
    "win4_early_stop",
    with_fixtures(
        f"""SELECT run, min(epoch) AS stop_epoch FROM (
  SELECT *, max(CASE WHEN improved THEN pos END) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
  FROM (SELECT *, coalesce(-val_mse > max(-val_mse) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
        FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS pos FROM fx_hist) a) b) c
WHERE pos >= {MIN_EPOCHS} AND pos - last_imp >= {PATIENCE} GROUP BY run""",
        "fx_hist",
    ),
)
def win4_early_stop(spark, sf):
    """First epoch (>= min_epochs) with patience epochs since the last
    improvement; runs that never stop have no row.  A run of any length is
    scanned by many tasks."""
    by_epoch = [F.col("epoch").asc()]
    h = running(_hist(spark, sf), ["run"], by_epoch, {"pos": ("sum", F.lit(1).cast("long")), "best": ("max", -F.col("val_mse"), "before")})
    h = h.withColumn("improved", F.coalesce(-F.col("val_mse") > F.col("best"), F.lit(True)))
    h = running(h, ["run"], by_epoch, {"last_imp": ("max", F.when(F.col("improved"), F.col("pos")))})
    stop = h.filter((F.col("pos") >= MIN_EPOCHS) & (F.col("pos") - F.col("last_imp") >= PATIENCE))
    return stop.groupBy("run").agg(F.min("epoch").alias("stop_epoch"))


CEILING = 0.21  # the score to beat, a parameter of the report


@register(
    "win5_peak_per_run",
    with_fixtures(
        f"""SELECT e.event_type AS run, round(m.pk, 6) AS peak, min(e.event_id) AS peak_epoch, CAST(NULL AS DOUBLE) AS std,
       round(m.pk - {CEILING}, 6) AS margin FROM events e
JOIN (SELECT event_type, max(value) AS pk FROM events GROUP BY event_type) m ON e.event_type = m.event_type AND e.value = m.pk
GROUP BY e.event_type, m.pk
UNION ALL SELECT 'ALL', round(avg(pk), 6), NULL, round(stddev_pop(pk), 6), round(avg(pk) - {CEILING}, 6)
FROM (SELECT max(value) AS pk FROM events GROUP BY event_type) q""",
        "fx_hist",
    ),
)
def win5_peak_per_run(spark, sf):
    """Peak metric per run with the epoch it occurs at (first wins) and its
    margin over a ceiling, plus mean, population std and margin over runs."""
    e = table(spark, sf, "events").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    per = e.groupBy(F.col("event_type").alias("run")).agg(
        F.max("value").alias("pk"), F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("peak_epoch")
    )
    allrow = per.agg(
        F.lit("ALL").alias("run"), rnd(F.avg("pk")).alias("peak"), F.lit(None).cast("bigint").alias("peak_epoch"),
        rnd(F.stddev_pop("pk")).alias("std"), rnd(F.avg("pk") - CEILING).alias("margin"),
    )
    runs = per.select("run", rnd(F.col("pk")).alias("peak"), "peak_epoch", F.lit(None).cast("double").alias("std"), rnd(F.col("pk") - CEILING).alias("margin"))
    return runs.unionByName(allrow)


@register(
    "win6_best_config_per_model",
    with_fixtures(
        """SELECT model, config, round(peak, 6) AS peak FROM (
  SELECT model, config, peak, row_number() OVER (PARTITION BY model ORDER BY peak DESC, config) AS r FROM
  (SELECT event_type AS model, user_id AS config, max(value) AS peak FROM events GROUP BY event_type, user_id) q) t WHERE r = 1""",
        "fx_hist",
    ),
)
def win6_best_config_per_model(spark, sf):
    """Arg-best configuration per model (first config wins ties).  The
    per-(model, config) table is aggregated before the window, so the window
    sees one row per config."""
    e = table(spark, sf, "events")
    peaks = e.groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("config")).agg(F.max("value").alias("peak"))
    w = Window.partitionBy("model").orderBy(F.col("peak").desc(), "config")
    return peaks.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1).select("model", "config", rnd(F.col("peak")).alias("peak"))


# ---- scoring ------------------------------------------------------------------------------
_PRED_SQL = """lb AS (SELECT sample_id, feature, ln(1 + value) AS y FROM fx_b),
split AS (
  SELECT sample_id, CASE WHEN rn <= CAST(ceil(0.2 * n) AS BIGINT) THEN 'val' ELSE 'train' END AS role FROM (
    SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(sample_id AS VARCHAR)))) AS rn,
           count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM fx_b) d) q),
tr AS (SELECT l.*, m.grp FROM lb l JOIN split USING (sample_id) JOIN fx_meta m USING (sample_id) WHERE role = 'train'),
va AS (SELECT l.*, m.grp FROM lb l JOIN split USING (sample_id) JOIN fx_meta m USING (sample_id) WHERE role = 'val'),
fm AS (SELECT feature, avg(y) AS mean_fill FROM tr GROUP BY feature),
gm AS (SELECT feature, grp, avg(y) AS gmean FROM tr GROUP BY feature, grp),
pr AS (SELECT v.sample_id, v.feature, v.y, g.gmean AS pred, f.mean_fill FROM va v JOIN gm g USING (feature, grp) JOIN fm f USING (feature)),
pf AS (SELECT feature, corr(y, pred) AS r, stddev_pop(y) AS sy, stddev_pop(pred) AS sp,
              CASE WHEN sum((y - my) * (y - my)) > 1e-12 THEN 1 - sum((y - pred) * (y - pred)) / sum((y - my) * (y - my)) END AS r2
       FROM (SELECT *, avg(y) OVER (PARTITION BY feature) AS my FROM pr) q GROUP BY feature)"""


def _predictions(spark, sf):
    """Stand-in predictions to score: log1p(B) predicted by the train-split
    mean of the sample's group (and the plain train mean = mean-fill)."""
    b = fx.b_long(spark, sf).select("sample_id", "feature", F.log1p("value").alias("y"))
    split = random_split(fx.b_vectors(spark, sf).select("sample_id"), 0.2, 42)
    lab = b.join(split, "sample_id").join(fx.meta(spark, sf).select("sample_id", "grp"), "sample_id")
    tr, va = lab.filter(F.col("role") == "train"), lab.filter(F.col("role") == "val")
    fill = tr.groupBy("feature").agg(F.avg("y").alias("mean_fill"))
    gmean = tr.groupBy("feature", "grp").agg(F.avg("y").alias("pred"))
    return va.join(gmean, ["feature", "grp"]).join(fill, "feature").select("sample_id", "feature", "y", "pred", "mean_fill")


@register(
    "mod3_mean_fill",
    with_fixtures("SELECT v.sample_id, v.feature, round(f.mean_fill, 6) AS pred FROM va v JOIN fm f USING (feature)", "fx_meta", "fx_b", extra=_PRED_SQL),
)
def mod3_mean_fill(spark, sf):
    """Train column mean repeated for every validation sample."""
    p = _predictions(spark, sf)
    return p.select("sample_id", "feature", rnd(F.col("mean_fill")).alias("pred"))


def _per_feature(spark, sf):
    return _per_feature_of(_predictions(spark, sf))


def _per_feature_of(p):
    """(feature, r, sy, sp, r2) of predictions (feature, y, pred)."""
    my = p.groupBy("feature").agg(F.avg("y").alias("my"))
    q = p.join(my, "feature")
    return q.groupBy("feature").agg(
        F.try_divide(F.covar_pop("y", "pred"), F.stddev_pop("y") * F.stddev_pop("pred")).alias("r"), F.stddev_pop("y").alias("sy"), F.stddev_pop("pred").alias("sp"),
        F.sum((F.col("y") - F.col("pred")) ** 2).alias("ss_res"), F.sum((F.col("y") - F.col("my")) ** 2).alias("ss_tot"),
    ).withColumn("r2", F.when(F.col("ss_tot") > 1e-12, F.lit(1.0) - F.col("ss_res") / F.col("ss_tot")))


@register(
    "evl1_per_feature_pearson",
    with_fixtures(
        "SELECT round(avg(CASE WHEN sy > 1e-12 AND sp > 1e-12 THEN r END), 6) AS mean_r, count_if(sy > 1e-12 AND sp > 1e-12) AS n_features FROM pf",
        "fx_meta",
        "fx_b",
        extra=_PRED_SQL,
    ),
)
def evl1_per_feature_pearson(spark, sf):
    """Mean per-feature Pearson r; features with a (near) constant side skipped."""
    pf = _per_feature(spark, sf)
    ok = (F.col("sy") > 1e-12) & (F.col("sp") > 1e-12)
    return pf.agg(rnd(F.avg(F.when(ok, F.col("r")))).alias("mean_r"), F.count_if(ok).alias("n_features"))


_EVL2_SQL = """SELECT round(avg(rr), 6) AS mean_r, round(median(rr), 6) AS median_r,
       round(avg(CASE WHEN rr > 0.1 THEN 1.0 WHEN rr IS NOT NULL THEN 0.0 END), 6) AS share_r_gt_01,
       round(avg(CASE WHEN rr > 0.3 THEN 1.0 WHEN rr IS NOT NULL THEN 0.0 END), 6) AS share_r_gt_03, count(*) AS n_features,
       round(avg(r2), 6) AS mean_r2, round(avg(CASE WHEN r2 > 0 THEN 1.0 WHEN r2 IS NOT NULL THEN 0.0 END), 6) AS share_r2_pos
FROM (SELECT *, CASE WHEN sy > 1e-12 AND sp > 1e-12 THEN r END AS rr FROM {src}) z"""


def per_feature_stats(per_feature):
    """One row over features: r counts where neither side is constant, R2
    wherever the truth varies (so also for a constant prediction)."""
    f = per_feature.withColumn("rr", F.when((F.col("sy") > 1e-12) & (F.col("sp") > 1e-12), F.col("r")))
    r, r2 = F.col("rr"), F.col("r2")
    return f.agg(
        rnd(F.avg(r)).alias("mean_r"), rnd(F.median(r)).alias("median_r"),
        rnd(F.avg((r > 0.1).cast("double"))).alias("share_r_gt_01"), rnd(F.avg((r > 0.3).cast("double"))).alias("share_r_gt_03"),
        F.count(F.lit(1)).alias("n_features"),
        rnd(F.avg(r2)).alias("mean_r2"), rnd(F.avg((r2 > 0).cast("double"))).alias("share_r2_pos"),
    )


@register("evl2_per_feature_stats", with_fixtures(_EVL2_SQL.format(src="pf"), "fx_meta", "fx_b", extra=_PRED_SQL))
def evl2_per_feature_stats(spark, sf):
    return per_feature_stats(_per_feature(spark, sf))


@register(
    "evl2_constant_prediction",
    with_fixtures(
        _EVL2_SQL.format(
            src="""(SELECT feature, corr(y, mean_fill) AS r, stddev_pop(y) AS sy, stddev_pop(mean_fill) AS sp,
  CASE WHEN sum((y - my) * (y - my)) > 1e-12 THEN 1 - sum((y - mean_fill) * (y - mean_fill)) / sum((y - my) * (y - my)) END AS r2
  FROM (SELECT *, avg(y) OVER (PARTITION BY feature) AS my FROM pr) q GROUP BY feature)"""
        ),
        "fx_meta",
        "fx_b",
        extra=_PRED_SQL,
    ),
)
def evl2_constant_prediction(spark, sf):
    """The same figures for mean-fill: no r, but an R2 per feature."""
    p = _predictions(spark, sf).drop("pred").withColumnRenamed("mean_fill", "pred")
    return per_feature_stats(_per_feature_of(p))


@register(
    "evl3_mse_vs_mean_fill",
    with_fixtures(
        """SELECT round(avg((pred - y) * (pred - y)), 6) AS mse_model, round(avg((mean_fill - y) * (mean_fill - y)), 6) AS mse_mean_fill,
       avg((pred - y) * (pred - y)) < avg((mean_fill - y) * (mean_fill - y)) AS beats_mean_fill FROM pr""",
        "fx_meta",
        "fx_b",
        extra=_PRED_SQL,
    ),
)
def evl3_mse_vs_mean_fill(spark, sf):
    p = _predictions(spark, sf)
    m = F.avg((F.col("pred") - F.col("y")) ** 2)
    f = F.avg((F.col("mean_fill") - F.col("y")) ** 2)
    return p.agg(rnd(m).alias("mse_model"), rnd(f).alias("mse_mean_fill"), (m < f).alias("beats_mean_fill"))
