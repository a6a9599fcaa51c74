"""Streaming operators (STR1-2) run with an ``availableNow`` trigger over the
driver's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators import compose as C
from tessera.operators import ridge as R
from tessera.operators.artifacts import load_ridge, save_ridge
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.sinks import scratch_folder
from tessera.sources import fixtures as fx
from tessera.sources.tables import table
from tessera.streaming.windows import lone_samples, missingness_stream, run_to_files


@register(
    "str2_windowed_missingness",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       count_if(value IS NULL) AS n_null_value, count_if(props IS NULL) AS n_null_props
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def str2_windowed_missingness(spark, sf):
    """Events read as a stream (file source), 1-day tumbling windows with a
    1-hour watermark, row and null counts per event type; append mode, so the
    windows that the watermark has closed."""
    schema = table(spark, sf, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    )
    plan = missingness_stream(stream, "ts", "event_type", ["value", "props"], "1 day", "1 hour")
    return run_to_files(spark, plan, "str2_missingness")


def _saved_model(spark, sf):
    """Scalers and ridge coefficients of direction A, written as an artifact."""
    from tessera.plans.q_models import _fit_predict, prepare_data

    rows, mean, scale = prepare_data(spark, sf)
    model, _ = _fit_predict(rows, "a_clr", "b")
    names = [fx.a_vectors(spark, sf).select("features").first()[0], fx.b_vectors(spark, sf).select("features").first()[0]]
    folder = scratch_folder(spark, "artifact")
    save_ridge(spark, folder, model, *names, scalers={"b_mean": mean, "b_scale": scale})
    return folder, names


def _scorer(spark, folder, names):
    """Scores arriving (sample_id, vec) rows by the artifact alone."""
    model, scalers = load_ridge(spark, folder, *names)

    def score(arriving):
        x = arriving.select("sample_id", C.clr_additive(C.closure(F.col("vec"))).alias("x"))
        raw = F.transform(R.array_unstandardise(F.col("pred"), scalers["b_mean"], scalers["b_scale"]), lambda v: F.expm1(v))
        return R.predict(x, model).select("sample_id", raw.alias("imputed"))

    return score


def _imputed_cells(out):
    return out.select("sample_id", F.posexplode("imputed").alias("target", "value")).select("sample_id", "target", rnd(F.col("value")).alias("value"))


@register("str1_stream_scoring")
def str1_stream_scoring(spark, sf):
    """Samples that lack modality B arrive as files; scalers and ridge coefficients
    loaded from their artifact impute it, one row in and one row out without state."""
    a, b = fx.a_vectors(spark, sf), fx.b_vectors(spark, sf)
    folder = scratch_folder(spark, "arriving")
    a.join(b.select("sample_id"), "sample_id", "left_anti").select("sample_id", "vec").write.parquet(folder)
    stream = spark.readStream.schema("sample_id long, vec array<double>").parquet(folder)
    score = _scorer(spark, *_saved_model(spark, sf))
    return _imputed_cells(run_to_files(spark, score(stream), "str1_scoring"))


@register(
    "str1_scored_ids",
    with_fixtures("SELECT sample_id, count(*) AS n FROM fx_meta, (SELECT DISTINCT p_type FROM part) t WHERE a_present AND NOT b_present GROUP BY sample_id", "fx_meta"),
)
def str1_scored_ids(spark, sf):
    """Which samples the stream scored, with the number of values."""
    return str1_stream_scoring(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "str1_two_streams",
    with_fixtures("SELECT sample_id, count(*) AS n FROM fx_meta, (SELECT DISTINCT p_type FROM part) t WHERE a_present AND NOT b_present GROUP BY sample_id", "fx_meta"),
)
def str1_two_streams(spark, sf):
    """Both modalities arrive as streams, every sample of A twice; the outer join
    tells which samples lack B, and only these are imputed."""
    at = lambda shift: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sample_id") % 1000 * 60 + shift)
    a = fx.a_vectors(spark, sf).select("sample_id", "vec").withColumn("ts", at(0))
    b = fx.b_vectors(spark, sf).select("sample_id").withColumn("ts", at(600))
    # a last row of both, far in the future, lets the watermarks pass all others
    end = F.timestamp_seconds(F.lit(1_800_000_000))
    stop = spark.range(1).select(F.lit(-1).cast("long").alias("sample_id"))
    folders = [scratch_folder(spark, f"stream-{m}") for m in "ab"]
    a.write.parquet(f"{folders[0]}/0")
    a.withColumn("ts", at(5)).write.parquet(f"{folders[0]}/1")
    b.write.parquet(f"{folders[1]}/0")
    stop.withColumn("vec", F.array(F.lit(0.0))).withColumn("ts", end).write.parquet(f"{folders[0]}/2")
    stop.withColumn("ts", end).write.parquet(f"{folders[1]}/2")
    read = lambda schema, f: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f)
    lone = lone_samples(read("sample_id long, vec array<double>, ts timestamp", folders[0]), read("sample_id long, ts timestamp", folders[1]), wait="24 hours")
    score = _scorer(spark, *_saved_model(spark, sf))
    out = run_to_files(spark, score(lone), "str1_two_streams")
    return out.select("sample_id", F.explode("imputed")).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
