"""Structured Streaming: running missingness by category over event-time
tumbling windows (STR2), and arriving samples scored as they are or once their
second modality has not come (STR1).

Streams read parquet files as they land and write files in append mode: a
window is emitted once the watermark has passed its end and its state is then
dropped.  Query state and outputs live under the shared checkpoint folder, so a
restarted driver resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def missingness_stream(events: DataFrame, time_col: str, category: str, columns: list[str], window: str, watermark: str) -> DataFrame:
    """Streaming (or batch) plan: per tumbling window and category, row count
    and null count of each column.  Rows later than the watermark are dropped."""
    # watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session time zone is UTC
    w = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, watermark)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(c).isNull()).alias(f"n_null_{c}") for c in columns]
    return w.groupBy(F.window(time_col, window).alias("w"), F.col(category)).agg(*aggs).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), category, *[a for a in ["n"] + [f"n_null_{c}" for c in columns]]
    )


def lone_samples(a: DataFrame, b: DataFrame, key: str = "sample_id", time: str = "ts", wait: str = "1 hour") -> DataFrame:
    """Rows of stream ``a`` whose sample does not arrive in stream ``b`` within ``wait``
    before or after: the samples that lack the second modality.

    Either stream may deliver a sample again (a repeated file): the first delivery
    within ``wait`` counts.  A row is let go once the watermarks say that no
    partner can come any more, so state is bounded by what arrives in that time;
    rows later than the watermark are dropped.
    """
    stamped = lambda d: d.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, wait)
    once = lambda d: stamped(d).dropDuplicatesWithinWatermark([key]) if d.isStreaming else stamped(d).dropDuplicates([key])
    left = once(a)
    right = once(b.select(key, time)).select(F.col(key).alias("_of"), F.col(time).alias("_at"))
    near = F.expr(f"{key} = _of AND _at >= {time} - INTERVAL {wait} AND _at <= {time} + INTERVAL {wait}")
    return left.join(right, near, "leftOuter").filter(F.col("_of").isNull()).drop("_of", "_at")


def run_to_files(spark: SparkSession, plan: DataFrame, name: str) -> DataFrame:
    """Drive a streaming plan over all input there is (``availableNow``), append
    its rows to files, and return them."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    q = (
        plan.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(plan.schema).parquet(f"{folder}/out")
