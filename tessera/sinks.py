"""Writers (SNK1-5): imputed tables, reviewable mappings and edges, graphs,
embedding datasets per configuration, aligned embeddings with a status sidecar."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scan import numbered
from tessera.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_wide(vectors: DataFrame, path: str, key: str = "sample_id", fmt: str = "csv") -> bool:
    """(key, features, vec) rows -> a wide table, one row per key under the
    original feature names.  Nothing is written, and False returned, when there
    are no rows."""
    head = vectors.select("features").first()
    if head is None:
        return False
    cols = [F.get("vec", F.lit(i)).alias(f) for i, f in enumerate(head["features"])]
    wide = vectors.select(key, *cols)
    (wide.write.option("header", True).csv(path) if fmt == "csv" else wide.write.parquet(path))
    return True


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Mapping and edge tables (or a graph's nodes and edges), one dataset each."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(f"{folder}/{name}") if fmt == "csv" else w.parquet(f"{folder}/{name}"))


def write_embeddings(vectors: DataFrame, folder: str, version: str, p: float, q: float, d: int, length: int, num_walks: int) -> str:
    """One self-describing dataset per configuration: (node_id, node_type, row_no,
    vector), partitioned by the hyperparameters; row_no is the vocabulary."""
    # the vocabulary is numbered by node id, by many tasks
    numbers = numbered(vectors, [], [F.col("node_id").asc()], "row_no").withColumn("row_no", F.col("row_no") - 1)
    keys = {"version": version, "p": p, "q": q, "d": d, "l": length, "num_walks": num_walks}
    out = numbers.withColumns({k: F.lit(v) for k, v in keys.items()})
    out.write.mode("append").partitionBy(*keys).parquet(folder)
    return folder


def write_aligned(aligned: DataFrame, folder: str) -> DataFrame:
    """Aligned vectors and their status sidecar; returns counts by status."""
    aligned.select("feature", "embedding").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    aligned.select("feature", "status").write.mode("overwrite").option("header", True).csv(f"{folder}/status")
    return aligned.sparkSession.read.option("header", True).csv(f"{folder}/status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
