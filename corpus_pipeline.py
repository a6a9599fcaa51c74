"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
The package ``tessera.llm`` holds the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, nbsvm, packing, simhash
from tessera.llm.common import free_names, read, scratch_folder

ORACLE_SQL = None  # a learned classifier and a genetic algorithm: tested against a brute-force version instead


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score under 0.5)."""
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "score")
    return nbsvm.with_score(docs, model, score).filter(F.col(score) >= 0.5).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that ten or more documents share; n_chars follows the text."""
    names = free_names(docs, "n_lines", "n_dropped")
    out = linededup.dedup_lines(docs, counts=tuple(names))
    n_chars = F.when(F.col(names[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep exactly one row of each near-duplicate group, one of the smallest doc_id's (a null id comes last)."""
    key = tuple(free_names(docs, "row1", "row2"))  # 128 bits of the whole row: rows that share them are copies
    keyed = docs.select("*", *[F.xxhash64(F.lit(k), *docs.columns).alias(c) for k, c in enumerate(key)])
    found = simhash.groups(keyed, shingle=3, distance=3, carry=key)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key)).alias("r"))
    kept = first.select(*[F.col(f"r.{c}").alias(c) for c in key])
    return keyed.join(kept, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    (hits,) = free_names(docs, "hits")
    found = decontam.with_hits(docs, read(spark, sf_dir, "benchmark"), hits)
    return found.filter(F.size(hits) == 0).drop(hits)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, 1024), 1024)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
