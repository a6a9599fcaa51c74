"""Stages keep documents' columns of any name; benchmark rows without an id are searched; sample bounds hold."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, linededup, nbsvm, packing, pii

SF = "/root/testdata/sf0.001"
NAMES = ["_doc", "_lines", "_th", "_bits", "_row1", "_row2", "_score", "_hits", "_item", "_lm", "score", "hits", "row1", "n_lines", "n_dropped", "Lines"]


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    more = docs.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000)
    shared = docs.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 6000).withColumn("text", F.concat("text", F.lit("\nShared line")))
    whole = docs.unionByName(more).unionByName(shared)
    for n in NAMES:
        whole = whole.withColumn(n, F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")))
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    whole.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, odd_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns, name
    rows = out.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)
    plain = {r.doc_id: r.text for r in stage(spark, odd_docs.drop(*NAMES), SF).collect()}
    assert {r.doc_id: r.text for r in rows} == plain


def test_packing_keeps_columns_of_any_name(spark):
    parts = spark.createDataFrame([(k, 300 + k, "i", "s", "o") for k in range(40)], "doc_id long, length long, _item string, sequence_id string, item string")
    parts = parts.toDF("doc_id", "length", "_item", "sequence_id", "item")
    out = packing.pack(parts, 1024)
    assert out.columns == ["doc_id", "length", "_item", "sequence_id", "item", "sequence_id_", "offset"]
    assert out.count() == 40 and out.filter("sequence_id <> 's'").count() == 0


def test_line_counts_take_other_names(spark, odd_docs):
    out = linededup.dedup_lines(odd_docs, counts=("all_lines", "gone"))
    assert out.columns == [*odd_docs.columns, "all_lines", "gone"] and out.filter("gone > 0").count() >= 30


def test_items_without_an_id_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    items = [" ".join(word() for _ in range(30)) for _ in range(3)]
    short = "tiny passage of four"
    bench = spark.createDataFrame([(None, items[0]), (7, items[1]), (None, items[2]), (8, None), (None, None), (None, short)], "item_id long, text string")
    filler = lambda: " ".join(word() for _ in range(50))
    docs = [(k, f"{filler()} {t} {filler()}") for k, t in enumerate([*items, f"{items[0]} {items[1]}", short, ""])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in decontam.contaminated(df, bench).collect())
    assert got == [(0, -1), (1, 7), (2, -1), (3, -1), (3, 7), (4, -1)]


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("mail a@b.org and text "), "id").alias("text"))
    found = pii.sample_candidates(docs, 1, 5)
    assert len(found) <= 20
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    again = [nbsvm.train(docs.repartition(n), labels, fit_rows=1) for n in (1, 5)]
    text = "mail a@b.org and text 7"
    assert again[0].score(text) == again[1].score(text)
