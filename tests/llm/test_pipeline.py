"""The pipeline against brute force, stage by stage, and whole on a small table."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from test_models import EDGE, check_sequences, docs_of
from test_native import brute_components, brute_lines, words_of

import corpus_pipeline
from tessera.llm import decontam

SF = "/root/testdata/sf0.001"


def written(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    # copies and shared lines, so that every stage has something to do
    more = docs.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 10_000)
    noted = docs.filter("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 20_000).withColumn(
        "text", F.concat("text", F.lit("\nSubscribe to our list\nfor more words of each kind, one after the other and so on"))
    )
    now = written(spark, docs.unionByName(more).unionByName(noted), tmp_path, "start")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = written(spark, stage(spark, now, SF), tmp_path, str(k))
        rows = now.collect()
        if k < 4:
            assert now.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
        if k == 0:
            assert set(after) <= {d for d, _ in before} and len(after) > 0.7 * len(before)
            assert all(after[d] == t for d, t in before if d in after)
        elif k == 1:
            want = {d: n for d, _, n, _ in brute_lines(before, 10)}
            assert {d: len(t.split("\n")) - len(after[d].split("\n")) for d, t in before if after[d]} == {
                d: n for d, n in want.items() if after[d]
            }
            assert any(want.values())
            assert all(r.n_chars == len(r.text) for r in rows if want[r.doc_id])
        elif k == 2:
            assert set(after) == {c for _, _, c in brute_components(before)}
        elif k == 3:
            bench = [t for (t,) in duckdb.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()]
            gone = {d for d, t in before} - set(after)
            held = {d for d, t in before if any(b in t for b in bench)}
            assert held <= gone
            for d, t in before:
                if d in gone - held:
                    w = decontam.words_of(t)
                    assert any(longest(decontam.words_of(b), w) >= 0.7 for b in bench)
        else:
            check_sequences(rows)
            assert {r.doc_id for r in rows} == {d for d, _ in before}
            least = math.ceil(sum(r.length for r in rows) / 1024)
            assert len({r.sequence_id for r in rows}) <= least + max(2, 0.01 * least)


def longest(item, words):
    mask = {}
    for i, w in enumerate(item):
        mask[w] = mask.get(w, 0) | 1 << i
    return decontam.common_subsequence(mask, len(item), words) / len(item)


@pytest.mark.parametrize("rows", [EDGE, EDGE[:2], []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    now = written(spark, docs_of(spark, rows).coalesce(1), tmp_path, "start")
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = written(spark, stage(spark, now, SF), tmp_path, str(k))
        if k < 4:
            assert now.columns == columns
    assert now.count() >= 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100


def test_words():
    assert words_of("a\x0bb c") == ["a", "b", "c"]
