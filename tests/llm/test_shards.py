"""Language-model training on shards that don't depend on the table's layout."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pseudolm


def made(spark, n=400):
    rng = random.Random(5)
    pairs = [("salt", "pepper"), ("night", "day"), ("left", "right"), ("hot", "cold")]
    rows = [(i, " ".join(f"{a} and {b}" for a, b in rng.choices(pairs, k=rng.randrange(1, 40)))) for i in range(n)]
    rows += [(1000 + i, "one text that many documents hold " * 3) for i in range(n // 2)]
    rows += [(None, "without an id"), (None, None), (5000, ""), (5001, "salt and pepper"), (5001, "salt and pepper")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def trained(docs, shard_words=2000):
    words = pseudolm.vocabulary(docs, size=256)
    return words, pseudolm.train(docs, words, shard_words=shard_words)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = made(spark)
    few, many = docs.coalesce(1).orderBy("doc_id").coalesce(4), docs.repartition(32)
    words, net = trained(few)
    again, other = trained(many)
    assert np.array_equal(words.hashes, again.hashes) and np.array_equal(words.counts, again.counts)
    for name in pseudolm.Net.NAMES:
        assert np.allclose(getattr(net, name), getattr(other, name), atol=1e-5), name
    a, b = (
        sorted((str(r.doc_id), r.text or "", r.lm.log_likelihood) for r in pseudolm.with_score(d, w, n).collect())
        for d, w, n in ((few, words, net), (many, again, other))
    )
    assert len(a) == len(b) == 605
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-4, atol=1e-3)


def test_shards_hold_every_word_and_split_copies(spark):
    docs = made(spark)
    words = pseudolm.vocabulary(docs, size=256)
    rows, shards = pseudolm.dealt(docs, words, 1000)
    got = rows.groupBy("shard").agg(F.sum(F.length("numbers")).alias("bytes"), F.count("*").alias("n")).collect()
    assert shards == -(-int(words.counts.sum()) // 1000) and shards > 10
    assert sum(r["bytes"] for r in got) == 2 * words.counts.sum()
    # the copies of one text are a quarter of all rows; no shard holds many of them
    copies = rows.groupBy("numbers").count().orderBy(F.desc("count")).first()["numbers"]
    per = [r["count"] for r in rows.filter(F.col("numbers") == F.lit(copies)).groupBy("shard").count().collect()]
    assert sum(per) >= 200 and max(per) < 60


def test_positions_over_several_shards(spark):
    docs, seen, averaged = made(spark, 60), [], pseudolm._averaged

    def spy(parts, partitions):
        seen.append((partitions, sum(r["n"] for r in parts.filter("slice = 0").select("n").collect())))
        return averaged(parts, partitions)

    words = pseudolm.vocabulary(docs, size=256)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pseudolm, "_averaged", spy)
        pseudolm.train(docs, words, rounds=3, shard_words=500)
    assert len(seen) == 3 and seen[0][0] > 3
    assert sum(n for _, n in seen) == words.counts.sum()


def test_columns_named_as_the_helpers_stay(spark):
    docs = made(spark, 20)
    odd = docs.select("doc_id", "text", *[F.lit(f"{c}!").alias(c) for c in ("_lm", "_lm_row", "_own", "own", "row", "log", "h", "shard", "numbers")])
    words = pseudolm.vocabulary(odd, size=128)
    got = pseudolm.with_score(odd, words, pseudolm.train(odd, words))
    assert got.columns == [*odd.columns, "lm"]
    assert got.filter("_lm = '_lm!' and row = 'row!' and log = 'log!' and own = 'own!'").count() == odd.count()


def test_texts_without_an_id_column(spark):
    docs = made(spark, 20).select("text")
    words = pseudolm.vocabulary(docs, size=128)
    got = pseudolm.with_score(docs, words, pseudolm.train(docs, words))
    assert got.count() == docs.count() and got.filter("text is null and lm.n_words = 0 and lm.log_likelihood = 0").count() == 1
