"""Several blocks of benchmark items give what one block gives."""

import random

import numpy as np

from tessera.llm import decontam


def made(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    items = [(k if k != 7 else None, " ".join(rng.sample(words, 20))) for k in range(40)]
    items += [(500, "five words only here now"), (501, None), (502, "")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 80)))
        if i % 3 == 0:
            text += " " + items[i % 40][1] + " " + " ".join(rng.choices(words, k=10))
        if i % 30 == 0:
            text += " " + items[(i + 11) % 40][1] + " five words only here now"
        docs.append((i, text, "mine"))
    docs += [(1, docs[0][1], "mine")] * 3 + [(900, None, "mine"), (901, "", "mine"), (None, items[7][1], "mine")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, one string")
    docs = docs.withColumns({c: docs["one"] for c in ("two", "block", "had")})
    return docs, spark.createDataFrame(items, "item_id long, text string")


def found(rows):
    return sorted((str(r.doc_id), r.text or "", sorted((str(h.item_id), round(h.lcs, 9)) for h in r.hits)) for r in rows)


def test_blocks_agree_with_one(spark):
    docs, items = made(spark)
    whole = decontam.with_hits(docs, items)
    split = decontam.with_hits(docs, items, block_items=9)
    assert set(split.columns) == {*docs.columns, "hits"} == set(whole.columns)
    a, b = whole.collect(), split.collect()
    assert found(a) == found(b) and sum(len(r.hits) for r in a) > 45
    assert all(r.one == r.two == r.block == r.had == "mine" and r.hits is not None for r in b)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0  # every pass is written, none is left in the plan


def test_window_sums_are_sums(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(50, 7))
    row = rng.integers(0, 50, 2000)
    for window in decontam.WINDOWS:
        step = window // 4
        some = np.sort(rng.choice((len(row) - window) // step, 40, replace=False))
        slow = np.array([values[row[k * step : k * step + window]].sum(axis=0) for k in some])
        assert np.allclose(decontam._window_sums(values, row, some, window, step), slow)


def test_more_passages_than_latent_columns(spark):
    """Long items have more passages than the rank; both ways of projecting find the same."""
    docs, items = made(spark)
    low = decontam.with_hits(docs, items, rank=12)
    got = {r.doc_id for r in low.collect() if r.hits}
    assert {i for i in range(0, 120, 3)} <= got
