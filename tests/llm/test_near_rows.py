"""The near-duplicate stage keeps one row of each group of rows, whatever the doc_ids."""

import random

from test_models import docs_of

import corpus_pipeline


def test_rows_that_are_nobodys_copy_all_stay(spark):
    rng = random.Random(16)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    nulls, shared, copied = [text() for _ in range(20)], [text(), text()], text()
    rows = [(None, t) for t in nulls] + [(5, t) for t in shared]
    rows += [(7, copied), (7, copied), (None, copied), (9, copied)]
    rows += [(None, nulls[0]), (3, shared[1])]  # near copies under another id
    for parts in (1, 3):
        out = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows).repartition(parts), "").collect()
        got = sorted((r.text, r.doc_id if r.doc_id is not None else -1) for r in out)
        want = [(t, -1) for t in nulls] + [(shared[0], 5), (shared[1], 3), (copied, 7)]
        assert got == sorted(want)
