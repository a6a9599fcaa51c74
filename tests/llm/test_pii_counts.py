"""The trees of personal data learn from every candidate of every text."""

import random
from collections import Counter

import numpy as np
from test_models import docs_of

from tessera.llm import pii


def texts(rng):
    rows = [(None, " ".join(f"mail a{k}@b{k}.org or b{k} [at] b{k} [dot] org" for k in range(300))), (1, None), (1, "")]
    for i in range(2, 500):
        said = rng.choice([f"jo{i}@site{i}.org", f"host 10.2.{i % 256}.7", f"call +1 (555) 555-{1000 + i}", f"order {rng.randrange(10**12, 10**13)}"])
        rows.append((i % 400, f"some words before {said}{rng.choice(['', ' ', '.'])}and after"))
    return rows


def test_every_candidate_is_counted_and_learnt_from(spark):
    rows = texts(random.Random(3))
    docs = docs_of(spark, rows)
    got = pii.counted_candidates(docs).collect()
    want = Counter((kind, y, tuple(x)) for _, t in rows for kind, y, x in pii.labelled(t or ""))
    found = Counter()
    for r in got:
        found[r.kind, 1.0, tuple(r.x)] += r.pos
        found[r.kind, 0.0, tuple(r.x)] += r.neg
    assert +found == want and sum(n for (k, _, _), n in want.items() if k == 0) > 600  # more than 50 of the first text
    models = [pii.train(docs.repartition(n)) for n in (1, 6)]
    for kind, trees in enumerate(models[0].trees):
        own = [(r.x, r.pos, r.neg) for r in got if r.kind == kind and not r.held]
        if trees is None:
            continue
        x = np.array([x for x, pos, neg in own for _ in range(pos + neg)], float)
        y = np.array([v for _, pos, neg in own for v in [1.0] * pos + [0.0] * neg])
        alone = pii.boost(x, y)
        for other in (alone, models[1].trees[kind]):
            assert (trees.feature == other.feature).all() and (trees.split == other.split).all()
            assert np.allclose(trees.value, other.value)
        held = [(trees.log_odds(np.array([r.x], float))[0], r.pos, r.neg) for r in got if r.kind == kind and r.held]
        cut = models[0].threshold[kind]
        assert cut == models[1].threshold[kind]
        over = [(pos, pos + neg) for s, pos, neg in held if s >= cut]
        assert sum(p for p, _ in over) >= 0.995 * sum(n for _, n in over)
    assert sum(t is not None for t in models[0].trees) >= 3


def test_borders_of_counted_values_are_quantiles():
    rng = np.random.default_rng(5)
    for size in (1, 2, 31, 1000):
        x = rng.integers(0, 40, size).astype(float)
        values, n = np.unique(x, return_counts=True)
        want = np.unique(np.quantile(x, np.linspace(0, 1, pii.BINS + 1)[1:-1]))
        assert np.allclose(pii.quantiles(values, n), want)
