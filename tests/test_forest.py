"""Forests against direct growth, with and without nodes too large for one task."""

from unittest import mock

import numpy as np
import pytest

from tessera.operators import forest as R


def frame(spark, x, y):
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, y array<double>").repartition(3)


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)), 1)
    y = np.column_stack([np.sign(x[:, 0]) * 3 + (x[:, 1] > 0.5), np.abs(x[:, 2]) + 0.1 * rng.normal(size=n), np.full(n, 2.5)])
    return x, y


def plain_tree(x, y, w):
    """Greedy squared-error growth by trying every feature and bin; ties to the first."""
    if len(set(y.tolist())) < 2:
        return float(np.average(y, weights=w))
    best = None
    base = (w * y).sum() ** 2 / w.sum()
    for f in range(x.shape[1]):
        for b in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= b
            gain = (w * y)[low].sum() ** 2 / w[low].sum() + (w * y)[~low].sum() ** 2 / w[~low].sum() - base
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, b, low)
    if best is None:
        return float(np.average(y, weights=w))
    _, f, b, low = best
    return (f, b, plain_tree(x[low], y[low], w[low]), plain_tree(x[~low], y[~low], w[~low]))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        f, b, left, right = tree
        tree = left if row[f] <= b else right
    return tree


def test_growth_against_plain_recursion():
    rng = np.random.default_rng(4)
    for _ in range(15):
        x = rng.integers(0, 6, (60, 3)).astype(np.uint8)
        y = rng.normal(size=60) + x[:, 0]
        w = rng.integers(1, 4, 60).astype(float)
        with mock.patch.object(R, "_drawn", lambda *a: np.arange(3)):  # all features, in order
            tree = R.grow(x, y, w, 3, 0, (0, 0))
        want = plain_tree(x, y, w)
        assert np.allclose(tree.value[tree.leaves(x)], [plain_value(want, r) for r in x])


def test_leaves_are_pure_and_forests_learn(spark):
    x, y = made(300)
    df = frame(spark, x, y)
    forests = R.fit_forests(df, trees=12, share=0.5, seed=3)
    assert not forests.tops and forests.table.count() == 3 * 12
    test_x, test_y = made(200, seed=9)
    got = R.predict_forests(frame(spark, test_x, test_y), forests, block=64).orderBy("sample_id").toPandas()
    pred = np.array(got["pred"].tolist())
    assert got.sample_id.tolist() == list(range(200))
    assert np.allclose(pred[:, 2], 2.5)
    for t in (0, 1):
        assert ((test_y[:, t] - pred[:, t]) ** 2).mean() < 0.35 * test_y[:, t].var()


def test_large_nodes_are_split_alike(spark):
    """Histograms over all rows make the same trees as tasks that hold whole nodes."""
    x, y = made(240)
    x = x + np.arange(240)[:, None] * 1e-4  # no two rows alike
    df = frame(spark, x, y[:, :2])
    a = R.fit_forests(df, trees=4, share=0.5, seed=5)
    b = R.fit_forests(df, trees=4, share=0.5, seed=5, node_rows=40)
    assert b.tops and b.table.count() > 8
    pa, pb = (np.array(R.predict_forests(df, f).orderBy("sample_id").toPandas()["pred"].tolist()) for f in (a, b))
    # two features of equal gain may be told apart by the last bits of a sum
    assert np.mean(np.abs(pa - pb) < 1e-9) > 0.9


def test_no_rows(spark):
    with pytest.raises(ValueError):
        R.fit_forests(frame(spark, *made(5)).limit(0))
