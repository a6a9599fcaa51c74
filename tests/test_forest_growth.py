"""Forests grow without a generator per node, and their trees are not written."""

import numpy as np
import pytest

from tessera.operators import forest as Fo


@pytest.mark.parametrize("features,share,first", [(10, 3, 1), (29, 9, 2**32 - 3), (5, 5, 2**66), (1, 1, 4)])
def test_draws_of_a_level_equal_those_of_its_nodes(features, share, first):
    nodes = [n for n in range(first, first + 6) if len(Fo._words(n)) == len(Fo._words(first))]
    words = np.array([Fo._words(n) for n in nodes], np.uint32).T
    target = np.arange(len(nodes)) % 3
    got = Fo.drawn_of_level(42, (target, 7), words, features, share)
    assert got.tolist() == [Fo._drawn(42, (int(t), 7), n, features, share).tolist() for t, n in zip(target, nodes)]


def test_children_carry_into_a_new_word():
    numbers = np.array([[2**32 - 1, 2**31], [0, 1]], np.uint32)
    got = [int(a) + (int(b) << 32) for a, b in Fo._children(numbers).T]
    assert got == [2**33 - 2, 2**33 - 1, 2**33 + 2**32, 2**33 + 2**32 + 1]


def test_growing_makes_no_generator_per_node(monkeypatch):
    rng = np.random.default_rng(3)
    x, ys = rng.integers(0, 64, (500, 6)).astype(np.uint8), rng.random((500, 2))

    def none(*a, **k):
        raise AssertionError("a generator per node")

    monkeypatch.setattr(np.random, "default_rng", none)
    trees = Fo.grow_all(x, ys, np.ones(500), 2, 42, [0, 1], 5)
    for t, tree in enumerate(trees):
        one = Fo.grow(x, ys[:, t].copy(), np.ones(500), 2, 42, (t, 5))
        assert (tree.value[tree.leaves(x)] == one.value[one.leaves(x)]).all()
        assert np.abs(tree.value[tree.leaves(x)] - ys[:, t]).max() < 1e-9


def test_large_levels_split_like_small_ones(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 64, (400, 5)).astype(np.uint8), rng.random(400)
    whole = Fo.grow(x, y, np.ones(400), 2, 42, (0, 1))
    monkeypatch.setattr(Fo, "LEVEL_CELLS", 64)
    parts = Fo.grow(x, y, np.ones(400), 2, 42, (0, 1))
    assert len(parts.feature) == len(whole.feature)
    assert np.allclose(parts.value[parts.leaves(x)], y) and (parts.feature[:7] == whole.feature[:7]).all()


def test_trees_are_not_written(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.random(3).tolist(), rng.random(2).tolist()) for i in range(60)], "sample_id long, x array<double>, y array<double>")
    cut, seen = Fo.cut_lineage, []
    monkeypatch.setattr(Fo, "cut_lineage", lambda df, *a: (seen.append(set(df.columns)), cut(df, *a))[1])
    want = None
    for bound in (Fo.NODE_ROWS, 20):
        forests = Fo.fit_forests(rows, trees=4, share=0.7, node_rows=bound)
        pred = Fo.predict_forests(rows, forests).orderBy("sample_id").collect()
        assert not any("blob" in c for c in seen)
        assert want is None or np.abs(np.array([r.pred for r in pred]) - want).max() < 0.2
        want = np.array([r.pred for r in pred])
    monkeypatch.setattr(Fo, "ROW_BYTES", 0)
    joined = Fo.predict_forests(rows, forests).orderBy("sample_id").collect()
    assert np.allclose(np.array([r.pred for r in joined]), want)
