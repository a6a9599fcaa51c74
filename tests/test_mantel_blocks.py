"""Mantel's ranks and shuffles taken of block pairs, not of a row per pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import distance as D
from tessera.operators import ranking


def odd_vectors(spark, seed, n=60, copies=0):
    """Small whole numbers (many ties), some vectors unknown or of zero sum, and copies."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, 3)).astype(float)
    x[:copies] = x[0]
    x[-1] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[5] = (5, None)
    rows[7 + seed] = (7 + seed, [1.0, None, 2.0])
    return spark.createDataFrame(rows, "sample_id long, vec array<double>")


@pytest.mark.parametrize("copies", [0, 45])
def test_spearman_of_blocks_equals_that_of_rows(spark, monkeypatch, copies):
    a, b = odd_vectors(spark, 1, copies=copies), odd_vectors(spark, 2, copies=copies)
    b = b.unionByName(b.filter("sample_id = 9"))  # an id twice
    cases = [("euclidean", "euclidean"), ("braycurtis", "euclidean")]
    want = []
    for m1, m2 in cases:
        u, v = (D.distance_pairs(t.select("sample_id", "vec"), m) for t, m in ((a, m1), (b, m2)))
        want.append(D.mantel(u, v, "spearman").first())

    def none(*args, **kwargs):
        raise AssertionError("a row per pair")

    monkeypatch.setattr(ranking, "row_ranks", none)
    monkeypatch.setattr(D, "distance_pairs", none)
    monkeypatch.setattr(D, "PAIR_ROWS", 0)
    monkeypatch.setattr(D, "CELL_ROWS", 32)
    for (m1, m2), w, group, cut in zip(cases, want, (100, 400), (1024, 20)):
        monkeypatch.setattr(D, "GROUP_PAIRS", group)
        monkeypatch.setattr(D, "CUT_ROWS", cut)
        got = D.mantel(D.Distances(a, m1), D.Distances(b, m2), "spearman").first()
        assert (got.n_pairs, got.r) == (w.n_pairs, pytest.approx(w.r, abs=1e-10))


def test_spearman_of_blocks_rounds_and_knows_no_spread(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIR_ROWS", 0)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (30, 2))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, vec array<double>")
    b = spark.createDataFrame([(i, (v + rng.normal(0, 1, 2)).tolist()) for i, v in enumerate(x)], "sample_id long, vec array<double>")
    rounded = [D.distance_pairs(t).withColumn("d", F.round("d", 0)) for t in (a, b)]
    want = D.mantel(*rounded, "spearman").first()
    got = D.mantel(D.Distances(a), D.Distances(b), "spearman", 0).first()
    assert (got.n_pairs, got.r) == (435, pytest.approx(want.r, abs=1e-10))
    flat = a.select("sample_id", F.array(F.lit(1.0)).alias("vec"))
    assert tuple(D.mantel(D.Distances(flat), D.Distances(a), "spearman").first()) == (435, None)


@pytest.mark.parametrize("odd", [False, True])
def test_mantel_shuffles_of_blocks_equal_those_of_rows(spark, monkeypatch, odd):
    """Both metrics on either side, blocks of shuffles, copies, and vectors or sums that are not known."""
    from tessera.operators import permutation as P

    rng = np.random.default_rng(7)
    x = np.abs(rng.normal(5, 1, (40, 3)))
    x[10:14] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if odd:
        rows[3], rows[4], rows[5] = (3, None), (4, [0.0] * 3), (5, [0.0] * 3)
    a = spark.createDataFrame(rows, "sample_id long, vec array<double>")
    b = spark.createDataFrame([(i, (v + rng.normal(0, 1, 3)).tolist()) for i, v in enumerate(x)], "sample_id long, vec array<double>")
    ids = a.select("sample_id").localCheckpoint()
    monkeypatch.setattr(P, "BLOCK_BYTES", 1000)  # the vectors are 960 bytes, a matrix of distances is 12,800
    monkeypatch.setattr(P, "MANTEL_CELL", 16)
    metrics = [("euclidean", "braycurtis")] if odd else [("euclidean", "braycurtis"), ("braycurtis", "euclidean"), ("braycurtis", "braycurtis")]
    want = [P.mantel_permutation(*[D.distance_pairs(a if k == 0 else b, m).localCheckpoint() for k, m in enumerate(ms)], ids, 29, 5).first() for ms in metrics]

    def none(*args, **kwargs):
        raise AssertionError("a row per pair and shuffle")

    monkeypatch.setattr(P, "_mantel_joined", none)
    monkeypatch.setattr(D, "distance_pairs", none)
    for block, ms, w in zip((1 << 25, 40 * 11, 1 << 25), metrics, want):
        monkeypatch.setattr(P, "BLOCK_CODES", block)
        got = P.mantel_permutation(D.Distances(a, ms[0]), D.Distances(b, ms[1]), ids, 29, 5).first()
        assert (got.n_pairs, got.p) == (w.n_pairs, w.p) and got.r == pytest.approx(w.r, abs=2e-9)
