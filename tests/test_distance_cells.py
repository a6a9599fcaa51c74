"""Distances formed by block pairs, and what adds them up without a row per pair."""

import numpy as np
import pytest
from test_numeric import vectors_of

from tessera.operators import distance as D


def both_metrics(x):
    return {
        "euclidean": np.linalg.norm(x[:, None] - x[None], axis=2),
        "braycurtis": np.abs(x[:, None] - x[None]).sum(2) / np.abs(x[:, None] + x[None]).sum(2),
    }


def test_pairs_of_odd_rows(spark):
    """Missing values, other lengths and zero sums give a null distance, repeated ids no pair of their own, null ids none."""
    rows = [(0, [1.0, 2.0]), (1, [4.0, 6.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [-1.0, -2.0]), (1, [4.0, 6.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>")
    for blocks in (1, 3):
        got = D.distance_pairs(df, "euclidean", blocks).collect()
        assert len(got) == 28 + 7 and all(r.i < r.j for r in got)
        d = {(r.i, r.j): r.d for r in got}
        assert d[0, 1] == 5.0 and d[5, 6] == 0.0
        assert all((v is None) == bool({2, 3, 4} & set(k)) for k, v in d.items())
        b = {(r.i, r.j): r.d for r in D.distance_pairs(df, "braycurtis", blocks).collect()}
        assert b[5, 6] is None and b[0, 7] is None and b[0, 1] == pytest.approx(7 / 13) and b[1, 7] == pytest.approx(13 / 7)
    plan = D.distance_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "namedlambda" not in plan


def test_pairs_of_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [3.0]), ("é", [0.0])], "k string, vec array<double>")
    for blocks in (1, 4):
        got = {(r.i, r.j): r.d for r in D.distance_pairs(df, "euclidean", blocks, "k").collect()}
        assert got == {("a", "b"): 2.0, ("a", "é"): 3.0, ("b", "é"): 1.0}


@pytest.mark.parametrize("cell", [2048, 7])
def test_group_means_without_pair_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(D, "CELL_ROWS", cell)
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(5, 1, (30, 4)))
    g = ["a"] * 12 + ["b"] * 15 + ["c"] + ["d"] * 2
    df = vectors_of(spark, x, extra=g)
    lab = df.select("sample_id", "grp")
    holes = lab.selectExpr("sample_id", "nullif(grp, 'd') as grp")
    vec = df.select("sample_id", "vec")
    for metric in D.METRICS:
        one = lambda t: {(r.g1, r.g2): (None if r.mean_d is None else round(r.mean_d, 9), r.n_pairs) for r in t.collect()}
        assert one(D.group_mean_distances(D.Distances(vec, metric), holes)) == one(D.group_mean_distances(D.distance_pairs(vec, metric), holes))
        got = one(D.group_mean_distances(D.Distances(vec, metric), lab))
        d = both_metrics(x)[metric]
        assert got["a", "a"] == (pytest.approx(d[:12, :12].sum() / 132, abs=1e-8), 66) and got["c", "c"] == (None, 0)


@pytest.mark.parametrize("cell", [2048, 6])
def test_mantel_without_pair_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(D, "CELL_ROWS", cell)
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(5, 1, (25, 3)))
    y = x + rng.normal(0, 0.3, x.shape)
    a, b = vectors_of(spark, x), vectors_of(spark, y[:-1])
    up = np.triu_indices(24, 1)
    for m1, m2 in (("euclidean", "euclidean"), ("euclidean", "braycurtis")):
        r = D.mantel(D.Distances(a, m1), D.Distances(b, m2)).first()
        want = np.corrcoef(both_metrics(x[:-1])[m1][up], both_metrics(y[:-1])[m2][up])[0, 1]
        assert (r.n_pairs, r.r) == (276, pytest.approx(want, abs=1e-12))
    rank = D.mantel(D.Distances(a), D.Distances(b), "spearman").first()
    assert rank == D.mantel(D.distance_pairs(a), D.distance_pairs(b), "spearman").first()
    flat = vectors_of(spark, np.ones((5, 2)))
    assert D.mantel(D.Distances(flat), D.Distances(a)).first().r is None
    assert D.mantel(D.Distances(a.limit(0)), D.Distances(a)).first().n_pairs == 0


def test_geometry_score_makes_no_pair_rows(spark, monkeypatch):
    from tessera.operators import ordination as O

    def none(*args, **kwargs):
        raise AssertionError("pairs are formed")

    monkeypatch.setattr(D, "distance_pairs", none)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 4))
    rows = [(i, x[i].tolist(), (x[i] * 2 + 1).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id long, truth array<double>, imputed array<double>")
    for mode in ("independent", "shared"):
        r = O.geometry_score(df, "truth", "imputed", mode).first()
        assert (r.n_pairs, r.r) == (190, pytest.approx(1.0, abs=1e-9))


@pytest.mark.parametrize("cell", [2048, 9])
def test_permanova_without_pair_rows(spark, monkeypatch, cell):
    from tessera.operators import permutation as P

    monkeypatch.setattr(D, "CELL_ROWS", cell)
    rng = np.random.default_rng(6)
    x = np.abs(np.vstack([rng.normal(4, 0.5, (14, 5)), rng.normal(4, 2, (12, 5)), rng.normal(5, 1, (3, 5))]))
    df = vectors_of(spark, x, extra=["a"] * 14 + ["b"] * 12 + [None] * 3)
    labels, vec = df.select("sample_id", "grp"), df.select("sample_id", "vec")
    a, b = (P.permanova_pairs(d, labels, 49, 5).first() for d in (D.distance_pairs(vec, "braycurtis"), D.Distances(vec, "braycurtis")))
    assert a.n == b.n == 26 and a.p == b.p and (b.sst, b.f, b.r2) == (pytest.approx(a.sst), pytest.approx(a.f), pytest.approx(a.r2))


def test_pairwise_permanova_without_pair_rows(spark):
    from tessera.operators import permutation as P

    x = np.abs(np.random.default_rng(6).normal(4, 1, (20, 3)))
    df = vectors_of(spark, x, extra=["a"] * 7 + ["b"] * 7 + ["c"] * 6)
    labels, vec = df.select("sample_id", "grp"), df.select("sample_id", "vec")
    a, b = (P.pairwise_permanova(d, labels, "c", 19, 5).orderBy("contrast").collect() for d in (D.distance_pairs(vec), D.Distances(vec)))
    assert [(r.contrast, r.n, r.p, r.fdr) for r in a] == [(r.contrast, r.n, r.p, r.fdr) for r in b]


def test_dispersion_without_pair_rows(spark, monkeypatch):
    from tessera.operators import permutation as P

    monkeypatch.setattr(P, "CELL_ROWS", 5)
    x = np.abs(np.random.default_rng(6).normal(4, 2, (16, 4)))
    df = vectors_of(spark, x, extra=["a"] * 9 + ["b"] * 7)
    vec, labels = df.select("sample_id", "vec"), df.select("sample_id", "grp")
    near = lambda d: [r.z for r in P.distances_to_medians(d, labels, tolerance=0.02).orderBy("sample_id").collect()]
    assert near(D.Distances(vec, "braycurtis")) == pytest.approx(near(D.distance_pairs(vec, "braycurtis")))


@pytest.mark.parametrize("cell", [2048, 4])
def test_gower_rows(spark, monkeypatch, cell):
    from pyspark.sql import functions as F

    from tessera.operators import ordination as O

    monkeypatch.setattr(D, "CELL_ROWS", cell)
    x = np.abs(np.random.default_rng(9).normal(4, 2, (11, 3)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (11, None)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>")
    b = O.gower(D.distance_pairs(df, "braycurtis"), df.select("sample_id"))
    want = b.groupBy("i").agg(F.sum(F.col("b") * F.col("b")).alias("s"), F.max(F.when(F.col("i") == F.col("j"), F.col("b"))).alias("d")).orderBy("i").collect()
    got = O.gower_rows(D.Distances(df, "braycurtis"), df.select("sample_id")).orderBy("i").collect()
    assert [r.i for r in got] == [r.i for r in want] == list(range(12))
    assert [r.sum_b2 for r in got] == pytest.approx([r.s for r in want]) and [r.diag for r in got] == pytest.approx([r.d for r in want])


def test_principal_coordinates_of_distances(spark, monkeypatch):
    """No row per pair; many close eigenvalues, repeated ids, missing values and a full basis as from the table."""
    from tessera.operators import ordination as O

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 30)) * np.array([4, 3] + [1] * 28)
    df = vectors_of(spark, x)
    z = x - x.mean(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    monkeypatch.setattr(D, "CELL_ROWS", 16)
    monkeypatch.setattr(O, "BASIS", 30)
    axes, explained = O.pcoa(D.Distances(df), df.select("sample_id"), rounds=60, tolerance=1e-6)
    got = np.array(axes.orderBy("sample_id").toPandas()["axes"].tolist())
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-2)
    assert np.allclose(explained, (s**2 / (s**2).sum())[:2], atol=1e-5)
    monkeypatch.undo()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x[:12, :3])] + [(3, [1.0] * 3), (None, [2.0] * 3), (50, None)]
    odd = spark.createDataFrame(rows, "sample_id long, vec array<double>")
    axes, explained = O.pcoa(D.Distances(odd), odd.select("sample_id"), rounds=100)
    # as from the table: a known cell adds to its ids' sums once a copy, each copy has a zero of its own on the diagonal
    known = [(i, np.array(v)) for i, v in rows if i is not None and v]
    ids = [*range(12), 50]
    copies = np.array([sum(i == k for i, _ in rows) for k in ids], float)
    cell, n = np.zeros((13, 13)), np.zeros((13, 13))
    for i, v in known:
        for j, w in known:
            if i != j:
                cell[i, j] -= ((v - w) ** 2).sum() / 2
                n[i, j] += 1
    m = cell.sum(1) / (n.sum(1) + copies)
    g = m.sum() / 14  # the row without an id has a mean of 0
    b = cell - n * (m[:, None] + m - g) + np.diag(copies * (g - 2 * m))
    values, vectors = np.linalg.eigh(b)
    assert np.allclose(explained, values[::-1][:2] / np.trace(b), atol=1e-6)
    got = np.array(axes.orderBy("sample_id").toPandas()["axes"].tolist())
    assert np.allclose(np.abs(got), np.abs(vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])), atol=1e-4)
