"""Pairs, distances and what is added up from them at sizes where copies and pairs would be too many."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import distance as D
from tessera.operators import ordination as O


def vectors_of(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "sample_id long, vec array<double>")


def fail(*a, **k):
    raise AssertionError("forms pairs")


def test_blocks_of_pairs_follow_the_tasks_not_the_rows(spark):
    rows = spark.range(40_000).select(F.col("id").alias("sample_id"), F.array(F.col("id").cast("double")).alias("vec"))
    plan = D.blocked_pairs(rows)._jdf.queryExecution().optimizedPlan().toString()
    blocks = {int(n) for n in re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plan)}
    most = int(np.ceil(np.sqrt(32 * spark.sparkContext.defaultParallelism)))
    assert len(blocks) == 1 and 8 <= blocks.pop() <= most
    assert D.blocked_pairs(rows.limit(700)).select("i", "j").distinct().count() == 700 * 699 // 2


def test_cells_copy_a_row_once_a_group(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL_ROWS", 4)
    monkeypatch.setattr(D, "LEAST_ROWS", 4)
    x = np.random.default_rng(0).random((300, 2))
    pairs = D.distance_pairs(vectors_of(spark, x)).cache()
    up = np.triu_indices(300, 1)
    want = np.linalg.norm(x[up[0]] - x[up[1]], axis=1)
    got = pairs.orderBy("i", "j").toPandas()
    assert (got.i.to_numpy() == up[0]).all() and (got.j.to_numpy() == up[1]).all() and np.allclose(got.d, want, atol=1e-12)
    # 75 blocks, but a block goes to one task for each group of them
    few = int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))
    assert pairs.rdd.getNumPartitions() == few * (few + 1) // 2


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_products_keep_small_distances(shift):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 8)) + shift
    x[60:65] = x[5]
    x[65:] = x[5] + 1e-7
    size = np.full(70, 8)
    d = np.vstack([d for _, d, _ in D.strips((x, size), (x, size), "euclidean")])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(d - want).max() < 1e-9 and (d[60:65, 5] == 0).all()


def test_products_are_used_for_whole_vectors_only():
    x = np.random.default_rng(2).random((6, 3))
    assert D._products((x, np.full(6, 3)), (x, np.full(6, 3))) is not None
    assert D._products((x, np.full(6, 3)), (x, np.array([3, 3, 2, 3, 3, 3]))) is None
    x[0, 0] = np.inf
    assert D._products((x, np.full(6, 3)), (x, np.full(6, 3))) is None


def test_braycurtis_group_means_form_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((60, 4)).round(1) + 0.1
    x /= x.sum(1)[:, None]
    rows = [None if i % 13 == 5 else v for i, v in enumerate(x)]
    lab = spark.createDataFrame([(i, None if i % 11 == 0 else "abc"[i % 3]) for i in range(59)] + [(59, "z")], "sample_id long, grp string")
    dist = D.Distances(vectors_of(spark, rows), "braycurtis")
    want = {r[:2]: r[2:] for r in map(tuple, D._group_sums(dist, lab, "sample_id", "grp").collect())}
    monkeypatch.setattr(D, "on_cells", fail)
    monkeypatch.setattr(D, "SORTED_VALUES", 16)
    got = {r[:2]: r[2:] for r in map(tuple, D.group_mean_distances(dist, lab).filter("n_pairs > 0").collect())}
    assert got.keys() == want.keys()
    for k, (mean, n) in want.items():
        assert got[k] == (pytest.approx(mean, abs=1e-12), n)


def test_braycurtis_of_other_vectors_is_not_sorted(spark):
    lab = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "sample_id long, grp string")
    for x in ([[1, 2], [3, 4], [5, 6]], [[0, 0], [0, 0], [0, 0]], [[2, -1], [1, 0], [0, 1]]):
        assert D._sorted_group_sums(D.Distances(vectors_of(spark, x), "braycurtis"), lab, "sample_id", "grp") is None
    twice = vectors_of(spark, [[0.5, 0.5]]).union(vectors_of(spark, [[0.5, 0.5]]))
    assert D._sorted_group_sums(D.Distances(twice, "braycurtis"), lab, "sample_id", "grp") is None


def test_euclidean_coordinates_form_no_pairs(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(40, 5)) + 3
    v = vectors_of(spark, x)
    want, share = O._pcoa_cells(D.Distances(v), v.select("sample_id"), 2, 60, 1e-10, "sample_id")
    monkeypatch.setattr(O, "on_cells", fail)
    got, own = O.pcoa(D.Distances(v), v.select("sample_id"))
    matrix = lambda t: np.abs(np.array([r.axes for r in t.orderBy("sample_id").collect()]))
    assert np.allclose(matrix(got), matrix(want), atol=1e-8) and np.allclose(own, share)
    odd = vectors_of(spark, [*x[:5], None])
    assert O._pcoa_vectors(D.Distances(odd), odd.select("sample_id"), 2, "sample_id") is None
    assert O._pcoa_vectors(D.Distances(v), v.select("sample_id").limit(7), 2, "sample_id") is None


def test_mantel_with_an_unknown_distance_is_null_however_rows_lie(spark):
    from tessera.operators.permutation import mantel_permutation

    x = np.random.default_rng(6).random((20, 3)).tolist()
    v = vectors_of(spark, [*x, None])
    d = D.distance_pairs(v).repartition(8, "i")
    row = mantel_permutation(d, d, v.select("sample_id"), 9).first()
    assert (row.n_pairs, row.r, row.p) == (210, None, None)


def test_predictions_of_rows_of_one_id_add_up(spark):
    from tessera.operators import forest as Fo

    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], [float(i % 7)]) for i in range(30)], "sample_id long, x array<double>, y array<double>")
    forests = Fo.fit_forests(rows, trees=3, share=0.5)
    one = {r.sample_id: r.pred[0] for r in Fo.predict_forests(rows, forests).collect()}
    two = {r.sample_id: r.pred[0] for r in Fo.predict_forests(rows.union(rows.limit(30)), forests).collect()}
    assert all(two[k] == pytest.approx(2 * v) for k, v in one.items()) and len(one) == len(two) == 30


def test_equal_distances_stay_equal_in_tables(spark):
    x = np.random.default_rng(7).integers(0, 3, (40, 5))
    got = D.distance_pairs(vectors_of(spark, x)).toPandas()
    assert set(got.d) <= {float(np.sqrt(float(k))) for k in range(21)}
