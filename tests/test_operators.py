"""Property tests of the operators against brute force on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.mathfn import chi2_sf, erfc
from tessera.operators import compose as C
from tessera.operators.ranking import bh_fdr, tie_ranks


def _avg_ranks(values):
    return pd.Series(values).rank(method="average").to_numpy()


def test_tie_ranks_match_brute_force_with_hot_value(spark):
    rng = random.Random(1)
    rows = []
    for k in ("a", "b"):
        vals = [0.0] * 40 + [round(rng.random(), 2) for _ in range(80)]  # a third of rows share one value
        rows += [(k, v) for v in vals]
    df = spark.createDataFrame(rows, "k string, v double")
    got = tie_ranks(df, ["k"], "v", buckets=4).toPandas()
    for k in ("a", "b"):
        vals = [v for kk, v in rows if kk == k]
        expect = dict(zip(vals, _avg_ranks(vals)))
        sub = got[got.k == k]
        assert len(sub) == len(set(vals))
        for _, r in sub.iterrows():
            assert r["rank"] == pytest.approx(expect[r["v"]])
            assert r["t"] == vals.count(r["v"])


def test_bh_matches_definition(spark):
    ps = [0.001, 0.02, 0.02, 0.04, 0.3, 0.9, 0.049]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "fam string, i int, p double")
    got = bh_fdr(df, ["fam"], "p", tiebreak=["i"]).orderBy("i").toPandas()["fdr"].to_numpy()
    m = len(ps)
    order = np.argsort(ps, kind="stable")
    q = np.empty(m)
    prev = 1.0
    for rank in range(m, 0, -1):
        idx = order[rank - 1]
        prev = min(prev, ps[idx] * m / rank)
        q[idx] = prev
    assert np.allclose(got, q)
    assert all(g >= p for g, p in zip(got, ps))


def test_clr_rows_sum_to_zero_and_inverse_recovers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0, 0.0, 1.0, 1.0])], "id int, v array<double>")
    out = df.select(
        C.clr_additive(C.closure(F.col("v"))).alias("c"),
        C.inverse_clr(C.clr_additive(C.closure(F.col("v")), 0.0)).alias("back"),
        C.closure(F.col("v")).alias("p"),
        C.clr_multiplicative(F.col("v")).alias("m"),
    ).collect()
    for r in out:
        assert abs(sum(r["c"])) < 1e-9
        assert abs(sum(r["m"])) < 1e-9
    back0, p0 = out[0]["back"], out[0]["p"]
    assert np.allclose(back0, p0)


def test_erfc_and_chi2(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 5.0, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(erfc(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=2e-7)
    df2 = spark.createDataFrame([(3.0, 2), (3.0, 4), (3.0, 1), (10.0, 3)], "x double, k int")
    got2 = [r[0] for r in df2.select(chi2_sf(F.col("x"), F.col("k"))).collect()]
    h = 1.5
    assert got2[0] == pytest.approx(math.exp(-h))
    assert got2[1] == pytest.approx(math.exp(-h) * (1 + h))
    assert got2[2] == pytest.approx(math.erfc(math.sqrt(h)), rel=1e-6)
    # df = 3: erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2)
    assert got2[3] == pytest.approx(math.erfc(math.sqrt(5.0)) + math.sqrt(20 / math.pi) * math.exp(-5.0), rel=1e-6)


def test_mann_whitney_u_identity(spark):
    from tessera.operators.stats import mann_whitney

    rng = random.Random(3)
    rows = [("f", rng.choice([1.0, 2.0, 3.0, rng.random()]), i < 30) for i in range(70)]
    df = spark.createDataFrame(rows, "k string, v double, case boolean")
    r = mann_whitney(df, ["k"], "v", F.col("case"), buckets=3).collect()[0]
    a = [v for _, v, c in rows if c]
    b = [v for _, v, c in rows if not c]
    u_brute = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u"] == pytest.approx(u_brute)
    assert 0.0 <= r["p"] <= 1.0
    assert r["rank_biserial"] == pytest.approx(2 * u_brute / (len(a) * len(b)) - 1)


def test_ordinal_by_hash_is_row_number(spark):
    from tessera.functions.draws import md5_key, ordinal_by_hash

    df = spark.range(300).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("g"))
    got = ordinal_by_hash(df.withColumn("h", md5_key(7, "sample_id")), ["g"], "h", "o", digits=1).toPandas()
    for g, sub in got.groupby("g"):
        expect = sub.sort_values("h")["sample_id"].tolist()
        assert sub.sort_values("o")["sample_id"].tolist() == expect
        assert sorted(sub["o"]) == list(range(1, len(sub) + 1))


def test_kfold_disjoint_cover(spark):
    from tessera.operators.splits import stratified_kfold

    df = spark.range(103).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 3, "tiny").otherwise((F.col("id") % 4).cast("string")).alias("stratum"))
    folds = stratified_kfold(df, "stratum", 5, 42).toPandas()
    val = folds[folds.role == "val"]
    assert val.sample_id.is_unique
    assert set(val.sample_id) == set(range(3, 103))
    assert not set(val.sample_id) & {0, 1, 2}
    with pytest.raises(ValueError):
        stratified_kfold(df, "stratum", 1, 42)


def test_blocked_pairs_and_permanova_identity(spark):
    from tessera.operators.distance import blocked_pairs, distance_pairs
    from tessera.operators.permutation import permanova_vectors

    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 3))
    labels = [str(i % 3) for i in range(37)]
    df = spark.createDataFrame([(i, x[i].tolist(), labels[i]) for i in range(37)], "sample_id long, vec array<double>, grp string")
    pairs = blocked_pairs(df, blocks=4).select("i", "j").toPandas()
    assert len(pairs) == 37 * 36 // 2
    assert (pairs.i < pairs.j).all() and not pairs.duplicated().any()
    d = distance_pairs(df, "euclidean", blocks=4).toPandas()
    n = 37
    sst = (d.d ** 2).sum() / n
    lab = dict(enumerate(labels))
    ssw = 0.0
    for g in set(labels):
        ng = labels.count(g)
        ssw += (d[[lab[i] == g and lab[j] == g for i, j in zip(d.i, d.j)]].d ** 2).sum() / ng
    r = permanova_vectors(df.select("sample_id", "vec"), df.select("sample_id", "grp"), permutations=19, seed=1).collect()[0]
    assert r["sst"] == pytest.approx(sst)
    assert r["ssw"] == pytest.approx(ssw)
    f = ((sst - ssw) / 2) / (ssw / (n - 3))
    assert r["f"] == pytest.approx(f, rel=1e-6)
    assert 0 < r["p"] <= 1


def test_t_pvalue_against_normal_limit(spark):
    from tessera.operators.correlate import betainc

    # I_x(a, b) with b = 1/2: compare with direct numeric integration
    a, b, x = np.array([3.0]), np.array([0.5]), np.array([0.4])
    grid = np.linspace(0, 0.4, 200001)
    dens = grid ** (a[0] - 1) * (1 - grid) ** (b[0] - 1)
    integral = np.trapezoid(dens, grid)
    beta = math.gamma(a[0]) * math.gamma(b[0]) / math.gamma(a[0] + b[0])
    assert betainc(a, b, x)[0] == pytest.approx(integral / beta, rel=1e-5)


def test_components_and_walk_steps_are_edges(spark):
    from tessera.operators.graph import connected_components, random_walks

    edges = spark.createDataFrame(
        [("a", "b", 1.0), ("b", "c", 2.0), ("x", "y", 1.0)], "src string, dst string, weight double"
    )
    comp = {r["node_id"]: r["component"] for r in connected_components(edges).collect()}
    assert comp["a"] == comp["b"] == comp["c"] == "a"
    assert comp["x"] == comp["y"] == "x"
    walks = random_walks(edges, num_walks=3, walk_length=4, seed=5).toPandas().sort_values(["walk_id", "step"])
    und = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x")}
    for _, w in walks.groupby("walk_id"):
        nodes = w.node.tolist()
        assert len(nodes) == 4
        assert all((u, v) in und for u, v in zip(nodes, nodes[1:]))


def test_no_cartesian_product_in_pair_plans(spark):
    from tessera.operators.distance import distance_pairs

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "sample_id long, vec array<double>")
    plan = distance_pairs(df, "euclidean")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
