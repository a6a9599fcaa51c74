"""Ridge, ordination, permutations, walks and readers against direct computations."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.mathfn import chi2_sf
from tessera.operators import embeddings as E
from tessera.operators import graph as G
from tessera.operators import naming as N
from tessera.operators import ordination as O
from tessera.operators import permutation as P
from tessera.operators import ridge as R
from tessera.operators.distance import distance_pairs, group_mean_distances, permuted_labels
from tessera.plans.q_select_eval import best_checkpoint
from tessera.sources import readers


def vectors_of(spark, x, name="vec", extra=None):
    rows = [(i, [float(v) for v in r], *([extra[i]] if extra is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"sample_id long, {name} array<double>" + (", grp string" if extra is not None else "")).repartition(3)


def test_chi_square_tail_at_large_degrees(spark):
    def tail(x, df):  # Simpson's rule on the density, from x upwards
        f = lambda t: math.exp((df / 2 - 1) * math.log(t) - t / 2 - (df / 2) * math.log(2) - math.lgamma(df / 2))
        t = np.linspace(x, x + 40 * math.sqrt(2 * df) + 200, 200_001)
        y = np.array([f(v) for v in t])
        return float((t[1] - t[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))

    cases = [(200.0, 200), (100.0, 100), (3.0, 1), (12.5, 3), (250.0, 201), (5.0, 2), (900.0, 1001)]
    df = spark.createDataFrame(cases, "x double, df int")
    for r in df.select("x", "df", chi2_sf(F.col("x"), F.col("df")).alias("p")).collect():
        assert r["p"] == pytest.approx(tail(r["x"], r["df"]), rel=1e-5, abs=2e-7)
    assert chi2_of(spark, 200.0, 200) == pytest.approx(0.48670, abs=1e-4)


def chi2_of(spark, x, df):
    return spark.range(1).select(chi2_sf(F.lit(x), F.lit(df)).alias("p")).first()["p"]


def test_components_of_long_paths(spark):
    edges = [(f"a::{i:04d}", f"a::{i + 1:04d}") for i in range(200)] + [("b::2", "b::1"), ("b::2", "b::2")]
    df = spark.createDataFrame([(u, v, 1.0, "t") for u, v in edges], "src string, dst string, weight double, edge_type string")
    got = {r["node_id"]: r["component"] for r in G.connected_components(df).collect()}
    assert got == {**{f"a::{i:04d}": "a::0000" for i in range(201)}, "b::1": "b::1", "b::2": "b::1"}
    flags = {r["node_id"]: r["island"] for r in G.islands(df).collect()}
    assert flags["b::1"] and not flags["a::0100"]


def test_null_scores_never_win(spark):
    rows = [("r", 1, None, None), ("r", 2, 0.5, float("nan")), ("r", 3, 0.4, -0.2), ("r", 4, 0.4, -0.2), ("s", 1, None, None)]
    h = spark.createDataFrame(rows, "run string, epoch int, val_mse double, per_feature_r double")
    assert [tuple(r) for r in best_checkpoint(h, "val_mse").collect()] == [("r", 3, -0.4)]
    assert [tuple(r) for r in best_checkpoint(h, "per_feature_r").collect()] == [("r", 3, -0.2)]


def dense_ridge(x, y, alphas):
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z, yc, n = (x - mean) / scale, y - y.mean(0), len(x)
    out = []
    for t in range(y.shape[1]):
        best = None
        for a in alphas:
            hat = np.full((n, n), 1.0 / n) + z @ np.linalg.solve(z.T @ z + a * np.eye(z.shape[1]), z.T)
            loo = (((y[:, t] - hat @ y[:, t]) / (1 - np.diag(hat))) ** 2).sum()
            if best is None or loo < best[0] - 1e-9:
                best = (loo, a)
        out.append((best[1], np.linalg.solve(z.T @ z + best[1] * np.eye(z.shape[1]), z.T @ yc[:, t])))
    return out


def test_ridge_matches_a_dense_solve(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, (60, 7)) * np.array([1, 10, 0.1, 1, 1, 1, 0])  # one constant column
    y = np.column_stack([x[:, 0] + 0.1 * rng.normal(size=60), rng.normal(size=60), 5 * x[:, 1] - x[:, 2] + rng.normal(size=60)])
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, x array<double>, y array<double>").repartition(4)
    m = R.fit_ridge(df)
    for t, (alpha, coef) in enumerate(dense_ridge(x, y, R.ALPHAS)):
        assert m.alpha[t] == pytest.approx(alpha)
        assert np.allclose(m.coef[:, t], coef, atol=1e-8)
    pred = R.predict(df, m).orderBy("sample_id").toPandas()
    assert np.allclose(np.array(pred["pred"].tolist()), m.predict(x))
    s = R.score(R.predict(df, m)).orderBy("j").toPandas()
    assert np.allclose(s["r"], [np.corrcoef(y[:, t], m.predict(x)[:, t])[0, 1] for t in range(3)])
    with pytest.raises(ValueError):
        R.fit_ridge(df.limit(0))


def test_pca_and_pcoa(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 3, 1, 0.5, 0.3, 0.1])
    df = vectors_of(spark, x)
    p = O.fit_pca(df, 2, standardise=False)
    z = x - x.mean(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(p.axes), np.abs(vt[:2].T), atol=1e-8)
    assert np.allclose(p.explained, (s**2 / (s**2).sum())[:2])
    assert (p.axes[np.abs(p.axes).argmax(0), [0, 1]] > 0).all()
    axes, explained = O.pcoa(distance_pairs(df), df.select("sample_id"), rounds=100)
    got = np.array(axes.orderBy("sample_id").toPandas()["axes"].tolist())
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-4)
    assert np.allclose(explained, (s**2 / (s**2).sum())[:2], atol=1e-6)
    assert O.fit_pca(df.limit(1), 5).axes.shape[1] == 1


def shuffled(spark, labels, n_perm, seed):
    rows = permuted_labels(labels, n_perm, seed).collect()
    out = {}
    for r in rows:
        out.setdefault(r["perm"], {})[r["sample_id"]] = r["grp"]
    return out


def plain_f(d, g):
    n, groups = len(g), sorted(set(g))
    sst = sum(d[i, j] ** 2 for i in range(n) for j in range(i)) / n
    ssw = sum(sum(d[i, j] ** 2 for i in range(n) for j in range(i) if g[i] == g[j] == k) / g.count(k) for k in groups)
    return ((sst - ssw) / (len(groups) - 1)) / (ssw / (n - len(groups)))


def test_permanova_of_vectors_and_pairs(spark):
    rng = np.random.default_rng(3)
    g = ["a"] * 8 + ["b"] * 7 + ["c"] * 9
    x = rng.normal(1000, 1, (24, 4)) + np.array([[k == "a"] * 4 for k in g]) * 0.8
    df = vectors_of(spark, x, extra=g)
    labels = df.select("sample_id", "grp")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    perms = shuffled(spark, labels, 99, 5)
    want = plain_f(d, g)
    stars = [plain_f(d, [perms[k][i] for i in range(24)]) for k in range(1, 100)]
    p = (1 + sum(round(f, 9) >= round(want, 9) for f in stars)) / 100
    pairs = distance_pairs(df)
    for r in (P.permanova_vectors(df.select("sample_id", "vec"), labels, 99, 5).first(), P.permanova_pairs(pairs, labels, 99, 5).first()):
        assert r["f"] == pytest.approx(want, rel=1e-6) and r["p"] == pytest.approx(p) and r["n"] == 24
    pw = P.pairwise_permanova(pairs, labels, "c", 49, 5).orderBy("contrast").toPandas()
    keep = [i for i in range(24) if g[i] in "ac"]
    assert pw["contrast"].tolist() == ["a", "b"]
    assert pw["f"][0] == pytest.approx(plain_f(d[np.ix_(keep, keep)], [g[i] for i in keep]), rel=1e-6)


def test_spatial_medians_and_dispersion(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(5, 3, (30, 3))])
    g = ["a"] * 30 + ["b"] * 30
    df = vectors_of(spark, x, extra=g)
    med = P.group_medians(df, "grp")
    for k, rows in (("a", x[:30]), ("b", x[30:])):
        at = np.linalg.norm(rows - med[k], axis=1).sum()
        for _ in range(50):
            assert np.linalg.norm(rows - (med[k] + rng.normal(0, 0.05, 3)), axis=1).sum() >= at - 1e-6
    r = P.permdisp_median(df.select("sample_id", "vec"), df.select("sample_id", "grp"), 99, 5).first()
    z = [np.linalg.norm(x[i] - med[g[i]]) for i in range(60)]
    za, zb = np.array(z[:30]), np.array(z[30:])
    between = 30 * ((za.mean() - np.mean(z)) ** 2 + (zb.mean() - np.mean(z)) ** 2)
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    assert r["f"] == pytest.approx(between / (within / 58), rel=1e-6)
    assert r["p"] == pytest.approx(0.01)


def test_mantel_permutation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(15, 3))
    y = x + rng.normal(0, 0.3, x.shape)
    a, b = vectors_of(spark, x), vectors_of(spark, y)
    r = P.mantel_permutation(distance_pairs(a), distance_pairs(b), a.select("sample_id"), 99, 5).first()
    iu = np.triu_indices(15, 1)
    dx, dy = (np.linalg.norm(v[:, None] - v[None], axis=2)[iu] for v in (x, y))
    assert r["n_pairs"] == 105 and r["r"] == pytest.approx(np.corrcoef(dx, dy)[0, 1], abs=1e-8) and r["p"] == pytest.approx(0.01)
    s = P.mantel_permutation(distance_pairs(a), distance_pairs(b), a.select("sample_id"), 9, 5, "spearman").first()
    rank = lambda v: np.argsort(np.argsort(v))
    assert s["r"] == pytest.approx(np.corrcoef(rank(dx), rank(dy))[0, 1], abs=1e-8)


def test_group_means_keep_single_groups(spark):
    df = vectors_of(spark, [[0.0], [1.0], [5.0]], extra=["a", "a", "b"])
    got = {(r["g1"], r["g2"]): (r["mean_d"], r["n_pairs"]) for r in group_mean_distances(distance_pairs(df), df.select("sample_id", "grp")).collect()}
    assert got == {("a", "a"): (1.0, 1), ("a", "b"): (4.5, 2), ("b", "b"): (None, 0)}


def star_graph(spark):
    rows = [("n::hub", f"n::{i:03d}", float(i + 1), "t") for i in range(40)] + [("n::000", "n::001", 2.0, "t")]
    return spark.createDataFrame(rows, "src string, dst string, weight double, edge_type string")


def test_transition_slices_touch(spark):
    t = G.transition_table(star_graph(spark)).toPandas()
    for _, d in t.groupby("src"):
        d = d.sort_values("lo")
        assert d["lo"].iloc[0] == 0.0 and d["hi"].iloc[-1] == 1.0
        assert (d["lo"].to_numpy()[1:] == d["hi"].to_numpy()[:-1]).all()


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (0.25, 4.0)])
def test_no_walk_is_lost_at_a_hub(spark, p, q):
    edges = star_graph(spark)
    walks = G.random_walks(edges, 3, 6, 7, p, q).toPandas()
    assert (walks.groupby("walk_id")["step"].nunique() == 6).all()
    linked = {(r["src"], r["dst"]) for r in G.neighbours(edges).collect()}
    for _, w in walks.sort_values("step").groupby("walk_id"):
        n = w["node"].tolist()
        assert all(x in linked for x in zip(n, n[1:]))


def test_second_order_probabilities(spark):
    probs = {(r["prev"], r["cur"], r["nxt"]): r["prob"] for r in G.second_order_probabilities(star_graph(spark), 0.5, 2.0).collect()}
    w = {("n::000", "n::hub"): 1.0}
    # from n::000 on to the hub: back to n::000 (1/p), to n::001 next to it (1), anywhere else (1/q)
    raw = {f"n::{i:03d}": (i + 1) * (2.0 if i == 0 else 1.0 if i == 1 else 0.5) for i in range(40)}
    assert w and all(probs["n::000", "n::hub", k] == pytest.approx(v / sum(raw.values())) for k, v in raw.items())


def test_skip_gram_keeps_neighbours_together(spark):
    edges = [(f"a::{i}", f"a::{j}") for i in range(6) for j in range(i)] + [(f"b::{i}", f"b::{j}") for i in range(6) for j in range(i)]
    df = spark.createDataFrame([(u, v, 1.0, "t") for u, v in edges], "src string, dst string, weight double, edge_type string")
    v = E.skip_gram(G.random_walks(df, 10, 10, 3), G.graph_nodes(df), 8, iterations=5).toPandas()
    x = {r["node_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for _, r in v.iterrows()}
    own = np.mean([x[a] @ x[b] for a in x for b in x if a != b and a[0] == b[0]])
    other = np.mean([x[a] @ x[b] for a in x for b in x if a[0] != b[0]])
    assert len(x) == 12 and own > other


def test_alignment_status_and_spread(spark):
    vec = spark.createDataFrame([(str(i), [float(i), -float(i)]) for i in range(50)], "feature string, embedding array<double>")
    features = spark.createDataFrame([(str(i),) for i in range(45, 300)], "feature string")
    got = E.align_with_status(features, vec, spark.createDataFrame([("46",)], "feature string")).toPandas().set_index("feature")
    assert got["status"].value_counts().to_dict() == {"missing": 250, "calibrated": 4, "island": 1}
    assert got.loc["47", "embedding"].tolist() == [47.0, -47.0]
    spread = np.array(got[got.status == "missing"]["embedding"].tolist()).std()
    assert spread == pytest.approx(np.std([s * i for i in (45, 47, 48, 49) for s in (1, -1)]), rel=0.15)
    with pytest.raises(ValueError, match="without a vector"):
        E.align_strict(features, vec.withColumnRenamed("feature", "node_id"), "x", 2)


def test_cached_search_and_single_hits(spark):
    syn = spark.createDataFrame([("C1", "blue dye", 1), ("C2", "red dye", 2), ("C2", "red colour", 3), ("C3", "red wine", 4)], "cid string, name string, rec_no int")
    cols = spark.createDataFrame([("SERUM_ABS_dye_blue_1",), ("SERUM_ABS_wine_1",), ("SERUM_ABS_dye_1",), ("SERUM_ABS_red_dye_2",)], "metabolome_column string")
    cache = spark.createDataFrame([("wine", "", ""), ("dye", "C9", "cached")], "query string, kegg_compound string, matched_name string")
    overrides = spark.createDataFrame([(" SERUM_ABS_red_dye_2", " C1", 1), ("SERUM_ABS_red_dye_2", "C2", 2)], "metabolome_column string, kegg_compound string, row_no int")
    got = {r[0]: (r[1], r[3], r[4]) for r in N.resolve(cols, syn, overrides, cache=cache).collect()}
    assert got["SERUM_ABS_dye_blue_1"] == ("C1", "blue dye", "kegg_rest")  # the only hit, its first name
    assert got["SERUM_ABS_wine_1"] == (None, None, "unmatched")  # a cached miss stays a miss
    assert got["SERUM_ABS_dye_1"] == ("C9", "cached", "kegg_rest")
    assert got["SERUM_ABS_red_dye_2"] == ("C2", "red dye", "manual_override")  # the last row, its synonym recovered


def test_readers_on_small_files(spark, tmp_path):
    wide = tmp_path / "wide.csv"
    wide.write_text(",f1,f 2\n1,0.5,\n2,,3\n")
    rows = {(r["sample_id"], r["feature"]): r["value"] for r in readers.read_wide_csv(spark, str(wide), "sample_id").collect()}
    assert rows == {(1, "f1"): 0.5, (1, "f 2"): None, (2, "f1"): None, (2, "f 2"): 3.0}
    lst = tmp_path / "ko.list"
    lst.write_text("ko:K1  ec:1.1\nko:K1\tec:1.1\n\nbroken\nko:K2 ec:2.2\n")
    assert {tuple(r) for r in readers.read_ko_ec(spark, str(lst)).collect()} == {("K1", "1.1"), ("K2", "2.2")}
    rec = tmp_path / "compound.txt"
    rec.write_text("ENTRY       C1   Compound\nNAME        Water;\n            H2O\nENZYME      1.1 2.2\n            3.3\nFORMULA     x\n///\nENTRY       C2   Compound\n///\n")
    got = {r["cid"]: (r["names"], r["primary_name"], r["ecs"]) for r in readers.read_compounds(spark, str(rec)).collect()}
    assert got == {"C1": (["Water", "H2O"], "Water", ["1.1", "2.2", "3.3"]), "C2": ([], "C2", [])}
    over = tmp_path / "o.csv"
    over.write_text("metabolome_column,kegg_compound\na, C1\n a,C2 \nb,\n,C3\n")
    assert [tuple(r) for r in readers.read_overrides(spark, str(over)).collect()] == [("a", "C2")]
    assert readers.read_overrides(spark, str(tmp_path / "absent.csv")).count() == 0
    with pytest.raises(ValueError, match="extension"):
        readers.read_embeddings(spark, "x.npy")
    features = spark.createDataFrame([("a",), ("b",)], "feature string")
    one = spark.createDataFrame([("a", [1.0])], "feature string, embedding array<double>")
    with pytest.raises(ValueError, match="without a vector, among them: b"):
        readers.strict_join(features, one, 1)
    with pytest.raises(ValueError, match="2 dimensions"):
        readers.strict_join(features.limit(1), one, 2)
    assert not any(r["trainable"] for r in readers.trainable_mask(features, None).collect())


def test_stream_drops_closed_windows_only_once(spark, tmp_path):
    import datetime as dt

    from tessera.streaming.windows import missingness_stream, run_to_files

    at = lambda day, h: dt.datetime(2024, 1, day, h)
    for k, rows in enumerate([[(at(1, 1), "x", 1.0), (at(1, 2), "x", None)], [(at(3, 0), "x", 1.0)], [(at(1, 3), "x", 9.0), (at(5, 0), "x", None)]]):
        spark.createDataFrame(rows, "ts timestamp, kind string, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ts timestamp, kind string, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = run_to_files(spark, missingness_stream(stream, "ts", "kind", ["v"], "1 day", "1 hour"), "late")
    got = {r["window_start"]: (r["n"], r["n_null_v"]) for r in out.collect()}
    assert got["2024-01-01 00:00:00"][1] == 1  # the late row of day 1 came after its window closed, or with it
    assert "2024-01-05 00:00:00" not in got and got["2024-01-03 00:00:00"] == (1, 0)


def test_exact_mann_whitney(spark):
    from itertools import combinations

    from tessera.operators.stats import exact_u_tail, mann_whitney

    for n1, n2 in ((3, 4), (5, 5), (1, 6), (6, 2)):
        us = [sum(c) - n1 * (n1 - 1) / 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            want = min(1.0, 2 * sum(x >= max(u, n1 * n2 - u) for x in us) / len(us))
            assert exact_u_tail(u, n1, n2) == pytest.approx(want)
    rows = [("k", float(v), v in (0, 1, 4)) for v in range(8)] + [("t", 1.0, True), ("t", 1.0, False), ("t", 2.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, c boolean")
    got = {r["k"]: (r["u"], r["p"], r["method"]) for r in mann_whitney(df, ["k"], "v", F.col("c"), method="exact").collect()}
    assert got["k"] == (2.0, pytest.approx(exact_u_tail(2.0, 3, 5)), "exact") and got["t"][1] is None
    with pytest.raises(ValueError):
        mann_whitney(df, ["k"], "v", F.col("c"), method="auto")
