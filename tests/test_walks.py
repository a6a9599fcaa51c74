"""Walks by guide tables and rejection: slices, hubs, and step frequencies against exact probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.mathfn import chi2_sf
from tessera.operators import embeddings as E
from tessera.operators import graph as G


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def small_graph(spark):
    rng = np.random.default_rng(2)
    names = [f"n::{i}" for i in range(7)]
    rows = [(a, b, rng.integers(1, 6)) for k, a in enumerate(names) for b in names[:k] if rng.random() < 0.6]
    return edges_of(spark, rows + [("n::0", "n::6", 40), ("n::3", "n::5", 0.01)])


def test_guide_slots_hold_every_slice(spark):
    edges = small_graph(spark)
    trans = {(r.src, r.dst): (r.lo, r.hi) for r in G.transition_table(edges).collect()}
    guide = G.guide_table(edges).collect()
    slots = {r.dst: r.dst_slots for r in guide}
    for r in guide:
        assert trans[r.src, r.dst] == (r.lo, r.hi)
        assert r.lo < (r.slot + 1) / slots[r.src] and r.hi > r.slot / slots[r.src]
    for s, count in slots.items():
        mine = sorted(v for (a, _), v in trans.items() if a == s)
        assert mine[0][0] == 0.0 and mine[-1][1] == 1.0 and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
        assert sum(r.src == s for r in guide) <= len(mine) + count and len(mine) <= count < 2 * len(mine)


def pooled(seen, probs):
    """Chi-square of counts by (before, here) against ``probs``, cells that expect under five left out."""
    total, chi, df = {}, 0.0, 0
    for (a, b, _), n in seen.items():
        total[a, b] = total.get((a, b), 0) + n
    for key, n in total.items():
        cells = [(seen.get(t, 0), n * w) for t, w in probs.items() if t[:2] == key and n * w >= 5]
        if len(cells) > 1:
            chi += sum((o - e) ** 2 / e for o, e in cells)
            df += len(cells) - 1
    return chi, df


@pytest.mark.parametrize(("p", "q"), [(1.0, 1.0), (0.5, 2.0), (4.0, 0.25)])
def test_step_frequencies(spark, p, q):
    """Counts of (before, here, next) against the exact probabilities, chi-square at 1e-4."""
    edges = small_graph(spark).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    walks = G.random_walks(edges, 400, 6, 11, p, q).toPandas().sort_values(["walk_id", "step"])
    nodes = walks.groupby("walk_id").node.apply(list)
    probs = {(r.prev, r.cur, r.nxt): r.prob for r in G.second_order_probabilities(edges, p, q).collect()}
    seen = {}
    for w in nodes:
        for t in zip(w, w[1:], w[2:]):
            seen[t] = seen.get(t, 0) + 1
    assert set(seen) <= set(probs)
    chi, df = pooled(seen, probs)
    assert chi2_sf_value(spark, chi, df) > 1e-4
    first = {}
    for w in nodes:
        first[w[0], w[1]] = first.get((w[0], w[1]), 0) + 1
    trans = {(None, r.src, r.dst): r.hi - r.lo for r in G.transition_table(edges).collect()}
    chi, df = pooled({(None, *k): v for k, v in first.items()}, trans)
    assert chi2_sf_value(spark, chi, df) > 1e-4


def chi2_sf_value(spark, chi, df):
    return spark.range(1).select(chi2_sf(F.lit(float(chi)), F.lit(int(df))).alias("p")).first().p


def test_walks_do_not_depend_on_partitions(spark):
    edges = small_graph(spark)
    a = {tuple(r) for r in G.random_walks(edges.repartition(1), 5, 5, 3, 0.5, 2.0).collect()}
    b = {tuple(r) for r in G.random_walks(edges.repartition(7), 5, 5, 3, 0.5, 2.0).collect()}
    assert a == b and len(a) == 7 * 5 * 5


def test_hub_of_many_neighbours(spark):
    """100,000 neighbours: second-order walks from every node go on to the end, and no triple table is planned."""
    n = 100_000
    edges = spark.range(n).select(F.lit("n::hub").alias("src"), F.concat(F.lit("n::"), "id").alias("dst"), (F.col("id") % 9 + 1).cast("double").alias("weight"))
    walks = G.random_walks(edges, 1, 4, 5, 0.5, 2.0)
    got = walks.groupBy("step").agg(F.count("*").alias("n"), F.sum((F.col("node") == "n::hub").cast("int")).alias("hub")).collect()
    assert {r.step: r.n for r in got} == {k: n + 1 for k in range(4)}
    assert {r.step: r.hub for r in got} == {0: 1, 1: n, 2: 1, 3: n}


@pytest.mark.parametrize("partitions", [1, 2, 4])
def test_skip_gram_in_several_tasks(spark, partitions):
    rows = [(f"{s}::{i}", f"{s}::{j}", 1.0) for s in "ab" for i in range(6) for j in range(i)]
    df = edges_of(spark, rows)
    v = E.skip_gram(G.random_walks(df, 20, 10, 3), G.graph_nodes(df), 8, iterations=5, partitions=partitions).toPandas()
    x = {r["node_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for _, r in v.iterrows()}
    own = np.mean([x[a] @ x[b] for a in x for b in x if a != b and a[0] == b[0]])
    other = np.mean([x[a] @ x[b] for a in x for b in x if a[0] != b[0]])
    assert len(x) == 12 and own > other + 0.1
