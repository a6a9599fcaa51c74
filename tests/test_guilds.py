"""Indices of feature sets against direct sums."""

import math
import random

from tessera.operators.guilds import set_contrast, set_indices

LONG = "sample_id long, feature string, value double"
SETS = "set string, feature string, weight double"


def test_indices_match_direct_sums(spark):
    rng = random.Random(3)
    long = [(i, f"f{j}", rng.choice([0.0, None, rng.random()])) for i in range(40) for j in range(12)]
    sets = [("x", "f1", 2.0), ("x", "f2", None), ("x", "f1", 2.0), ("y", "f1", -1.0), ("y", "f11", 0.5), ("none", "absent", 1.0)]
    sets += [("z", "f3", 1.0), ("z", "f3", 2.0), (None, "f4", 1.0), ("x", None, 1.0)]
    got = {(r.sample_id, r.set): r for r in set_indices(spark.createDataFrame(long, LONG), spark.createDataFrame(sets, SETS)).collect()}
    weights = {"x": {"f1": 2, "f2": 1}, "y": {"f1": -1, "f11": 0.5}, "z": {"f3": 3}, "none": {"absent": 1}}
    assert len(got) == 40 * 4
    for i in range(40):
        own = {f: v for s, f, v in long if s == i and v is not None}
        for name, w in weights.items():
            r = got[i, name]
            assert math.isclose(r.total, sum(k * own.get(f, 0) for f, k in w.items()), abs_tol=1e-12)
            assert math.isclose(r.share, sum(own.get(f, 0) for f in w) / sum(own.values()), abs_tol=1e-12)
            assert (r.n_seen, r.n_members) == (sum(own.get(f, 0) > 0 for f in w), len(w))


def test_contrast_and_empty_tables(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", 3.0), (3, "c", 0.0)], LONG)
    sets = spark.createDataFrame([("u", "a", 1.0), ("v", "b", 1.0)], SETS)
    index = set_indices(long, sets)
    got = {r.sample_id: r for r in set_contrast(index, "u", "v").collect()}
    assert math.isclose(got[1].log_ratio, math.log(0.5)) and got[2].log_ratio is None and got[3].log_ratio is None
    assert [r.share for r in index.filter("sample_id = 3").collect()] == [None, None]
    assert set_indices(long.limit(0), sets).count() == 0
    assert set_indices(long, sets.limit(0)).count() == 0
