"""Missingness on cells that are null, zero and absent in different places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import missing as M
from tessera.plans.q_profiling import prevalent

CELLS = [
    (1, "f", 1.0), (1, "g", None),  # partly null
    (2, "f", None), (2, "g", None),  # all null
    (3, "f", 0.0), (3, "g", 0.0),  # a true zero row
    (4, "f", 2.0), (4, "g", 3.0),
]  # sample 5 has no row


def tables(spark):
    long = spark.createDataFrame(CELLS, "sample_id long, feature string, value double")
    return spark.createDataFrame([(i,) for i in range(1, 6)], "sample_id long"), long


def test_presence_is_any_value(spark):
    samples, long = tables(spark)
    got = {r["sample_id"]: r["a"] for r in M.presence(samples, long, "a").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    both = M.presence_table(samples, {"a": long, "b": long.filter("feature = 'g'")})
    assert {r["sample_id"]: r["complete"] for r in both.collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_nulls_per_feature_and_row(spark):
    samples, long = tables(spark)
    got = [tuple(r) for r in M.nulls_per_feature(samples, long).collect()]
    assert got == [("g", 3, 60.0), ("f", 2, 40.0)]
    rows = M.nulls_per_row(samples, long, 2)
    assert {r["sample_id"]: r["n_missing"] for r in rows.collect()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 2}
    s = M.row_missing_summary(rows).first()
    assert (s["mean"], s["min"], s["q25"], s["q50"], s["q75"], s["max"]) == (1.0, 0, 0.0, 1.0, 2.0, 2)


def test_dropna_flavours_differ(spark):
    m = spark.createDataFrame([(1, 30, None), (2, None, None), (3, 40, 1.0)], "sample_id long, age int, bmi double")
    cols = ["age", "bmi"]
    assert {r["sample_id"] for r in m.dropna(how="all", subset=cols).collect()} == {1, 3}
    assert {r["sample_id"] for r in M.meta_complete(m, cols).filter("meta_complete").collect()} == {3}
    by = {r["g"]: (r["null_age"], r["null_bmi"]) for r in M.nulls_in_columns_by_group(m.withColumn("g", F.col("sample_id") > 2), "g", cols).collect()}
    assert by == {False: (1, 2), True: (0, 0)}


def test_groups_drop_the_null_group(spark):
    samples, long = tables(spark)
    meta = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (5, "y")], "sample_id long, grp string")
    flags = M.presence_table(samples, {"a": long})
    got = {r["grp"]: (r["n"], r["full_a"], r["missing_a"]) for r in M.completeness_by_group(flags, meta, "grp", ["a"]).collect()}
    assert got == {"x": (2, 1, 1), "y": (2, 1, 1)}


def test_prevalence_is_inclusive(spark):
    long = spark.createDataFrame([("f", 1.0)] + [("f", 0.0)] * 9 + [("g", 0.0)] * 10, "feature string, value double")
    assert [r["feature"] for r in prevalent(long).collect()] == ["f"]
    assert prevalent(long, 0.11).count() == 0


def test_exact_quantiles_match_linear_interpolation(spark):
    import numpy as np

    from tessera.operators.ranking import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {"a": [0.0] * 30 + rng.random(31).round(2).tolist(), "b": [5.0], "c": rng.normal(size=40).tolist(), "d": [1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    got = {r["k"]: [r[n] for n in qs] for r in exact_quantiles(df, ["k"], "v", qs, buckets=4).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, list(qs.values())))
    one = exact_quantiles(df.filter("k = 'c'"), [], "v", {"m": 0.5}).first()
    assert np.isclose(one["m"], np.median(groups["c"]))
