"""Samples are built once where a query reads them several times; tokens are pooled by a product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.tokens import pool_tokens
from tessera.plans import q_models as Q


def test_pooling_without_element_lambdas(spark):
    """Missing values give an unknown mean, rows of another length too; the plan holds no lambda over the matrix."""
    rng = np.random.default_rng(1)
    v, e = rng.normal(size=(3, 2)), rng.normal(size=(2, 3))
    rows = [(i, ["x", "y"], r) for i, r in enumerate([*v.tolist(), [1.0, None], None, [1.0]])]
    vectors = spark.createDataFrame(rows, "sample_id long, features array<string>, vec array<double>")
    emb = spark.createDataFrame([("y", e[1].tolist()), ("x", e[0].tolist()), ("z", [9.0] * 3)], "feature string, e array<double>")
    token = {"scale": lambda a, b: a * b, "add": lambda a, b: b + 0.5 * a, "affine": lambda a, b: b * (1 + 0.5 * a)}
    for mode, fuse in token.items():
        p = pool_tokens(vectors, emb, mode, 0.5)
        assert "zip_with" not in p._jdf.queryExecution().executedPlan().toString()
        got = {r.sample_id: r.pooled for r in p.collect()}
        assert np.allclose([got[i] for i in range(3)], [np.mean([fuse(a, b) for a, b in zip(r, e)], axis=0) for r in v])
        assert [got[i] for i in (3, 4, 5)] == [[None] * 3] * 3
    with pytest.raises(ValueError):
        pool_tokens(vectors, emb, "other")


def counted(monkeypatch, spark, n=40):
    """Own vectors of both modalities (every fifth sample lacks one) and how often each was built."""
    rng = np.random.default_rng(4)
    built = {"a": 0, "b": 0}

    def of(name, width, lack):
        rows = [(i, [f"{name}{k}" for k in range(width)], rng.uniform(1, 9, width).tolist()) for i in range(n) if i % 5 != lack]

        def make(session, sf):
            built[name] += 1
            return session.createDataFrame(rows, "sample_id long, features array<string>, vec array<double>")

        return make

    monkeypatch.setattr(Q.fx, "a_vectors", of("a", 3, 0))
    monkeypatch.setattr(Q.fx, "b_vectors", of("b", 4, 1))
    monkeypatch.setattr(Q.fx, "feature_names", lambda s, sf, c: {"p_brand": ["a0", "a1", "a2"], "p_type": ["b0", "b1", "b2", "b3"]}[c], raising=False)
    return built


def test_folds_share_the_samples(spark, monkeypatch):
    built = counted(monkeypatch, spark)
    folds = spark.createDataFrame([(f, i, "val" if i % 2 == f else "train") for f in range(2) for i in range(38)] + [(0, 2, "val")], "fold long, sample_id long, role string")
    of = Q.prepare_folds(spark, "", folds)
    for fold in range(2):
        rows, mean, _ = of(fold)
        got = rows.collect()
        known = [i for i in range(38) if i % 5 > 1]
        assert sorted((r.sample_id, r.role) for r in got) == sorted([(i, "val" if i % 2 == fold else "train") for i in known] + [(2, "val")] * (fold == 0))
        assert np.allclose(mean, np.mean([r.b_log for r in got if r.role == "train"], axis=0))
    assert built == {"a": 1, "b": 1}


def test_imputation_builds_each_modality_once(spark, monkeypatch):
    built = counted(monkeypatch, spark)
    b, a = Q.impute_missing(spark, "")
    assert sorted(r.sample_id for r in b.select("sample_id").collect()) == list(range(1, 40, 5))
    assert sorted(r.sample_id for r in a.select("sample_id").collect()) == list(range(0, 40, 5))
    assert b.first().features == ["b0", "b1", "b2", "b3"] and np.isclose(sum(a.first().vec), 1.0)
    assert built == {"a": 1, "b": 1}
