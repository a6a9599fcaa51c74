"""Token heads, saved parameters, two-stream imputation and the record reader."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts as A
from tessera.operators import naming as N
from tessera.operators import ridge as R
from tessera.operators import token_head as T
from tessera.sources import readers
from tessera.streaming.windows import lone_samples, run_to_files


def frame(spark, x, y):
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, y array<double>").repartition(3)


def test_pooling_of_each_fusion():
    rng = np.random.default_rng(1)
    v, e = rng.normal(size=(5, 4)), rng.normal(size=(4, 3))
    token = {"scale": lambda a, b: a * b, "add": lambda a, b: b + 0.5 * a, "affine": lambda a, b: b * (1 + 0.5 * a)}
    for name, fuse in token.items():
        want = [np.mean([fuse(v[i, j], e[j]) for j in range(4)], axis=0) for i in range(5)]
        assert np.allclose(T.pooled(v, e, name, 0.5), want)


@pytest.mark.parametrize("fusion", ["scale", "affine"])
def test_trainable_rows_move_and_calibrated_stay(spark, fusion):
    """Two targets hang on two features without a vector in one direction: training their rows helps."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 12))
    y = np.column_stack([x[:, 3] + x[:, 7] + 0.1 * rng.normal(size=150), x[:, 0] + 0.1 * rng.normal(size=150)])
    e = rng.normal(size=(12, 3))
    free = np.isin(np.arange(12), [3, 7])
    df = frame(spark, x, y)
    fixed = T.fit_token_head(df, e, np.zeros(12, bool), fusion)
    model = T.fit_token_head(df, e, free, fusion, strength=1e-3)
    assert np.array_equal(model.embedding[~free], e[~free]) and np.abs(model.embedding[free] - e[free]).min() > 0
    assert np.array_equal(fixed.embedding, e)
    err = lambda m: ((m.predict(x) - y) ** 2).mean()
    assert err(model) <= err(fixed) * 1.0001
    got = T.predict_token_head(df, model).orderBy("sample_id").toPandas()
    assert np.allclose(np.array(got["pred"].tolist()), model.predict(x))


def test_trained_rows_solve_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x, y, e = rng.normal(size=(80, 6)), rng.normal(size=(80, 3)), rng.normal(size=(6, 2))
    free = np.array([False, True, True, False, False, True])
    df = frame(spark, x, y)
    before = T.fit_token_head(df, e, np.zeros(6, bool), "scale")
    model = T.fit_token_head(df, e, free, "scale", rounds=1, strength=0.7)
    w = before.head.coef[6:] / before.head.scale[6:, None]
    resid = y - before.predict(x)
    # dense least squares over all entries of the free rows, towards their start
    m = np.einsum("ij,dt->itjd", x[:, free] / 6, w).reshape(80 * 3, -1)
    step = np.linalg.solve(m.T @ m + 0.7 * np.eye(m.shape[1]), m.T @ resid.reshape(-1))
    assert np.allclose(model.embedding[free] - e[free], step.reshape(3, 2), atol=1e-8)


def test_fusions_differ(spark):
    rng = np.random.default_rng(4)
    x, y, e = rng.normal(size=(60, 8)), rng.normal(size=(60, 2)), rng.normal(size=(8, 3))
    df = frame(spark, x, y)
    preds = [T.fit_token_head(df, e, np.arange(8) < 2, f).predict(x) for f in ("scale", "add")]
    assert not np.allclose(*preds)
    with pytest.raises(ValueError):
        T.fit_token_head(df, e, np.zeros(8, bool), "other")


def test_saved_parameters_are_loaded_or_refused(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(40, 2))
    model = R.fit_ridge(frame(spark, x, y))
    emb = spark.createDataFrame([("f0", [1.0, 2.0]), ("f1", [0.5, 0.25])], "feature string, embedding array<double>")
    digest = A.embedding_digest(emb)
    assert digest == A.embedding_digest(emb.orderBy(F.desc("feature")).repartition(3))
    folder, names = str(tmp_path / "m"), ["f0", "f1", "f2"]
    A.save_ridge(spark, folder, model, names, ["t0", "t1"], {"b_mean": np.arange(2.0)}, digest)
    other = spark.newSession()
    back, scalers = A.load_ridge(other, folder, names, ["t0", "t1"], digest)
    assert np.array_equal(back.predict(x), model.predict(x)) and scalers["b_mean"].tolist() == [0.0, 1.0]
    for bad in ({"features": ["f1", "f0", "f2"]}, {"features": names[:2]}, {"targets": ["t1", "t0"]}, {"embedding": "x"}):
        with pytest.raises(ValueError):
            A.load_ridge(spark, folder, **bad)
    with pytest.raises(ValueError):
        A.save_ridge(spark, str(tmp_path / "n"), model, names[:2], ["t0", "t1"])
    spark.createDataFrame([("version", 0, [99.0], [""])], "part string, place int, numbers array<double>, names array<string>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="version"):
        A.load_ridge(spark, str(tmp_path / "v"))


def test_lone_samples_of_two_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    far = at(100_000)
    a_files = [[(1, at(0), 1.0), (2, at(1), 2.0)], [(1, at(2), 1.0), (3, at(5), 3.0), (2, at(1), 2.0)], [(9, far, 0.0)], [(11, far, 0.0)], [(4, at(3), 4.0)], [(10, far + dt.timedelta(hours=9), 0.0)]]
    b_files = [[(1, at(20))], [(3, at(5)), (3, at(6))], [(9, far)], [(11, far)], [(2, at(2))], [(10, far + dt.timedelta(hours=9))]]
    for name, files, schema in (("a", a_files, "sample_id long, ts timestamp, v double"), ("b", b_files, "sample_id long, ts timestamp")):
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / str(k)))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    lone = lone_samples(read("a", "sample_id long, ts timestamp, v double"), read("b", "sample_id long, ts timestamp"))
    got = sorted((r.sample_id, r.v) for r in run_to_files(spark, lone, "lone").collect())
    # 2's partner and sample 4 come after the watermark has passed them; repeated deliveries count once
    assert got == [(2, 2.0)]
    # without lateness, a batch says the same
    batch = lambda files, schema: spark.createDataFrame([r for f in files for r in f], schema)
    whole = lone_samples(batch(a_files[:3], "sample_id long, ts timestamp, v double"), batch(b_files[:3], "sample_id long, ts timestamp"))
    assert sorted((r.sample_id, r.v) for r in whole.collect()) == [(2, 2.0)]


RECORDS = "ENTRY       C9   Compound\nNAME        Water;\n            H2O\nENZYME      1.1 2.2\n            3.3\nFORMULA     x\n///\nENTRY       C1   Compound\nNAME        water\n///\nENTRY       C2   Compound\n///\n"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_in_file_order_with_either_line_end(spark, tmp_path, end):
    path = tmp_path / "compound.txt"
    path.write_bytes(RECORDS.replace("\n", end).encode())
    c = readers.read_compounds(spark, str(path))
    got = [(r.rec_no, r.cid, r.names, r.primary_name, r.ecs) for r in c.orderBy("rec_no").collect()]
    assert got == [(1, "C9", ["Water", "H2O"], "Water", ["1.1", "2.2", "3.3"]), (2, "C1", ["water"], "water", []), (3, "C2", [], "C2", [])]
    index = {tuple(r) for r in N.synonym_index(readers.synonym_rows(c)).collect()}
    assert any("C9" in r for r in index) and not any("C1" in r for r in index)  # the first record in the file has the name


def test_many_records_keep_their_order_over_splits(spark, tmp_path):
    path = tmp_path / "compound.txt"
    ids = [int(x) for x in np.random.default_rng(1).permutation(3000)]
    path.write_text("".join(f"ENTRY       C{i}   Compound\nNAME        n{i}\n///\n" for i in ids))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = [r.cid for r in readers.read_compounds(spark, str(path)).orderBy("rec_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"C{i}" for i in ids]
