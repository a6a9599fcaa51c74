"""Fitted parameters as a versioned table (MOD7): scalers, coefficients, feature order.

An artifact is a folder of rows (part, place, numbers, names): every array of the
model row by row, and the names it was fitted on.  Loading checks the version and,
where given, the feature order, the targets and a digest of the embedding, and
refuses on any difference, so a job never scores with another layout's numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ridge import Ridge

VERSION = 1
_SCHEMA = "part string, place int, numbers array<double>, names array<string>"


def embedding_digest(vectors: DataFrame) -> str:
    """Digest of (feature, embedding) rows, whatever their order: summed hashes of the rows."""
    sums = [F.sum(F.xxhash64(F.lit(k), "feature", "embedding").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    r = vectors.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return hashlib.sha256(f"{r['n']}:{r['h1']}:{r['h2']}".encode()).hexdigest()


def save_ridge(
    spark: SparkSession, folder: str, model: Ridge, features: Sequence[str], targets: Sequence[str], scalers: dict[str, np.ndarray] | None = None,
    embedding: str | None = None,
) -> None:
    """Write a ridge with its names, further ``scalers`` and the digest of the embedding it used."""
    if len(features) != len(model.mean) or len(targets) != len(model.intercept):
        raise ValueError("names don't fit the model")
    arrays = {"mean": model.mean, "scale": model.scale, "intercept": model.intercept, "alpha": model.alpha, **(scalers or {})}
    rows = [("version", 0, [float(VERSION)], [embedding or ""]), ("features", 0, [], list(features)), ("targets", 0, [], list(targets))]
    rows += [(name, 0, [float(x) for x in v], []) for name, v in arrays.items()]
    rows += [("coef", k, [float(x) for x in r], []) for k, r in enumerate(model.coef)]
    spark.createDataFrame(rows, _SCHEMA).write.mode("errorifexists").parquet(folder)


def load_ridge(
    spark: SparkSession, folder: str, features: Sequence[str] | None = None, targets: Sequence[str] | None = None, embedding: str | None = None
) -> tuple[Ridge, dict[str, np.ndarray]]:
    """The model and its scalers; raises where version, names or embedding differ from what is asked for."""
    rows = spark.read.schema(_SCHEMA).parquet(folder).orderBy("part", "place").collect()
    held: dict[str, list] = {}
    for r in rows:
        held.setdefault(r["part"], []).append(r)
    if "version" not in held or held["version"][0]["numbers"] != [float(VERSION)]:
        raise ValueError(f"{folder} is no artifact of version {VERSION}")
    for part, asked in (("features", features), ("targets", targets)):
        have = held[part][0]["names"]
        if asked is not None and list(asked) != have:
            odd = next((f"{a!r} instead of {b!r}" for a, b in zip(asked, have) if a != b), f"{len(asked)} instead of {len(have)}")
            raise ValueError(f"{part} differ from the artifact's: {odd}")
    if embedding is not None and embedding != held["version"][0]["names"][0]:
        raise ValueError("the embedding is not the one that the artifact was fitted on")
    one = {k: np.array(v[0]["numbers"]) for k, v in held.items() if k not in ("version", "features", "targets", "coef")}
    coef = np.array([r["numbers"] for r in held["coef"]])
    model = Ridge(one.pop("mean"), one.pop("scale"), coef, one.pop("intercept"), one.pop("alpha"))
    return model, one
