"""Naive Bayes support vector quality classifier.

Features are indicators of hashed word 1- and 2-grams.  On a bounded sample of
labelled rows (``fit_rows``, chosen by a hash of the id) class log-count ratios
scale the indicators, and a linear hinge-loss model is fitted to them by dual
coordinate descent, classes weighted to equal mass.  A logistic curve fitted to
cross-validated margins turns the final model's margins into scores.
Scoring is one Arrow pass over the texts without a shuffle.

Defined cases: a null text is empty and scores as the model's intercept; rows
without a label, or whose label is null, are never learned from; a document
labelled twice has its largest label; if the sample lacks a class every score
is the share of label 1 in it, or 0.5 without any label; repeated rows are
scored each; other columns are kept and never read.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-gram indicators.
BUCKETS = 1 << 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = 1  # id of every 2-gram that repeats one word


class _WordIds(dict):
    """word -> 32-bit hash, remembered; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


_IDS = _WordIds()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's 1- and 2-grams."""
    words = _TOKEN.findall((text or "").lower())
    ids = np.fromiter(map(_IDS.__getitem__, words), np.uint32, len(words))
    pairs = (ids[:-1] * np.uint32(0x9E3779B1)) ^ (ids[1:] * np.uint32(0x85EBCA6B))
    pairs[ids[:-1] == ids[1:]] = _SAME
    grams = np.concatenate([ids * np.uint32(0xC2B2AE35), pairs])
    return np.unique(grams >> np.uint32(14)).astype(np.int32)


@dataclass
class Model:
    """margin = sum(weight[f]) / sqrt(sum(scale[f])) + bias; score = logistic(a * margin + b)."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.scale[found].sum())
        return self.bias + (float(self.weight[found].sum()) / math.sqrt(norm) if norm > 0 else 0.0)

    def score(self, text: str | None) -> float:
        z = self.a * self.margin(features(text)) + self.b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """ln of the classes' smoothed shares of documents that hold each bucket."""
    pos, neg = np.ones(BUCKETS), np.ones(BUCKETS)
    for f, label in zip(rows, y):
        (pos if label > 0 else neg)[f] += 1
    return np.log(pos / (int((y > 0).sum()) + 2)) - np.log(neg / (int((y < 0).sum()) + 2))


def dual_coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0
) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM on unit-length rows ``scale[f]``; an unregularised-size bias column of ones."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    # rows stay as their buckets; a row's values are looked up when it is its turn
    norm = np.array([max(float(np.sqrt((scale[f] ** 2).sum())), 1e-300) for f in rows])
    q = np.array([1.0 + float((scale[f] ** 2).sum()) / s**2 for f, s in zip(rows, norm)])
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    top = cost * share
    alpha, w, bias = np.zeros(n), np.zeros(len(scale)), 0.0
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            f = rows[i]
            v = scale[f] / norm[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1.0
            old = alpha[i]
            new = min(max(old - gradient / q[i], 0.0), top[i])
            if new != old:
                alpha[i] = new
                step = (new - old) * y[i]
                w[f] += step * v
                bias += step
                worst = max(worst, abs(new - old))
        if worst < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of the logistic fit to margins, by Newton steps with a small ridge."""
    t = (y > 0).astype(float)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-2 * (a - 1), (p - t).sum() + 1e-2 * b])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum() + 1e-2, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """Fit on (features, 0/1 label) rows; the logistic curve sees each row's margin from a fold without it."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else min(max(float((y > 0).mean()), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, math.log(share / (1 - share)))
    # each fold has its share of either class
    fold = np.zeros(len(y), int)
    for label in (1, -1):
        fold[y == label] = np.arange((y == label).sum()) % folds
    margins = np.full(len(y), np.nan)
    for k in range(folds):
        train = np.flatnonzero(fold != k)
        if len(set(y[train].tolist())) == 2:
            model = _machine([rows[i] for i in train], y[train])
            for i in np.flatnonzero(fold == k):
                margins[i] = model.margin(rows[i])
    model = _machine(rows, y)
    seen = ~np.isnan(margins)
    if len(set(y[seen].tolist())) == 2:
        model.a, model.b = logistic_curve(margins[seen], y[seen])
    return model


def _machine(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = log_count_ratios(rows, y)
    w, bias = dual_coordinate_descent(rows, y, ratio)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 8_000) -> Model:
    """Fit on at most ``fit_rows`` labelled documents that are not held out."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    @F.pandas_udf("binary")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in text])

    # at most fit_rows ids and labels, and of the rows that share an id the one of the least text hash: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = rows.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    got = sample.select("doc_id", "_y", found("r.text").alias("f")).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return fit([np.frombuffer(f, np.int32) for f in got["f"]], got["_y"].to_numpy())


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in text], dtype="float64")

    # as non-deterministic, so that a filter on the score doesn't run it twice
    return docs.withColumn(name, score.asNondeterministic()("text"))
