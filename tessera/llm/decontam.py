"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts in how many each hashed term occurs; the
   counts give the inverse document frequencies.
2. The benchmark's passages become TF-IDF rows, and a randomised SVD of that
   matrix (range finder with power iterations, each product summed over
   partitions) gives the latent basis.
3. A second pass slides windows over every document.  A window is projected on
   the basis and compared with each passage by cosine, for which a window counts
   as no heavier than the passage, so the text around a copy cannot hide it.
   Each term's largest part in any passage's product is known; a window whose
   terms' parts add up to less than the threshold needs no projection, which
   loses nothing.
4. Each candidate is checked by the longest common subsequence of words around
   the window and by its answer: the words after the last "answer:" if the
   passage has one, else its most telling words.

The benchmark is handled in blocks of ``block_items`` items; each block is one
pass over the documents, so a task holds one block's model.  With several blocks
each pass writes the hits of the texts that have any, keyed by two hashes of the
text, and the documents meet them in one join at the end.

Defined cases: null or empty texts match nothing; a passage of fewer than
``MIN_WORDS`` words must occur word for word; rows that repeat a doc_id or an
item_id are searched each; items without an id are searched too and show up in a
document as one hit with a null item_id; long items are searched as passages of at most
``PASSAGE`` words, any of which counts; other columns are kept and never read;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, free_names
from tessera.llm.words import chunks, words_of, words_of_all

#: Words of a benchmark passage at most; longer items are cut.
PASSAGE = 64
#: Passages of fewer words are compared word for word.
MIN_WORDS = 8
#: Hash buckets of the document frequencies.
BUCKETS = 1 << 16
#: Window lengths; a window is the smallest that holds a passage at any alignment.
WINDOWS = (12, 18, 24, 36, 54, 88)

def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per term bucket, and the number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            n += len(b)
            for texts in chunks(b["text"]):
                h, per = words_of_all(texts)
                key = np.repeat(np.arange(len(per)), per) * BUCKETS + bucket_of(h)
                counts += np.bincount(np.unique(key) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": np.r_[at, -1], "n": np.r_[counts[at], n]})

    got = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = got.toPandas()  # at most BUCKETS + 1 rows
    counts = np.zeros(BUCKETS, np.int64)
    known = table[table["bucket"] >= 0]
    counts[known["bucket"].to_numpy()] = known["n"].to_numpy()
    return counts, int(table.loc[table["bucket"] < 0, "n"].sum())


@dataclass
class Passage:
    item: int
    words: np.ndarray
    answer: list[int] = field(default_factory=list)


def passages_of(item: int, text: str | None) -> list[Passage]:
    words, low = words_of(text), (text or "").lower()
    answer = words_of(low.rsplit("answer:", 1)[1]).tolist() if "answer:" in low else []
    cut = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]
    if len(cut) > 1 and len(cut[-1]) < PASSAGE // 2:
        cut[-1] = words[-PASSAGE:]
    return [Passage(item, w, answer if k == len(cut) - 1 else []) for k, w in enumerate(cut)]


def randomised_svd(rows: DataFrame, columns: int, rank: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors (columns x rank) of sparse rows (at: array<int>, weight: array<double>).

    A^T (A Q) is summed over partitions for each power iteration, so a task
    holds its own rows and one columns x rank block.
    """
    sc = rows.sparkSession.sparkContext

    def product(q: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(q)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            basis = shared.value
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for at, weight in zip(b["at"], b["weight"]):
                    y = np.asarray(weight) @ basis[np.asarray(at)]
                    for t, w in zip(at, weight):
                        total[t] = total[t] + w * y if t in total else w * y
            yield pd.DataFrame({"t": list(total), "y": [v.tobytes() for v in total.values()]})

        out = np.zeros_like(q)
        for t, y in rows.mapInPandas(run, "t int, y binary").toLocalIterator():
            out[t] += np.frombuffer(y)
        shared.destroy()
        return out

    rank = max(1, min(rank, columns))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, rank)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, ::-1]


@dataclass
class Index:
    """What a task needs to search one block of the benchmark."""

    terms: np.ndarray  # sorted hashes of the block's words
    weight: np.ndarray  # idf of each term, then of each bucket of other words, then 0
    basis: np.ndarray  # terms x rank, rows scaled by idf; a last row of zeros
    by_window: dict[int, tuple[np.ndarray, np.ndarray]]  # window -> passage numbers, unit latent rows
    part: np.ndarray  # the most that one occurrence of each term adds to a window's product with a passage
    least: np.ndarray  # cosine threshold of each passage
    norm: np.ndarray  # of each passage's weights
    passages: list[Passage]
    masks: list[dict[int, int]]
    telling: list[Counter]


def build_index(
    spark, block: list[tuple[int, str | None]], counts: np.ndarray, n_docs: int, rank: int, cosine: float
) -> Index:
    passages = [p for item, text in block for p in passages_of(item, text) if len(p.words)]
    terms = np.unique(np.concatenate([p.words for p in passages])) if passages else np.empty(0, np.uint64)
    idf = np.log((n_docs + 1) / (counts + 1)) + 0.1
    weight = np.concatenate([idf[bucket_of(terms)], idf, [0.0]]).astype(np.float32)
    places = [np.searchsorted(terms, p.words) for p in passages]
    rows = []
    for k, at in enumerate(places):
        own, n = np.unique(at, return_counts=True)
        rows.append((k, own.tolist(), (n * weight[own]).astype(float).tolist()))
    frame = spark.createDataFrame(rows, "k int, at array<int>, weight array<double>") if rows else None
    basis = randomised_svd(frame.repartition(4), len(terms), min(rank, len(rows))) if rows else np.zeros((0, 1))
    scaled = (basis * weight[: len(terms), None]).astype(np.float32)
    by_window, least, norms = defaultdict(list), np.zeros(len(passages), np.float32), np.zeros(len(passages), np.float32)
    latent = np.zeros((len(passages), basis.shape[1]), np.float32)
    for k, (p, at) in enumerate(zip(passages, places)):
        if len(p.words) < MIN_WORDS:
            continue
        z = scaled[at].sum(0)
        norm = float(np.linalg.norm(z))
        counted = np.bincount(at, minlength=len(terms)) * weight[: len(terms)]
        latent[k] = z / norm if norm else 0
        # the part of the passage that the basis holds bounds what a copy can reach
        norms[k] = np.linalg.norm(counted)
        least[k] = cosine * norm / norms[k]
        window = next((w for w in WINDOWS if len(p.words) <= w - w // 4 + 1), WINDOWS[-1])
        by_window[window].append(k)
    part = np.zeros(len(weight))
    if rows:
        part[: len(terms)] = np.maximum(scaled @ latent.T, 0).max(axis=1)
    masks, telling = [], []
    for p, at in zip(passages, places):
        m: dict[int, int] = defaultdict(int)
        for i, w in enumerate(p.words.tolist()):
            m[w] |= 1 << i
        masks.append(dict(m))
        rare = sorted(set(at.tolist()), key=lambda t: (-weight[t], t))[: max(1, len(set(at.tolist())) // 3)]
        telling.append(Counter(p.answer or terms[rare].tolist()))
    return Index(
        terms,
        weight,
        np.vstack([scaled, np.zeros((1, scaled.shape[1]), np.float32)]),
        {w: (np.array(ks), latent[ks]) for w, ks in by_window.items()},
        part,
        least,
        norms,
        passages,
        masks,
        telling,
    )


def common_subsequence(mask: dict, n: int, words: Iterable) -> int:
    """Length of the longest common subsequence of ``words`` and the passage behind ``mask``, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = mask.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _window_sums(values: np.ndarray, row: np.ndarray, some: np.ndarray, window: int, step: int) -> np.ndarray:
    """For each window (its number; they begin ``step`` words apart) the sum of its words' rows of ``values``.

    The sums of each ``step`` words are made once for all windows that hold them.
    """
    whole = window // step
    part, at = np.unique(some[:, None] + np.arange(whole), return_inverse=True)
    sums = values[row[part[:, None] * step + np.arange(step)]].sum(axis=1)
    at = at.reshape(len(some), whole)
    total = sums[at[:, 0]]
    for k in range(1, whole):
        total += sums[at[:, k]]
    for k in range(whole * step, window):
        total += values[row[some * step + k]]
    return total


class Searcher:
    def __init__(self, index: Index, lcs: float, answer: float):
        self.x, self.lcs, self.answer = index, lcs, answer
        self.square = index.weight.astype(np.float64) ** 2
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(index.terms >> np.uint64(44)).astype(np.int64)] = True
        self.short = [(k, p.words) for k, p in enumerate(index.passages) if len(p.words) < MIN_WORDS]
        self.needed = [answer * sum(told.values()) for told in index.telling]
        # with fewer passages than latent columns, each term's latent products with them are the shorter rows
        rank = index.basis.shape[1]
        self.by_term = {w: index.basis @ rows.T for w, (_, rows) in index.by_window.items() if len(rows) <= rank}

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the index: its term's, or after them its bucket's."""
        terms = self.x.terms
        at = len(terms) + bucket_of(hashes)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(terms, hashes[some]), max(0, len(terms) - 1))
        hit = terms[place] == hashes[some]
        at[some[hit]] = place[hit]
        return at

    def candidates(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows near enough to a passage: arrays of passage, first word, last word + 1, cosine."""
        x, n, v = self.x, len(at), len(self.x.terms)
        # a window's squared norm, each occurrence of a term on its own
        mass = np.r_[0.0, np.cumsum(self.square[at])]
        bound = np.r_[0.0, np.cumsum(x.part[at])]
        row = np.r_[np.minimum(at, v), np.full(WINDOWS[-1], v)]
        found = []
        for window, (ks, rows) in x.by_window.items():
            step = window // 4
            begin = np.arange(0, max(1, n - window + step), step)
            end = np.minimum(begin + window, n)
            norm = np.sqrt(np.maximum(mass[end] - mass[begin], 1e-9))
            floor = 0.999 * float(x.least[ks].min()) * np.minimum(norm, float(x.norm[ks].min()))
            near = np.flatnonzero(bound[end] - bound[begin] >= floor)
            for i in range(0, len(near), 256):
                some = near[i : i + 256]
                if window in self.by_term:
                    product = _window_sums(self.by_term[window], row, some, window, step)
                else:
                    product = _window_sums(x.basis, row, some, window, step) @ rows.T
                a, b = np.nonzero(product >= x.least[ks] * np.minimum(norm[some, None], x.norm[ks]))
                found.append((ks[b], begin[some[a]], end[some[a]], product[a, b] / norm[some[a]]))
        if not found:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        return tuple(np.concatenate(c) for c in zip(*found))

    def search(self, texts: Iterable[str | None]) -> list[list[dict]]:
        """The items found in each text."""
        return [hits for some in chunks(texts) for hits in self._search(some)]

    def _search(self, texts: list[str | None]) -> list[list[dict]]:
        """Texts lie one after the other, a window of weightless places apart, so no
        window holds words of two of them."""
        hashes, counts = words_of_all(texts)
        gap = WINDOWS[-1]
        first = np.r_[0, np.cumsum(counts)]
        starts = first[:-1] + gap * np.arange(len(texts))
        at = np.full(int(counts.sum()) + gap * len(texts), len(self.x.weight) - 1)
        at[np.arange(len(hashes)) + np.repeat(gap * np.arange(len(texts)), counts)] = self.columns(hashes)
        best: list[dict[int, tuple[float, float, int]]] = [{} for _ in texts]
        seen: set[tuple[int, int, int, int]] = set()
        passage, begin, end, cosine = self.candidates(at)
        # the last text that begins before the window's end: the gap is as long as any window
        owner = np.maximum(np.searchsorted(starts, end, side="left") - 1, 0)
        for k, a, b, c, o in zip(passage.tolist(), begin.tolist(), end.tolist(), cosine.tolist(), owner.tolist()):
            p, n = self.x.passages[k], int(counts[o])
            margin = len(p.words) // 2
            lo, hi = max(0, a - int(starts[o]) - margin), min(n, b - int(starts[o]) + margin)
            if (o, k, lo, hi) in seen:
                continue
            seen.add((o, k, lo, hi))
            region = hashes[first[o] + lo : first[o] + max(lo, hi)].tolist()
            told, need = self.x.telling[k], self.needed[k]
            # the telling words that are there at all, as often as the passage has them: most candidates end here
            if sum(map(told.__getitem__, told.keys() & region)) < need:
                continue
            there = Counter(region)
            if sum(min(m, there[w]) for w, m in told.items()) < need:
                continue
            share = common_subsequence(self.x.masks[k], len(p.words), region) / len(p.words)
            if share >= self.lcs:
                best[o][p.item] = max(best[o].get(p.item, (0.0, 0.0, 0)), (share, c, lo))
        for k, words in self.short:
            begin = np.flatnonzero(hashes[: max(0, len(hashes) - len(words) + 1)] == words[0])
            for j in range(1, len(words)):
                begin = begin[hashes[begin + j] == words[j]]
            owner = np.searchsorted(first, begin, side="right") - 1
            for i, o in zip(begin.tolist(), owner.tolist()):
                if i + len(words) <= first[o + 1]:
                    best[o][self.x.passages[k].item] = (1.0, 1.0, i - int(first[o]))
        return [
            [{"item_id": i, "lcs": s, "cosine": c, "first_word": lo} for i, (s, c, lo) in sorted(b.items(), key=_item_order)] for b in best
        ]


def _item_order(row: tuple) -> tuple:
    """By item, those without an id last, then by what follows."""
    return row[0] is None, row[0] or 0, row[1:]


HITS = "array<struct<item_id:long,lcs:double,cosine:double,first_word:int>>"


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str = "hits",
    cosine: float = 0.40,
    lcs: float = 0.7,
    answer: float = 0.6,
    rank: int = 256,
    block_items: int = 512,
) -> DataFrame:
    """Documents with an array of the benchmark items found in each."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    n_items = items.count()
    blocks = max(1, math.ceil(n_items / block_items))
    counts, n_docs = document_frequencies(docs)
    dealt = cut_lineage(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    one, two = (F.xxhash64(F.lit(k), "text") for k in (1, 2))  # equal texts have equal hits
    written = []
    for block in range(blocks):
        # about block_items rows: a bounded part of the query set
        rows = [(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == block).collect()]
        if not rows:
            continue
        index = build_index(spark, sorted(rows, key=_item_order), counts, n_docs, rank, cosine)
        shared = spark.sparkContext.broadcast(index)
        found = _finder(shared, lcs, answer)
        if blocks == 1:
            return docs.withColumn(name, found("text"))
        hits = docs.select(one.alias("one"), two.alias("two"), found("text").alias("hits")).filter(F.size("hits") > 0)
        written.append(cut_lineage(hits.groupBy("one", "two").agg(F.first("hits").alias("hits")).withColumn("block", F.lit(block))))
        shared.destroy()  # a task holds one block's index at a time
    if not written:
        return docs.withColumn(name, F.array().cast(HITS))
    each = F.array_sort(F.collect_list(F.struct("block", "hits")))  # at most one entry of each block
    found = reduce(DataFrame.unionAll, written).groupBy("one", "two").agg(F.flatten(F.transform(each, lambda x: x["hits"])).alias("hits"))
    k1, k2, had = free_names(docs.withColumn(name, F.lit(None)), "one", "two", "had")
    found = found.select(F.col("one").alias(k1), F.col("two").alias(k2), F.col("hits").alias(had))
    joined = docs.withColumns({k1: one, k2: two}).join(found, [k1, k2], "left")
    return joined.withColumn(name, F.coalesce(had, F.array().cast(HITS))).drop(k1, k2, had)


def _finder(shared, lcs: float, answer: float):
    @F.pandas_udf(HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Searcher(shared.value, lcs, answer)
        for texts in batches:
            yield pd.Series(s.search(texts))

    # as non-deterministic, so that a filter on the hits doesn't search twice
    return found.asNondeterministic()


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, lcs, cosine), one row per document and benchmark item found in it."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.lcs", "h.cosine")
