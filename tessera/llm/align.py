"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide link counts.

Each text is encoded by a byte-level BPE (A, on space + text) and a piece BPE
with byte fallback (B, which adds the space itself).  Cumulative token ends go
into one dictionary per side, end -> index; the sorted intersection of their
keys slices both id lists into groups, and inside a slice the A-B pairs whose
byte ranges overlap are the links.  One pass writes each document's digest and
its distinct id pairs with how often they are linked; pair counts are summed per
task and then by Spark; a second pass over the written pairs looks the counts up.

The pair table grows with the corpus, so only its ``hot`` most frequent pairs
travel to the tasks as arrays of bounded size; the rest meet the documents that
hold them in a join.

Defined cases: a null or empty text, and one whose tokens' bytes do not join to
space + text (such as one with U+2581), has zeros and an empty digest; special
tokens' strings are ordinary text; every row is a document, so repeated rows and
rows of one doc_id count each; a null doc_id is kept; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, scratch_folder
from tessera.llm.tokens import byte_bpe, byte_bpe_entries, piece_bpe, piece_bpe_entries, public_path

#: Id pairs that tasks get as arrays (13 bytes each).
HOT = 1 << 20
#: Pair codes that a task sums at once.
FLUSH = 1 << 22


@dataclass(frozen=True)
class Tokenizers:
    """Vocabulary files: A in tiktoken's rank format, B a sentencepiece model."""

    a: str
    b: str


def public_tokenizers() -> Tokenizers:
    return Tokenizers(public_path("byte_bpe_50k.tiktoken"), public_path("piece_bpe_32k.model"))


@dataclass
class Alignment:
    """One text: ids, where slices end in either list, and the linked positions."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


_NONE = np.empty(0, np.int64)
NOTHING = Alignment(_NONE, _NONE, _NONE, _NONE, _NONE, _NONE)


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B precede each byte offset where tokens of both end."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(filter(at_a.__contains__, at_b))  # the keys of both, found by hash
    return (
        np.fromiter(map(at_a.__getitem__, common), np.int64, len(common)),
        np.fromiter(map(at_b.__getitem__, common), np.int64, len(common)),
    )


def expand_links(
    ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all A-B pairs with overlapping ranges, slice by slice.

    Where a slice has one token on either side, that token meets all of the
    other's; in the others each A token meets the run of B tokens it overlaps.
    """
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    slice_of = np.repeat(np.arange(len(n_a)), n_a)
    low = (cut_b - n_b)[slice_of]
    high = cut_b[slice_of]
    mixed = np.flatnonzero(((n_a > 1) & (n_b > 1))[slice_of])
    if len(mixed):
        starts_a = np.r_[0, ends_a[:-1]]
        starts_b = np.r_[0, ends_b[:-1]]
        low[mixed] = np.searchsorted(ends_b, starts_a[mixed], side="right")
        high[mixed] = np.searchsorted(starts_b, ends_a[mixed], side="left")
    many = high - low
    link_a = np.repeat(np.arange(len(ends_a)), many)
    link_b = np.arange(len(link_a)) + np.repeat(low - (np.cumsum(many) - many), many)
    return link_a, link_b


@lru_cache(maxsize=2)
def _lengths(files: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in e], np.int64) for e in (byte_bpe_entries(files.a), piece_bpe_entries(files.b)))


def align(text: str | None, files: Tokenizers) -> Alignment:
    """The alignment of one text, ``NOTHING`` where its tokens' bytes do not join to it."""
    if not text:
        return NOTHING
    raw = (" " + text).encode("utf-8", "surrogatepass")
    ids_a = byte_bpe(files.a, False)(" " + text)
    ids_b = piece_bpe(files.b).encode(text, num_threads=1)
    a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    of_a, of_b = _lengths(files)
    ends_a, ends_b = np.cumsum(of_a[a]), np.cumsum(of_b[b])
    # A's entries hold every byte and its pattern every character: only B's bytes can differ
    if ends_a[-1] != len(raw) or b"".join(map(piece_bpe_entries(files.b).__getitem__, ids_b)) != raw:
        return NOTHING
    cut_a, cut_b = slices(ends_a, ends_b)
    return Alignment(a, b, cut_a, cut_b, *expand_links(ends_a, ends_b, cut_a, cut_b))


@lru_cache(maxsize=4)
def _decimals(size: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}".encode() for i in range(size)])


def groups_text(al: Alignment, sizes: tuple[int, int]) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group in decimal."""
    n_a, n_b = np.diff(al.cut_a, prepend=0), np.diff(al.cut_b, prepend=0)
    width = max(len(str(max(sizes))) + 1, 2)
    out = np.zeros(len(al.a) + len(al.b), f"S{width}")
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    place_a = np.arange(len(al.a)) + (al.cut_b - n_b)[group_a]
    place_b = np.arange(len(al.b)) + al.cut_a[group_b]
    out[place_a] = _decimals(sizes[0], ",")[al.a]
    out[place_b] = _decimals(sizes[1], ",")[al.b]
    out[al.cut_a - 1 + (al.cut_b - n_b)] = _decimals(sizes[0], "|")[al.a[al.cut_a - 1]]
    out[al.cut_b - 1 + al.cut_a] = _decimals(sizes[1], ";")[al.b[al.cut_b - 1]]
    flat = out.view(np.uint8)
    return flat[flat != 0].tobytes()[:-1]


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def aligned(docs: DataFrame, files: Tokenizers, keep: list[str] = ["doc_id"], with_text: bool = False) -> DataFrame:
    """(*keep, al): the struct n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times of each row.

    ``groups`` is null unless ``with_text``; ``pairs`` holds the differences of
    the sorted distinct pair codes (A id x size of B + B id), ``times`` how often
    each is linked.
    """
    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary"
    names = [f.split()[0] for f in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(text: pd.Series) -> pd.DataFrame:
        sizes = (len(byte_bpe_entries(files.a)), len(piece_bpe_entries(files.b)))
        if sizes[0] * sizes[1] >= 1 << 32:
            raise ValueError("a pair of ids must fit into 32 bits")
        rows = []
        for t in text:
            al = align(t, files)
            said = groups_text(al, sizes) if len(al.a) else None
            pairs, times = np.unique(al.a[al.link_a] * sizes[1] + al.b[al.link_b], return_counts=True)
            digest = "" if said is None else hashlib.sha256(said).hexdigest()
            shown = (said or b"").decode() if with_text else None
            counts = (len(al.a), len(al.b), len(al.cut_a), len(al.link_a))
            rows.append((*counts, digest, shown, _packed(np.diff(pairs, prepend=0)), _packed(times)))
        return pd.DataFrame(rows, columns=names)

    return docs.select(*keep, run("text").alias("al"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of an aligned table each id pair is linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for raw in b["pairs"]:
                held.append(np.cumsum(_numbers(raw)))
                size += len(held[-1])
                if size >= FLUSH:
                    pair, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"pair": pair, "n": n})
                    held, size = [], 0
        if held:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"pair": pair, "n": n})

    found = table.select("al.pairs").mapInPandas(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def marked_counts(counts: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): best where n is the highest of the pair's A id."""
    held = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    top = held.groupBy("a").agg(F.max("n").alias("top"))
    return held.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def hot_pairs(marked: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """The at most ``hot`` most frequent pairs (but for a quantile's error), and whether that is all."""
    size = marked.count()
    if size <= hot:
        return marked, True
    least = marked.agg(F.percentile_approx("n", 1.0 - hot / size, 100_000)).first()[0]
    return marked.filter(F.col("n") > least), False


def align_corpus(docs: DataFrame, files: Tokenizers | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    files = files or public_tokenizers()
    spark = docs.sparkSession
    folder = scratch_folder(spark, "align")
    numbered = docs.select("doc_id", "text")
    aligned(numbered, files).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    table = spark.read.parquet(folder)
    marked = cut_lineage(marked_counts(pair_counts(table), len(piece_bpe_entries(files.b))))
    frequent, all_hot = hot_pairs(marked, hot)
    pd_hot = frequent.toPandas().sort_values("pair", ignore_index=True)
    shared = spark.sparkContext.broadcast(
        (pd_hot["pair"].to_numpy(np.uint32), pd_hot["n"].to_numpy(np.int64), pd_hot["best"].to_numpy(bool))
    )

    @F.pandas_udf("n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    def look_up(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        known, n, best = shared.value
        rows = []
        for p, t in zip(pairs, times):
            code, many = np.cumsum(_numbers(p)), _numbers(t)
            at = np.minimum(np.searchsorted(known, code.astype(np.uint32)), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            at, of = at[hit], many[hit]
            rest = [{"pair": x, "times": y} for x, y in zip(code[~hit].tolist(), many[~hit].tolist())]
            rows.append((int(of[best[at]].sum()), int((of * n[at]).sum()), rest))
        return pd.DataFrame(rows, columns=["n_best", "count_sum", "rest"])

    own = ["row", "doc_id", *[F.col(f"al.{c}") for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]]
    scored = table.select(*own, look_up("al.pairs", "al.times").alias("s"))
    if not all_hot:
        scored = cut_lineage(scored)
        rest = scored.select("row", F.explode("s.rest").alias("r")).select("row", "r.pair", "r.times")
        found = rest.join(marked, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
        scored = scored.join(found, "row", "left")
    else:
        scored = scored.withColumns({"more_best": F.lit(0).cast("long"), "more_sum": F.lit(0).cast("long")})
    zero = F.lit(0).cast("long")
    return scored.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("s.n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("s.count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
