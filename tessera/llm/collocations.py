"""Collocations per language from counts of padded longest windows.

Words are counted once per language; those found often enough get ids.  Each
word position then gives one window: its word and the next ones as lead
columns, padded at the end of its piece and at the first word that is too rare
for any candidate.  Only these windows are counted, and Spark's ROLLUP sums them
over ever shorter prefixes, down to two words: a phrase's count is the sum over
all windows that begin with it, so no n-grams are exploded.  Before the rollup,
a window's tail is padded where its first three words are too rare together,
and a window goes whose first two are, so what the rollup shuffles is close to
what can be a candidate.

Windows meet by their first two words.  Where both are so frequent that a pair
of them could be hot, the third word is part of the key, and the fourth where
three are, so no key holds more than about a thousandth of all windows.

Word ids are ranks for the ``hot`` most frequent words, which tasks get as a
dictionary of bounded size, and 62-bit hashes for all others.

Defined cases: a null text is empty; a null lang is ``und``; repeated rows and
rows of one doc_id count each; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, text_of

#: Words that end a piece, white space between words (fixed by the operator's definition).
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Longest phrase.
LONGEST = 4
#: Words whose ranks tasks hold as a dictionary.
HOT = 1 << 19
#: Distinct words, or windows, that a task sums at once; a window takes some 150 bytes while it is sorted.
FLUSH = 1 << 19
WINDOWS = 1 << 20
#: A pair of words is dealt on by its third one where each has this share of all words at least.
SHARE = 1024

PAD, END = -1, -2
#: A byte that no UTF-8 text holds marks the end of a piece.
_MARK = b"\xff"
_TABLE = bytes(
    ord("\n") if b in PIECE_ENDS else ord(" ") if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_COLS = [f"w{k}" for k in range(1, LONGEST + 1)]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, with a mark between pieces."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return raw.replace(b"\n", b" " + _MARK + b" ").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of each word in each language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)

        def drain() -> pd.DataFrame:
            rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in held.items() for w, n in c.items() if w != _MARK]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) >= FLUSH:
                yield drain()
        yield drain()

    return _texts(docs).mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))


@dataclass
class Vocabulary:
    """Words frequent enough for a candidate: a table, and what tasks get of it."""

    table: DataFrame  # lang, word, n, id
    ranks: Broadcast  # lang -> word -> rank
    whole: bool  # whether every word of the table has a rank
    leading: int  # ids below belong to words that could make a hot pair


def _hash_id(lang: str, word: bytes) -> int:
    """As ``_hash_column``: Spark's xxhash64 of (lang, word), marked as no rank."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return xxhash.xxh64_intdigest(word, seed) >> 2 | 1 << 62


def _hash_column() -> Column:
    return F.shiftrightunsigned(F.xxhash64("lang", "word"), 2).bitwiseOR(F.lit(1 << 62))


def vocabulary(counts: DataFrame, least: int, total: int, hot: int = HOT) -> Vocabulary:
    spark = counts.sparkSession
    often = counts.filter(F.col("n") >= least)
    size = often.count()
    bound = 0
    if size > hot:
        bound = often.agg(F.percentile_approx("n", 1.0 - hot / size, 100_000)).first()[0]
    # at most ``hot`` words (but for the quantile's error): ranked in one bounded sort
    ranked = often.filter(F.col("n") > bound).toPandas().sort_values(["n", "lang", "word"], ascending=[False, True, True], ignore_index=True)
    ranks: dict[str, dict[bytes, int]] = defaultdict(dict)
    for k, (lang, word) in enumerate(zip(ranked["lang"], ranked["word"])):
        ranks[lang][word.encode("utf-8", "surrogatepass")] = k
    ranked["id"] = np.arange(len(ranked))
    schema = "lang string, word string, n long, id long"
    table = spark.createDataFrame(ranked, schema) if len(ranked) else spark.createDataFrame([], schema)
    if bound:
        table = table.unionByName(often.filter(F.col("n") <= bound).withColumn("id", _hash_column()))
    leading = int((ranked["n"].to_numpy(np.int64) * SHARE >= total).sum())
    return Vocabulary(cut_lineage(table), spark.sparkContext.broadcast(dict(ranks)), not bound, leading)


def cut_windows(ids: np.ndarray) -> np.ndarray:
    """A row per word with an id whose next one has one: both and the next two, padded from the first without."""
    padded = np.r_[ids, np.full(LONGEST - 1, END, np.int64)]
    cols = [np.where(ids < 0, PAD, ids)]
    for k in range(1, LONGEST):
        lead = padded[k : k + len(ids)]
        cols.append(np.where((cols[-1] < 0) | (lead < 0), PAD, lead))
    return np.stack(cols, axis=1)[cols[1] >= 0]


def _counted(w: np.ndarray) -> pd.DataFrame:
    """Equal windows summed, in the order of their words."""
    w = w[np.lexsort(w.T[::-1])]
    new = np.r_[True, (w[1:] != w[:-1]).any(axis=1)] if len(w) else np.empty(0, bool)
    first = np.flatnonzero(new)
    out = pd.DataFrame(w[first], columns=_COLS)
    out["n"] = np.diff(np.r_[first, len(w)])
    return out


def window_tables(batches: Iterator[pd.DataFrame], known: dict[str, dict[bytes, int]], whole: bool) -> Iterator[pd.DataFrame]:
    """Counted windows of (lang, text) batches, about ``WINDOWS`` at a time."""
    held, size = [], 0

    def drain() -> pd.DataFrame:
        nonlocal size
        ids = np.concatenate(held)
        held.clear()
        size = 0
        return _counted(cut_windows(ids))

    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            own = known.get(lang, {})
            found = words_of(text)
            ids = np.fromiter(map(own.get, found, repeat(END)), np.int64, len(found))
            if not whole:
                for k in np.flatnonzero(ids == END).tolist():
                    if found[k] != _MARK:
                        ids[k] = _hash_id(lang, found[k])
            held.append(np.r_[ids, END])
            size += len(ids)
            del found, ids
            if size >= WINDOWS:
                yield drain()
    if held:
        yield drain()


def windows(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(w1, ..., w4, n): padded windows, summed within each task."""
    ranks, whole = words.ranks, words.whole
    run = lambda batches: window_tables(batches, ranks.value, whole)
    schema = ", ".join([*(f"{c} long" for c in _COLS), "n long"])
    return _texts(docs).mapInPandas(run, schema)


def phrase_counts(found: DataFrame, least: int, leading: int) -> DataFrame:
    """(w1, ..., w4, k, n): every phrase of 2 to 4 words found ``least`` times or more; k words, then nulls.

    ``found`` are windows; ``leading`` is the first id that can't be in a hot pair.
    """

    def hot(*cols: str) -> Column:
        out = F.lit(True)
        for c in cols:
            out = out & F.col(c).between(0, leading - 1)
        return out

    # more words in the key where fewer could make a hot one; null elsewhere
    spread = found.withColumns({"s3": F.when(hot("w1", "w2"), F.col("w3")), "s4": F.when(hot("w1", "w2", "w3"), F.col("w4"))})
    key = ["w1", "w2", "s3", "s4"]
    dealt = spread.repartition(*key)
    once = dealt.groupBy(*key, "w3", "w4").agg(F.sum("n").alias("n"))
    n3 = F.sum("n").over(Window.partitionBy(*key, "w3"))
    n2 = F.sum("n").over(Window.partitionBy(*key))
    summed = once.withColumn("n3", n3).withColumn("n2", n2)
    # sums are whole only where the key holds no further word; what they can't rule out the rollup counts
    rare2 = (F.col("n2") < least) & ~hot("w1", "w2")
    rare3 = (F.col("n3") < least) & ~hot("w1", "w2", "w3")
    pad = F.lit(PAD).cast("long")
    trimmed = summed.filter(~rare2).select(
        "w1",
        "w2",
        F.when(rare3, pad).otherwise(F.col("w3")).alias("w3"),
        F.when(rare3 | (F.col("n") < least), pad).otherwise(F.col("w4")).alias("w4"),
        "n",
    )
    rolled = found.sparkSession.sql(
        "SELECT w1, w2, w3, w4, sum(n) AS n FROM {trimmed} GROUP BY w1, w2, ROLLUP (w3, w4)", trimmed=trimmed
    ).filter(F.col("n") >= least)
    # a null is a word summed over, a pad the end of a window: neither is a word of a phrase
    for c in ("w3", "w4"):
        rolled = rolled.filter(F.col(c).isNull() | (F.col(c) >= 0))
    length = sum((F.col(c).isNotNull().cast("int") for c in _COLS), F.lit(0))
    return rolled.select(*_COLS, length.alias("k"), "n")


def _key(first: int, count: int) -> Column:
    """Words ``first`` to ``first + count - 1`` (from 1) of a phrase as a join key."""
    return F.array(*[F.col(f"w{k}") for k in range(first, first + count)])


def scored(phrases: DataFrame) -> DataFrame:
    """(w1, ..., w4, k, a, l, r, score) of every phrase of two words or more; its lowest-scoring cut counts."""
    by_key = phrases.select(F.expr(f"slice(array({', '.join(_COLS)}), 1, k)").alias("key"), "n")
    cuts = [
        F.when(F.col("k") == k, F.array(*[F.struct(F.lit(c).alias("cut"), _key(1, c).alias("lk"), _key(c + 1, k - c).alias("rk")) for c in range(1, k)]))
        for k in range(2, LONGEST + 1)
    ]
    parts = phrases.filter("k >= 2").select(*_COLS, "k", F.col("n").alias("a"), F.explode(F.coalesce(*cuts)).alias("c")).select("*", "c.*").drop("c")
    joined = parts.join(by_key.select(F.col("key").alias("lk"), F.col("n").alias("l")), "lk").join(
        by_key.select(F.col("key").alias("rk"), F.col("n").alias("r")), "rk"
    )
    wide = joined.withColumn("score", F.expr("(cast(2000000 as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r)"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("b")
    return wide.groupBy(*_COLS, "k", "a").agg(best).select(*_COLS, "k", "a", "b.l", "b.r", "b.score")


def not_inside(candidates: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """Candidates but for those inside a longer one that is found ``percent`` of their times or more."""
    inner = [
        F.when(
            F.col("k") == k,
            F.array(*[_key(first, size) for size in range(2, k) for first in range(1, k - size + 2)]),
        )
        for k in range(3, LONGEST + 1)
    ]
    held = phrases.filter("k >= 3").select(F.explode(F.coalesce(*inner)).alias("key"), "n")
    most = held.groupBy("key").agg(F.max("n").alias("longer"))
    own = F.expr(f"slice(array({', '.join(_COLS)}), 1, k)")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    joined = candidates.withColumn("key", own).join(most, "key", "left")
    drop = F.lit(100) * big("longer") >= F.lit(percent) * big("a")
    return joined.filter(~F.coalesce(drop, F.lit(False))).drop("key", "longer")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words."""
    counts = cut_lineage(word_counts(docs))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = vocabulary(counts, least, counts.agg(F.sum("n")).first()[0] or 0, hot)
    none = F.lit(None).cast("long")
    single = words.table.select(F.col("id").alias("w1"), *[none.alias(c) for c in _COLS[1:]], F.lit(1).alias("k"), "n")
    phrases = cut_lineage(phrase_counts(windows(docs, words), least, words.leading).unionByName(single))
    kept = not_inside(scored(phrases), phrases, percent)
    numbered = kept.withColumn("id", F.monotonically_increasing_id())
    placed = cut_lineage(numbered)
    spelt = placed.select("id", F.posexplode(F.expr(f"slice(array({', '.join(_COLS)}), 1, k)")).alias("at", "w"))
    named = spelt.join(words.table.select(F.col("id").alias("w"), "lang", "word"), "w")
    texts = named.groupBy("id").agg(
        F.first("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase")
    )
    whole = placed.join(texts, "id").select("lang", "phrase", "a", "l", "r", "score")
    # first within shares of a language, then over what is left of them: no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", "share").orderBy(*order)
    some = whole.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("at", F.row_number().over(share))
    last = some.filter(F.col("at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
