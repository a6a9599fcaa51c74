"""Masked pseudo-likelihood from a bidirectional window network.

The network's outputs are the corpus's most frequent words, counted over all
documents, and hashed classes of the rarer ones.  For each position the network
sees up to four words on either side, never the word itself: their embeddings,
scaled per place, sum to a hidden layer, and a two-level softmax (group of 64
words, word within it) gives the output's probability.  A rarer word's
probability is its class's times its share of the class, count(word) /
count(class), from the counts of all words: each document's rarer words are
joined to them.  A document's score is the sum of these log-probabilities over
all its words.

Training is data-parallel over all documents.  Their word numbers are written
once, dealt to shards by a hash of doc_id and text; the number of shards follows
the words of the corpus (``shard_words`` each) and rows within a shard are in the
order of the hash, so neither depends on how the table is split.  In each round
every shard starts from the shared parameters and predicts its masked positions;
the shards' parameters are averaged, weighted by positions, in a tree of bounded
groups.  The ``mask`` residues of the positions are dealt over the rounds, so
every position of every document is a target exactly once.

Defined cases: a null text is empty; a document without words scores 0 over 0
words and its mean is null; a word that the counted documents lack is scored as
if it occurred once; repeated rows are scored each; other columns are kept and
never read, but one called as the result is replaced; a table without doc_id is
dealt by its texts alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, free_names
from tessera.llm.words import chunks, words_of_all

GROUP = 64  # words of a group
CLASSES = 64  # hashed classes of rarer words
SIDE = 4
PLACES = [-4, -3, -2, -1, 1, 2, 3, 4]
BATCH = 1024
#: Rows and values of one averaging group.
FAN, SLICE = 32, 8192
#: Words laid out together in training, and tasks of a round at most (beyond, a task trains several shards).
LAID, TASKS = 1 << 18, 100_000


@dataclass
class Vocabulary:
    """Sorted hashes of the kept words, their counts, and the counts of the rarer words' classes.

    Word numbers follow falling counts, so a group holds words of like frequency;
    the classes come last.
    """

    hashes: np.ndarray
    number: np.ndarray
    counts: np.ndarray  # by number, classes included
    counted: DataFrame | None = None  # (w, n): every word's hash and count; stays on the driver

    def __getstate__(self) -> dict:
        return {**self.__dict__, "counted": None}

    def __len__(self) -> int:
        return len(self.counts)

    @property
    def stored(self) -> type:
        """The integers that hold a word number (and the padding's)."""
        return np.uint16 if len(self) < 1 << 16 else np.uint32

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + (hashes % np.uint64(CLASSES)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.number[at[hit]]
        return out


def vocabulary(docs: DataFrame, size: int = 4096) -> Vocabulary:
    """The ``size - CLASSES`` most frequent words of all documents, the rarer words' classes, and the table of all counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for texts in chunks(b["text"], 1 << 22):
                h, n = np.unique(words_of_all(texts)[0].view(np.int64), return_counts=True)
                yield pd.DataFrame({"w": h, "n": n})

    counted = docs.select("text").mapInPandas(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    top = counted.orderBy(F.desc("n"), "w").limit(size - CLASSES).toPandas()  # size - CLASSES rows
    # a class's count is the sum over its words less that of the kept ones; at most CLASSES rows
    klass = F.expr(f"pmod((w >> 32 & 4294967295L) * {pow(2, 32, CLASSES)}L + (w & 4294967295L), {CLASSES}L)")
    every = {r["c"]: r["n"] for r in counted.groupBy(klass.alias("c")).agg(F.sum("n").alias("n")).collect()}
    hashes = top["w"].to_numpy(np.int64).view(np.uint64)
    kept = np.bincount((hashes % np.uint64(CLASSES)).astype(np.int64), top["n"].to_numpy(), CLASSES)
    rest = np.array([every.get(c, 0) for c in range(CLASSES)]) - kept
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order.astype(np.int64), np.r_[top["n"].to_numpy(), rest].astype(float), counted)


@dataclass
class Laid:
    """Texts as word numbers one after the other, SIDE places of padding between them."""

    around: np.ndarray
    place: np.ndarray  # of each word in ``around``
    owner: np.ndarray  # text of each word
    position: np.ndarray  # of each word in its text
    counts: np.ndarray
    hashes: np.ndarray | None = None

    def contexts(self, at) -> np.ndarray:
        return self.around[self.place[at][:, None] + np.array(PLACES)]

    def targets(self, at) -> np.ndarray:
        return self.around[self.place[at]]


def lay_numbers(numbers: np.ndarray, counts: np.ndarray, padding: int, hashes: np.ndarray | None = None) -> Laid:
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(numbers)) + SIDE * (owner + 1)
    around = np.full(len(numbers) + SIDE * (len(counts) + 1), padding)
    around[place] = numbers
    position = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
    return Laid(around, place, owner, position, counts, hashes)


def lay_out(texts: list[str | None], words: Vocabulary) -> Laid:
    hashes, counts = words_of_all(texts)
    return lay_numbers(words.numbers(hashes), counts, len(words), hashes)


@dataclass
class Net:
    embed: np.ndarray  # words + 1 (padding) x d
    place: np.ndarray  # places x d
    bias: np.ndarray  # d
    group: np.ndarray  # d x groups
    group_bias: np.ndarray
    word: np.ndarray  # groups x d x GROUP
    word_bias: np.ndarray  # groups x GROUP

    NAMES = ("embed", "place", "bias", "group", "group_bias", "word", "word_bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32)

    def filled(self, values: np.ndarray) -> Net:
        out, at = [], 0
        for n in self.NAMES:
            a = getattr(self, n)
            out.append(values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Net(*out)


def fresh(words: Vocabulary, d: int = 32, seed: int = 3) -> Net:
    """Small random weights; output biases are the unigram log-counts, so it starts as a unigram model."""
    rng = np.random.default_rng(seed)
    n = len(words)
    groups = math.ceil(n / GROUP)
    counts = np.full(groups * GROUP, 1e-9)
    counts[:n] = words.counts + 0.5
    by_group = counts.reshape(groups, GROUP)
    embed = rng.normal(0, 0.3, (n + 1, d))
    embed[n] = 0
    return Net(
        *[
            a.astype(np.float32)
            for a in (
                embed,
                np.ones((2 * SIDE, d)),
                np.zeros(d),
                rng.normal(0, 0.05, (d, groups)),
                np.log(by_group.sum(1) / by_group.sum()),
                rng.normal(0, 0.05, (groups, d, GROUP)),
                np.log(by_group / by_group.sum(1, keepdims=True)),
            )
        ]
    )


def hidden(net: Net, ctx: np.ndarray) -> np.ndarray:
    return np.tanh(np.einsum("bpd,pd->bd", net.embed[ctx], net.place) + net.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    """The softmax of each row, made in place."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place; the exponentials are made in place."""
    own = z[np.arange(len(z)), at]
    top = z.max() if len(z) else 0.0
    if top - z.min() < 60:  # one shift for all rows cannot underflow a whole row
        z -= top
        shift = top
    else:
        shift = z.max(1)
        z -= shift[:, None]
    np.exp(z, out=z)
    return own - shift - np.log(z.sum(1))


def log_probabilities(net: Net, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    g, w = np.divmod(target, GROUP)
    order = np.argsort(g, kind="stable")  # words of one group lie together
    g, w = g[order], w[order]
    h = hidden(net, ctx[order])
    share = _log_share(h @ net.group + net.group_bias, g)
    cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            k = g[a]
            share[a:b] += _log_share(h[a:b] @ net.word[k] + net.word_bias[k], w[a:b])
    out = np.empty_like(share)
    out[order] = share
    return out


class Trainer:
    """Adagrad over batches of masked positions."""

    def __init__(self, net: Net, rate: float):
        self.net, self.rate = Net(*[getattr(net, n).copy() for n in Net.NAMES]), rate
        self.sum = Net(*[np.full_like(getattr(net, n), 1e-2) for n in Net.NAMES])

    def _step(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        s, p = getattr(self.sum, name), getattr(self.net, name)
        s[rows] += grad * grad
        p[rows] -= self.rate * grad / np.sqrt(s[rows])

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        scale = np.float32(1.0 / math.sqrt(n))
        g, w = np.divmod(target, GROUP)
        order = np.argsort(g, kind="stable")  # words of one group lie together
        g, w, ctx, at = g[order], w[order], ctx[order], np.arange(n)
        seen = net.embed[ctx]
        h = np.tanh(np.einsum("bpd,pd->bd", seen, net.place) + net.bias)
        dz = _softmax(h @ net.group + net.group_bias)
        dz[at, g] -= 1
        dh = dz @ net.group.T
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), n]
        ks = g[cuts[:-1]]
        dw = net.word_bias[g]
        for a, b, k in zip(cuts, cuts[1:], ks.tolist()):
            dw[a:b] += h[a:b] @ net.word[k]
        dw = _softmax(dw)
        dw[at, w] -= 1
        word = np.empty((len(ks), *net.word.shape[1:]), np.float32)
        for i, (a, b, k) in enumerate(zip(cuts, cuts[1:], ks.tolist())):
            dh[a:b] += dw[a:b] @ net.word[k].T
            np.matmul(h[a:b].T, dw[a:b], out=word[i])
        self._step("group", h.T @ dz * scale)
        self._step("group_bias", dz.sum(0) * scale)
        self._step("word", word * scale, ks)
        self._step("word_bias", np.add.reduceat(dw, cuts[:-1]) * scale, ks)
        da = dh * (1 - h * h)
        de = (da[:, None, :] * net.place).reshape(-1, da.shape[1])
        self._step("place", np.einsum("bd,bpd->pd", da, seen) * scale)
        self._step("bias", da.sum(0) * scale)
        # 16-bit keys sort in linear time
        flat = ctx.ravel().astype(np.uint16 if len(net.embed) <= 1 << 16 else np.int64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        rows, total = flat[first].astype(np.int64), np.add.reduceat(de[order], first) * scale
        real = rows < len(net.embed) - 1
        self._step("embed", total[real], rows[real])


def _averaged(parts: DataFrame, partitions: int) -> DataFrame:
    """(part, slice, n, values) -> one row per slice: means weighted by n, in groups of at most FAN rows."""

    def mean(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("part")  # sums in one order
        n = d["n"].to_numpy()
        each = [np.frombuffer(v, np.float32) for v in d["values"]]
        value = sum(float(k) * v.astype(float) for k, v in zip(n, each)) / max(1, n.sum())
        first = d.iloc[0]
        return pd.DataFrame(
            {"part": [int(first["part"]) // FAN], "slice": [int(first["slice"])], "n": [int(n.sum())], "values": [value.astype(np.float32).tobytes()]}
        )

    levels = max(1, math.ceil(math.log(max(2, partitions), FAN)))
    for _ in range(levels):
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("_group"), F.col("slice").alias("_slice")).applyInPandas(
            mean, "part long, slice int, n long, values binary"
        )
    return parts


def dealt(docs: DataFrame, words: Vocabulary, shard_words: int) -> tuple[DataFrame, int]:
    """(shard, h, numbers): the word numbers of every text with words, written in the shards' order; and the number of shards."""
    shards = max(1, math.ceil(words.counts.sum() / shard_words))
    known = docs.sparkSession.sparkContext.broadcast(words)
    by = [c for c in ("doc_id", "text") if c in docs.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = known.value
        for b in batches:
            h, at = b["h"].to_numpy(), 0
            for texts in chunks(b["text"]):
                hashes, counts = words_of_all(texts)
                each = np.split(words.numbers(hashes).astype(words.stored), np.cumsum(counts)[:-1])
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"h": h[at + some], "numbers": [each[i].tobytes() for i in some]})
                at += len(texts)

    rows = docs.select(F.xxhash64(*by).alias("h"), "text").mapInPandas(run, "h long, numbers binary")
    rows = rows.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "numbers")
    rows = rows.repartitionById(min(shards, TASKS), "shard").sortWithinPartitions("shard", "h", "numbers")
    return cut_lineage(rows), shards


def _together(rows: Iterable[np.ndarray], size: int = LAID) -> Iterator[list[np.ndarray]]:
    """Consecutive rows of about ``size`` words together."""
    held, n = [], 0
    for x in rows:
        held.append(x)
        n += len(x)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(
    docs: DataFrame, words: Vocabulary, rounds: int = 2, mask: int = 16, rate: float = 0.15, shard_words: int = 1 << 21
) -> Net:
    net, padding, stored = fresh(words), len(words), words.stored
    sc = docs.sparkSession.sparkContext
    rows, shards = dealt(docs, words, shard_words)
    for r in range(rounds):
        shared = sc.broadcast(net)

        def run(batches: Iterator[pd.DataFrame], r: int = r, shared=shared) -> Iterator[pd.DataFrame]:
            every = (x for b in batches for x in zip(b["shard"].tolist(), b["numbers"]))
            for shard, own in groupby(every, itemgetter(0)):
                trainer, n = Trainer(shared.value, rate), 0
                for some in _together(np.frombuffer(x, stored) for _, x in own):
                    laid = lay_numbers(np.concatenate(some), np.array([len(x) for x in some]), padding)
                    # the residues of this round; over all rounds each position comes once
                    at = np.flatnonzero((laid.position + laid.counts[laid.owner]) % mask % rounds == r)
                    n += len(at)
                    for i in range(0, len(at), BATCH):
                        batch = at[i : i + BATCH]
                        trainer.step(laid.contexts(batch), laid.targets(batch))
                if n:
                    flat = trainer.net.flat()
                    cut = range(0, len(flat), SLICE)
                    yield pd.DataFrame(
                        {"part": shard, "slice": list(range(len(cut))), "n": n, "values": [flat[i : i + SLICE].tobytes() for i in cut]}
                    )

        parts = rows.select("shard", "numbers").mapInPandas(run, "part long, slice int, n long, values binary")
        got = _averaged(parts, shards).collect()  # one set of parameters
        if got:
            got.sort(key=lambda x: x["slice"])
            net = net.filled(np.concatenate([np.frombuffer(x["values"], np.float32) for x in got]))
        shared.destroy()
    return net


def score_laid(net: Net, laid: Laid, block: int = 8192) -> np.ndarray:
    """The sum of each text's log-probabilities, a rarer word taken as its class."""
    n = len(laid.counts)
    sums = np.zeros(n)
    for i in range(0, len(laid.place), block):
        at = slice(i, i + block)
        p = log_probabilities(net, laid.contexts(at), laid.targets(at))
        sums += np.bincount(laid.owner[at], p, n)
    return sums


def score_texts(net: Net, words: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and the sum of their log-probabilities, a rarer word taken as its class."""
    laid = lay_out(texts, words)
    return laid.counts, score_laid(net, laid)


def rare_words(laid: Laid, words: Vocabulary) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text: the sum of its rarer words' log class counts, those words' hashes, and how often each occurs."""
    n, kept = len(laid.counts), len(words.hashes)
    number = laid.around[laid.place]
    at = np.flatnonzero(number >= kept)
    of_class = np.bincount(laid.owner[at], np.log(np.maximum(words.counts, 1))[number[at]], n)
    owner, h = laid.owner[at], laid.hashes[at].view(np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (h[1:] != h[:-1])][: len(h)])
    times = np.diff(np.r_[new, len(h)])
    cuts = np.searchsorted(owner[new], np.arange(1, n))
    return of_class, np.split(h[new], cuts), np.split(times, cuts)


SCORED = "n_words long, log_likelihood double, w array<long>, n array<int>"


def with_score(docs: DataFrame, words: Vocabulary, net: Net, name: str = "lm", keep: list[str] | None = None) -> DataFrame:
    """Documents (all columns or those to ``keep``) with a struct (n_words, log_likelihood)."""
    shared = docs.sparkSession.sparkContext.broadcast((words, net))

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, net = shared.value
        for batch in batches:
            parts: list[list] = [[], [], [], []]
            for texts in chunks(batch):
                laid = lay_out(texts, words)
                of_class, w, n = rare_words(laid, words)
                for part, values in zip(parts, (laid.counts, score_laid(net, laid) - of_class, w, n)):
                    part.extend(values)
            yield pd.DataFrame(dict(zip(("n_words", "log_likelihood", "w", "n"), parts)))

    columns = docs.columns if keep is None else keep
    own, row, log = free_names(docs, "own", "row", "log")
    rows = docs.select(*columns, score("text").alias(own), F.monotonically_increasing_id().alias(row))
    rows = cut_lineage(rows)  # the row numbers must not be dealt twice
    rare = rows.select(row, F.explode(F.arrays_zip(f"{own}.w", f"{own}.n")).alias("r")).select(row, "r.w", "r.n")
    # a word that occurs once adds log(1); the most frequent words are outputs, so no word here is a hot key
    often = words.counted.filter("n > 1").select("w", F.log("n").alias("share"))
    shares = rare.join(often, "w").groupBy(row).agg(F.sum(F.col("n") * F.col("share")).alias(log))
    total = F.col(f"{own}.log_likelihood") + F.coalesce(log, F.lit(0.0))
    lm = F.struct(F.col(f"{own}.n_words").alias("n_words"), total.alias("log_likelihood"))
    return rows.join(shares, row, "left").withColumn(name, lm).drop(own, row, log)
