"""Multi-output random forests on binned features (MOD2): one forest per target,
grown to pure leaves, all targets and trees together.

Rows carry their own bootstrap weights, drawn from (seed, key, tree) and shared by
the targets.  While a node holds more than ``node_rows`` rows, it is split by
histograms: every task adds up (count, sum) per bin of the node's drawn features
for all trees at once, Spark sums them, and one pass over the rows is one level.
A node of fewer rows goes to one task, which grows what is left of its tree; where
that already holds for the root, a tree's rows travel once for all targets.
Splits are told apart by bins of equal frequency, at most ``BINS`` a feature.

A node is split by the drawn feature and bin of the largest gain in squared error
(ties: the first); where none of the drawn features can split it, all are tried.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import fine_uniform
from tessera.operators.ridge import _matrix
from tessera.session import cut_lineage

#: Bins of a feature.
BINS = 64
#: Rows of a node that one task holds.
NODE_ROWS = 1 << 19
#: Bytes of histograms that a task holds in one pass.
HISTOGRAM_BYTES = 64 << 20
#: Rows of trees that grow together.
TOGETHER = 1 << 17
#: Bytes of binned rows that tasks get whole.
ROW_BYTES = 64 << 20
#: Cumulative probabilities of a Poisson draw with mean 1, for 0 to 7 copies of a row.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8))


@dataclass
class Tree:
    """Nodes as arrays: ``feature`` is -1 at a leaf, rows with bin <= ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            r, n = rows[inner], at[inner]
            low = x[r, self.feature[n]] <= self.bin[n]
            at[r] = np.where(low, self.left[n], self.right[n])


def cut_points(rows: DataFrame, x: str = "x") -> list[np.ndarray]:
    """At most ``BINS`` - 1 values per feature, the upper ends of its bins."""
    share = [k / BINS for k in range(1, BINS)]
    cells = rows.select(F.posexplode(x).alias("j", "v"))
    got = cells.groupBy("j").agg(F.array_distinct(F.percentile_approx("v", share, 10_000)).alias("c")).orderBy("j").collect()
    return [np.array(sorted(r["c"])) for r in got]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


def bootstrap(key: Column, trees: int, seed: int) -> Column:
    """How often each tree draws the row: an array of Poisson counts."""

    def draws(k: Column) -> Column:
        u = fine_uniform(seed, key, k)
        return sum(((u >= F.lit(c)).cast("int") for c in POISSON), F.lit(0)).cast("byte")

    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), draws)


def _drawn(seed: int, tree: tuple[int, int], node: int, features: int, share: int) -> np.ndarray:
    """The features a node may be split by."""
    return np.random.default_rng([seed, *tree, node]).permutation(features)[:share]


_U32, _LOW = np.uint32, np.uint64(0xFFFFFFFF)
_STEP_HIGH, _STEP_LOW = np.uint64(0x2360ED051FC65DA4), np.uint64(0x4385DF649FCCF645)
_STEP = _STEP_LOW & _LOW, _STEP_LOW >> np.uint64(32)


def _words(value: int) -> list[int]:
    out = [value & 0xFFFFFFFF]
    while value := value >> 32:
        out.append(value & 0xFFFFFFFF)
    return out


def _seeded(entropy: list[np.ndarray]) -> list[np.ndarray]:
    """The eight words that ``SeedSequence`` makes of each column of 32-bit words."""
    const = 0x43B0D7E5

    def hashed(v: np.ndarray) -> np.ndarray:
        nonlocal const
        v = v ^ _U32(const)
        const = const * 0x931E8875 & 0xFFFFFFFF
        v = v * _U32(const)
        return v ^ (v >> _U32(16))

    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = a * _U32(0xCA01F9DD) - b * _U32(0x4973F715)
        return r ^ (r >> _U32(16))

    zero = np.zeros_like(entropy[-1])
    pool = [hashed(entropy[i] if i < len(entropy) else zero) for i in range(4)]
    for src in range(4):
        for dst in range(4):
            if src != dst:
                pool[dst] = mixed(pool[dst], hashed(pool[src]))
    for more in entropy[4:]:
        for dst in range(4):
            pool[dst] = mixed(pool[dst], hashed(more))
    const, out = 0x8B51F9DD, []
    for i in range(8):
        v = pool[i % 4] ^ _U32(const)
        const = const * 0x58F38DED & 0xFFFFFFFF
        v = v * _U32(const)
        out.append(v ^ (v >> _U32(16)))
    return out


def _stepped(low: np.ndarray, high: np.ndarray, inc_low: np.ndarray, inc_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """state x multiplier + inc; numbers of 128 bits are two of 64."""
    half = np.uint64(32)
    a, b = low & _LOW, low >> half
    c, d = b * _STEP[0], a * _STEP[1]
    middle = (a * _STEP[0] >> half) + (c & _LOW) + (d & _LOW)
    up = b * _STEP[1] + (c >> half) + (d >> half) + (middle >> half)
    up += low * _STEP_HIGH + high * _STEP_LOW + inc_high
    out = low * _STEP_LOW + inc_low
    up += out < inc_low
    return out, up


#: Nodes whose draws are made at once.
DRAWS = 1 << 14


def drawn_of_level(seed: int, tree: tuple[np.ndarray | int, int], numbers: np.ndarray, features: int, share: int) -> np.ndarray:
    """:func:`_drawn` of many nodes at once, by the same generator step by step; ``numbers`` has the
    32-bit words of each node's number, the lowest first, and the target may be one for each node."""
    count = numbers.shape[1]
    if count > DRAWS:
        parts = [slice(k, k + DRAWS) for k in range(0, count, DRAWS)]
        return np.concatenate([drawn_of_level(seed, (tree[0] if np.ndim(tree[0]) == 0 else tree[0][at], tree[1]), numbers[:, at], features, share) for at in parts])
    fill = lambda v: [np.full(count, w, np.uint32) for w in _words(v)]
    target = fill(tree[0]) if np.ndim(tree[0]) == 0 else [tree[0].astype(np.uint32)]
    words = [w.astype(np.uint64) for w in _seeded([*fill(seed), *target, *fill(tree[1]), *numbers])]
    # the start and the increment, the high half of each first
    start_high, start_low, way_high, way_low = (words[k] | words[k + 1] << np.uint64(32) for k in (0, 2, 4, 6))
    one = np.uint64(1)
    inc_low, inc_high = way_low << one | one, way_high << one | way_low >> np.uint64(63)
    low = inc_low + start_low  # a step from 0 is the increment
    low, high = _stepped(low, inc_high + start_high + (low < inc_low), inc_low, inc_high)
    kept, has = np.zeros(count, np.uint64), np.zeros(count, bool)
    order = np.tile(np.arange(features), (count, 1))
    for i in range(features - 1, 0, -1):
        mask = np.uint64((1 << i.bit_length()) - 1)
        j, todo = np.zeros(count, np.int64), np.arange(count)
        while len(todo):
            old = has[todo]
            value = kept[todo]
            new = todo[~old]
            if len(new):
                now, up = _stepped(*((v[new] for v in (low, high, inc_low, inc_high)) if len(new) < count else (low, high, inc_low, inc_high)))
                low[new], high[new] = now, up
                turn = up >> np.uint64(58)
                mixed = now ^ up
                out = mixed >> turn | mixed << ((np.uint64(64) - turn) & np.uint64(63))
                value[~old] = out & _LOW
                kept[new] = out >> np.uint64(32)
            has[todo] = ~old
            value = value & mask
            fine = value <= np.uint64(i)
            j[todo[fine]] = value[fine].astype(np.int64)
            todo = todo[~fine]
        at = np.arange(count)
        order[at, i], order[at, j] = order[at, j], order[at, i].copy()
    return order[:, :share]


def _children(numbers: np.ndarray) -> np.ndarray:
    """Words of 2 n and 2 n + 1 of every number, one after the other."""
    up = numbers << _U32(1)
    up[1:] |= numbers[:-1] >> _U32(31)
    if (numbers[-1] >> _U32(31)).any():
        up = np.vstack([up, numbers[-1:] >> _U32(31)])
    out = np.repeat(up, 2, axis=1)
    out[0, 1::2] |= _U32(1)
    return out


def _best(hist: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature position, bin) of the best split of a (2, features, bins) histogram of counts and sums."""
    n, s = hist[0].cumsum(axis=1), hist[1].cumsum(axis=1)
    total_n, total_s = n[:, -1:], s[:, -1:]
    right_n = total_n - n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s**2 / n + (total_s - s) ** 2 / right_n - total_s**2 / total_n
    gain[(n <= 0) | (right_n <= 0)] = -np.inf
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if np.isfinite(gain[f, b]) else None


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, share: int, seed: int, tree: tuple[int, int], root: int = 1) -> Tree:
    """The tree of these rows, level by level; all nodes of a level are split by one sorted pass.

    ``root`` numbers the root among the nodes of the whole tree (children of i are
    2 i and 2 i + 1), which seeds the draws of its features.
    """
    return grow_all(x, y[:, None], w, share, seed, [tree[0]], tree[1], root)[0]


def grow_all(x: np.ndarray, ys: np.ndarray, w: np.ndarray, share: int, seed: int, targets: list[int], k: int, root: int = 1) -> list[Tree]:
    """The trees ``k`` of some targets, level by level together: only the draws are made for all at once."""
    growing = [_growing(x, np.ascontiguousarray(ys[:, t]), w, share, root) for t in range(ys.shape[1])]
    out: list[Tree | None] = [None] * len(growing)
    asked = {}
    for t, g in enumerate(growing):
        try:
            asked[t] = next(g)
        except StopIteration as end:
            out[t] = end.value
    while asked:
        numbers = list(asked.values())  # nodes of one level have numbers of one length
        target = np.repeat(np.array([targets[t] for t in asked]), [n.shape[1] for n in numbers])
        picked = drawn_of_level(seed, (target, k), np.hstack(numbers), x.shape[1], share)
        start, nxt = 0, {}
        for t, n in asked.items():
            try:
                nxt[t] = growing[t].send(picked[start : start + n.shape[1]])
            except StopIteration as end:
                out[t] = end.value
            start += n.shape[1]
        asked = nxt
    return out


def _growing(x: np.ndarray, y: np.ndarray, w: np.ndarray, share: int, root: int) -> Generator[np.ndarray, np.ndarray, Tree]:
    """Grows a tree; yields the numbers of a level's nodes to be split, gets their features."""
    p = x.shape[1]
    feature, cut, left, value = [], [], [], []  # by level
    spot = np.zeros(len(y), np.int64)  # each row's place among the nodes of the level
    rows = np.arange(len(y))
    numbers, made = np.array([[w] for w in _words(root)], np.uint32), 0
    while len(rows):
        count = numbers.shape[1]
        wn, ws = np.bincount(spot, w[rows], count), np.bincount(spot, w[rows] * y[rows], count)
        low, high = np.full(count, np.inf), np.full(count, -np.inf)
        np.minimum.at(low, spot, y[rows])
        np.maximum.at(high, spot, y[rows])
        split_f, split_b = np.full(count, -1), np.zeros(count, np.int64)
        for wide in (False, True):
            todo = np.flatnonzero((high > low) & (split_f < 0))
            if not len(todo) or (wide and share >= p):
                continue
            m = p if wide else share
            picked = np.tile(np.arange(p), (len(todo), 1)) if wide else (yield numbers[:, todo])
            place = np.full(count, -1)
            place[todo] = np.arange(len(todo))
            mine = place[spot] >= 0
            split_f[todo], split_b[todo] = _level_splits(x, y, w, rows[mine], place[spot[mine]], picked, m)
        split = split_f >= 0
        child = np.cumsum(split) - 1  # the place of a node's children is twice this
        feature.append(split_f)
        cut.append(split_b)
        left.append(np.where(split, made + count + 2 * child, 0))
        value.append(ws / wn)
        made += count
        stays = split[spot]
        rows, spot = rows[stays], spot[stays]
        goes_left = x[rows, split_f[spot]] <= split_b[spot]
        spot = 2 * child[spot] + np.where(goes_left, 0, 1)
        numbers = _children(numbers[:, split])
    if not made:
        return Tree(np.array([-1]), np.array([0]), np.array([0]), np.array([0]), np.array([0.0]))
    feature, cut, left, value = (np.concatenate(v) for v in (feature, cut, left, value))
    return Tree(feature, cut, left, np.where(feature >= 0, left + 1, 0), value)


#: Cells (rows x features) of a level that are sorted at once; nodes of many rows are added up by bins.
LEVEL_CELLS = 1 << 21


def _level_splits(x, y, w, r, a, picked, m) -> tuple[np.ndarray, np.ndarray]:
    """(features, bins) of the best split of each node, -1 where there is none; rows ``r`` lie in nodes ``a``."""
    if len(r) * m <= LEVEL_CELLS:
        return _sorted_splits(x, y, w, r, a, picked, m)
    f, b = np.full(len(picked), -1), np.zeros(len(picked), np.int64)
    order = np.argsort(a, kind="stable")
    r, a = r[order], a[order]
    ends = np.cumsum(np.bincount(a, minlength=len(picked)))
    start, node = 0, 0
    while node < len(picked):
        if (ends[node] - start) * m > LEVEL_CELLS // 8:
            f[node], b[node] = _summed_split(x, y, w, r[start : ends[node]], picked[node])
            start, node = ends[node], node + 1
            continue
        last = max(int(np.searchsorted(ends, start + LEVEL_CELLS // m, "right")), node + 1)
        at = slice(start, ends[last - 1])
        f[node:last], b[node:last] = _sorted_splits(x, y, w, r[at], a[at] - node, picked[node:last], m)
        start, node = ends[last - 1], last
    return f, b


def _summed_split(x, y, w, r, picked) -> tuple[int, int]:
    hist = np.zeros((2, len(picked), BINS))
    wr, ws = w[r].astype(float), w[r] * y[r]
    for k, f in enumerate(picked):
        bins = x[r, f]
        hist[0, k], hist[1, k] = np.bincount(bins, wr, BINS), np.bincount(bins, ws, BINS)
    found = _best(hist)
    return (int(picked[found[1]]), found[2]) if found else (-1, 0)


def _sorted_splits(x, y, w, r, a, picked, m) -> tuple[np.ndarray, np.ndarray]:
    nodes = len(picked)
    key = ((a[:, None] * m + np.arange(m)) * BINS + x[r[:, None], picked[a]]).ravel()
    # a sort of (key, place) in one number: equal keys stay in their order
    bits = max(len(key) - 1, 1).bit_length()
    both = np.sort(key << bits | np.arange(len(key)))
    key, order = both >> bits, both & ((1 << bits) - 1)
    wn = np.repeat(w[r], m)[order].astype(float)
    ws = np.repeat(w[r] * y[r], m)[order]
    end = np.flatnonzero(np.r_[key[1:] != key[:-1], True])  # last row of each bin
    seg = key[end] // BINS
    n, s = np.cumsum(wn)[end], np.cumsum(ws)[end]
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    length = np.diff(np.r_[first, len(seg)])
    before = lambda v: np.repeat(np.r_[0.0, v[first[1:] - 1]], length)
    whole = lambda v: np.repeat(v[first + length - 1], length)
    bn, bs = before(n), before(s)
    ln, ls = n - bn, s - bs
    tn, ts = whole(n) - bn, whole(s) - bs
    rn = tn - ln
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ls**2 / ln + (ts - ls) ** 2 / rn - ts**2 / tn
    gain[np.r_[seg[1:] != seg[:-1], True]] = -np.inf  # the last bin leaves nothing on the right
    node = seg // m
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.maximum.reduceat(gain, start)
    hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[start, len(node)])))
    chosen = hit[np.unique(node[hit], return_index=True)[1]]
    chosen = chosen[np.isfinite(gain[chosen])]
    f, b, k = np.full(nodes, -1), np.zeros(nodes, np.int64), node[chosen]
    f[k], b[k] = picked[k, seg[chosen] % m], key[end[chosen]] % BINS
    return f, b


@dataclass
class Forests:
    """``table`` holds (target, tree, node, blob): a subtree from each node of the tops down."""

    table: DataFrame
    tops: dict[tuple[int, int], Tree]
    cuts: list[np.ndarray]
    targets: int
    trees: int


def _top_leaves(tops: dict, tree: tuple[int, int], x: np.ndarray) -> np.ndarray:
    """Number (root 1, children 2 i and 2 i + 1) of each row's leaf in the top of a tree."""
    splits = tops.get(tree)
    at = np.ones(len(x), np.int64)
    if not splits:
        return at
    todo = np.arange(len(x))
    while len(todo):
        keep = []
        for node in np.unique(at[todo]).tolist():
            if node in splits:
                mine = todo[at[todo] == node]
                f, b = splits[node]
                at[mine] = 2 * node + (x[mine, f] > b)
                keep.append(mine)
        todo = np.concatenate(keep) if keep else np.empty(0, np.int64)
    return at


def fit_forests(
    rows: DataFrame, key: str = "sample_id", x: str = "x", y: str = "y", trees: int = 100, share: float = 0.33, seed: int = 42,
    node_rows: int = NODE_ROWS,
) -> Forests:
    """Forests of every position of ``y`` on the positions of ``x``."""
    spark = rows.sparkSession
    cuts = cut_points(rows, x)
    head = rows.select(F.size(x).alias("p"), F.size(y).alias("t")).first()
    if head is None:
        raise ValueError("forest fit: no training rows")
    p, targets = head["p"], head["t"]
    drawn = max(1, int(share * p))
    data = cut_lineage(rows.select(F.col(x).alias("x"), F.col(y).alias("y"), bootstrap(F.col(key), trees, seed).alias("w")))
    sizes = data.select(F.posexplode("w").alias("k", "w")).groupBy("k").agg(F.count_if(F.col("w") > 0).alias("n")).collect()
    # the splits of nodes too large for one task, by tree; a small table
    tops: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    large = [(t, r["k"], 1) for r in sizes if r["n"] > node_rows for t in range(targets)]
    while large:
        large = _split_large(data, large, tops, cuts, drawn, seed, node_rows)
    if not tops:
        return Forests(_whole_trees(data, cuts, drawn, seed, trees), tops, cuts, targets, trees)
    shared = spark.sparkContext.broadcast(pickle.dumps(tops))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(shared.value)
        for b in batches:
            xb, ys, ws = binned(_matrix(b["x"]), cuts), _matrix(b["y"]), _matrix(b["w"])
            for k in range(trees):
                at = np.flatnonzero(ws[:, k] > 0)
                for t in range(targets):
                    node = _top_leaves(own, (t, k), xb[at])
                    order = np.argsort(node, kind="stable")
                    names, first = np.unique(node[order], return_index=True)
                    parts = np.split(at[order], first[1:])
                    blobs = {"x": [xb[i].tobytes() for i in parts], "y": [ys[i, t].tobytes() for i in parts], "w": [ws[i, k].astype(np.uint8).tobytes() for i in parts]}
                    yield pd.DataFrame({"target": t, "tree": k, "node": names, **(blobs if len(at) else {c: [] for c in "xyw"})})

    def one(d: pd.DataFrame) -> pd.DataFrame:
        t, k, node = (int(d[c].iloc[0]) for c in ("target", "tree", "node"))
        xb, y, w = _unpacked(d["x"], d["y"], d["w"], 1, p)
        grown = grow(xb, y[:, 0], w, drawn, seed, (t, k), node)
        return pd.DataFrame({"target": [t], "tree": [k], "node": [node], "blob": [_packed_tree(grown)]})

    dealt = data.mapInPandas(deal, "target int, tree int, node long, x binary, y binary, w binary")
    grown = dealt.groupBy("target", "tree", "node").applyInPandas(one, "target int, tree int, node long, blob binary")
    return Forests(grown, tops, cuts, targets, trees)


def _unpacked(x, y, w, targets: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, targets and weights of the rows in lists of bytes."""
    w = np.frombuffer(b"".join(w), np.uint8).astype(float)
    return np.frombuffer(b"".join(x), np.uint8).reshape(len(w), p), np.frombuffer(b"".join(y)).reshape(len(w), targets), w


def _packed_tree(t: Tree) -> bytes:
    """``right`` is one behind ``left``."""
    return pickle.dumps((t.feature.astype(np.int16), t.bin.astype(np.uint8), t.left.astype(np.int32), t.value))


def _unpacked_tree(blob: bytes) -> Tree:
    feature, cut, left, value = pickle.loads(blob)
    return Tree(feature, cut, left, left + 1, value)


def _whole_trees(data: DataFrame, cuts: list[np.ndarray], drawn: int, seed: int, trees: int) -> DataFrame:
    """Every target's trees where a tree's rows fit into one task: the rows travel once a tree, as bytes."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            xb, ys, ws = binned(_matrix(b["x"]), cuts), _matrix(b["y"]), _matrix(b["w"])
            parts = [np.flatnonzero(ws[:, k] > 0) for k in range(trees)]
            yield pd.DataFrame({
                "k": range(trees), "targets": ys.shape[1], "x": [xb[i].tobytes() for i in parts], "y": [ys[i].tobytes() for i in parts],
                "w": [ws[i, k].astype(np.uint8).tobytes() for k, i in enumerate(parts)],
            })

    def one(d: pd.DataFrame) -> pd.DataFrame:
        k, targets = int(d["k"].iloc[0]), int(d["targets"].iloc[0])
        # sums of squares depend on the order of rows only in the last bits, but ties are settled by them
        xb, ys, w = _unpacked(d["x"], d["y"], d["w"], targets, len(cuts))
        order = np.lexsort((*ys.T, w))
        xb, ys, w = xb[order], ys[order], w[order]
        # the targets that a batch grows together hold no more rows than one large one
        some = max(1, TOGETHER // max(len(w), 1))
        blobs = [_packed_tree(g) for t in range(0, targets, some) for g in grow_all(xb, ys[:, t : t + some], w, drawn, seed, list(range(t, min(t + some, targets))), k)]
        return pd.DataFrame({"target": range(len(blobs)), "tree": k, "node": 1, "blob": blobs})

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield pa.RecordBatch.from_pandas(one(pa.Table.from_batches(held).to_pandas()), out, preserve_index=False)

    out = pa.schema([("target", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("blob", pa.binary())])
    dealt = data.mapInPandas(deal, "k int, targets int, x binary, y binary, w binary")
    return dealt.repartitionById(trees, "k").mapInArrow(grown, "target int, tree int, node long, blob binary")


def _split_large(data, large, tops, cuts, drawn, seed, node_rows) -> list[tuple[int, int, int]]:
    """Split the given nodes by summed histograms, in as few passes as their size allows; the children still too large."""
    spark = data.sparkSession
    p = len(cuts)
    per_pass = max(1, HISTOGRAM_BYTES // (16 * p * BINS))
    nxt = []
    for start in range(0, len(large), per_pass):
        part = large[start : start + per_pass]
        by_tree: dict[tuple[int, int], list[int]] = {}
        for t, k, node in part:
            by_tree.setdefault((t, k), []).append(node)
        shared = spark.sparkContext.broadcast(pickle.dumps(({k: tops.get(k, {}) for k in by_tree}, by_tree)))

        def add(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, wanted = pickle.loads(shared.value)
            hist: dict[tuple[int, int, int], np.ndarray] = {}
            for b in batches:
                xb, ys, ws = binned(_matrix(b["x"]), cuts), _matrix(b["y"]), _matrix(b["w"])
                flat = xb + np.arange(p) * BINS
                for (t, k), nodes in wanted.items():
                    at = _top_leaves(own, (t, k), xb)
                    for node in nodes:
                        mine = np.flatnonzero((at == node) & (ws[:, k] > 0))
                        if not len(mine):
                            continue
                        w = np.repeat(ws[mine, k], p)
                        cells = flat[mine].ravel()
                        got = np.stack([np.bincount(cells, v, p * BINS) for v in (w, w * np.repeat(ys[mine, t], p), np.repeat(1.0, len(cells)))])
                        hist[t, k, node] = hist.get((t, k, node), 0.0) + got
            for (t, k, node), h in hist.items():
                yield pd.DataFrame({"target": [t], "tree": [k], "node": [node], "h": [h.ravel()]})

        def decide(d: pd.DataFrame) -> pd.DataFrame:
            t, k, node = (int(d[c].iloc[0]) for c in ("target", "tree", "node"))
            h = np.sum(d["h"].to_list(), axis=0).reshape(3, p, BINS)
            picked = _drawn(seed, (t, k), node, p, drawn)
            found = _best(h[:2, picked])
            found = found and (found[0], int(picked[found[1]]), found[2])
            found = found or _best(h[:2])
            if found is None or found[0] <= 0:
                return pd.DataFrame({"target": [t], "tree": [k], "node": [node], "f": [-1], "b": [0], "l": [0], "r": [0]})
            _, f, b = found
            rows = h[2, f]
            lefts = int(rows[: b + 1].sum())
            return pd.DataFrame({"target": [t], "tree": [k], "node": [node], "f": [f], "b": [b], "l": [lefts], "r": [int(rows.sum()) - lefts]})

        sums = data.mapInPandas(add, "target int, tree int, node long, h array<double>")
        splits = sums.groupBy("target", "tree", "node").applyInPandas(decide, "target int, tree int, node long, f int, b int, l long, r long")
        for r in splits.collect():
            if r["f"] < 0:
                continue
            tops.setdefault((r["target"], r["tree"]), {})[r["node"]] = (r["f"], r["b"])
            for side, n in ((0, r["l"]), (1, r["r"])):
                if n > node_rows:
                    nxt.append((r["target"], r["tree"], 2 * r["node"] + side))
    return nxt


def predict_forests(rows: DataFrame, forests: Forests, key: str = "sample_id", x: str = "x", out: str = "pred", block: int = 4096) -> DataFrame:
    """(key, out): the mean over each target's trees.

    Up to ``ROW_BYTES`` of binned rows go to the tasks that grow the trees, so no tree
    is written or shuffled.  More rows meet each tree once: dealt into blocks, they are
    joined by number with the groups of written subtrees.  Only sums per row and target leave a task.
    """
    spark = rows.sparkSession
    cuts, targets, trees = forests.cuts, forests.targets, forests.trees
    kind, count = dict(rows.dtypes)[key], rows.count()
    if count * max(len(cuts), 1) <= ROW_BYTES:
        return _predict_where_grown(cut_lineage(rows.select(F.col(key).alias("id"), F.col(x).alias("x"))), forests).select(F.col("id").alias(key), F.col("pred").alias(out))
    shared = spark.sparkContext.broadcast(pickle.dumps(forests.tops))
    blocks = max(1, -(-count // block))
    cells = rows.select(F.col(key).alias("id"), F.col(x).alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    groups = cut_lineage(forests.table).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(d: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(f):
            return pd.DataFrame({"id": d["id"].iloc[:0], "pred": pd.Series([], dtype=object)})
        own = pickle.loads(shared.value)
        xb = binned(_matrix(d["x"]), cuts)
        total = np.zeros((len(d), targets))
        for (t, k), subtrees in f.groupby(["target", "tree"]):
            at = _top_leaves(own, (t, k), xb)
            for node, blob in zip(subtrees["node"].tolist(), subtrees["blob"]):
                mine = np.flatnonzero(at == node)
                if len(mine):
                    tree = _unpacked_tree(blob)
                    total[mine, t] += tree.value[tree.leaves(xb[mine])]
        return pd.DataFrame({"id": d["id"], "pred": list(total)})

    # a group of trees at a time: sums add up over the groups
    salted = groups.withColumn("part", F.pmod(F.col("tree"), F.lit(16)))
    spread = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    schema = f"id {kind}, pred array<double>"
    sums = spread.groupBy("block", "part").cogroup(salted.groupBy("block", "part")).applyInPandas(run, schema)
    one = sums.select("id", F.posexplode("pred").alias("t", "v")).groupBy("id", "t").agg(F.sum("v").alias("v"))
    mean = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", (F.col("v") / trees).alias("v")))).alias("p"))
    return mean.select(F.col("id").alias(key), F.col("p.v").alias(out))


def _predict_where_grown(rows: DataFrame, forests: Forests) -> DataFrame:
    """(id, pred) of written rows: each task that holds trees adds up what they say of every row."""
    spark, cuts, targets, trees = rows.sparkSession, forests.cuts, forests.targets, forests.trees

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "x": [r.tobytes() for r in binned(_matrix(b["x"]), cuts)]})

    numbered = cut_lineage(rows.withColumn("n", F.monotonically_increasing_id()))
    t = numbered.select("n", "x").mapInPandas(bins, "n long, x binary").toArrow()
    order = np.argsort(t["n"].to_numpy())
    number = t["n"].to_numpy()[order]
    raw = np.frombuffer(b"".join(t["x"].to_pylist()), np.uint8).reshape(len(order), len(cuts))[order]
    shared = spark.sparkContext.broadcast((number, raw, pickle.dumps(forests.tops)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, xb, tops = shared.value
        own, total = pickle.loads(tops), None
        tops_of = {}
        for b in batches:
            for t, k, node, blob in zip(*(b.column(c).to_pylist() for c in ("target", "tree", "node", "blob"))):
                total = np.zeros((len(xb), targets)) if total is None else total
                tree = _unpacked_tree(blob)
                if (t, k) not in own:
                    total[:, t] += tree.value[tree.leaves(xb)]
                    continue
                if tops_of.get("of") != (t, k):
                    tops_of = {"of": (t, k), "at": _top_leaves(own, (t, k), xb)}
                mine = np.flatnonzero(tops_of["at"] == node)
                if len(mine):
                    total[mine, t] += tree.value[tree.leaves(xb[mine])]
        if total is not None:
            for start in range(0, len(total), 1 << 16):
                part = total[start : start + (1 << 16)]
                v = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * targets, part.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(number[start : start + len(part)]), v], ["n", "v"])

    sums = forests.table.mapInArrow(run, "n long, v array<double>")
    cells = numbered.select("id", "n").join(sums, "n")
    # rows of one id add up
    total = cells.groupBy("id").agg(F.array(*[F.sum(F.get("v", F.lit(t))) for t in range(targets)]).alias("v"))
    return cut_lineage(total.select("id", F.transform("v", lambda v: v / trees).alias("pred")))
