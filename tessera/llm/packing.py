"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

One Arrow pass turns each document into pieces of at most ``capacity`` tokens.
Full pieces are sequences of their own; the rest are bin-packing items, dealt by
hash to islands of bounded size.  On an island a population of packings evolves
by grouping crossover: a child takes over whole well-filled bins of one parent,
drops the bins of the other that hold the same documents, and best-fits the
displaced ones.  Between epochs each island sends its elite bins to the next as
patterns of lengths, which that island fills with its own documents of these
lengths.  At the end, items of bins that are not well filled meet on fewer,
merged islands until few are left.

Defined cases: a null text is empty and yields the end id alone; rows that
repeat a doc_id are packed each; a null doc_id is kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, free_names
from tessera.llm.tokens import byte_bpe, public_path

END_ID = 2
#: Items of one island: what one task holds.
ISLAND = 4096
#: Elite bins that an island sends on.
ELITES = 64


def encoder(path: str):
    """text -> ids, the special token's string in a text as its own id."""
    return byte_bpe(path, True)


def default_vocabulary() -> str:
    return public_path("byte_bpe_50k.tiktoken")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be short."""
    first = len(ids) % capacity or capacity
    bounds = [0, *range(first, len(ids) + 1, capacity)]
    raw = ids.astype("<u4")
    return [(k, a, b - a, zlib.crc32(raw[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def split(text: pd.Series) -> pd.Series:
        encode = encoder(path)
        out = []
        for t in text:
            ids = np.array([*encode(t or ""), END_ID], np.int64)
            out.append([dict(zip(("piece", "start", "length", "ids_crc32"), p)) for p in cut(ids, capacity)])
        return pd.Series(out)

    found = docs.select("doc_id", F.explode(split("text")).alias("p"))
    return found.select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32")


# ---- packings: a packing is a list of bins, a bin a tuple of item positions


def best_fit(sizes: list[int], items: list[int], bins: list[tuple], capacity: int) -> list[tuple]:
    """Add ``items`` in the given order, each to the fullest bin that has room."""
    grown = [list(b) for b in bins]
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(grown))
    for i in items:
        s = sizes[i]
        at = bisect_left(room, (s, -1))
        if at == len(room):
            grown.append([i])
            insort(room, (capacity - s, len(grown) - 1))
        else:
            left, k = room.pop(at)
            grown[k].append(i)
            insort(room, (left - s, k))
    return [tuple(b) for b in grown]


def fitness(sizes: list[int], bins: list[tuple], capacity: int) -> float:
    """Mean squared fill: fewer, fuller bins are better."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], into: list[tuple], other: list[tuple], capacity: int, rng: random.Random) -> list[tuple]:
    """Inject well-filled bins of ``other``, drop the bins that clash, best-fit the displaced items."""
    full = [b for b in other if sum(sizes[i] for i in b) >= 0.98 * capacity] or other
    take = rng.sample(full, max(1, len(full) // 4))
    return inject(sizes, into, take, capacity)


def inject(sizes: list[int], into: list[tuple], take: list[tuple], capacity: int) -> list[tuple]:
    taken = {i for b in take for i in b}
    kept, displaced = list(take), []
    # the emptiest bins are opened as well, so that displaced items can regroup
    fill = [sum(sizes[i] for i in b) for b in into]
    low = sorted(fill)[max(0, len(fill) // 20 - 1)] if fill else 0
    for b, f in zip(into, fill):
        if f <= low and f < capacity or not taken.isdisjoint(b):
            displaced += [i for i in b if i not in taken]
        else:
            kept.append(b)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, kept, capacity)


def from_patterns(sizes: list[int], patterns: list[tuple], capacity: int) -> list[tuple]:
    """Bins of own items whose lengths follow the patterns, as far as the items last."""
    free = defaultdict(list)
    for i, s in enumerate(sizes):
        free[s].append(i)
    out = []
    for p in patterns:
        got = []
        for s in p:
            if not free[s]:
                break
            got.append(free[s].pop())
        if len(got) == len(p):
            out.append(tuple(got))
        else:
            for i in got:
                free[sizes[i]].append(i)
    return out


def evolve(
    sizes: list[int],
    start: list[tuple] | None,
    patterns: list[tuple],
    capacity: int,
    generations: int,
    population: int,
    seed: int,
) -> list[tuple]:
    """The best packing found; never worse than best-fit decreasing or ``start``."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool = [best_fit(sizes, order, [], capacity)]
    if start:
        pool.append(start)
    if patterns:
        pool.append(inject(sizes, pool[-1], from_patterns(sizes, patterns, capacity), capacity))
    while len(pool) < population:
        noisy = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
        pool.append(best_fit(sizes, noisy, [], capacity))
    scored = sorted(((fitness(sizes, b, capacity), k, b) for k, b in enumerate(pool)), reverse=True)
    least, born = math.ceil(sum(sizes) / capacity), len(scored)
    for _ in range(generations):
        if len(scored[0][2]) <= least:
            break
        a, b = rng.sample(range(min(len(scored), population)), 2)
        child = crossover(sizes, scored[min(a, b)][2], scored[max(a, b)][2], capacity, rng)
        born += 1
        scored.append((fitness(sizes, child, capacity), born, child))
        scored = sorted(scored, reverse=True)[:population]
    return min((s[2] for s in scored), key=lambda b: (len(b), -fitness(sizes, b, capacity)))


def _evolved(items: DataFrame, capacity: int, generations: int, population: int, seed: int, elites: DataFrame | None) -> DataFrame:
    """(island, item, length, bin) -> the same with the bins of the island's best packing."""
    schema = "island long, item long, length long, bin long"

    def run(items: pd.DataFrame, patterns: list[tuple]) -> pd.DataFrame:
        own = items.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        sizes = own["length"].tolist()
        start = None
        if (own["bin"] >= 0).all():
            groups = defaultdict(list)
            for i, b in enumerate(own["bin"].tolist()):
                groups[b].append(i)
            start = [tuple(g) for g in groups.values()]
        island = int(own["island"].iloc[0])
        best = evolve(sizes, start, patterns, capacity, generations, population, seed * 1_000_003 + island)
        bin_of = np.empty(len(own), np.int64)
        for k, b in enumerate(best):
            bin_of[list(b)] = k
        return own.assign(bin=bin_of)[["island", "item", "length", "bin"]]

    if elites is None:
        return items.groupBy("island").applyInPandas(lambda d: run(d, []), schema)

    def both(d: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("island", "item", "length", "bin")})
        return run(d, [tuple(p) for p in e["lengths"]] if len(e) else [])

    return items.groupBy("island").cogroup(elites.groupBy("island")).applyInPandas(both, schema)


def _bins(items: DataFrame) -> DataFrame:
    return items.groupBy("island", "bin").agg(
        F.sum("length").alias("fill"), F.sort_array(F.collect_list("length"), asc=False).alias("lengths")
    )


def _elites(items: DataFrame, islands: int, capacity: int) -> DataFrame:
    """Each island's exactly filled bins of the most items, addressed to the next island."""
    full = _bins(items).filter(F.col("fill") == capacity)
    top = full.groupBy("island").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("bin").alias("o"), "lengths"))), 1, ELITES).alias("e")
    )
    return top.select(((F.col("island") + 1) % islands).alias("island"), F.explode("e.lengths").alias("lengths"))


def pack(
    parts: DataFrame, capacity: int = 1024, generations: int = 14, population: int = 6, epochs: int = 2, seed: int = 7
) -> DataFrame:
    """Pieces (any columns with ``length``) with sequence_id and offset added.

    Sequence ids are unique, not consecutive.  A column of the pieces that has
    one of these names stays; the added one then has underscores after its name.
    """
    key, own_id, own_at = free_names(parts, "item", "sequence_id", "offset")
    whole = cut_lineage(parts.withColumn(key, F.monotonically_increasing_id()))
    items = whole.filter(F.col("length") < capacity).select(F.col(key).alias("item"), "length")
    n = items.count()
    islands, stage = max(1, math.ceil(n / ISLAND)), 0
    done: list[DataFrame] = []
    rest = items.withColumn("bin", F.lit(-1).cast("long"))
    while n:
        placed = rest.select(F.pmod(F.xxhash64("item", F.lit(stage)), F.lit(islands)).cast("long").alias("island"), "item", "length", "bin")
        state, elites = placed, None
        for epoch in range(epochs):
            state = cut_lineage(_evolved(state, capacity, generations, population, seed + 100 * stage + epoch, elites))
            if islands > 1 and epoch + 1 < epochs:
                elites = _elites(state, islands, capacity)
        numbered = state.join(_bins(state).select("island", "bin", "fill"), ["island", "bin"]).select(
            "item",
            "length",
            (F.lit(stage + 1).cast("long") * (1 << 56) + F.col("island") * (1 << 20) + F.col("bin")).alias("sequence_id"),
            "fill",
        )
        if islands == 1:
            done.append(numbered)
            break
        well = F.col("fill") >= int(0.995 * capacity)
        done.append(numbered.filter(well))
        left = numbered.filter(~well)
        rest = left.select("item", "length", F.lit(-1).cast("long").alias("bin"))
        before, n = n, rest.count()
        stage += 1
        islands = max(1, min(math.ceil(n / ISLAND), islands // 2))
        if n > before // 2 or stage == 6:
            # merging no longer pays: these bins stand as they are
            done.append(left)
            break
    full = whole.filter(F.col("length") >= capacity).select(
        F.col(key), F.col(key).alias(own_id), F.lit(0).cast("long").alias(own_at)
    )
    out = full
    if done:
        every = done[0]
        for d in done[1:]:
            every = every.unionByName(d)
        one = every.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("b"))
        before_item = F.aggregate(F.slice("b", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
        placed = one.select("sequence_id", "b", F.posexplode("b").alias("i", "x")).select(
            F.col("x.item").alias(key), F.col("sequence_id").alias(own_id), before_item.alias(own_at)
        )
        out = full.unionByName(placed)
    return whole.join(out, key).drop(key)
