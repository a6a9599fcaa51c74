"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are 64-bit majority votes over hashed word shingles.  Two that
differ in at most three bits agree on at least two of five blocks, so distinct
fingerprints meet on each pair of blocks (ten keys of 25 or 26 bits).  A bucket
of more than ``CHUNK`` fingerprints is dealt into chunks, and each pair of its
chunks is a cell of its own, so no task holds more than two chunks of a bucket.
Every pair in a cell has its Hamming distance checked in place; only a spanning
forest of the links leaves the task, never all pairs, and components of the
forests are the near-duplicate groups.

Defined cases: a null or empty text, or one without a word, has fingerprint
zero and links like any other; a text of fewer words than a shingle is one
shingle; repeated rows come back each; a null doc_id takes part in linking but
is never a component's id unless all its ids are null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage
from tessera.llm.components import components

SEED = 42
# Bit ranges of the blocks (first bit, number of bits).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of one bucket compared at once; a larger bucket goes through chunk pairs.
CHUNK = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        cut = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in cut]
    h = np.array(hashes, dtype="<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    value = np.packbits(votes * 2 > len(h), bitorder="little").view("<i8")[0]
    return int(value)


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) per row and the long columns to ``carry``, never null; fp is the signed view of the 64 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = {c: b[c] for c in carry}
            yield pd.DataFrame({"doc_id": b["doc_id"], **own, "fp": [fingerprint(t, shingle) for t in b["text"]]})

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *carry, "text")
    found = ids.mapInPandas(run, ", ".join(["doc_id string", *(f"{c} long" for c in carry), "fp long"]))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "fp")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _bits(first: int, n: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of the edges that join two trees when edges are added in order."""
    parent = list(range(n))
    used = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(k)
    return np.array(used, np.int64)


def _compare(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: a spanning forest of the links within equal keys."""
    n, u = len(fps), fps.view(np.uint64)  # popcounts of signed numbers would be of their absolute values
    left, right = [], []
    run = np.r_[0, np.cumsum(keys[1:] != keys[:-1])] if n else keys
    longest = int(np.bincount(run).max()) if n else 0
    alive = np.arange(n)
    for d in range(1, longest):
        alive = alive[alive + d < n]
        alive = alive[run[alive + d] == run[alive]]
        x = alive[np.bitwise_count(u[alive] ^ u[alive + d]) <= distance]
        left.append(x)
        right.append(x + d)
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    keep = _forest(a, b, n)
    return fps[a[keep]], fps[b[keep]]


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) links that connect all within ``distance`` bits.

    ``distance`` is at most 3: with five blocks two always agree.
    """
    if not 0 <= distance <= 3:
        raise ValueError("five blocks find pairs of at most three differing bits")
    keys = F.array(
        *[
            F.struct(
                F.lit(c).alias("combo"),
                F.shiftleft(_bits(*BLOCKS[i]), BLOCKS[j][1]).bitwiseOR(_bits(*BLOCKS[j])).alias("key"),
            )
            for c, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )
    placed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.combo", "k.key")
    sizes = placed.groupBy("combo", "key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    paired = (
        placed.join(sizes.select("combo", "key", chunks.alias("chunks")), ["combo", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "combo", "key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"))
    )
    cell = F.xxhash64("combo", "key", "c1", "c2")
    cells = paired.select(cell.alias("cell"), "fp")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            k = np.r_[held_k, b["cell"].to_numpy()]
            f = np.r_[held_f, b["fp"].to_numpy()]
            done = int(np.searchsorted(k, k[-1])) if len(k) else 0
            x, y = _compare(k[:done], f[:done], distance)
            held_k, held_f = k[done:], f[done:]
            yield pd.DataFrame({"a": x, "b": y})
        x, y = _compare(held_k, held_f, distance)
        yield pd.DataFrame({"a": x, "b": y})

    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links."""
    return groups(docs, shingle, distance).select("doc_id", "fp", "component_id")


def groups(docs: DataFrame, shingle: int = 3, distance: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``carry``, fp, root, component_id) per row; root names the component whatever its ids."""
    prints = cut_lineage(fingerprints(docs, shingle, carry))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(reps.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", *carry, "fp", "root", "component_id")
