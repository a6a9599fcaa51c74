"""N-gram Jaccard self-join of whole documents by set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word shingles; equal
sets become one.  All sets are ordered by one global order, shingles of little
filled hash buckets first, so two sets above the threshold share a shingle among
their first few (prefix filter).  Index lists, one per such shingle, hold the
sets with their size and the shingle's position.

Within a list, entries of equal size and position form a block, and a block is
skipped whole where sizes or positions leave too little to share.  Of the sets a
set still has to meet, the overlaps are derived from those of the most similar
set computed before: only the shingles by which the two differ are counted.

A first pass over the lists carries only the shingles that sets share with any
other and a few marks of their prefixes, and leaves out pairs that these rule
out.  What is left connects candidate groups, and a group of bounded size is a
cell of its own in which its whole sets meet once.  The sets of a larger group
meet on its lists, in two rounds: each set's two foremost shingles find most
links, so that components are nearly whole, and then all lists are joined but
those whose sets already lie in one component.  Of lists with equal members only
the foremost is joined.  Sets of a list that have the same shingle before its
own met on that shingle's list, so here they only meet the others.  A long list
is dealt into chunks, and each pair of chunks that has to meet is a cell; only a
spanning forest of the links leaves a task.  A pair already connected isn't
compared again, so no link between two components is lost and groups of
thousands of copies don't cost all pairs.

Defined cases: a text of fewer words than a shingle is one shingle; a text
without a word, empty or null, has an empty set and links with nothing; repeated
rows come back each; a null doc_id takes part in linking but is a component's id
only where all its ids are null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, cut_lineage
from tessera.llm.components import components
from tessera.llm.words import chunks as text_chunks
from tessera.llm.words import hashes_of

#: Shingles are counted in this many buckets (powers of two) for the global order.
BUCKET_BITS = 18
#: Bits of the filter that spares texts of no use in the last reading.
FILTER_BITS = 24
#: A chunk of a list holds about this many sets and shingles.
CHUNK = 512
CHUNK_SHINGLES = 1 << 18
#: Foremost shingles whose lists the first round joins.
FOREMOST = 2
#: Places of a set's prefix that the first pass carries, evenly spread and both ends among them.
MARKS = 9
#: A set is derived from a more similar one if they differ in at most this share of it.
DERIVE = 0.5

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACE_CHARS.encode())] = False


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[k])
    return x ^ (x >> np.uint64(29))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each position on."""
    count = len(words) - size + 1
    total = np.full(max(count, 0), size, np.uint64)
    for k in range(size):
        total = _mixed(total + words[k : count + k], 0) * np.uint64(_MIX[1])
    return _mixed(total, 3)


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # of bytes, only A-Z change
    words, counts = hashes_of(raw, _IN_WORD)
    every = _shingles(words, shingle)
    out, at = [], 0
    for n in counts.tolist():
        if n >= shingle:
            out.append(np.unique(every[at : at + n - shingle + 1]))
        else:
            out.append(_shingles(words[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that name each set, as two signed numbers; of the empty set, zeros."""
    ends = np.cumsum([0, *map(len, sets)])
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    sums = [np.r_[np.uint64(0), np.cumsum(_mixed(every, k), dtype=np.uint64)] for k in (2, 4)]
    return np.stack([(c[ends[1:]] - c[ends[:-1]]).view(np.int64) for c in sums], axis=1)


def least_overlap(n: int, m: int, percent: int) -> int:
    """The fewest common shingles with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Foremost shingles of which a set shares one with any set of its size or less that it links with."""
    return n - -(-percent * n // 100) + 1


def lead_length(n: int, percent: int) -> int:
    """The same for sets of its size or more."""
    return n - least_overlap(n, n, percent) + 1


def in_order(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set as sorted order keys: a shingle's bucket, numbered by load, before the rest of its hash."""
    rest = np.uint64(64 - BUCKET_BITS)
    return np.sort(rank[bucket_of(s)] << rest | s & np.uint64((1 << int(rest)) - 1))


# ---- readings of the texts


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row (doc_id, row, n, f1, f2), bucket -1; and per task and bucket (bucket, load)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            sizes, prints = [], [np.empty((0, 2), np.int64)]
            for texts in text_chunks(b["text"]):
                sets = shingle_sets(texts, shingle)
                load += np.bincount(bucket_of(np.concatenate(sets)), minlength=len(load))
                sizes += map(len, sets)
                prints.append(fingerprints(sets))
            f = np.concatenate(prints)
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "n": sizes, "f1": f[:, 0], "f2": f[:, 1], "bucket": -1, "load": 0})
        at = np.flatnonzero(load)
        yield pd.DataFrame({"doc_id": None, "row": 0, "n": 0, "f1": 0, "f2": 0, "bucket": at, "load": load[at]})

    schema = "doc_id string, row long, n long, f1 long, f2 long, bucket long, load long"
    return _rows(docs).mapInPandas(run, schema)


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """Texts with a hash of id and text, by which one row of each set is picked for the last reading."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return own.withColumn("row", F.xxhash64("doc_id", "text"))


def bucket_ranks(found: DataFrame) -> Broadcast:
    """The buckets' places by how many shingles they hold: an array of fixed size."""
    spark = found.sparkSession
    rows = found.filter("bucket >= 0").groupBy("bucket").agg(F.sum("load").alias("load")).toPandas()
    load = np.zeros(1 << BUCKET_BITS, np.int64)
    load[rows["bucket"].to_numpy(np.int64)] = rows["load"].to_numpy(np.int64)
    rank = np.empty(len(load), np.uint64)
    rank[np.argsort(load, kind="stable")] = np.arange(len(load), dtype=np.uint64)
    return spark.sparkContext.broadcast(rank)


def distinct_sets(docs: DataFrame, rank: Broadcast, shingle: int, percent: int) -> DataFrame:
    """(sid, f1, f2, n, row, prefix) of each distinct set that isn't empty; the prefix is in the global order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for texts in text_chunks(b["text"]):
                rows = b["row"].iloc[at : at + len(texts)]
                at += len(texts)
                sets = shingle_sets(texts, shingle)
                first = [in_order(s, rank.value)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else s for s in sets]
                f = fingerprints(sets)
                out = pd.DataFrame({"row": rows.to_numpy(), "n": list(map(len, sets)), "f1": f[:, 0], "f2": f[:, 1], "prefix": first})
                yield out[out["n"] > 0]

    every = _rows(docs).select("row", "text").mapInPandas(run, "row long, n long, f1 long, f2 long, prefix array<long>")
    one = every.groupBy("f1", "f2").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return cut_lineage(one.withColumn("sid", F.monotonically_increasing_id()))


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sid, shingles) for the wanted (sid, row, f1, f2): sorted hashes as bytes."""
    spark = docs.sparkSession
    # a filter of fixed size spares most texts of no use; the join that follows is what decides
    place = F.shiftrightunsigned("row", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(row, {64 - FILTER_BITS}) & 63 as int))")
    words = wanted.select(F.shiftright(place, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    mask = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    mask[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(mask.view(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["row"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            use = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            rows, at = b["row"][use], 0
            for texts in text_chunks(b["text"][use]):
                sets = shingle_sets(texts, shingle)
                f = fingerprints(sets)
                own = rows.iloc[at : at + len(texts)].to_numpy()
                at += len(texts)
                yield pd.DataFrame({"row": own, "f1": f[:, 0], "f2": f[:, 1], "shingles": [s.tobytes() for s in sets]})

    read = _rows(docs).select("row", "text").mapInPandas(run, "row long, f1 long, f2 long, shingles binary")
    met = read.join(wanted, ["row", "f1", "f2"]).select("sid", "shingles")
    return met.groupBy("sid").agg(F.first("shingles").alias("shingles"))


# ---- lists and cells


def index_lists(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists on which some pair could meet, (token, sid, n, pos, prev), ``prev`` the shingle before
    in the set; and (sid, shared), the shingles of each set's prefix that are on any other's.

    Left out are lists of one set, lists on which no set is by its lead, of lists
    with equal members all but the one foremost in the sets, and lists of two sets
    that sizes, positions or the number of shingles their prefixes share rule out.
    """
    lead = F.col("n") - _ceil(F.lit(2 * percent) * F.col("n"), 100 + percent) + 1
    entries = sets.select("sid", "n", "prefix", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "sid", "n", "pos", F.get("prefix", F.col("pos") - 1).alias("prev")
    )
    size = entries.groupBy("token").agg(
        F.count("*").alias("c"),
        F.max((F.col("pos") < lead).cast("int")).alias("lead"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.min(F.col("n") - F.col("pos")).alias("left"),
    )
    need = _ceil(F.lit(percent) * (F.col("least") + F.col("most")), 100 + percent)
    similar = 100 * F.col("least") >= percent * F.col("most")
    open_ = (F.col("lead") == 1) & ((F.col("c") > 2) | (need <= F.col("left")))
    shared_lists = size.filter((F.col("c") > 1) & ((F.col("c") > 2) | similar)).select("token", "c", open_.alias("open"))
    found = cut_lineage(entries.join(shared_lists, "token"))
    # two sets share at most the lists they have to themselves and the longer ones that the one in fewer is in
    longer = found.filter("c > 2").groupBy("sid").agg(F.count("*").alias("longer"))
    member = [F.xxhash64(F.lit(k), "sid").cast("decimal(38,0)") for k in (1, 2)]
    said = (
        found.join(longer, "sid", "left")
        .groupBy("token", "c", "open")
        .agg(
            F.sum(member[0]).alias("m1"),
            F.sum(member[1]).alias("m2"),
            F.sum("pos").alias("depth"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.min(F.coalesce("longer", F.lit(0))).alias("longer"),
        )
    )
    foremost = said.groupBy("c", "m1", "m2").agg(
        F.min(F.struct("depth", "token", "open")).alias("f"),
        F.count("*").alias("times"),
        *[F.max(x).alias(x) for x in ("least", "most", "longer")],
    )
    # whichever prefix ends first is seen whole, so beyond what they share in prefixes only so much is left
    shared = need - _ceil(F.lit(percent) * F.col("most"), 100) + 1
    kept = foremost.filter(F.col("f.open") & ((F.col("c") > 2) | (F.col("times") + F.col("longer") >= shared)))
    lists = found.drop("c", "open").join(kept.select(F.col("f.token").alias("token")), "token", "left_semi")
    return lists, found.groupBy("sid").agg(F.collect_list("token").alias("shared"))


def _ceil(x: Column, by: int) -> Column:
    """The quotient of whole numbers, rounded up."""
    up = x + F.lit(by - 1)
    return ((up - F.pmod(up, F.lit(by))) / by).cast("long")


def _unsettled(lists: DataFrame) -> DataFrame:
    """Lists that hold sets of two components."""
    said = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return lists.join(said.filter("lo < hi").select("token"), "token", "left_semi")


def cells(lists: DataFrame) -> DataFrame:
    """(cell, half, sid, n, pos, root): what has to meet on each list, in cells of at most two chunks.

    Sets whose ``prev`` is the list's most frequent one are covered: they met on
    that one's list.  The others meet each other and the covered ones.  In a cell
    of two chunks only sets of different halves (0 and 1) have to meet; in a cell
    of one chunk (half -1), all.
    """
    befores = lists.filter("prev is not null").groupBy("token", "prev").agg(F.count("*").alias("c"))
    cover = befores.groupBy("token").agg(F.max(F.struct("c", "prev"))["prev"].alias("cover"))
    marked = lists.join(cover, "token", "left").withColumn("covered", F.coalesce(F.col("prev") == F.col("cover"), F.lit(False)))
    chunk = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sizes = marked.groupBy("token", "covered").agg(chunk.alias("chunks"))
    both = sizes.groupBy("token").agg(
        F.coalesce(F.max(F.when(~F.col("covered"), F.col("chunks"))), F.lit(0)).alias("open"),
        F.coalesce(F.max(F.when(F.col("covered"), F.col("chunks"))), F.lit(0)).alias("shut"),
    )
    # chunks 0 .. open - 1 hold the open sets, the next ones the covered
    count = F.when(F.col("covered"), F.col("shut")).otherwise(F.col("open"))
    own = F.pmod(F.xxhash64("sid", "token"), count).cast("int") + F.when(F.col("covered"), F.col("open")).otherwise(0)
    last = F.when(F.col("covered"), F.col("open")).otherwise(F.col("open") + F.col("shut")) - 1
    dealt = marked.join(both.filter("open > 0"), "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    half = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return dealt.select(cell.alias("cell"), half.cast("long").alias("half"), "sid", "n", "pos", "root")


# ---- what tasks do with a cell

#: Columns of a cell's rows beside the cell and what they carry.
_OWN = ("half", "sid", "n", "pos", "root")


class Cell:
    """Sets of one cell sorted by size and position, and who of them has to meet."""

    def __init__(self, columns: dict[str, np.ndarray], carried: list[np.ndarray]):
        order = np.lexsort((columns["sid"], columns["pos"], columns["n"]))
        self.order = order
        self.half, self.sid, self.n, self.pos = (columns[c][order] for c in ("half", "sid", "n", "pos"))
        self.comp = np.unique(columns["root"][order], return_inverse=True)[1]
        self.carried = [carried[k] for k in order.tolist()]

    def partners(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, the earlier sets that k could link with): whole blocks of equal size and position are skipped."""
        n, pos = self.n, self.pos
        first = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])])
        bounds = np.r_[first, len(n)]
        size, left = n[first], n[first] - pos[first]
        for b in range(len(first)):
            need = -(-percent * (size[b] + size[: b + 1]) // (100 + percent))
            # this list's shingle is the first common one of the pairs that it is to find
            near = np.flatnonzero((need <= np.minimum(left[b], left[: b + 1])) & (100 * size[: b + 1] >= percent * size[b]))
            if not len(near):
                continue
            met = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in near.tolist()])
            for k in range(bounds[b], bounds[b + 1]):
                yield k, met[(met < k) & ((self.half[met] != self.half[k]) | (self.half[k] < 0)) & (self.comp[met] != self.comp[k])]


class Overlaps:
    """Overlaps of each set with all others of its cell, derived from a similar set's where there is one."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        token, local = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.cumsum([0, *map(len, sets)])
        order = np.argsort(local, kind="stable")
        self.members = np.repeat(np.arange(len(sets)), np.diff(bounds))[order]
        self.start = np.searchsorted(local[order], np.arange(len(token) + 1))
        shared = np.diff(self.start) > 1  # a shingle of one set adds nothing to an overlap with another
        self.sets = [np.sort(x[shared[x]]) for x in (local[a:b] for a, b in zip(bounds, bounds[1:]))]
        self.known: dict[int, np.ndarray] = {}
        self.parent = np.full(len(sets), -1)
        self.with_parent = np.zeros(len(sets), np.int32)

    def _sum(self, shingles: np.ndarray) -> np.ndarray:
        rows = [self.members[self.start[t] : self.start[t + 1]] for t in shingles.tolist()]
        if not rows:
            return np.zeros(self.count, np.int32)
        return np.bincount(np.concatenate(rows), minlength=self.count).astype(np.int32)

    def of(self, k: int) -> np.ndarray:
        if k in self.known:
            return self.known[k]
        own, p, got = self.sets[k], int(self.parent[k]), None
        if p >= 0:
            other = self.sets[p]
            gone, new = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
            if len(gone) + len(new) <= DERIVE * len(own):
                got = self.known[p] + self._sum(new) - self._sum(gone)
        if got is None:
            got = self._sum(own)
        self.known[k] = got
        better = got > self.with_parent
        self.with_parent[better] = got[better]
        self.parent[better] = k
        return got


def _common(sets: list[np.ndarray], k: int, met: np.ndarray, held: list[Overlaps]) -> np.ndarray:
    """How many shingles set k shares with each of ``met``; a few pairs are counted one by one."""
    if len(met) <= 2 and not held:
        return np.array([len(np.intersect1d(sets[k], sets[i], assume_unique=True)) for i in met.tolist()])
    if not held:
        held.append(Overlaps(sets))
    return held[0].of(k)[met]


def join_cell(cell: Cell, percent: int) -> list[tuple[int, int]]:
    """Links (sids) that connect what the sets of one cell connect, beside what their roots already do."""
    held: list[Overlaps] = []
    out = []
    for k, met in cell.partners(percent):
        if not len(met):
            continue
        shared = _common(cell.carried, k, met, held)
        for i in met[100 * shared >= percent * (cell.n[k] + cell.n[met] - shared)].tolist():
            if cell.comp[i] != cell.comp[k]:
                out.append((int(cell.sid[i]), int(cell.sid[k])))
                cell.comp[cell.comp == cell.comp[i]] = cell.comp[k]
    return out


def hopeful(cell: Cell, percent: int) -> list[tuple[int, int]]:
    """A spanning forest (sids) of the pairs that could link by what the cell's rows carry.

    That is, the first ``MARKS`` of a row, order keys at even places of its prefix,
    and then the prefix's shingles that any other set shares.  Up to the lesser of
    two prefixes' ends all common shingles are seen; beyond it, the sets can share
    at most what is left of the smaller one.
    """
    out: list[tuple[int, int]] = []
    held: list[Overlaps] = []
    marks = np.stack([c[:MARKS] for c in cell.carried])
    shared = [np.sort(c[MARKS:]) for c in cell.carried]
    length = cell.n - -(-percent * cell.n // 100) + 1
    for k, met in cell.partners(percent):
        if not len(met):
            continue
        common = _common(shared, k, met, held)
        last = np.minimum(marks[k, -1], marks[met, -1])
        most = common + np.minimum(cell.n[k] - _seen(marks[[k]], length[[k]], last), cell.n[met] - _seen(marks[met], length[met], last))
        for i in met[most >= -(-percent * (cell.n[k] + cell.n[met]) // (100 + percent))].tolist():
            if cell.comp[i] != cell.comp[k]:
                out.append((int(cell.sid[i]), int(cell.sid[k])))
                cell.comp[cell.comp == cell.comp[i]] = cell.comp[k]
    return out


def _seen(marks: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    """At least so many of a prefix's shingles lie up to ``last``."""
    passed = (marks <= last[:, None]).sum(axis=1)
    return np.where(passed > 0, (passed - 1) * (length - 1) // (MARKS - 1) + 1, 0)


def _by_cell(batches: Iterator[pd.DataFrame], carried: str) -> Iterator[tuple[int, dict[str, np.ndarray], list]]:
    """(cell, its columns, what its rows carry) of whole cells of two sets or more from sorted batches."""
    names = ("cell", *_OWN)
    held = {c: np.empty(0, np.int64) for c in names}
    load: list = []
    for b in _ended(batches):
        if b is not None:
            held = {c: np.r_[held[c], b[c].to_numpy(np.int64)] for c in names}
            load = load + list(b[carried])
        cell = held["cell"]
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        bounds = [0, *cuts.tolist()] if len(cell) else []
        if b is None and len(cell):
            bounds.append(len(cell))
        for x, y in zip(bounds, bounds[1:]):
            if y - x > 1:
                yield int(cell[x]), {c: held[c][x:y] for c in _OWN}, load[x:y]
        if bounds:
            held = {c: v[bounds[-1] :] for c, v in held.items()}
            load = load[bounds[-1] :]


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _dealt(rows: DataFrame, carried: str) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell").select("cell", *_OWN, carried)


def hopeful_links(dealt: DataFrame, sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of each cell's pairs that could link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for _, columns, carried in _by_cell(batches, "known"):
            found += hopeful(Cell(columns, [np.asarray(c, np.int64).view(np.uint64) for c in carried]), percent)
            if len(found) >= 1 << 16:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"])

    place = F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda i: F.get("prefix", F.floor(i * (F.size("prefix") - 1) / (MARKS - 1)).cast("int")))
    known = sets.select("sid", place.alias("marks")).join(shared, "sid").select("sid", F.concat("marks", "shared").alias("known"))
    return _dealt(dealt.join(known, "sid"), "known").mapInPandas(run, "a long, b long")


def cell_links(rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of each cell's links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, columns, carried in _by_cell(batches, "shingles"):
            found = join_cell(Cell(columns, [np.frombuffer(x, np.uint64) for x in carried]), percent)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return _dealt(rows.join(whole, "sid"), "shingles").mapInPandas(run, "a long, b long")


def _rooted(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("sid"))
    named = lists.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
    return named.withColumn("root", F.coalesce("root", "sid"))


def links(docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between distinct sets that connect all sets above the threshold."""
    lists, shared = index_lists(sets, percent)
    lists = cut_lineage(lists)
    maybe = cut_lineage(hopeful_links(cells(_rooted(lists, None)), sets, shared, percent))
    grouped = cut_lineage(components(maybe).withColumnRenamed("node", "sid").join(sets.select("sid", "n", "row", "f1", "f2"), "sid"))
    size = grouped.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    small = (F.col("c") <= CHUNK) & (F.col("s") <= CHUNK_SHINGLES)
    marked = cut_lineage(grouped.join(size.select("root", small.alias("small")), "root"))
    whole = cut_lineage(whole_sets(docs, marked.select("sid", "row", "f1", "f2"), shingle))
    zero = F.lit(0).cast("long")
    alone = marked.filter("small").select(F.col("root").alias("cell"), (zero - 1).alias("half"), "sid", "n", zero.alias("pos"), F.col("sid").alias("root"))
    found = cut_lineage(cell_links(alone, whole, percent))
    rest = marked.filter("not small").select("sid")
    if rest.isEmpty():
        return found
    large = cut_lineage(lists.join(rest, "sid", "left_semi"))
    first = cut_lineage(cell_links(cells(_unsettled(_rooted(large.filter(F.col("pos") < FOREMOST), None))), whole, percent))
    second = cut_lineage(cell_links(cells(_unsettled(_rooted(large, components(first)))), whole, percent))
    return found.unionByName(first).unionByName(second)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: linked where 100 |A & B| >= percent |A | B|."""
    if not 1 <= percent <= 100:
        raise ValueError("percent lies between 1 and 100")
    found = cut_lineage(sketches(docs, shingle))
    sets = distinct_sets(docs, bucket_ranks(found), shingle, percent)
    roots = components(links(docs, sets, shingle, percent))
    rows = found.filter("bucket < 0").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "f1", "f2")
    ids = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    placed = (
        sets.select("sid", "f1", "f2")
        .join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .select("f1", "f2", F.coalesce("root", "sid").alias("root"))
        .join(ids, ["f1", "f2"])
    )
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("f1", "f2", "component_id")
    # an empty set's fingerprint is zeros, which no other set has: it meets nothing here
    joined = rows.join(named, ["f1", "f2"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
