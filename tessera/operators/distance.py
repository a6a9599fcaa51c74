"""Pairwise distances, PERMANOVA, PERMDISP (centroid), Mantel (DST/PRM/AGG6).

* Pairs come from a **blocked self-join**: each row gets a block
  ``pmod(xxhash64(id), B)``; left rows are replicated to block pairs (b, q>=b),
  right rows to (p<=b, b); equi-join on the block pair; inside one block keep
  i < j, across blocks keep every pair stored as (least, greatest).  No
  cartesian product, no broadcast nested-loop join; the pair count n(n-1)/2 is
  inherent to the operators that need pairs (Bray-Curtis, Mantel, PCoA).
* Distances are computed a block pair at a time (:func:`on_cells`).  What only
  sums distances up (group means, PERMANOVA, PERMDISP, Gower rows, Pearson's
  Mantel) takes a :class:`Distances` and adds up inside the block pair, so no row
  per pair is made, shuffled or written; it also takes a table (i, j, d).
  Spearman's Mantel ranks arrays of distances, dealt by groups of values.
* Euclidean PERMANOVA never forms pairs (:mod:`tessera.operators.permutation`):
  sum_{i<j} d_ij^2 / n equals sum_i ||x_i - mean||^2.
* Permutations are md5 label shuffles: in permutation k the sample at md5
  position r (key seed:k:id) takes the label of the sample at canonical
  position r -- reproducible and computable in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import md5_key, ordinal_by_hash


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def braycurtis(a: Column, b: Column) -> Column:
    num = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    den = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x + y)), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(num, den)


#: Rows of one block of a blocked self-join at most and, where there are few, at least.
BLOCK_ROWS, LEAST_BLOCK = 1 << 14, 512


def blocked_pairs(vectors: DataFrame, blocks: int | None = None, key: str = "sample_id", vec: str = "vec") -> DataFrame:
    """(i, j, vi, vj) for every unordered pair i < j.

    Without ``blocks`` their number follows the row count, at least 8, so a
    block pair stays about BLOCK_ROWS x BLOCK_ROWS however many rows there are.
    A row is shuffled once a block, so there are no more blocks than that and
    than the tasks need.
    """
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    if blocks is None:
        n = vectors.count()
        blocks = max(8, -(-n // BLOCK_ROWS), min(-(-n // LEAST_BLOCK), int(np.ceil(np.sqrt(8 * tasks)))))
    tasks = min(tasks, blocks * (blocks + 1) // 2)
    v = vectors.select(F.col(key).alias("_id"), F.col(vec).alias("_v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b"))
    left = v.select(
        F.col("_id").alias("i0"), F.col("_v").alias("v0"), F.col("_b").alias("bp"),
        F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("bq"),
    )
    right = v.select(
        F.col("_id").alias("i1"), F.col("_v").alias("v1"), F.col("_b").alias("bq"),
        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("bp"),
    )
    # a block pair is much work of few rows: Spark would put many into a task by their size
    j = left.repartition(tasks, "bp", "bq").join(right.repartition(tasks, "bp", "bq"), ["bp", "bq"])
    keep = F.when(F.col("bp") == F.col("bq"), F.col("i0") < F.col("i1")).otherwise(F.lit(True))
    lo = F.col("i0") < F.col("i1")
    return j.filter(keep).select(
        F.when(lo, F.col("i0")).otherwise(F.col("i1")).alias("i"),
        F.when(lo, F.col("i1")).otherwise(F.col("i0")).alias("j"),
        F.when(lo, F.col("v0")).otherwise(F.col("v1")).alias("vi"),
        F.when(lo, F.col("v1")).otherwise(F.col("v0")).alias("vj"),
    )


#: Rows of a block where a block pair leaves sums only, and rows of its left side handled at once.
CELL_ROWS, STRIP = 2048, 64
#: Rows of a block at least, where there are few; blocks that a task reads at most of each side.
LEAST_ROWS, PART_BLOCKS = 128, 32
METRICS = ("euclidean", "braycurtis")


@dataclass
class Distances:
    """All distances of (key, vec) rows by a metric, not yet formed."""

    vectors: DataFrame
    metric: str = "euclidean"
    key: str = "sample_id"

    def pairs(self) -> DataFrame:
        """The table (i, j, d)."""
        return distance_pairs(self.vectors, self.metric, key=self.key)


def whole_vector(vec: str) -> Column:
    """The vector, or null if a value is missing: no distance to it is known."""
    return F.when(F.forall(vec, lambda x: x.isNotNull()), F.col(vec))


def side_matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one side as a matrix and their lengths, -1 for a null one."""
    arr = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    size = pc.fill_null(pc.list_value_length(arr), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    out = np.full((len(arr), max(width, 0)), np.nan)
    if width > 0:
        out[np.arange(width) < size[:, None]] = arr.flatten().to_numpy(zero_copy_only=False)
    return out, size


def strips(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], metric: str, exact: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(left rows, distances, which are known) in strips of the left side.

    Euclidean distances come from a matrix product; those too small for its digits, like all
    others and those to be told apart or ranked (``exact``), are sums in the order of the vector."""
    (x, nx), (y, ny) = a, b
    width = min(x.shape[1], y.shape[1])
    cols = np.ascontiguousarray(y[:, :width].T)
    positive = metric == "braycurtis" and not (x[:, :width] < 0).any() and not (cols < 0).any()
    product = _products(a, b) if metric == "euclidean" and not exact else None
    for start in range(0, len(x), STRIP):
        at = slice(start, min(start + STRIP, len(x)))
        known = (nx[at, None] == ny) & (nx[at, None] >= 0)
        part = x[at, :width]
        d = product(at) if product else None
        if d is not None:
            yield at, d, known
            continue
        total, step = np.zeros((len(part), len(y))), np.empty((len(part), len(y)))
        under = np.zeros((len(part), len(y))) if metric == "braycurtis" and not positive else None
        for k in range(width):
            np.subtract(part[:, k, None], cols[k], out=step)
            if metric == "euclidean":
                np.multiply(step, step, out=step)
            else:
                np.abs(step, out=step)
            total += step
            if under is not None:
                np.add(part[:, k, None], cols[k], out=step)
                under += np.abs(step, out=step)
        if metric == "euclidean":
            d = np.sqrt(total, out=total)
        else:
            if under is None:
                under = part.sum(1)[:, None] + cols.sum(0)
            known &= under != 0
            d = np.divide(total, under, out=total, where=known)
        yield at, d, known


#: Squares below this share of the vectors' own are added up one by one, unless more than FEW of a strip are.
SMALL, FEW = 1e-6, 1 / 32


def _products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Callable[[slice], np.ndarray | None] | None:
    """A function of left rows that gives their Euclidean distances, or None where products would not do;
    None if vectors differ in length or hold what is no number."""
    (x, nx), (y, ny) = a, b
    here, there = nx >= 0, ny >= 0
    if not here.any() or not there.any() or len(np.unique(np.concatenate([nx[here], ny[there]]))) > 1 or not x.shape[1]:
        return None
    x, y = (np.where(k[:, None], v, 0.0) if not k.all() else v for v, k in ((x, here), (y, there)))
    if x.shape[1] != y.shape[1]:
        return None
    with np.errstate(invalid="ignore", over="ignore"):
        centre = x[here].mean(0)
        x, y = np.where(here[:, None], x - centre, 0.0), np.where(there[:, None], y - centre, 0.0)
        n2, m2 = (x * x).sum(1), (y * y).sum(1)
    if not (np.isfinite(n2).all() and np.isfinite(m2).all()):
        return None
    left, right = np.column_stack([x, n2, np.ones(len(x))]), np.vstack([-2.0 * y.T, np.ones(len(y)), m2])

    def distances(at: slice) -> np.ndarray | None:
        d = left[at] @ right
        small = SMALL * (n2[at].max() + m2.max())
        if d.min() < small:
            r, c = np.nonzero(d < small)
            if len(r) > FEW * d.size:
                return None
            square = np.zeros(len(r))
            for k in range(x.shape[1]):
                square += (a[0][at.start + r, k] - b[0][c, k]) ** 2
            d[r, c] = square
        return np.sqrt(d, out=d)

    return distances


def on_cells(rows: DataFrame, run: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray, bool], pa.Table | Iterator[pa.Table]], schema: str, side: int | None = None, blocks: int | None = None, within: str | None = None) -> DataFrame:
    """``run(left, right, left codes, right codes, same block)`` for each pair of blocks of the rows.

    ``rows`` has ``id`` and whatever else ``run`` reads; a row without an id has no
    pairs.  Codes are in the order of the ids, and equal for equal ids.  With
    ``within`` only rows equal in that column meet.

    A block is one row.  Groups of blocks, not blocks, are copied to the tasks, one for each
    pair of groups: every row is shuffled once a group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = rows.filter(F.col("id").isNotNull())
    if within:
        rows = rows.filter(F.col(within).isNotNull())
    side = side or CELL_ROWS
    few = int(np.ceil(np.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism)))
    if blocks is None:
        sizes = rows.groupBy(within).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")) if within else rows.agg(F.count(F.lit(1)))
        n = sizes.first()[0] or 0
        blocks = max(1, -(-n // side), min(-(-n // LEAST_ROWS), few))
    parts = min(blocks, max(few, -(-blocks // PART_BLOCKS)))
    names, keys = rows.columns, [*([within] if within else []), "_b"]
    placed = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = placed.repartitionById(parts, F.pmod("_b", F.lit(parts))).sortWithinPartitions(*keys, "id")
    kind = f"{within} {dict(rows.dtypes)[within]}, _b int" if within else "_b int"
    block_schema, out_schema = (to_arrow_schema(StructType.fromDDL(d)) for d in (f"{kind}, _t binary", schema))

    def whole(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as writer:
            for b in held:
                writer.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, sink.getvalue().to_pybytes()), block_schema)], schema=block_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                v = batch.column(k).dictionary_encode().indices.to_numpy()
                new[1:] |= v[1:] != v[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), len(batch)]
            for start, end in zip(edges, edges[1:]):
                now = tuple(batch.column(k)[start].as_py() for k in keys)
                if held and now != key:
                    yield whole(key, held)
                    held = []
                key = now
                held.append(batch.slice(start, end - start).select(names))
        if held:
            yield whole(key, held)

    def read(blob: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(blob.as_buffer()).read_all()

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [], [], []  # (keys, block) of a group met with itself, or of one and another
        for batch in batches:
            for k in range(len(batch)):
                sides[batch.column("_s")[k].as_py()].append((tuple(batch.column(c)[k].as_py() for c in keys), batch.column("_t")[k]))
        for side in sides:
            side.sort(key=lambda r: r[0][-1])
        for x, (p, one) in enumerate(sides[0] or sides[1]):
            a = read(one)
            for q, two in sides[0][x:] or sides[2]:
                if p[:-1] != q[:-1]:
                    continue
                b = a if p == q else read(two)
                ids = pa.concat_arrays([*a["id"].chunks, *b["id"].chunks])
                code = pc.rank(ids, tiebreaker="min").to_numpy()
                got = run(a, b, code[: len(a)], code[len(a) :], p == q)
                for t in (got,) if isinstance(got, pa.Table) else got:
                    yield from t.select(out_schema.names).cast(out_schema).combine_chunks().to_batches(max_chunksize=1 << 17)

    packed = dealt.mapInArrow(pack, f"{kind}, _t binary").withColumn("_m", F.pmod("_b", F.lit(parts)))
    copies = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low, high = F.least("_m", "_o"), F.greatest("_m", "_o")
    copies = copies.select(*keys, "_t", F.when(F.col("_m") == F.col("_o"), 0).when(F.col("_m") < F.col("_o"), 1).otherwise(2).alias("_s"), (high * (high + 1) / 2 + low).cast("int").alias("_c"))
    return copies.repartitionById(parts * (parts + 1) // 2, "_c").drop("_c").mapInArrow(cell, schema)


def _once(a: np.ndarray, b: np.ndarray, at: slice, same: bool) -> np.ndarray | None:
    """Which cells of a strip are pairs to be counted: across blocks all, inside one those of rising ids."""
    return a[at, None] < b if same else None


def distance_pairs(vectors: DataFrame, metric: str = "euclidean", blocks: int | None = None, key: str = "sample_id") -> DataFrame:
    """(i, j, d) for i < j; d is null where a vector has missing values, or the sums of Bray-Curtis are 0."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(F.col(key).alias("id"), whole_vector("vec").cast("array<double>").alias("vec"))

    def run(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[pa.Table]:
        ids = pa.concat_arrays([*left["id"].chunks, *right["id"].chunks])
        for at, d, known in strips(side_matrix(left["vec"]), side_matrix(right["vec"]), metric, exact=True):
            once = _once(a, b, at, same)
            r, c = np.nonzero(once) if once is not None else np.divmod(np.arange(d.size), d.shape[1])
            ds, gone = d[r, c], ~known[r, c]
            r = r + at.start
            rising = a[r] < b[c]
            i, j = (ids.take(pa.array(v)) for v in (np.where(rising, r, c + len(a)), np.where(rising, c + len(a), r)))
            yield pa.table({"i": i, "j": j, "d": pa.array(ds, mask=gone)})

    return on_cells(rows, run, f"i {kind}, j {kind}, d double", blocks=blocks)


def group_mean_distances(pairs: DataFrame | Distances, labels: DataFrame, key: str = "sample_id", group: str = "grp") -> DataFrame:
    """(g1, g2, mean_d, n_pairs) with g1 <= g2; the diagonal excludes self pairs,
    so a group of one sample has a diagonal row with a null mean."""
    if isinstance(pairs, Distances):
        ids = pairs.vectors.select(F.col(pairs.key).alias(key)).filter(F.col(key).isNotNull()).distinct()
        others = ids.agg(F.count(F.lit(1))).scalar()
        ends = ids.withColumn("_o", others).filter("_o > 1").drop("_o")
        means = _sorted_group_sums(pairs, labels, key, group) if pairs.metric == "braycurtis" else None
        means = _group_sums(pairs, labels, key, group) if means is None else means
    else:
        l1 = labels.select(F.col(key).alias("i"), F.col(group).alias("_g1"))
        l2 = labels.select(F.col(key).alias("j"), F.col(group).alias("_g2"))
        j = pairs.join(l1, "i").join(l2, "j")
        ends = pairs.select(F.col("i").alias(key)).union(pairs.select(F.col("j").alias(key))).distinct()
        means = j.groupBy(F.least("_g1", "_g2").alias("g1"), F.greatest("_g1", "_g2").alias("g2")).agg(
            F.avg("d").alias("mean_d"), F.count(F.lit(1)).alias("n_pairs")
        )
    single = labels.join(ends, key, "left_semi").groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    lone = single.select(F.col(group).alias("g1"), F.col(group).alias("g2"), F.lit(None).cast("double").alias("mean_d"), F.lit(0).cast("long").alias("n_pairs"))
    return means.unionByName(lone)


def _group_sums(dist: Distances, labels: DataFrame, key: str, group: str) -> DataFrame:
    """(g1, g2, mean_d, n_pairs) of the groups that have pairs, added up by block pair."""
    kind, metric = dict(labels.dtypes)[group], dist.metric
    rows = dist.vectors.select(F.col(dist.key).alias("id"), whole_vector("vec").cast("array<double>").alias("vec"))
    rows = rows.join(labels.select(F.col(key).alias("id"), F.col(group).alias("g")), "id")

    def run(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray, same: bool) -> pa.Table:
        names = pa.concat_arrays([*left["g"].chunks, *right["g"].chunks]).dictionary_encode(null_encoding="encode")
        code = names.indices.to_numpy().astype(np.int64)
        ga, gb, size = code[: len(a)], code[len(a) :], len(names.dictionary)
        # rows of a group stand together, so that a group's cells are added up as they lie
        oa, ob = np.argsort(ga, kind="stable"), np.argsort(gb, kind="stable")
        (fa, sa), (fb, sb) = (np.unique(g[o], return_index=True) for g, o in ((ga, oa), (gb, ob)))
        cells = (fa[:, None] * size + fb).ravel()
        (x, nx), (y, ny) = side_matrix(left["vec"]), side_matrix(right["vec"])
        per = np.zeros((3, len(x), len(fb)))
        for at, d, known in strips((x[oa], nx[oa]), (y[ob], ny[ob]), metric):
            once = _once(a[oa], b[ob], at, same)
            if once is None and known.all():
                per[0, at] = per[1, at] = np.diff(np.r_[sb, len(y)])
            else:
                once = np.ones(d.shape, bool) if once is None else once
                known = known & once
                d = np.where(known, d, 0.0)
                per[0, at], per[1, at] = (np.add.reduceat(v.astype(float), sb, axis=1) for v in (once, known))
            per[2, at] = np.add.reduceat(d, sb, axis=1)
        n, m, s = np.zeros((3, size * size))
        n[cells], m[cells], s[cells] = (np.add.reduceat(v, sa, axis=0).ravel() for v in per)
        at = np.flatnonzero(n)
        one, two = (names.dictionary.take(pa.array(v)) for v in np.divmod(at, size))
        return pa.table({"ga": one, "gb": two, "n": n[at].astype(np.int64), "m": m[at].astype(np.int64), "s": s[at]})

    return _mean_of_sums(on_cells(rows, run, f"ga {kind}, gb {kind}, n long, m long, s double"))


#: Values that a task of a sorted sum holds, and groups up to which it is made.
SORTED_VALUES, SORTED_GROUPS = 1 << 20, 64


def _sorted_group_sums(dist: Distances, labels: DataFrame, key: str, group: str) -> DataFrame | None:
    """The same of Bray-Curtis distances between vectors of one total, without pairs; None if they are not such.

    Where every vector is non-negative and adds up to t, the distance is sum_k |x_k - y_k| / 2 t, and the sum of
    |x - y| over all pairs follows from the sorted values of a position: each value counts once up for what lies
    below it, which is a number and a sum by group.  A range of values is a task; what a range adds to the ones
    above it is a number and a sum, too.
    """
    from tessera.session import cut_lineage

    kind = dict(labels.dtypes)[group]
    vec = whole_vector("vec").cast("array<double>")
    total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v)
    rows = dist.vectors.select(F.col(dist.key).alias("id"), vec.alias("vec")).join(labels.select(F.col(key).alias("id"), F.col(group).alias("g")), "id")
    rows = cut_lineage(rows.withColumn("t", total))
    finite = F.forall("vec", lambda v: (v >= 0) & (v < F.lit(float("inf"))))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("t").alias("low"), F.max("t").alias("high"),
        F.min(F.size("vec")).alias("d"), F.max(F.size("vec")).alias("most"), F.bool_and(finite).alias("fine"), F.count_if(F.col("t") == 0).alias("zeros"),
    ).first()
    if not found["n"] or found["ids"] != found["n"] or not found["fine"] or found["zeros"] or found["d"] != found["most"] or found["high"] - found["low"] > 1e-12 * found["high"]:
        return None
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count("vec").alias("m")).orderBy("g").limit(SORTED_GROUPS + 1).collect()
    if len(sizes) > SORTED_GROUPS:
        return None
    names, groups = [r["g"] for r in sizes], len(sizes)
    table = rows.sparkSession.createDataFrame([(g, c) for c, g in enumerate(names)], f"g {kind}, c int")
    coded = rows.filter("vec is not null").join(F.broadcast(table), F.col("c").isNotNull() & rows["g"].eqNullSafe(table["g"]))
    ranges = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-found["n"] * found["d"] // SORTED_VALUES))
    dealt = coded.select("c", F.posexplode("vec").alias("k", "v")).repartitionByRange(ranges, "k", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        k, v, c = (t[name].to_numpy() for name in ("k", "v", "c"))
        order = np.lexsort((v, k))
        k, v, c = k[order], v[order], c[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out = []
        for start, end in zip(first, np.r_[first[1:], len(k)]):
            x, g = v[start:end], c[start:end]
            up = np.zeros((groups, groups))
            for h in range(groups):
                mine = g == h
                up[:, h] = np.bincount(g, x * np.cumsum(mine) - np.cumsum(np.where(mine, x, 0.0)), groups)
            out.append((int(k[start]), float(x[0]), np.bincount(g, minlength=groups).astype(float), np.bincount(g, x, groups), up.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(zip(*out), (pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * 3))], ["k", "v", "n", "s", "up"])

    pieces = dealt.mapInArrow(run, "k int, v double, n array<double>, s array<double>, up array<double>")
    sums, below, at = np.zeros((groups, groups)), None, None
    for r in pieces.orderBy("k", "v").toLocalIterator():
        if r["k"] != at:
            at, below = r["k"], np.zeros((2, groups))
        n, s = np.array(r["n"]), np.array(r["s"])
        sums += np.array(r["up"]).reshape(groups, groups) + np.outer(s, below[0]) - np.outer(n, below[1])
        below += n, s
    n, m = (np.array([float(r[c]) for r in sizes]) for c in "nm")
    both = lambda v: np.where(np.eye(groups, dtype=bool), np.outer(v, v) / 2 - np.diag(v) / 2, np.outer(v, v))
    pairs, known = both(n), both(m)
    sums = np.where(np.eye(groups, dtype=bool), sums, sums + sums.T) / (found["low"] + found["high"]) if found["high"] else sums
    out = [(names[i], names[j], float(sums[i, j]), int(known[i, j]), int(pairs[i, j])) for i in range(groups) for j in range(i, groups) if pairs[i, j]]
    return _mean_of_sums(rows.sparkSession.createDataFrame(out, f"ga {kind}, gb {kind}, s double, m long, n long"))


def _mean_of_sums(sums: DataFrame) -> DataFrame:
    by = sums.groupBy(F.least("ga", "gb").alias("g1"), F.greatest("ga", "gb").alias("g2"))
    return by.agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.sum("n").alias("n_pairs")).select("g1", "g2", F.try_divide("s", "m").alias("mean_d"), "n_pairs")


# ---- permutations ---------------------------------------------------------------------------
def permuted_labels(
    labels: DataFrame, permutations: int, seed: int, key: str = "sample_id", group: str = "grp", first: int = 0
) -> DataFrame:
    """(perm, key, grp) of shuffles ``first`` to ``permutations``: 0 is the observed
    labelling, the others are md5 shuffles of the same label multiset."""
    base = ordinal_by_hash(labels.withColumn("_h", md5_key(seed, F.lit("base"), key)), [], "_h", "_pos").select(
        F.col("_pos"), F.col(group).alias("_lab")
    )
    observed = labels.select(F.lit(0).cast("bigint").alias("perm"), key, group)
    if permutations < max(first, 1):
        return observed
    reps = labels.select(key, F.explode(F.sequence(F.lit(max(first, 1)), F.lit(permutations))).alias("perm"))
    reps = reps.withColumn("_h", md5_key(seed, F.col("perm"), key))
    pos = ordinal_by_hash(reps, ["perm"], "_h", "_pos")
    shuffled = pos.join(base, "_pos").select(F.col("perm").cast("bigint").alias("perm"), key, F.col("_lab").alias(group))
    return observed.unionByName(shuffled) if first == 0 else shuffled


def permdisp_centroid(vectors: DataFrame, labels: DataFrame, key: str = "sample_id", group: str = "grp") -> DataFrame:
    """Distances to the group centroid (Euclidean space), one-way ANOVA F on
    them: one row (n, a, f)."""
    lab = labels.filter(F.col(group).isNotNull())
    cells = vectors.join(lab, key).select(key, group, F.inline(F.transform("vec", lambda x, i: F.struct(i.alias("dim"), x.alias("x")))))
    cent = cells.groupBy(group, "dim").agg(F.avg("x").alias("c"))
    dist = cells.join(cent, [group, "dim"]).groupBy(key, group).agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("z"))
    return anova_f(dist, group, "z")


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA F of ``value`` across ``group``: (n, a, f); F is null for one group or one row a group."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("ng"), F.avg(value).alias("mg"), F.sum(F.col(value) ** 2).alias("sq"))
    t = g.agg(
        F.sum("ng").alias("n"), F.count(F.lit(1)).alias("a"),
        F.sum(F.col("ng") * F.col("mg")).alias("st"), F.sum("sq").alias("sqt"),
        F.sum(F.col("ng") * F.col("mg") * F.col("mg")).alias("sb0"),
    )
    n = F.col("n").cast("double")
    ssb = F.col("sb0") - F.try_divide(F.col("st") * F.col("st"), n)
    ssw = F.col("sqt") - F.col("sb0")
    between, within = F.try_divide(ssb, F.col("a") - 1), F.try_divide(ssw, n - F.col("a"))
    return t.select("n", "a", F.try_divide(between, within).alias("f"))


#: Pairs that are ranked as rows; more are ranked as blocks of values, in groups of about GROUP_PAIRS.
PAIR_ROWS, GROUP_PAIRS = 1 << 16, 1 << 21
#: Samples whose pairs tell where the groups of values end.
CUT_ROWS = 1024


def mantel(d1: DataFrame | Distances, d2: DataFrame | Distances, method: str = "pearson", decimals: int | None = None) -> DataFrame:
    """Correlation of two distance pair tables over their common (i, j); null if the distances of one are all equal.

    Two :class:`Distances` are met by block pairs: Pearson's adds up, Spearman's ranks blocks of
    values; only few pairs are ranked as rows.  Ranks are of distances rounded to ``decimals``.
    """
    from tessera.operators.correlate import correlated

    if isinstance(d1, Distances) and isinstance(d2, Distances):
        if method == "pearson":
            return _mantel_sums(d1, d2)
        n = _both_sides(d1, d2).count()
        if n * (n - 1) // 2 > PAIR_ROWS:
            return _mantel_ranks(d1, d2, n, decimals)
    d1, d2 = (d.pairs() if isinstance(d, Distances) else d for d in (d1, d2))
    j = d1.select("i", "j", F.col("d").alias("d1")).join(d2.select("i", "j", F.col("d").alias("d2")), ["i", "j"])
    if method == "spearman":
        from tessera.operators.ranking import row_ranks

        if decimals is not None:
            j = j.withColumns({c: F.round(c, decimals) for c in ("d1", "d2")})
        j = row_ranks(j.withColumn("_k", F.lit(1)), ["_k"], "d1").withColumnRenamed("rank", "r1")
        j = row_ranks(j, ["_k"], "d2").withColumnRenamed("rank", "r2")
        return j.agg(F.count(F.lit(1)).alias("n_pairs"), correlated("r1", "r2").alias("r"))
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), correlated("d1", "d2").alias("r"))


def _both_sides(d1: Distances, d2: Distances) -> DataFrame:
    """(id, u, v): the vectors of the samples that both have."""
    side = lambda d, c: d.vectors.select(F.col(d.key).alias("id"), whole_vector("vec").cast("array<double>").alias(c))
    return side(d1, "u").join(side(d2, "v"), "id")


def _edges(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, from above it, hot) of each edge between groups of values; a value that fills a whole
    group is hot: edges on both sides of it leave it a group of its own."""
    value, times = np.unique(cuts, return_counts=True)
    above = np.concatenate([np.zeros(len(value), bool), np.ones(int((times > 1).sum()), bool)])
    edge = np.concatenate([value, value[times > 1]])
    order = np.lexsort((above, edge))
    edge, above = edge[order], above[order]
    return edge, above, np.concatenate([[False], np.r_[edge[1:] == edge[:-1], False][: len(edge)] & ~above])


def _dealt(x: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups in sorted values."""
    edge, above, _ = edges
    at = np.where(above, np.searchsorted(x, edge, "right"), np.searchsorted(x, edge, "left"))
    return np.r_[0, at], np.r_[at, len(x)]


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of sorted values."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(x)])
    return np.repeat(first + (size + 1) / 2.0, size)


def _mantel_ranks(d1: Distances, d2: Distances, n: int, decimals: int | None) -> DataFrame:
    """(n_pairs, r) of average ranks, no row per pair.

    The distances of a block pair are dealt by groups of values of the first, as arrays of both
    distances.  A group ranks its first distances and deals them on by groups of the second, which
    rank those.  What is left is, for every two groups, a count and sums of ranks inside the groups;
    the ranks below a group are added to those when all groups' sizes are known.  The pairs of a
    value that fills a group have one rank, so they need not be brought together.
    """
    from tessera.session import cut_lineage

    rows = cut_lineage(_both_sides(d1, d2))
    metrics = d1.metric, d2.metric
    groups = max(-(-(n * (n - 1) // 2) // GROUP_PAIRS), rows.sparkSession.sparkContext.defaultParallelism)

    def formed(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray, same: bool) -> list[np.ndarray]:
        """Both distances of the pairs of a cell, NaN where unknown; one that is itself no number ranks highest."""
        out = []
        for c, metric in zip("uv", metrics):
            held = []
            for at, d, known in strips(side_matrix(left[c]), side_matrix(right[c]), metric, exact=True):
                once = _once(a, b, at, same)
                d = np.where(known, np.where(np.isnan(d), np.inf, d), np.nan)
                held.append(d.ravel() if once is None else d[once])
            d = np.concatenate(held)
            out.append(d if decimals is None else np.round(d, decimals))
        return out

    def quantiles(*cell) -> pa.Table:
        share = np.arange(1, groups) / groups
        got = [v[~np.isnan(v)] for v in formed(*cell)]
        cuts = [np.quantile(v, share, method="nearest") if len(v) else np.empty(0) for v in got]
        return pa.table({c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in zip("uv", cuts)})

    some = rows.orderBy(F.xxhash64("id"), "id").limit(CUT_ROWS)
    e1, e2 = (_edges(np.array(c, float)) for c in on_cells(some, quantiles, "u array<double>, v array<double>", blocks=1).first())
    hot1, hot2 = (set(np.flatnonzero(e[2]).tolist()) for e in (e1, e2))

    def deal(x: np.ndarray, y: np.ndarray, edges: tuple) -> tuple[list[int], list[bytes], list[bytes]]:
        """Groups of y with their parts of x and y; unknown y are group -1 and come last."""
        order = np.argsort(y)
        x, y = x[order], y[order]
        known = len(y) - int(np.isnan(y).sum())
        starts, ends = _dealt(y[:known], edges)
        full = np.flatnonzero(ends > starts).tolist()
        cut = [slice(starts[g], ends[g]) for g in full]
        if known < len(y):
            full, cut = [*full, -1], [*cut, slice(known, len(y))]
        return full, [x[c].tobytes() for c in cut], [y[c].tobytes() for c in cut]

    def by_first(*cell) -> pa.Table:
        x, y = formed(*cell)
        g, y, x = deal(y, x, e1)
        return pa.table({"g1": pa.array(g, pa.int32()), "x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary())})

    def values(t: pa.Table, c: str) -> np.ndarray:
        return np.frombuffer(b"".join(t[c].to_pylist()))

    def by_second(key, t):
        """The ranks in a group of the first distance by the groups of the second, and (g2 = -1) what they add up to."""
        g, x, y = key[0].as_py(), values(t, "x"), values(t, "y")
        if g < 0 or g in hot1:
            rank = np.zeros(len(x))
        else:
            order = np.argsort(x)
            rank, y = _average_ranks(x[order]), y[order]
        g2, r, v = deal(rank, y, e2)
        if g2 and g2[-1] < 0:
            g2, r, v = g2[:-1], r[:-1], v[:-1]
        k = len(g2)
        return pa.table({
            "g1": pa.array([g] * (k + 1), pa.int32()), "g2": pa.array([*g2, -1], pa.int32()), "x": pa.array([*r, None], pa.binary()), "y": pa.array([*v, None], pa.binary()),
            "n": pa.array([0] * k + [len(rank)], pa.int64()), "s": [0.0] * k + [float(rank.sum())], "ss": [0.0] * k + [float(rank @ rank)],
        })

    def add(key, t):
        """Sums by two groups; of a group of the second alone with g1 = -2, of one of the first with g2 = -1."""
        g2 = key[0].as_py()
        if g2 < 0:
            zero = np.zeros(len(t))
            return pa.table({"g1": t["g1"], "g2": t["g2"], "n": t["n"], "s1": t["s"], "s2": zero, "s12": zero, "ss": t["ss"]})
        r1, y = values(t, "x"), values(t, "y")
        g1 = np.repeat(t["g1"].to_numpy().astype(np.int64), pc.binary_length(t["y"]).to_numpy() // 8)
        r2 = np.zeros(len(y))
        if g2 not in hot2:
            order = np.argsort(y)
            r2[order] = _average_ranks(y[order])
        code = g1 + 1
        n, s1, s2, s12 = np.bincount(code), np.bincount(code, r1), np.bincount(code, r2), np.bincount(code, r1 * r2)
        at = np.flatnonzero(n[1:]) + 1
        of = lambda v, whole: np.append(v[at], whole)
        return pa.table({
            "g1": pa.array(np.append(at - 1, -2), pa.int32()), "g2": pa.array(np.full(len(at) + 1, g2), pa.int32()), "n": pa.array(of(n, len(y)), pa.int64()),
            "s1": of(s1, 0.0), "s2": of(s2, r2.sum()), "s12": of(s12, 0.0), "ss": of(np.zeros(len(n)), r2 @ r2),
        })

    # a hot group's rows may be added up anywhere
    spread = lambda g, hot, *by: F.when(F.col(g).isin(hot), F.pmod(F.xxhash64(*by), F.lit(groups))).otherwise(F.lit(0)).alias("part")
    first = on_cells(rows, by_first, "g1 int, x binary, y binary").groupBy("g1", spread("g1", [-1, *hot1], "y"))
    second = first.applyInArrow(by_second, "g1 int, g2 int, x binary, y binary, n long, s double, ss double")
    second = second.groupBy("g2", spread("g2", [-1, *hot2], "g1", "x"))
    added = second.applyInArrow(add, "g1 int, g2 int, n long, s1 double, s2 double, s12 double, ss double")
    sums = cut_lineage(added.groupBy("g1", "g2").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s12", "ss")]))
    return _ranked_correlation(sums, hot1, hot2)


def _ranked_correlation(sums: DataFrame, hot1: set, hot2: set) -> DataFrame:
    """(n_pairs, r) from counts and sums of the ranks inside groups."""
    spark = sums.sparkSession

    def below(rows: list, hot: set) -> tuple[dict[int, float], float, float]:
        """What is to be added to each group's ranks, centred; number and variance of all ranks."""
        total = sum(n for _, n, _, _ in rows)
        off, before, square, plain = {}, 0, 0.0, 0.0
        for g, n, s, ss in rows:
            off[g] = before + ((n + 1) / 2 if g in hot else 0.0) - (total + 1) / 2
            square += n * off[g] ** 2 + 2 * off[g] * s + ss
            plain += n * off[g] + s
            before += n
        return off, total, square / total - (plain / total) ** 2 if total else 0.0

    own = sums.filter("g2 = -1").select("g1", "n", "s1", "ss").orderBy("g1").collect()
    off1, n1, var1 = below([tuple(r) for r in own if r["g1"] >= 0], hot1)
    off2, n2, var2 = below([tuple(r) for r in sums.filter("g1 = -2").select("g2", "n", "s2", "ss").orderBy("g2").collect()], hot2)
    n_pairs, r = sum(x["n"] for x in own), None
    if var1 * 16 > n1 and var2 * 16 > n2:  # ranks that are not all equal vary by (n - 1) / 4 at least
        table = lambda off, g, o: spark.createDataFrame(list(off.items()), f"{g} int, {o} double")
        met = sums.join(table(off1, "g1", "o1"), "g1").join(table(off2, "g2", "o2"), "g2")
        t = met.agg(
            F.sum("n").alias("m"), F.sum(F.col("n") * F.col("o1") + F.col("s1")).alias("a"), F.sum(F.col("n") * F.col("o2") + F.col("s2")).alias("b"),
            F.sum(F.col("n") * F.col("o1") * F.col("o2") + F.col("o1") * F.col("s2") + F.col("o2") * F.col("s1") + F.col("s12")).alias("ab"),
        ).first()
        if t["m"]:
            r = float((t["ab"] / t["m"] - t["a"] / t["m"] * t["b"] / t["m"]) / np.sqrt(var1 * var2))
    return spark.createDataFrame([(n_pairs, r)], "n_pairs long, r double")


def _mantel_sums(d1: Distances, d2: Distances) -> DataFrame:
    """(n_pairs, r) from counts, means and centred sums of each block pair."""
    from tessera.session import cut_lineage

    rows = _both_sides(d1, d2)
    metrics = d1.metric, d2.metric

    def run(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray, same: bool) -> pa.Table:
        both = [strips(side_matrix(left[c]), side_matrix(right[c]), m) for c, m in zip("uv", metrics)]
        out = []
        for (at, x, known), (_, y, too) in zip(*both):
            once = _once(a, b, at, same)
            use, n = known & too, x.size
            if once is not None:
                use, n = use & once, int(once.sum())
            x, y = (x.ravel(), y.ravel()) if use.all() else (x[use], y[use])
            if not len(x):
                out.append((n, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
                continue
            mx, my = x.mean(), y.mean()
            x, y = x - mx, y - my
            out.append((n, len(x), mx, my, x @ x, y @ y, x @ y))
        names = ("n", "m", "mx", "my", "xx", "yy", "xy")
        return pa.table({c: pa.array(v, pa.int64() if c in "nm" else pa.float64()) for c, v in zip(names, zip(*out))})

    got = cut_lineage(on_cells(rows, run, "n long, m long, mx double, my double, xx double, yy double, xy double"))
    mean = got.agg(F.sum(F.col("m") * F.col("mx")).alias("x"), F.sum(F.col("m") * F.col("my")).alias("y"), F.sum("m").alias("m"))
    mean = mean.select(F.try_divide("x", "m").alias("x"), F.try_divide("y", "m").alias("y"))
    dx, dy = F.col("mx") - F.col("tx"), F.col("my") - F.col("ty")
    t = got.withColumns({"tx": mean.select("x").scalar(), "ty": mean.select("y").scalar()}).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.sum(F.col("xx") + F.col("m") * dx * dx).alias("xx"),
        F.sum(F.col("yy") + F.col("m") * dy * dy).alias("yy"), F.sum(F.col("xy") + F.col("m") * dx * dy).alias("xy"),
    )
    return t.select("n_pairs", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("r"))
