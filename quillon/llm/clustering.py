"""Centroid clustering (Lloyd's rounds) by kd-tree filtering.

Vectors become integers, floor(SCALE * x).  Each task packs its vectors into kd-trees of
bounded size; a node holds its number of vectors, their integer sum and their box.  The trees
are written once and read in every round.  A round goes down each tree level by level with the
centroids that are still candidates of a node: the one nearest to the middle of the box
dominates another if even that corner of the box which favours the other most is strictly
nearer to it.  A node with one candidate left is assigned whole by its count and sum; leaves
that keep several are resolved vector by vector.  Tasks send one sum per centroid and
component, which Spark adds up; the driver sees centroids only (k times DIM numbers).

All arithmetic is exact: in floating point where every number stays below 2^53, in 64-bit
integers up to 2^62, in Python's integers beyond, so that finite components of any size take part.

Defined cases: vectors that are null, of another length, or hold null or non-finite components
take no part; of fewer vectors than k each is a centroid; a null id seeds after all others, equal
ids in the order of their vectors; equal centroids leave the vectors to the smaller number, the
other stays empty; distances and inertias beyond a long count as the largest long; repeated
rows count as rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import settings, written_table

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, 2
TREE_ROWS, LEAF = 2048, 32
#: Trees come a few at a time to the tasks.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Sums travel as digits of this many bits, so that no sum of a column of them can overflow.
_DIGIT = 30
_NARROW = 1 << 26
_LAST = (1 << 63) - 1


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); Python integers (dtype object) where 64 bits would not do in later products."""
    if not x.size or np.abs(x).max() < _NARROW / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(Fraction(float(v)) * SCALE) for v in x.ravel()], object).reshape(x.shape)


def _fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the fastest type in which sums of DIM products of their doubled differences are exact."""
    high = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    worst = 16 * arrays[0].shape[1] * high * high
    kind = np.float64 if worst < 1 << 53 else np.int64 if worst < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each centroid."""
    return (points * points).sum(1)[:, None] - 2 * (points @ centroids.T) + (centroids * centroids).sum(1)[None]


class KdTree:
    """Nodes in breadth-first order over rows that are sorted so that each node is a run.

    ``first`` and ``last`` bound the run of a node, ``left`` is its first child (the second
    follows; -1 for a leaf), ``low`` and ``high`` its box, ``total`` the sum of its rows.
    """

    def __init__(self, rows: np.ndarray, first, last, left, low, high, total):
        self.rows, self.first, self.last, self.left = rows, first, last, left
        self.low, self.high, self.total = low, high, total

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> tuple[KdTree, np.ndarray]:
        """The tree and the order of its rows."""
        order, spans, left = np.arange(len(rows)), [(0, len(rows))], []
        for a, b in spans:  # grows while it is read
            part = rows[order[a:b]]
            spread = part.max(0) - part.min(0)
            axis = int(np.argmax(spread))
            if b - a <= leaf or not spread[axis]:
                left.append(-1)
                continue
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
            left.append(len(spans))
            spans += [(a, a + middle), (a + middle, b)]
        rows = rows[order]
        low, high, total = (np.array([f(rows[a:b]) for a, b in spans], rows.dtype) for f in (lambda r: r.min(0), lambda r: r.max(0), lambda r: r.sum(0)))
        first, last = np.array(spans, np.int64).T
        return cls(rows, first, last, np.array(left, np.int64), low, high, total), order

    def assign(self, centroids: np.ndarray, each: bool = False):
        """(counts, sums) by centroid; with ``each`` also (labels, squared distances) of the rows.

        Centroids are distinct; the smaller number wins a tie.
        """
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, self.rows.shape[1]), self.rows.dtype)
        labels = np.zeros(len(self.rows), np.int64)
        low, high, c = _fitting(self.low, self.high, centroids)
        norms = (c * c).sum(1)
        nodes, open_to = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            lo, hi = low[nodes], high[nodes]
            reach = distances(lo + hi, 2 * c)
            nearest = np.where(open_to, reach, reach.max() + 1).argmin(1)
            gap = c[None] - c[nearest][:, None]  # node, candidate, component
            corner = (np.maximum(gap, 0) * hi[:, None] + np.minimum(gap, 0) * lo[:, None]).sum(2)
            open_to &= ~(norms[None] - norms[nearest][:, None] > 2 * corner)
            single, leaf = open_to.sum(1) == 1, self.left[nodes] < 0
            whole = nodes[single]
            np.add.at(counts, nearest[single], self.last[whole] - self.first[whole])
            np.add.at(sums, nearest[single], self.total[whole])
            if each:
                for node, z in zip(whole, nearest[single], strict=True):
                    labels[self.first[node] : self.last[node]] = z
            if len(rest := nodes[leaf & ~single]):
                at = np.concatenate([np.arange(self.first[n], self.last[n]) for n in rest])
                mine = distances(*_fitting(self.rows[at], centroids)).argmin(1)
                np.add.at(counts, mine, 1)
                np.add.at(sums, mine, self.rows[at])
                labels[at] = mine
            down = np.flatnonzero(~leaf & ~single)
            nodes = np.r_[self.left[nodes[down]], self.left[nodes[down]] + 1]
            open_to = np.r_[open_to[down], open_to[down]]
        if not each:
            return counts, sums
        rows, c = _fitting(self.rows, centroids)
        return labels, ((rows - c[labels]) ** 2).sum(1)

    def packed(self) -> bytes:
        return np.concatenate([np.stack([self.first, self.last, self.left], 1), self.low, self.high, self.total], 1).astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, rows: np.ndarray, nodes: bytes) -> KdTree:
        dim = rows.shape[1]
        table = np.frombuffer(nodes, "<i8").reshape(-1, 3 + 3 * dim)
        return cls(rows, *table[:, :3].T, *(table[:, 3 + i * dim : 3 + (i + 1) * dim] for i in range(3)))


def _planting(dim: int, tree_rows: int):
    """Tasks turn their vectors into trees: (ids, data, nodes) per tree; nodes is null where rows are wide."""

    def tree(ids: pa.Array, x: np.ndarray, wide: bool):
        if wide:
            return pa.array([ids], pa.list_(ids.type)), x.astype("<f8").tobytes(), None
        built, order = KdTree.build(whole_numbers(x))
        return pa.array([ids.take(pa.array(order))], pa.list_(ids.type)), built.rows.astype("<i4").tobytes(), built.packed()

    def run(batches):
        kept: dict[bool, list] = {False: [], True: []}

        def full(wide: bool, end: bool):
            while kept[wide] and (end or sum(len(i) for i, _ in kept[wide]) >= tree_rows):
                ids, x = pa.concat_arrays([i for i, _ in kept[wide]]), np.concatenate([x for _, x in kept[wide]])
                kept[wide] = [(ids[tree_rows:], x[tree_rows:])] if len(ids) > tree_rows else []
                owners, data, nodes = tree(ids[:tree_rows], x[:tree_rows], wide)
                yield pa.RecordBatch.from_arrays([owners, pa.array([data], pa.binary()), pa.array([nodes], pa.binary())], names=["ids", "data", "nodes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            large = np.abs(x).max(1) >= _NARROW / SCALE
            for wide in (False, True):
                if (large == wide).any():
                    kept[wide].append((batch.column("id").filter(pa.array(large == wide)), x[large == wide]))
                    yield from full(wide, False)
        for wide in (False, True):
            yield from full(wide, True)

    return run


def _trees(batch: pa.RecordBatch, dim: int):
    """(ids, tree) of the rows of a batch."""
    for ids, data, nodes in zip(batch.column("ids"), batch.column("data"), batch.column("nodes"), strict=True):
        if nodes.is_valid:
            yield ids.values, KdTree.unpacked(np.frombuffer(data.as_py(), "<i4").reshape(-1, dim).astype(np.int64), nodes.as_py())
        else:
            built, order = KdTree.build(whole_numbers(np.frombuffer(data.as_py(), "<f8").reshape(-1, dim)))
            yield ids.values.take(pa.array(order)), built


def _distinct(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The different centroids and the smallest number of each, ascending."""
    numbers = np.array(sorted({tuple(c): n for n, c in reversed(list(enumerate(centroids)))}.values()), np.int64)
    rows = [centroids[n] for n in numbers]
    kind = np.int64 if max(abs(v) for r in rows for v in r) < 1 << 62 else object
    return np.array(rows, kind), numbers


def _round(centroids: list[list[int]], dim: int):
    """Sums by centroid over a task: (cluster, part, digit, value); part -1 is the count."""

    def run(batches):
        rows, numbers = _distinct(centroids)
        counts, sums = np.zeros(len(rows), object), np.zeros((len(rows), dim), object)
        for batch in batches:
            for _, tree in _trees(batch, dim):
                n, s = tree.assign(rows)
                counts, sums = counts + n, sums + s
        out = []
        for z in np.flatnonzero(counts):
            for part, value in enumerate([counts[z], *sums[z]], -1):
                sign, value, digit = (-1 if value < 0 else 1), abs(int(value)), 0
                while value or (part < 0 and not digit):
                    out.append((int(numbers[z]), part, digit, sign * (value & (1 << _DIGIT) - 1)))
                    value, digit = value >> _DIGIT, digit + 1
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "part", "digit", "value"])

    return run


def _final(centroids: list[list[int]], dim: int):
    def run(batches):
        rows, numbers = _distinct(centroids)
        for batch in batches:
            for ids, tree in _trees(batch, dim):
                labels, far = tree.assign(rows, each=True)
                far = pa.array([min(int(d), _LAST) for d in far] if far.dtype == object else far.astype(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers[labels].astype(np.int32)), far], names=["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    kept = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(
        (F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    with settings(spark, _BATCHES):
        trees = written_table(kept.mapInArrow(_planting(dim, tree_rows), f"ids array<{kind}>, data binary, nodes binary"))
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
        firsts = kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
        centroids = [[math.floor(Fraction(v) * SCALE) for v in r["x"]] for r in firsts]
        for _ in range(rounds if centroids else 0):
            parts = trees.mapInArrow(_round(centroids, dim), "cluster int, part int, digit int, value long")
            sums: dict[int, dict[int, int]] = {}
            for r in parts.groupBy("cluster", "part", "digit").agg(F.sum("value").alias("value")).collect():
                mine = sums.setdefault(r["cluster"], {})
                mine[r["part"]] = mine.get(r["part"], 0) + (r["value"] << _DIGIT * r["digit"])
            for z, mine in sums.items():
                centroids[z] = [mine.get(i, 0) // mine[-1] for i in range(dim)]
        rows = trees.mapInArrow(_final(centroids, dim), f"id {kind}, cluster int, distance long")
        assigned = written_table(rows if centroids else rows.limit(0))
    long_sum = F.sum(F.col("distance").cast("decimal(38,0)"))
    stats = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(long_sum.alias("s")).collect()}
    total = min(_LAST, sum(stats.values()))
    facts = [(z, min(_LAST, s), total, hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()) for z, s in stats.items()]
    by_cluster = spark.createDataFrame(facts, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return assigned.join(F.broadcast(by_cluster), F.col("cluster") == F.col("number")).select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
