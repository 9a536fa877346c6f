"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: 64 bits by majority over the XXH64 (seed 42) of all 3-word shingles of
the lower-cased (A-Z) text.  Links: fingerprints that differ in at most 3 bits.

Two fingerprints within 3 bits agree on one of four 16-bit blocks.  So there are four
Gray orders, each of the fingerprints rotated until one of the blocks leads; its value is
then the prefix of the Gray rank, and the fingerprints of one value are a run of the order
with a tree of their own, whatever their number.  An upper node stores the bits that all
its members share (mask and pattern).  A search starts with the roots and goes down in
pairs of nodes; each pair adds the differences of the bits that its level decides to those
of the levels above, and a pair of whole groups is pruned as soon as they exceed 3.
A block with very many fingerprints is dealt by hash into parts of bounded size, and
each pair of parts is a task of its own.  A task returns a spanning forest of the links
that it finds, never all pairs; components are joined by star contraction.

Defined cases: null text counts as empty; a text without words has fingerprint zero
and links like any other; one or two words form one shingle; a null id counts as
larger than any other, a component of null ids only has a null id; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, numbered, whole_text
from quillon.llm.components import connected_components

WORDS, RADIUS, BLOCKS = 3, 3, 4
#: Most fingerprints of one block that one task compares with as many others.
PART = 2048
FANOUT = 16
#: Rows of small blocks that one call indexes together.
BUCKET_ROWS = 8192
_PIECE = 1 << 17


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of one text; shingles are hashed in pieces so memory stays bounded."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z only
    if not tokens:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _PIECE):
        part = tokens[start : min(start + _PIECE, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
        hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp as a signed long."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray sequence."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def turned(fp: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Rotated to the left."""
    bits = np.asarray(bits, np.uint64) & np.uint64(63)
    return (fp << bits) | (fp >> ((np.uint64(64) - bits) & np.uint64(63)))


class GrayIndex:
    """Trees over fingerprints in Gray order, one for each group (numbered from 0).

    Level 0 holds the fingerprints; a node of a higher level stands for up to FANOUT
    neighbours of the level below and holds the bits that all of them share (which, and
    their values).  At the top level node g is the root of group g.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray | None = None, turn: np.ndarray | int = 0):
        group = np.zeros(len(fps), np.int64) if group is None else group
        order = np.lexsort((gray_rank(turned(fps, turn)), group))
        self.fps, group = fps[order], group[order]
        ones, zeros = self.fps, ~self.fps  # bits that all members have / lack
        self.levels, self.children = [(ones, ones | zeros)], []
        while (head := np.r_[True, group[1:] != group[:-1]]).sum() < len(group):
            starts = np.flatnonzero(head)
            place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            first = np.flatnonzero(place % FANOUT == 0)
            self.children.append((first, np.diff(np.r_[first, len(group)])))
            ones, zeros, group = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first), group[first]
            self.levels.append((ones, ones | zeros))

    def links(self, radius: int, a: np.ndarray, b: np.ndarray, chunk: int = 1 << 18):
        """Yield (i, j) arrays of positions of linked pairs between the groups a[k] <= b[k].

        A pair of nodes carries the bits that both have decided and the differences among
        them; each level adds the bits that are decided there, and a pair beyond the radius
        is dropped with all that is below it.
        """
        stack = [(len(self.levels) - 1, a, b, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint8))]
        while stack:
            level, a, b, known, differ = stack.pop()
            bits, decided = self.levels[level]
            both = decided[a] & decided[b]
            differ = differ + np.bitwise_count((bits[a] ^ bits[b]) & both & ~known)
            near = np.flatnonzero(differ <= radius)
            a, b, known, differ = a[near], b[near], both[near], differ[near]
            if level == 0:
                yield a, b
                continue
            first, count = self.children[level - 1]
            for s in range(0, len(a), max(1, chunk // FANOUT**2)):
                x, y = a[s : s + chunk // FANOUT**2], b[s : s + chunk // FANOUT**2]
                pairs = count[x] * count[y]
                row = np.repeat(np.arange(len(x)), pairs)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                i, j = first[x][row] + k // count[y][row], first[y][row] + k % count[y][row]
                once = np.flatnonzero(i < j if level == 1 else i <= j)
                row = row[once] + s
                stack.append((level - 1, i[once], j[once], known[row], differ[row]))


class _Forest:
    """Union by vectorised rounds of hooking and shortcutting."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def forest_edges(fps: np.ndarray, key: np.ndarray, part: np.ndarray, turn: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (edges as two arrays) of the links between rows of equal key.

    Each part of a key is a group of the index; a key of two parts is searched between them.
    """
    if not len(key):
        return fps, fps
    order = np.lexsort((part, key))
    fps, key, part = fps[order], key[order], part[order]
    turn = np.broadcast_to(turn, len(order))[order]
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    nodes = np.unique(fps)
    index, forest = GrayIndex(fps, group, turn), _Forest(len(nodes))
    at = np.searchsorted(nodes, index.fps)
    for a, b in index.links(RADIUS, group[starts], group[np.r_[starts[1:], len(key)] - 1]):
        forest.add(at[a], at[b])
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def _bucket(table: pa.Table) -> pa.Table:
    column = lambda name: table.column(name).to_numpy()
    key = np.unique(np.stack([column("block"), column("value"), column("low"), column("high")]), axis=1, return_inverse=True)[1]
    turn = 64 - 64 // BLOCKS * (column("block") + 1)  # the block of the key leads
    a, b = forest_edges(column("fp").view(np.uint64), key.ravel(), column("part"), turn)
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(distinct: DataFrame, part: int = PART, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) within RADIUS bits."""
    bits = 64 // BLOCKS
    buckets = max(1, BLOCKS * distinct.count() // bucket_rows)
    blocks = F.array(*[F.struct(F.lit(k).cast("long").alias("block"), F.shiftrightunsigned("fp", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for k in range(BLOCKS)])
    keyed = distinct.select("fp", F.explode(blocks).alias("key")).select("fp", "key.block", "key.value")
    sizes = distinct.select(F.explode(blocks).alias("key")).groupBy("key").count().where("count > 1")
    sized = keyed.join(
        sizes.select(F.col("key.block").alias("b2"), F.col("key.value").alias("v2"), F.ceil(F.col("count") / part).cast("long").alias("parts")),
        (F.col("block") == F.col("b2")) & (F.col("value") == F.col("v2")),
    )
    own = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = (
        sized.select("fp", "block", "value", "parts", own.alias("part"), other.alias("other"))
        .withColumn("low", F.least("part", "other"))
        .withColumn("high", F.greatest("part", "other"))
        # Small blocks share buckets; each pair of parts of a hot block has its own.
        .withColumn(
            "bucket",
            F.when(F.col("parts") == 1, F.struct(F.pmod(F.xxhash64("block", "value"), F.lit(buckets)).alias("n"), F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high")))
            .otherwise(F.struct((F.col("block") * (1 << bits) + F.col("value") + buckets).alias("n"), F.col("low").alias("low"), F.col("high").alias("high"))),
        )
    )
    return dealt.select("bucket", "fp", "block", "value", "low", "high", "part").groupBy("bucket").applyInArrow(_bucket, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    distinct = checkpointed(firsts)
    components = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each component; all columns stay as they are."""
    names = docs.columns
    docs, id_col, text_col = numbered(docs, id_col, text_col)
    kept = near_dedup(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    chosen = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    repeated = checkpointed(docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"))
    if repeated.isEmpty():
        return chosen.toDF(*names)
    once = chosen.join(repeated, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    more = chosen.join(repeated, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([id_col])
    return once.unionByName(more).toDF(*names)
