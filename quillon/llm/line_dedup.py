"""Line dedup by an exact set-similarity join of line tokens.

A line is the set of its words.  A line goes if an earlier line (by document id, then line
number) has the same set, or one with Jaccard similarity of at least 0.8.

1. Token counts over all documents in a sketch of fixed size give the global order, rare
   tokens first (any fixed order is exact; rarity keeps the index groups small).
2. Equal sets are grouped by a 128-bit hash of the set (with its size and bitmap); the earliest
   line stands for its class.
3. Each class enters an index under its prefix (its first n - ceil(0.8 n) + 1 tokens).  Classes
   that meet at a token pass length, positional and bitmap filters (each exact).  Tokens
   with very many classes are dealt by hash into parts, every pair of parts a task.
   For each line the earlier partner whose bitmap is closest is emitted at first; lines with
   more that did not match it get all of theirs in a second round.
4. Candidates are verified on the words of their lines themselves.

Defined cases: null text counts as empty; lines without words always stay; case matters;
null ids come last; rows with equal id and text are one document and get equal results; an empty
table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import byte_hashes, byte_heads, checkpointed, mixed, numbered, slices, whole_text, written_table

#: Buckets of the rarity sketch (fixed size, broadcast) and of the filter for verification.
SKETCH_BITS, SLICES, WANTED_BITS = 19, 64, 1 << 24
SKETCH = 1 << SKETCH_BITS
#: Similarity as an exact fraction.
NUMERATOR, DENOMINATOR = 4, 5
PART, BUCKETS_OF, LEAF = 2048, 16_384, 48
HOT_TOKENS, BLOCK = 200_000, 256
_CHUNK = 500_000
NO_ID = (1 << 63) - 1
_LOW, _HIGH = (1 << 40) - 1, (1 << 48) - 1
_IS_SPACE = np.array([chr(b).isspace() and b < 128 for b in range(256)])
#: Lead byte -> the other bytes of the white space characters outside ASCII.
_WIDE = {}
for _c in filter(str.isspace, map(chr, range(128, sys.maxunicode + 1))):
    _WIDE.setdefault(_c.encode()[:1], []).append(_c.encode()[1:])
_ROW = "doc long, tie long, line int"
#: Lanes of the parity bitmap.
BITS = ("bits0", "bits1", "bits2")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, text), distinct; ``tie`` tells documents of one id apart, and is 0 where ids are unique."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), whole_text(text_col).alias("text"))
    if base.groupBy("doc").count().where("count > 1").isEmpty():
        return base.select("doc", F.lit(0).cast("long").alias("tie"), "text")
    return base.withColumn("tie", F.xxhash64("text")).groupBy("doc", "tie").agg(F.first("text").alias("text"))


class Words:
    """Words of the lines of some texts, found on their bytes all at once.

    ``starts`` and ``sizes`` are those of the words, ``ends_at`` counts the words up to
    the end of each line, ``lines_of`` the lines of each text.
    """

    def __init__(self, texts: pa.Array):
        parts = texts.cast(pa.binary()).to_pylist()
        data = np.frombuffer(b"\n".join([*parts, bytes(8)]), np.uint8)
        size = len(data) - 8
        space = _IS_SPACE[data[:size]]
        for lead in _WIDE:  # white space of two or three bytes
            for tail in _WIDE[lead] if (data[:size] == lead[0]).any() else ():
                found = np.flatnonzero(data[:size] == lead[0])
                for k, byte in enumerate(tail, 1):
                    found = found[data[found + k] == byte]
                for k in range(len(tail) + 1):
                    space[found + k] = True
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        bounds = np.r_[0, change] if size and not space[0] else change  # the last byte is a line end
        self.starts, ends = bounds[::2], bounds[1::2]
        self.sizes = ends - self.starts
        self.breaks = np.flatnonzero(data[:size] == 10)
        self.ends_at = np.searchsorted(self.starts, self.breaks)
        closing = np.cumsum([len(x) + 1 for x in parts]) - 1
        self.lines_of = np.diff(np.r_[-1, np.searchsorted(self.breaks, closing)])
        self._octets = np.ndarray(size, "<u8", data, strides=(1,))
        self.head = byte_heads(self._octets, self.starts, self.sizes)

    def buckets(self) -> np.ndarray:
        """Sketch bucket of each word: by its first eight bytes and its length."""
        return (self.head * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, over all its bytes."""
        return byte_hashes(self._octets, self.starts, self.sizes, self.head)


def token_sketch(rows: DataFrame) -> np.ndarray:
    """Word occurrences by hash bucket over all documents; tasks send compressed slices."""

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in slices(batches, 2048):
            total += np.bincount(Words(batch.column(0)).buckets(), minlength=SKETCH)
        pack, parts = zstandard.ZstdCompressor(level=1), total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([pack.compress(x.tobytes()) for x in parts], pa.binary())], names=["slice", "n"])

    def add(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(unpack.decompress(x.as_py()), np.int64) for x in table.column("n"))
        return pa.table({"slice": table.column("slice")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("text").mapInArrow(count, "slice int, n binary").groupBy("slice").applyInArrow(add, "slice int, n binary").collect()
    out = np.zeros((SLICES, SKETCH // SLICES), np.int64)  # fixed size
    for r in sums:
        out[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return out.ravel()


def prefix_length(n: np.ndarray | int):
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def rarity(counts: np.ndarray) -> np.ndarray:
    """Class of each bucket, 0 the rarest: four to each doubling of the count."""
    return np.minimum(255, np.log2(np.maximum(counts, 1)) * 4).astype(np.uint64)


def line_sets(hashes: np.ndarray, buckets: np.ndarray, lines: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Per distinct value of ``lines`` (ascending, under 2^16): set hash, size, bitmap and prefix.

    Words are ordered by (rarity class, low 40 bits of the hash) within their line; the high
    48 bits are sorted beside them, so that the two halves tell all words apart.
    """
    line = lines.astype(np.uint64) << np.uint64(48)
    key = line | classes[buckets] << np.uint64(40) | hashes & np.uint64(_LOW)
    low, high = (np.sort(x) for x in (key, line | hashes >> np.uint64(16)))
    low, high = (x[np.r_[True, x[1:] != x[:-1]]] for x in (low, high))
    starts, others = (np.flatnonzero(np.r_[True, (x[1:] ^ x[:-1]) >> np.uint64(48) != 0]) for x in (low, high))
    sizes = np.diff(np.r_[starts, len(low)])
    if (sizes < np.diff(np.r_[others, len(high)])).any():  # words of a line that share their low half: tell them apart by the rest
        order = np.lexsort((hashes, key))
        first = np.r_[True, (key[order][1:] != key[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]
        low = key[order][first]
        starts = np.flatnonzero(np.r_[True, (low[1:] ^ low[:-1]) >> np.uint64(48) != 0])
        sizes = np.diff(np.r_[starts, len(low)])
    tokens = low & np.uint64(_LOW)
    kind, lane = np.uint64(1) << (tokens >> np.uint64(34)), (tokens >> np.uint64(24)) % np.uint64(len(BITS))
    prefix = prefix_length(sizes)
    rank = np.arange(len(low)) - np.repeat(starts, sizes)
    chosen = np.flatnonzero(rank < np.repeat(prefix, sizes))
    return {
        "line": (low[starts] >> np.uint64(48)).astype(np.int64),
        "set": np.add.reduceat(mixed(tokens + np.uint64(1)), starts),
        "other": np.add.reduceat(mixed(high & np.uint64(_HIGH)), others),
        "n": sizes,
        # Parity of the tokens of each of 64 kinds a lane: sets whose bitmaps differ in d bits differ in d tokens at least.
        **{name: np.bitwise_xor.reduceat(np.where(lane == k, kind, np.uint64(0)), starts) for k, name in enumerate(BITS)},
        # 32 bits of a token tell it apart inside a bucket; rare clashes only add candidates.
        "prefix": (tokens[chosen] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32),
        "class": (low[chosen] >> np.uint64(40) & np.uint64(255)).astype(np.int64),
        "offsets": np.r_[0, np.cumsum(prefix)].astype(np.int32),
    }


def _classes(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row per distinct token set: its earliest line, size, bitmap, prefix tokens, and
    those of them that may be common (by the sketch, which never counts too low)."""
    common_from = int(rarity(np.array([PART]))[0])
    shared = rows.sparkSession.sparkContext.broadcast(rarity(counts).astype(np.uint8))

    def run(batches):
        kinds = shared.value.astype(np.uint64)
        for batch in slices(batches, 2048):
            words = Words(batch.column(2))
            hashes, buckets = words.hashes(), words.buckets()
            of = np.repeat(np.arange(batch.num_rows), words.lines_of)
            number = np.arange(len(of)) - np.repeat(np.cumsum(words.lines_of) - words.lines_of, words.lines_of)
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            per_line = np.diff(np.r_[0, words.ends_at])
            for a in range(0, len(of), 1 << 16):
                here = per_line[a : a + (1 << 16)]
                last = words.ends_at[min(a + (1 << 16), len(of)) - 1]
                first = last - here.sum()
                if first == last:
                    continue
                found = line_sets(hashes[first:last], buckets[first:last], np.repeat(np.arange(len(here)), here), kinds)
                at = found["line"] + a
                prefix = pa.ListArray.from_arrays(pa.array(found["offsets"]), pa.array(found["prefix"]))
                keep = found["class"] >= common_from
                ends = np.r_[0, np.cumsum(keep)][found["offsets"]].astype(np.int32)
                hot = pa.ListArray.from_arrays(pa.array(ends), pa.array(found["prefix"][keep]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["set"].view(np.int64)), pa.array(found["other"].view(np.int64)), *[pa.array(found[k].view(np.int64)) for k in BITS], pa.array(doc[of[at]]), pa.array(tie[of[at]]), pa.array(number[at].astype(np.int32)), pa.array(found["n"].astype(np.int32)), prefix, hot],
                    names=["set", "other", *BITS, "doc", "tie", "line", "n", "prefix", "hot"],
                )

    parts = rows.mapInArrow(run, f"set long, other long, {', '.join(f'{k} long' for k in BITS)}, {_ROW}, n int, prefix array<int>, hot array<int>")
    return (
        parts.groupBy("set", "other", *BITS, "n")
        .agg(F.min(F.struct("doc", "tie", "line", "prefix", "hot")).alias("x"))
        .select("x.doc", "x.tie", "x.line", "n", *BITS, "x.prefix", "x.hot")
    )


def _pairs(first_rows: np.ndarray, second_rows: np.ndarray, c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (index arrays) pass the length, positional and bitmap filters, and how far apart they look."""
    n1, n2, k1, k2 = c["n"][first_rows], c["n"][second_rows], c["k"][first_rows], c["k"][second_rows]
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    ok = low * DENOMINATOR >= high * NUMERATOR
    need = -(-(n1 + n2) * NUMERATOR // (NUMERATOR + DENOMINATOR))  # smallest overlap at this similarity
    ok &= np.minimum(k1, k2) + 1 + np.minimum(n1 - k1, n2 - k2) - 1 >= need
    apart = sum(np.bitwise_count(c[k][first_rows] ^ c[k][second_rows]).astype(np.int64) for k in BITS)
    return ok & (apart <= n1 + n2 - 2 * need), apart * 1000 // (n1 + n2)


_FIELDS = (("token", np.int32), ("low", np.int32), ("high", np.int32), ("part", np.int32), ("doc", np.int64), ("tie", np.int64), ("line", np.int32), ("n", np.int32), ("k", np.int32), *((k, np.int64) for k in BITS), ("probe", np.int8))


def _index(classes: DataFrame, hot, buckets: int, only=None) -> DataFrame:
    """(bucket, block): index entries, packed by bucket within each task.

    ``only`` has bitmaps of the lines that look for partners and of the tokens that
    matter to them, if not all do.  ``hot`` maps common tokens to their number of parts; an entry under one of them goes to
    every pair of parts that its own part belongs to.
    """

    def run(batches):
        parts_of = hot.value
        common = np.array(sorted(parts_of), np.int32)
        parts_list = np.array([parts_of[t] for t in common.tolist()], np.int64)

        def out(held):
            c = {k: np.concatenate([h[k] for h in held]) for k, _ in _FIELDS if k not in ("low", "high", "part")}
            where = np.minimum(np.searchsorted(common, c["token"]), max(0, len(common) - 1))
            is_hot = common[where] == c["token"] if len(common) else np.zeros(len(c["token"]), bool)
            parts = np.where(is_hot, parts_list[where], 1) if len(common) else np.ones(len(c["token"]), np.int64)
            own = (mixed((c["doc"] * 1_000_003 + c["line"]).view(np.uint64) ^ c["tie"].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            rows = np.repeat(np.arange(len(parts)), parts)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
            c = {k: v[rows] for k, v in c.items()}
            c["part"] = own[rows]
            c["low"], c["high"] = np.minimum(c["part"], other), np.maximum(c["part"], other)
            key = mixed(c["token"].astype(np.int64).view(np.uint64))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            split = parts[rows] > 1
            pair = mixed(key + (c["low"] * 65_537 + c["high"] + 1).view(np.uint64))
            bucket = np.where(split, buckets + (pair >> np.uint64(2)).astype(np.int64), bucket)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
            columns = [c[k][order].astype(t) for k, t in _FIELDS]
            pack = zstandard.ZstdCompressor(level=1)
            blocks = [pack.compress(b"".join(x[a:b].tobytes() for x in columns)) for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][starts]), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        held, size = [], 0
        for batch in slices(batches, 4096):
            prefix = batch.column(4 + len(BITS))
            sizes = prefix.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            entry = {name: np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i, name in enumerate(("doc", "tie", "line", "n", *BITS))}
            entry["token"] = prefix.flatten().to_numpy(zero_copy_only=False)
            entry["k"] = np.arange(len(entry["token"])) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            entry["doc"], entry["line"] = entry["doc"].astype(np.int64), entry["line"].astype(np.int64)
            entry["probe"] = np.ones(len(entry["token"]), np.int8)
            if only is not None:
                lines, tokens = only.value
                use = _in_bitmap(tokens, entry["token"].astype(np.int64) % WANTED_BITS)
                entry = {k: v[use] for k, v in entry.items()}
                entry["probe"] = _in_bitmap(lines, _slots(entry["doc"], entry["tie"], entry["line"])).astype(np.int8)
            held.append(entry)
            size += len(entry["token"])
            if size > _CHUNK:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return classes.select("doc", "tie", "line", "n", *BITS, "prefix").mapInArrow(run, "bucket long, block binary")


def _unpacked(blocks) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [] for k, _ in _FIELDS}
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    unpack = zstandard.ZstdDecompressor()
    for block in blocks:
        raw = unpack.decompress(block.as_py())
        n, at = len(raw) // width, 0
        for k, t in _FIELDS:
            end = at + n * np.dtype(t).itemsize
            parts[k].append(np.frombuffer(raw[at:end], t))
            at = end
    return {k: np.concatenate(v) for k, v in parts.items()}


def _join(every: bool):
    def run(table: pa.Table) -> pa.Table:
        c = _unpacked(table.column("block"))
        c = {k: v.astype(np.int64) if k in ("n", "k", "line") else v for k, v in c.items()}
        order = np.lexsort((c["line"], c["tie"], c["doc"], c["high"], c["low"], c["token"]))
        c = {k: v[order] for k, v in c.items()}
        probe = c["probe"].astype(bool)
        c |= {k: c[k].view(np.uint64) for k in BITS}
        change = np.r_[True, (c["token"][1:] != c["token"][:-1]) | (c["low"][1:] != c["low"][:-1]) | (c["high"][1:] != c["high"][:-1])]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.r_[starts, len(change)])
        into = np.arange(len(change)) - np.repeat(starts, sizes)  # earlier rows of the group
        found: list[tuple[np.ndarray, np.ndarray]] = []
        best, partner, hits = np.full(len(change), 1 << 30), np.zeros(len(change), np.int64), np.zeros(len(change), np.int64)

        def take(later, earlier, apart):  # at most one pair for each row in ``later`` unless every pair is wanted
            if every:
                found.append((later, earlier))
                return
            better = apart < best[later]
            best[later[better]], partner[later[better]] = apart[better], earlier[better]

        small = np.flatnonzero(probe & (np.repeat(sizes, sizes) <= LEAF))
        for back in range(LEAF - 1):
            small = small[into[small] > back]
            if not len(small):
                break
            later, earlier = small, small - into[small] + back
            ok, apart = _pairs(earlier, later, c)
            hits[later[ok]] += 1
            take(later[ok], earlier[ok], apart[ok])
        for start, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True):
            rows = np.arange(start, start + size)
            split = c["low"][start] != c["high"][start]
            for at in range(0, size, BLOCK):  # a block of later rows meets all earlier ones at once
                block = rows[at : at + BLOCK]
                block, before = block[probe[block]], rows[: at + BLOCK]
                near = c["n"][before][None] * DENOMINATOR >= c["n"][block][:, None] * NUMERATOR
                near &= c["n"][block][:, None] * DENOMINATOR >= c["n"][before][None] * NUMERATOR
                near &= before[None] < block[:, None]
                if split:  # pairs inside a part belong to that part's own task
                    near &= c["part"][before][None] != c["part"][block][:, None]
                i, j = np.nonzero(near)
                later, earlier = block[i], before[j]
                ok, apart = _pairs(earlier, later, c)
                later, earlier, apart = later[ok], earlier[ok], apart[ok]
                if not every and len(later):
                    order = np.lexsort((earlier, apart, later))
                    first = order[np.r_[True, later[order][1:] != later[order][:-1]]]
                    np.add.at(hits, later, 1)
                    later, earlier, apart = later[first], earlier[first], apart[first]
                take(later, earlier, apart)
        if not every:
            later = np.flatnonzero(hits)
            found = [(later, partner[later])]
        later, earlier = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        out = {f"{name}_{k}": c[k][rows] for name, rows in (("x", later), ("y", earlier)) for k in ("doc", "tie", "line")}
        out["apart"], out["x_more"] = best[later], hits[later] > 1
        return pa.table(out)

    return run


def _candidates(classes: DataFrame, hot, buckets: int, every: bool, only=None) -> DataFrame:
    """Pairs of a later line x and an earlier line y: all, or for each x the one that looks closest."""
    schema = ", ".join(f"{s}_doc long, {s}_tie long, {s}_line long" for s in "xy") + ", apart long, x_more boolean"
    found = _index(classes, hot, buckets, only).groupBy("bucket").applyInArrow(_join(every), schema)
    x, y = (F.struct(*[f"{s}_{k}" for k in ("doc", "tie", "line")]) for s in "xy")
    if every:
        return found.select(x.alias("x"), y.alias("y")).distinct().select("x.*", "y.*")
    least, most = F.min(F.struct("apart", y.alias("y"))), F.max(y)
    closest = found.groupBy(x.alias("x")).agg(least.alias("c"), ((F.min(y) != most) | F.max("x_more")).alias("x_more"))
    return closest.select("x.*", "c.y.*", "x_more")


def common_tokens(classes: DataFrame, part: int) -> dict[int, int]:
    """Tokens of more than ``part`` classes and the parts that they are dealt into.

    The part grows until at most HOT_TOKENS tokens are left, which bounds the map.
    """
    counts = checkpointed(classes.select(F.explode("hot").alias("token")).groupBy("token").count().where(F.col("count") > part))
    while counts.where(F.col("count") > part).count() > HOT_TOKENS:
        part *= 2
    return {r.token: -(-r["count"] // part) for r in counts.where(F.col("count") > part).collect()}


def _slots(doc, tie, line) -> np.ndarray:
    key = (doc.astype(np.int64) * np.int64(1_000_003) + line.astype(np.int64)).view(np.uint64) ^ tie.astype(np.int64).view(np.uint64)
    return (mixed(key) % np.uint64(WANTED_BITS)).astype(np.int64)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """Bitmap (WANTED_BITS bits, as bytes) of the column ``slot``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()  # of fixed size
    out = np.zeros(WANTED_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _in_bitmap(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _wanted(members: DataFrame) -> np.ndarray:
    """Bitmap of the slots of lines (doc, tie, line)."""

    def slots(batches):
        for batch in batches:
            used = np.unique(_slots(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))))
            yield pa.RecordBatch.from_arrays([pa.array(used)], names=["slot"])

    return _bitmap(members.mapInArrow(slots, "slot long"))


def _tokens_of(classes: DataFrame, lines) -> DataFrame:
    """Slots of the prefix tokens of the lines in a bitmap."""

    def run(batches):
        for batch in slices(batches, 8192):
            use = _in_bitmap(lines.value, _slots(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))))
            tokens = batch.column(3).filter(pa.array(use)).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(tokens.astype(np.int64) % WANTED_BITS))], names=["slot"])

    return classes.select("doc", "tie", "line", "prefix").mapInArrow(run, "slot long")


def similar(a: str, b: str) -> bool:
    """Whether the word sets of two lines reach the similarity."""
    x, y = set(a.split()), set(b.split())
    shared = len(x & y)
    return shared * DENOMINATOR >= (len(x) + len(y) - shared) * NUMERATOR


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The distinct later lines (doc, tie, line) of the pairs whose similarity holds, by the words themselves."""
    members = pairs.select(F.col("x_doc").alias("doc"), F.col("x_tie").alias("tie"), F.col("x_line").cast("int").alias("line")).union(
        pairs.select("y_doc", "y_tie", F.col("y_line").cast("int"))
    )
    wanted = rows.sparkSession.sparkContext.broadcast(_wanted(members))

    def pick(batches):
        for batch in slices(batches, 2048):
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lines = pc.split_pattern(batch.column(2), "\n")
            sizes = lines.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), sizes)
            number = (np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            use = np.flatnonzero(_in_bitmap(wanted.value, _slots(doc[of], tie[of], number)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[of[use]]), pa.array(tie[of[use]]), pa.array(number[use]), lines.flatten().take(pa.array(use)).cast(pa.string())], names=["doc", "tie", "line", "value"])

    lines = rows.select("doc", "tie", "text").mapInArrow(pick, f"{_ROW}, value string")

    keys = [f"{s}_{k}" for s in "xy" for k in ("doc", "tie", "line")]
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{k}").alias(f"of_{k}") for k in ("doc", "tie", "line")]) for s in "xy"]))
    ends = pairs.select(*keys, sides.alias("e")).select(*keys, "e.*")
    found = ends.join(lines, (F.col("of_doc") == F.col("doc")) & (F.col("of_tie") == F.col("tie")) & (F.col("of_line") == F.col("line")))
    both = found.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}value") for s in "xy"])

    def check(batches):
        for batch in batches:
            good = [similar(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:3]], names=["doc", "tie", "line"])

    hits = both.select("x_doc", "x_tie", F.col("x_line").cast("int"), "xvalue", "yvalue").mapInArrow(check, _ROW)
    return hits.distinct()


def kept_lines(rows: DataFrame, part: int = PART, bucket_rows: int = BUCKETS_OF) -> DataFrame:
    """(doc, tie, line) of the lines with words that stay."""
    context = rows.sparkSession.sparkContext
    classes = written_table(_classes(rows, token_sketch(rows)))
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(1, total // bucket_rows)
    hot = context.broadcast(common_tokens(classes, part))
    pairs = written_table(_candidates(classes, hot, buckets, False))
    keys, x = ["doc", "tie", "line"], ["x_doc", "x_tie", "x_line"]

    def lines_of(some: DataFrame) -> DataFrame:
        return some.select(*[F.col(a).cast(t).alias(b) for a, b, t in zip(x, keys, ("long", "long", "int"), strict=True)])

    removed = checkpointed(_verified(pairs, rows))
    open_lines = checkpointed(lines_of(pairs.where("x_more")).distinct().join(removed, keys, "left_anti"))
    if not open_lines.isEmpty():
        # Bitmaps of fixed size choose the lines; what they let through beside the open ones does no harm.
        lines = _wanted(open_lines)
        only = context.broadcast((lines, _bitmap(_tokens_of(classes, context.broadcast(lines)))))
        rest = written_table(_candidates(classes, hot, buckets, True, only))
        removed = checkpointed(removed.union(_verified(rest, rows)).distinct())
    return classes.select(*keys).join(removed, keys, "left_anti")


#: What str.split() takes for white space, as a class of Java's regular expressions.
_WORD = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()) + "]"


def wordless(text: Column) -> Column:
    """Numbers of the lines without words, by the rule of the tokenizer."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~x.rlike(_WORD), i)), lambda i: i.isNotNull())


def _joined(docs: DataFrame, id_col: str, text_col: str, narrow: bool) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    kept = kept_lines(rows).groupBy(F.col("doc").alias("__d"), F.col("tie").alias("__t")).agg(F.sort_array(F.collect_list("line")).alias("__kept"))
    unique = rows.select("tie").where("tie <> 0").isEmpty()
    keyed = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__tie", F.lit(0).cast("long") if unique else F.xxhash64(whole_text(text_col)))
    if narrow:
        keyed = keyed.select(id_col, "__doc", "__tie", F.size(F.split(whole_text(text_col), "\n")).alias("__lines"), wordless(whole_text(text_col)).alias("__blank"))
    return keyed.join(kept, (F.col("__doc") == F.col("__d")) & (F.col("__tie") == F.col("__t")), "left")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_removed and kept_lines (numbers from 0) of every document."""
    none = F.array().cast("array<int>")
    kept = F.array_sort(F.concat(F.coalesce("__kept", none), F.col("__blank")))
    return _joined(docs, id_col, text_col, True).select(
        id_col, F.col("__lines").cast("long").alias("n_lines"), (F.col("__lines") - F.size(kept)).cast("long").alias("n_removed"), kept.alias("kept_lines")
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that go taken out of their texts."""
    given = docs.columns
    docs, id_col, text_col = numbered(docs, id_col, text_col)
    at, kept_at, names = docs.columns.index(text_col), len(docs.columns), docs.columns

    def run(batches):
        for batch in batches:
            texts = []
            for text, kept in zip(batch.column(at), batch.column(kept_at), strict=True):
                keep = set(kept.as_py() or ())
                texts.append("\n".join(x for i, x in enumerate((text.as_py() or "").split("\n")) if i in keep or not x.split()))
            columns = list(batch.columns[:kept_at])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _joined(docs, id_col, text_col, False).select(*names, "__kept").mapInArrow(run, docs.schema).toDF(*given)
