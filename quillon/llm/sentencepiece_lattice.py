"""SentencePiece encoding and decoding by a relational lattice.

* Texts are cut into units that no piece of the vocabulary can cross (checked when the
  model is loaded): runs of letters or of other characters, with the spaces before them.
* Each distinct unit is encoded once: its substrings that can be pieces by their first
  three characters and their length are exploded and equi-joined to the piece table (broadcast: its size is that of the model file); the
  matching edges are grouped by unit and folded over Arrow batches, all units of a batch at once.
  Unigram models fold Viterbi.  BPE models need their own fold (best-ranked applicable
  edge first), because a Viterbi path over merge ranks is not what BPE yields.
  The BPE fold takes as many rounds as a unit has merges, so that the lattice holds units up to
  60 characters; longer ones go through the same merges with a heap.
* The encodings return to the documents in two exact ways: those of the most frequent
  units (a bounded number) are broadcast; all others meet the keys of their documents in the
  exchange before the lattice, so that each is encoded once, and are joined per document.

Defined cases: null text counts as empty; an empty text has no ids; characters outside
the vocabulary become byte pieces (or the unknown id without byte fallback); repeated
rows and equal texts get equal ids; an empty table gives an empty result.
Normalisation other than identity is refused when the model is loaded.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import byte_hashes, settings, slices, small_batches, whole_text, written, written_table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Most units whose encodings are broadcast (about 35 bytes each); all others are joined.
FREQUENT_UNITS = 1 << 20
#: Marks that may follow a word of letters.
MARKS = ".,;:!?"
#: Units that a task encodes, and units whose edges it groups in memory before it sorts.
UNITS_A_TASK, UNITS_AT_ONCE = 32_768, 1 << 16
#: Longest unit of the lattice: the fold takes as many rounds as a unit has merges.
LATTICE_CHARS = 60
_FLUSH = 1_000_000
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unigram: bool = False
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, kind, prefix = [], [], [], 1, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                kinds.append(own.get(3, 1))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only identity normalisation is supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        return cls(tuple(pieces), tuple(scores), tuple(kinds), kind == 1, prefix)

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (1, USER)}

    @cached_property
    def byte_ids(self) -> list[int]:
        """Ids of the byte pieces, or the unknown id for each byte without them."""
        own = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        return [own.get(b, self.unknown) for b in range(256)]

    @cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @cached_property
    def has_bytes(self) -> bool:
        return BYTE in self.kinds

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table))

    @cached_property
    def unit_pattern(self) -> str:
        """Pattern of units; the letter cut is used only if no piece crosses it."""
        odd = {c for p in self.table for c in p if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()}
        letter = rf"[^\W\d_{re.escape(''.join(sorted(odd)))}{SPACE}]"
        for pattern in (rf"{SPACE}*{letter}+|{SPACE}*(?:(?!{letter})[^{SPACE}])+|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+"):
            find = re.compile(pattern).findall
            if all(len(find(p)) == 1 for p in self.table):
                return pattern
        return r"(?s:.+)"

    def units(self, text: str, find) -> list[str]:
        if not text:
            return []
        return find((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit; used for units beyond the fold's state."""
        parts = self._viterbi(unit) if self.unigram else self._merges(unit)
        out: list[int] = []
        for p in parts:
            if p in self.table:
                out.append(self.table[p][0])
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")] if self.has_bytes else [self.unknown]
        return out

    def _merges(self, unit: str) -> list[str]:
        n, table = len(unit), self.table
        after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), list(unit)
        heap: list = []

        def offer(a):
            b = after[a]
            if b < n and (hit := table.get(text[a] + text[b])):
                heapq.heappush(heap, (-hit[1], a, text[a], text[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, left, right = heapq.heappop(heap)
            b = after[a] if text[a] == left else n
            if b >= n or text[b] != right:
                continue
            text[a], text[b], after[a] = left + right, "", after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [t for t in text if t]

    def _viterbi(self, unit: str) -> list[str]:
        n, miss = len(unit), min(self.scores) - 10.0
        best: list = [(0.0, 0)] + [None] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                hit = self.table.get(unit[s:e])
                score = hit[1] if hit else miss if e - s == 1 else None
                if score is not None and (best[e] is None or best[s][0] + score > best[e][0]):
                    best[e] = (best[s][0] + score, s)
        out, e = [], n
        while e:
            out.append(unit[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def decoded(self, parts) -> str:
        """Text of the bytes of pieces."""
        data = b"".join(parts)
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    @cached_property
    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, and the start and length of each."""

        def one(p, k):
            return bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode()

        parts = [one(p, k) for p, k in zip(self.pieces, self.kinds, strict=True)]
        lengths = np.array(list(map(len, parts)), np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _units_of(words: pa.Array, find) -> tuple[pa.Array, np.ndarray]:
    """The units of words, one after the other, and how many each has.

    A word of letters is a unit as it is.  Where the pattern cuts letters from other
    characters, words of letters and a mark behind them are cut without it too; where it
    cuts before spaces, all other words are cut in one go.
    """
    stems = pc.utf8_rtrim(words, MARKS) if len(find(f"{SPACE}a,")) == 2 else words
    extra = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
    plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (extra <= 1)
    ends = plain & (extra == 1)
    easy = pc.binary_join_element_wise(SPACE, stems.filter(pa.array(plain)), "")
    tails = pc.utf8_slice_codeunits(words.filter(pa.array(ends)), -1)
    hard = words.filter(pa.array(~plain)).to_pylist()
    if len(find(f"{SPACE}a{SPACE}a")) == 2:
        rest = pa.array(find("".join([SPACE + w for w in hard])), pa.string())
        first = np.flatnonzero(pc.starts_with(rest, SPACE).to_numpy(zero_copy_only=False))
        counts = np.diff(np.r_[first, len(rest)])
    else:
        found = [find(SPACE + w) for w in hard]
        rest, counts = pa.array([u for x in found for u in x], pa.string()), np.array([len(x) for x in found], np.int64)
    sizes = 1 + ends.astype(np.int64)
    sizes[~plain] = counts
    starts = np.cumsum(sizes) - sizes
    at = np.r_[starts[plain], starts[ends] + 1, _ranges(starts[~plain], sizes[~plain])]
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    return pa.concat_arrays([easy, tails, rest]).take(pa.array(order)), sizes


class _Cut:
    """Units of a batch of texts, in order, with those of equal words found once.

    A single space starts a unit, so the units of a text without runs of spaces are those
    of its words; other texts are cut as a whole.  ``units`` are the units of the distinct
    words, ``starts`` and ``sizes`` those of each word, ``of`` the words of the texts in
    order and ``words`` how many each text has.
    """

    def __init__(self, model: Model, texts: pa.Array, find):
        texts = texts.fill_null("")
        odd = np.ones(len(texts), bool)
        if model.dummy_prefix and all(SPACE not in p.lstrip(SPACE) for p in model.table):
            ends = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
            inside = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
            odd = pc.or_(pc.or_(ends, inside), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        coded = plain.flatten().dictionary_encode()
        found, sizes = _units_of(coded.dictionary, find)
        own = len(sizes)
        whole = [model.units(x, find) for x in texts.filter(pa.array(odd)).to_pylist()]
        rest = sum(map(len, whole))
        self.units = pa.concat_arrays([found, pa.array([u for x in whole for u in x], pa.string())])
        self.sizes = np.r_[sizes, np.ones(rest, np.int64)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.zeros(len(texts), np.int64)
        self.words[~odd], self.words[odd] = plain.value_lengths().to_numpy(zero_copy_only=False), [len(x) for x in whole]
        first = np.zeros(len(texts), np.int64)  # in ``of`` before the texts are put in order
        counts = self.words[~odd]
        first[~odd] = np.cumsum(counts) - counts
        counts = self.words[odd]
        first[odd] = np.cumsum(counts) - counts + len(coded)
        flat = np.r_[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(own, own + rest)]
        self.of = flat[_ranges(first, self.words)]


def unit_counts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(unit, n) over all documents, counted within tasks before the shuffle."""

    def count(batches):
        find, seen = re.compile(model.unit_pattern).findall, []

        def out():
            table = pa.Table.from_batches(seen).group_by("unit").aggregate([("n", "sum")])
            return table.select(["unit", "n_sum"]).rename_columns(["unit", "n"]).combine_chunks().to_batches()

        size = 0
        for batch in slices(batches, 2048):
            cut = _Cut(model, batch.column(0), find)
            uses = np.bincount(cut.of, minlength=len(cut.sizes))
            seen.append(pa.RecordBatch.from_arrays([cut.units, pa.array(np.repeat(uses, cut.sizes))], names=["unit", "n"]))
            size += len(cut.units)
            if size > _FLUSH:
                yield from out()
                seen, size = [], 0
        if seen:
            yield from out()

    parts = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "unit string, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n"))


def _merge_fold(size: int, own: np.ndarray, start: np.ndarray, end: np.ndarray, cost: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The edge of each piece by its start (or -1), after merging each unit's best applicable edge until none is left.

    ``after`` has the next boundary of every position of the units, which lie one after the
    other; it is changed to that of the pieces.  Positions ``size`` (no boundary any more)
    and ``size + 1`` (past the end of a unit) follow themselves.
    """
    made = np.full(size + 2, -1)
    edge = np.lexsort((start, cost, own))
    edge = edge[end[edge] - start[edge] > 1]
    while len(edge):
        first, last, unit = start[edge], end[edge], own[edge]
        fits = np.flatnonzero(after[after[first]] == last)
        best = fits[np.flatnonzero(np.diff(unit[fits], prepend=-1))]
        after[after[first[best]]] = size
        after[first[best]], made[first[best]] = last[best], edge[best]
        left = after[first]  # an edge stays while its ends are boundaries, it is no piece yet, and its unit still merges
        edge = edge[(left != size) & (left != last) & (after[last] != size) & np.isin(unit, unit[best])]
    return made


def _viterbi_fold(size: int, own: np.ndarray, start: np.ndarray, end: np.ndarray, cost: np.ndarray, after: np.ndarray, miss: float) -> np.ndarray:
    """As ``_merge_fold``, by the best-scored path; of equal scores the longest last piece."""
    ends = after[:size] == size + 1
    single = np.flatnonzero(~ends)
    length = np.arange(size) - np.maximum.accumulate(np.where(np.r_[True, ends[:-1]], np.arange(size), 0))  # from the unit's start
    first, last = np.r_[start, single], np.r_[end, single + 1]
    costs, edges = np.r_[cost, np.full(len(single), -miss)], np.r_[np.arange(len(start)), np.full(len(single), -1)]
    total, back = np.zeros(size), np.full(size, -1)
    turn = np.argsort(length[last], kind="stable")
    for part in np.split(turn, np.flatnonzero(np.diff(length[last][turn])) + 1):
        sums = total[first[part]] + costs[part]
        order = np.lexsort((first[part], sums, last[part]))
        best = order[np.flatnonzero(np.diff(last[part][order], prepend=-1))]
        total[last[part[best]]], back[last[part[best]]] = sums[best], part[best]
    made = np.full(size + 2, -1)
    after[:size][~ends] = size
    at = np.flatnonzero(ends & (length > 0))
    while len(at):
        used = back[at]
        after[first[used]], made[first[used]] = at, edges[used]
        at = first[used][length[first[used]] > 0]
    return made


def folded(model: Model, units: pa.Array, own: np.ndarray, s: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """Ids of ``units``, from their edges: unit, start, length and id of a piece; edges of one unit are neighbours."""
    chars = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.cumsum(chars + 1) - chars - 1
    size = int(base[-1] + chars[-1] + 1)
    after = np.r_[np.arange(1, size + 1), size, size + 1]
    after[base + chars] = size + 1
    start = base[own] + s
    end, cost = start + sizes, -np.array(model.scores)[ids]
    single = np.full(size + 2, -1)
    single[start[sizes == 1]] = ids[sizes == 1]
    made = _viterbi_fold(size, own, start, end, cost, after, min(model.scores) - 10.0) if model.unigram else _merge_fold(size, own, start, end, cost, after)
    begins = np.flatnonzero(after[:size] < size)
    out = np.where(made[begins] >= 0, ids[made[begins]] if len(ids) else -1, single[begins])
    unit = np.repeat(np.arange(len(units)), chars + 1)[begins]
    counts, odd = np.ones(len(begins), np.int64), np.flatnonzero(out < 0)
    octets = []
    for k in odd.tolist():  # characters outside the vocabulary
        char = units[unit[k]].as_py()[begins[k] - base[unit[k]]]
        octets.append([model.byte_ids[b] for b in char.encode()] if model.has_bytes else [model.unknown])
        counts[k] = len(octets[-1])
    flat, at = np.repeat(out, counts), np.cumsum(counts) - counts
    for k, more in zip(odd.tolist(), octets, strict=True):
        flat[at[k] : at[k] + len(more)] = more
    offsets = np.r_[0, np.cumsum(np.bincount(unit, counts, len(units)).astype(np.int64))]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def candidates(units: DataFrame, model: Model) -> DataFrame:
    """``units`` with s and l: substrings that can be pieces, and an empty one for each unit.

    Those of one or two characters are all there; longer ones only in the lengths of the
    pieces with the same first three characters (broadcast: at most a row for each piece).
    Units beyond the lattice have the empty one only.
    """
    short = [1, 2]
    lengths: dict[str, set[int]] = {}
    for p in model.table:
        if len(p) > 2:
            lengths.setdefault(p[:3], set(short)).add(len(p))
    heads = F.broadcast(units.sparkSession.createDataFrame([(h, sorted(own)) for h, own in lengths.items()], "head string, lengths array<int>"))
    size, own = F.length("unit"), F.coalesce(F.col("lengths"), F.lit(short))
    starts = units.select("*", F.explode(F.sequence(F.lit(0), F.when(size <= LATTICE_CHARS, size - 1).otherwise(0))).alias("s"))
    spans = starts.join(heads, F.expr("substring(unit, s + 1, 3)") == F.col("head"), "left")
    spans = spans.select(*units.columns, "s", F.explode(F.when(size > LATTICE_CHARS, F.lit([0])).when(F.col("s") == 0, F.concat(F.lit([0]), own)).otherwise(own)).alias("l"))
    return spans.where(F.col("s") + F.col("l") <= size)


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (distinct in their column ``unit``) plus ids: the lattice.  Other columns stay as they are."""
    spark = units.sparkSession
    # The empty piece is an edge that every unit has, so that none is lost in the join.
    table = pd.DataFrame([(p, i) for p, (i, _) in model.table.items()] + [("", -1)], columns=["piece", "id"])
    pieces = F.broadcast(spark.createDataFrame(table, "piece string, id int"))  # as many rows as the model has
    edge = (F.col("id").cast("long") * 64 + F.col("s")) * 64 + F.col("l")  # start and length are below 64: one number
    joined = candidates(units, model).join(pieces, F.expr("substring(unit, s + 1, l)") == F.col("piece"))
    lattice = joined.groupBy(*units.columns).agg(F.collect_list(edge).alias("edges"))
    at, columns = units.columns.index("unit"), units.columns

    def fold(batches):
        for batch in slices(batches, 2048):
            if batch.num_rows:
                names, lists = batch.column(at), batch.column(batch.num_columns - 1)
                edges, own = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                real = edges >= 0
                edges, own = edges[real], own[real]
                ids = folded(model, names, own, edges >> 6 & 63, edges & 63, edges >> 12)
                far = np.flatnonzero(pc.utf8_length(names).to_numpy(zero_copy_only=False) > LATTICE_CHARS).tolist()
                if far:
                    ids = ids.to_pylist()
                    for k in far:
                        ids[k] = model.encode_unit(names[k].as_py())
                    ids = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*columns, "ids"])

    return lattice.mapInArrow(fold, units.limit(0).withColumn("ids", F.array().cast("array<int>")).schema)


def frequent_from(counts: DataFrame, bound: int) -> int:
    """Smallest count such that at most ``bound`` units occur at least that often."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("units"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    best, total = 1 << 62, 0
    for row in levels:  # a thousand at most
        total += row["units"]
        if total > bound:
            break
        best = row["n"]
    return best


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0)))


class _Codes:
    """Ids of units: a table of units beside their ids, one after the other."""

    def __init__(self, units: pa.Array, sizes: np.ndarray, ids: np.ndarray):
        self.units, self.sizes, self.starts, self.ids = units, _narrow(sizes), _narrow(np.cumsum(sizes) - sizes), _narrow(ids)

    @classmethod
    def of(cls, units: pa.Array, lists: pa.Array) -> _Codes:
        return cls(units, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))

    def find(self, units: pa.Array) -> np.ndarray:
        """Row of each unit, or -1."""
        return pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class _Known(_Codes):
    """Codes in the order of a hash of their units; what is found is compared with the unit itself."""

    def __init__(self, units: pa.Array, sizes: np.ndarray, ids: np.ndarray):
        hashes, starts = _hashes(units), np.cumsum(sizes) - sizes
        order = np.argsort(hashes, kind="stable")
        super().__init__(units.take(pa.array(order)), sizes[order], ids[_ranges(starts[order], sizes[order])])
        self.hashes = hashes[order]
        same = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1
        self.twins = {self.units[k].as_py(): k for k in same.tolist()}

    def find(self, units: pa.Array) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(units), -1)
        own = _hashes(units)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        likely = np.flatnonzero(self.hashes[at] == own)
        equal = pc.equal(units.take(pa.array(likely)), self.units.take(pa.array(at[likely]))).to_numpy(zero_copy_only=False)
        out = np.full(len(units), -1)
        out[likely[equal]] = at[likely[equal]]
        for k in likely[~equal].tolist():
            out[k] = self.twins.get(units[k].as_py(), -1)
        return out


def _hashes(strings: pa.Array) -> np.ndarray:
    strings = pa.concat_arrays([strings])  # from offset 0 on
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer((strings.buffers()[2].to_pybytes() if len(strings) and strings.buffers()[2] else b"") + bytes(8), np.uint8)
    octets = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return byte_hashes(octets, offsets[:-1], np.diff(offsets))


def encode_cut(cut: _Cut, known: _Codes, more: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each text has."""
    at = known.find(cut.units)
    missing = np.flatnonzero(at < 0)
    own = np.flatnonzero(at >= 0)
    other = more.find(cut.units.take(pa.array(missing)))
    if len(missing) and other.min() < 0:
        raise ValueError("a unit has no encoding")
    unit_sizes = np.empty(len(at), np.int64)
    unit_sizes[own], unit_sizes[missing] = known.sizes[at[own]], more.sizes[other]
    before = np.r_[0, np.cumsum(unit_sizes)]  # ids before each unit of the distinct words
    ids = np.empty(before[-1], np.int32)
    for units, codes, rows in ((own, known, at[own]), (missing, more, other)):
        ids[_ranges(before[units], unit_sizes[units])] = codes.ids[_ranges(codes.starts[rows].astype(np.int64), unit_sizes[units])]
    word_starts = before[cut.starts]
    word_sizes = before[cut.starts + cut.sizes] - word_starts
    out = ids[_ranges(word_starts[cut.of], word_sizes[cut.of])]
    total = np.r_[0, np.cumsum(word_sizes[cut.of])]
    ends = np.cumsum(cut.words)
    return out, total[ends] - total[ends - cut.words]


def decode_ids(model: Model, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Texts of lists of ids that lie one after the other."""
    data, starts, lengths = model.piece_bytes
    used = lengths[ids]
    text = data[_ranges(starts[ids], used)].tobytes()
    at = np.r_[0, np.cumsum(used)][np.r_[0, np.cumsum(sizes)]]
    return [model.decoded([text[a:b]]) for a, b in zip(at, at[1:], strict=False)]


def encode(docs: DataFrame, model: Model, text_col: str = "text", frequent: int = FREQUENT_UNITS, ids_col: str = "ids", decoded_col: str | None = None, equal_col: str | None = None) -> DataFrame:
    """``docs`` plus ``ids_col`` (array of int); other columns stay as they are.

    ``decoded_col`` adds the text of the ids in the same pass; ``equal_col`` adds whether that is the
    text itself, and leaves the text out.  A name that the input has already is refused.
    """
    added = [ids_col] + [c for c in (decoded_col, equal_col) if c]
    if set(added) & set(docs.columns):
        raise ValueError(f"{added} must not be columns of the input")
    spark: SparkSession = small_batches(docs)
    counts, remove = written(unit_counts(docs, model, text_col))
    total, least = counts.count(), frequent_from(counts, frequent)
    together = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(UNITS_AT_ONCE)}
    with settings(spark, together):
        often = counts.where(F.col("n") >= least).select("unit").repartition(max(1, -(-min(total, frequent) // UNITS_A_TASK)), "unit")
        top = encode_units(often, model).toArrow().combine_chunks()  # at most ``frequent`` rows
    remove()
    codes = _Known.of(pa.concat_arrays(top.column("unit").chunks or [pa.array([], pa.string())]), pa.concat_arrays(top.column("ids").chunks or [pa.array([], pa.list_(pa.int32()))]))
    known = spark.sparkContext.broadcast(codes)
    names, kept = docs.columns, [c for c in docs.columns if c != text_col]
    inner = [f"c{i}" for i in range(len(kept))]
    flat = docs.select(*[F.col(c).alias(i) for c, i in zip(kept, inner, strict=True)], whole_text(text_col).alias("text")).withColumn("key", F.xxhash64("text"))

    def rare(batches):
        find, own = re.compile(model.unit_pattern).findall, known.value
        for batch in slices(batches, 512):
            cut = _Cut(model, batch.column(1), find)
            lone = own.find(cut.units) < 0
            counts = np.r_[0, np.cumsum(lone)]
            per_word = counts[cut.starts + cut.sizes] - counts[cut.starts]
            number = np.repeat(np.arange(batch.num_rows), cut.words)
            with_any = np.flatnonzero(per_word[cut.of])
            word, text = cut.of[with_any], number[with_any]
            units = np.flatnonzero(lone)[_ranges(counts[cut.starts[word]], per_word[word])]
            key = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[text], per_word[word])
            pairs = pa.RecordBatch.from_arrays([pa.array(key), cut.units.take(pa.array(units))], names=["key", "unit"])
            yield from pa.Table.from_batches([pairs]).group_by(["key", "unit"]).aggregate([]).select(["key", "unit"]).combine_chunks().to_batches()

    lone = flat.select("key", "text").mapInArrow(rare, "key long, unit string").repartition(max(1, -(-total // UNITS_A_TASK)), "unit")
    with settings(spark, together):
        coded = encode_units(lone.groupBy("unit").agg(F.collect_set("key").alias("keys")), model)
        coded = written_table(coded.select(F.explode("keys").alias("found_key"), "unit", "ids"))
    found = coded.groupBy("found_key").agg(F.collect_list(F.struct("unit", "ids")).alias("rare"))

    def pack(batches):  # texts travel compressed
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(x) for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*inner, "key", "packed"])

    shape = flat.select(*inner, "key").limit(0)
    moved = flat.select(*inner, "key", "text").mapInArrow(pack, shape.withColumn("packed", F.lit(b"")).schema)
    joined = moved.join(found, F.col("key") == F.col("found_key"), "left").select(*inner, "packed", "rare")
    at = {c: i for i, c in enumerate(kept)}

    def merge(batches):
        find, own, unpack = re.compile(model.unit_pattern).findall, known.value, zstandard.ZstdDecompressor()
        for batch in slices(batches, 512):
            texts = pa.array([unpack.decompress(x) for x in batch.column(len(inner)).to_pylist()], pa.binary()).cast(pa.string())
            lists = batch.column(len(inner) + 1).flatten()
            units = lists.field("unit") if len(lists) else pa.array([], pa.string())
            ids, sizes = encode_cut(_Cut(model, texts, find), own, _Codes.of(units, lists.field("ids") if len(lists) else pa.array([], pa.list_(pa.int32()))))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            columns = {c: batch.column(at[c]) for c in kept}
            if not equal_col:
                columns[text_col] = texts
            columns[ids_col] = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            if decoded_col or equal_col:
                again = pa.array(decode_ids(model, ids, sizes), pa.string())
                columns |= {decoded_col: again} if decoded_col else {}
                columns |= {equal_col: pc.equal(again, texts)} if equal_col else {}
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], names=schema.names)

    shown = docs.limit(0).withColumn(ids_col, F.array().cast("array<int>"))
    shown = shown.withColumn(decoded_col, F.lit("")) if decoded_col else shown
    shown = shown.withColumn(equal_col, F.lit(True)).drop(text_col) if equal_col else shown
    schema = shown.withColumn(text_col, F.lit("").cast("string")).schema if text_col in shown.columns else shown.schema
    return joined.mapInArrow(merge, schema)


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` plus the texts of the ids; null ids decode to an empty text."""
    if decoded_col in encoded.columns:
        raise ValueError(f"{decoded_col} must not be a column of the input")
    at, names = encoded.columns.index(ids_col), list(encoded.columns)

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(at)
            texts = decode_ids(model, lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, decoded_col])

    return encoded.mapInArrow(run, encoded.limit(0).withColumn(decoded_col, F.lit("")).schema)


def round_trip(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether decoding gives the text again."""
    model = Model.load(model_path)
    coded = encode(docs.select("doc_id", "text"), model, ids_col="token_ids", equal_col="decoded_equal")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_equal")
