"""Source divergence audit over mergeable radix tries.

Each task counts the terms of its documents in a radix trie over bytes, whose leaves have a counter
per (lang, source) of occurrences and of the documents that hold the term.  Tries are kept as the
walk over their leaves in UTF-8 order with the lengths of shared paths, so that building and
merging are sorts of whole arrays; a trie that reaches its bound of counters is sent off and begun
anew, as tries merge by adding counters.  They travel as blocks of neighbouring leaves, written once;
ranges of prefixes are cut so that each has about as many counters, and a block that crosses cuts
is parted at them, so that a range gets its own counters only, however many tries there are.  Each range merges its blocks and streams its kept terms in UTF-8
order, all sources of a term and language in one row.  For the pairs, tasks add up differences of all
ordered pairs of sources beyond those of two absent counts, which are added once by their number;
for the terms, candidates of a group are ranked by (value, byte order), with the first ranks of
each task taken before the exchange.

A language's sources come with its terms by a join that Spark broadcasts only where its own
size check allows; a language with S sources has S (S - 1) rows of pairs in any case.

Defined cases: null text, lang and source count as ''; a row is a document, repeated rows too; a
text without terms counts for its group alone; a language without kept terms has pairs of value 0
and no term rows; a group alone in its language has no pairs; counts and sums of any size are
exact; bytes that are no UTF-8 count as term bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import settings, whole_text, written_table
from quillon.llm.substring_dedup import pieces

SCALE, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: Counters of a trie that a task sends off, counters of a range (about), leaves of a block.
TRIE_LEAVES, RANGE_LEAVES, BLOCK = 1_000_000, 500_000, 1024
#: Block heads (about) that the cuts between ranges are chosen from.
CUT_SAMPLE = 100_000
#: Numbers that a task holds of a block of terms and of sums of pairs.
_CELLS = 1 << 20
_DIGITS = 32
_TERM_BYTES = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms (runs of ASCII letters, A-Z lower-cased, and of bytes beyond ASCII) and the text of each."""
    data = np.frombuffer(b" " + b" ".join([*texts, b""]), np.uint8)
    inside = _TERM_BYTES[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first and the last byte are none
    starts, ends = change[::2], change[1::2]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return found, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v for v in values)


class RadixTrie:
    """A byte trie with merged single-child paths, as the walk over its leaves in byte order.

    ``terms`` are the leaves; ``shared`` is the length of the path that a leaf has in common with
    the one before, where its own edge starts.  Counters belong to leaves: ``leaf`` (ascending),
    ``group`` (ascending in a leaf), ``n`` occurrences, ``docs`` documents.
    """

    def __init__(self, terms: pa.Array, leaf: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.terms, self.leaf, self.group, self.n, self.docs = terms, leaf, group, n, docs

    @classmethod
    def of_counts(cls, found: pa.Array, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> RadixTrie:
        """From counters of terms in any order; those of one term and group are added up."""
        coded = found.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = int(group.max()) + 1 if len(group) else 1
        keys, n, docs = _sums(place[coded.indices.to_numpy()] * width + group, n, docs)
        return cls(coded.dictionary.take(pa.array(order)), keys // width, keys % width, n, docs)

    @classmethod
    def of_texts(cls, texts: list[bytes], groups: np.ndarray) -> RadixTrie:
        found, text = terms(texts)
        coded = found.dictionary_encode()
        size = max(1, len(coded.dictionary))
        keys, n = _sums(text * size + coded.indices.to_numpy(), np.ones(len(text), np.int64))
        return cls.of_counts(coded.dictionary.take(pa.array(keys % size)), groups[keys // size], n, np.ones(len(keys), np.int64))

    @classmethod
    def merged(cls, tries: list[RadixTrie]) -> RadixTrie:
        found = pa.concat_arrays([t.terms.take(pa.array(t.leaf)) for t in tries])
        return cls.of_counts(found, *(np.concatenate([getattr(t, k) for t in tries]) for k in ("group", "n", "docs")))

    def __len__(self) -> int:
        return len(self.leaf)

    def blocks(self, rows: int):
        """Subtries of neighbouring leaves: (first, last, shared, sizes, edges, counters per leaf, group, n, docs)."""
        heads = np.searchsorted(self.leaf, np.arange(len(self.terms) + 1))
        for a in range(0, len(self.terms), rows):
            part = self.terms[a : a + rows]
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data, sizes = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)
            shared = shared_lengths(data, offsets[:-1] - offsets[0], sizes)
            own = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes) >= np.repeat(shared, sizes)
            x, y = heads[a], heads[a + len(part)]
            yield part[0].as_py(), part[-1].as_py(), shared, sizes, data[own].tobytes(), np.diff(heads[a : a + len(part) + 1]), self.group[x:y], self.n[x:y], self.docs[x:y]


def shared_lengths(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common start of each byte string with the one before it (0 for the first), eight bytes at a time."""
    octets = np.ndarray(len(data), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
    out, pairs, at = np.zeros(len(starts), np.int64), np.arange(1, len(starts)), 0
    limit = np.minimum(sizes[1:], sizes[:-1])
    while len(pairs):
        differ = octets[starts[pairs] + at] ^ octets[starts[pairs - 1] + at]
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8  # 8 where equal
        out[pairs] = np.minimum(at + low, limit[pairs - 1])
        at += 8
        pairs = pairs[(low == 8) & (limit[pairs - 1] > at)]
    return out


def whole_terms(shared: list[int], sizes: list[int], edges: bytes) -> list[bytes]:
    """The walk over a block: paths put together from edges."""
    out, path, at = [], b"", 0
    for keep, size in zip(shared, sizes, strict=True):
        path = path[:keep] + edges[at : at + size - keep]
        at += size - keep
        out.append(path)
    return out


_GROUPS = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))
_BLOCK = "first binary, last binary, shared array<int>, sizes array<int>, edges binary, counters array<int>, `group` array<int>, n array<long>, docs array<long>, `groups` array<struct<lang:string,source:string>>"
_BLOCK_KINDS = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2, _GROUPS]
_BLOCK_NAMES = "first last shared sizes edges counters group n docs groups".split()


def _counting(trie_leaves: int, block: int):
    """Blocks of the tries of a task."""

    def sent(trie: RadixTrie, groups: list):
        for *fields, group, n, docs in trie.blocks(block):
            used, group = np.unique(group, return_inverse=True)
            row = [*fields, group, n, docs, [groups[g] for g in used]]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() if isinstance(x, np.ndarray) else x], t) for x, t in zip(row, _BLOCK_KINDS, strict=True)], names=_BLOCK_NAMES)

    def run(batches):
        tries, numbers = [], {}
        for batch in pieces(batches):
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            groups = np.array([numbers.setdefault(g, len(numbers)) for g in names], np.int64)
            tries.append(RadixTrie.of_texts(batch.column("text").to_pylist(), groups))
            if sum(map(len, tries)) >= 2 * trie_leaves:
                tries = [RadixTrie.merged(tries)]
                if len(tries[0]) >= trie_leaves:
                    yield from sent(tries[0], [{"lang": a, "source": b} for a, b in numbers])
                    tries, numbers = [], {}
        if tries:
            yield from sent(RadixTrie.merged(tries), [{"lang": a, "source": b} for a, b in numbers])

    return run


def _dealing(cuts: list[bytes]):
    """Blocks -> blocks of one range (``at``) each; those that cross cuts are parted, so that every counter goes to one range."""

    def parts(batch: pa.RecordBatch, i: int, low: int, high: int):
        numbers = {k: batch.column(k)[i].values.to_numpy() for k in ("shared", "sizes", "counters", "group", "n", "docs")}
        shared, sizes, edges = numbers["shared"], numbers["sizes"], batch.column("edges")[i].as_py()
        found = whole_terms(shared.tolist(), sizes.tolist(), edges)
        edge, heads = np.r_[0, np.cumsum(sizes - shared)], np.r_[0, np.cumsum(numbers["counters"])]
        bounds = [0, *(bisect_left(found, cut) for cut in cuts[low:high]), len(found)]
        for at, (a, b) in enumerate(pairwise(bounds), low):
            if a < b:
                x, y = heads[a], heads[b]
                counters = [numbers[k][x:y] for k in ("group", "n", "docs")]
                row = [found[a], found[b - 1], np.r_[0, shared[a + 1 : b]], sizes[a:b], found[a] + edges[edge[a + 1] : edge[b]], numbers["counters"][a:b], *counters, batch.column("groups")[i].as_py(), at]
                yield pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v], t) for v, t in zip(row, [*_BLOCK_KINDS, pa.int32()], strict=True)], names=[*_BLOCK_NAMES, "at"])

    def run(batches):
        for batch in batches:
            for i, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)):
                low, high = bisect_right(cuts, first), bisect_right(cuts, last)
                if low == high:
                    whole = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([*(whole.column(k) for k in _BLOCK_NAMES), pa.array([low], pa.int32())], names=[*_BLOCK_NAMES, "at"])
                else:
                    yield from parts(batch, i, low, high)

    return run


def _merging(least_docs: int):
    """Blocks of one range -> kept (lang, term, total, sources: (source, n)) in UTF-8 order."""

    def read(batch: pa.RecordBatch, i: int, numbers: dict) -> RadixTrie:
        shared, sizes, counters, group, n, docs = (batch.column(k)[i].values.to_numpy().astype(np.int64) for k in ("shared", "sizes", "counters", "group", "n", "docs"))
        found = whole_terms(shared.tolist(), sizes.tolist(), batch.column("edges")[i].as_py())
        names = np.array([numbers.setdefault((g["lang"], g["source"]), len(numbers)) for g in batch.column("groups")[i].as_py()], np.int64)
        return RadixTrie(pa.array(found, pa.large_binary()), np.repeat(np.arange(len(found)), counters), names[group], n, docs)

    def kept(trie: RadixTrie, groups: list):
        """By term and language: groups are numbered so that those of a language are neighbours."""
        order = sorted(range(len(groups)), key=groups.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        langs = np.unique(np.array([groups[g][0] for g in order], object), return_inverse=True)
        by = np.lexsort((place[trie.group], trie.leaf))
        leaf, group, n, docs = trie.leaf[by], place[trie.group][by], trie.n[by], trie.docs[by]
        lang = langs[1][group]
        heads = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (lang[1:] != lang[:-1])])
        sizes = np.diff(np.r_[heads, len(leaf)])
        stays = np.add.reduceat(docs, heads) >= least_docs
        rows = np.repeat(stays, sizes)
        sources = pa.array([groups[g][1] for g in order], pa.string()).take(pa.array(group[rows]))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[stays])].astype(np.int32)), pa.StructArray.from_arrays([sources, pa.array(n[rows])], names=["source", "n"]))
        text = pa.array([t.decode("utf-8", "replace") for t in trie.terms.take(pa.array(leaf[heads][stays])).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs[0][lang[heads][stays]], pa.string()), text, pa.array(np.add.reduceat(n, heads)[stays]), lists], names=["lang", "term", "total", "sources"]
        )

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, numbers, least = [], {}, 1 << 20
        for batch in batches:
            for i in range(batch.num_rows):
                tries.append(read(batch, i, numbers))
                if sum(map(len, tries)) >= least:
                    tries = [RadixTrie.merged(tries)]
                    least = 2 * len(tries[0]) + (1 << 20)
        trie = RadixTrie.merged(tries)
        if len(trie):
            yield from kept(trie, list(numbers))

    return run


def kept_terms(named: DataFrame, least_docs: int, trie_leaves: int, range_leaves: int, block: int) -> DataFrame:
    """(lang, term, total, sources) of the terms in at least so many documents of a language."""
    blocks = written_table(named.mapInArrow(_counting(trie_leaves, block), _BLOCK))
    counters, n = blocks.agg(F.sum(F.size("n")), F.count("*")).first()
    ranges = -(-(counters or 0) // range_leaves)
    # First leaves of blocks, chosen by a hash of them, give the cuts: all of them, or CUT_SAMPLE about.
    share = F.pmod(F.xxhash64("first", "last"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CUT_SAMPLE / max(1, n)))
    firsts = [bytes(r[0]) for r in blocks.where(share).select("first").orderBy("first").collect()] if ranges > 1 else []
    cuts = sorted({firsts[len(firsts) * k // ranges] for k in range(1, ranges)}) if firsts else []
    dealt = blocks.select(*_BLOCK_NAMES).mapInArrow(_dealing(cuts), f"{_BLOCK}, at int") if cuts else blocks.withColumn("at", F.lit(0))
    return dealt.groupBy("at").applyInArrow(_merging(least_docs), "lang string, term string, total long, sources array<struct<source:string,n:long>>")


def _share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exact; null where there is nothing to share."""
    whole = lambda c: c.cast("decimal(38,0)")
    fits = (count < 1_000_000_000) & (total < 1 << 61) & (v < 1 << 61)
    short = F.call_function("div", (count.cast("long") + F.lit(1)) * F.lit(SCALE).cast("long"), F.nullif(total.cast("long") + v, F.lit(0)))
    top = (whole(count) + F.lit(1)).cast("decimal(26,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = F.nullif((whole(total) + whole(v)).cast("decimal(20,0)"), F.lit(0))
    return F.when(fits, short).otherwise(F.call_function("div", top, under)) + F.lit(1)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so that longs hold all of it."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairing(batches):
    """Per task: sums over terms of the pairs' differences beyond those of absent counts, in two digits.

    Rows in: lang, ``at`` and ``p`` (numbers and shares of the sources that have the term), ``absent``
    (the share of every source of the language at count 0).
    """

    def rows(lang: str, sums: np.ndarray):
        s, t = np.nonzero(sums.any(0))
        columns = [pa.array([lang] * len(s), pa.string()), *(pa.array(x.astype(np.int32)) for x in (s, t)), *(pa.array(x[s, t]) for x in sums)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "s", "t", "high", "low"])

    def beyond(p, q, p0, q0):
        return (p - q) ** 2 // q - (p0 - q0) ** 2 // q0

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            part = batch.filter(pa.array(langs == lang))
            absent = part.column("absent")[0].values.to_numpy()
            size = len(absent)
            block = max(1, _CELLS // size)
            sums = held.pop(lang, None)
            sums = np.zeros((2, size, size), np.int64) if sums is None else sums
            for start in range(0, part.num_rows, max(1, block // size)):
                piece = part.slice(start, max(1, block // size))
                lists = piece.column("at")
                term = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
                at, p = lists.flatten().to_numpy(), piece.column("p").flatten().to_numpy()
                dense = np.tile(absent, (piece.num_rows, 1))
                dense[term, at] = p
                there = np.zeros(dense.shape, bool)
                there[term, at] = True
                for a in range(0, len(at), block):
                    x, mine, row = at[a : a + block], p[a : a + block, None], term[a : a + block]
                    given = beyond(mine, dense[row], absent[x][:, None], absent[None])
                    taken = np.where(there[row], 0, beyond(absent[None], mine, absent[None], absent[x][:, None]))
                    for digit, f in enumerate((lambda v: v >> _DIGITS, lambda v: v & (1 << _DIGITS) - 1)):
                        np.add.at(sums[digit], x, f(given))
                        np.add.at(sums[digit].T, x, f(taken))
            held[lang] = sums
            while sum(s.size for s in held.values()) > 4 * _CELLS:
                lang = next(iter(held))
                yield rows(lang, held.pop(lang))
    for lang, sums in held.items():
        yield rows(lang, sums)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS, trie_leaves: int = TRIE_LEAVES, range_leaves: int = RANGE_LEAVES, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    named = docs.select(whole_text(text_col).cast("binary").alias("text"), whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source"))
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}):
        kept = written_table(kept_terms(named, least_docs, trie_leaves, range_leaves, block))

    flat = kept.select("lang", F.explode("sources").alias("s")).select("lang", "s.source", "s.n")
    counted = flat.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = named.select("lang", "source").distinct().join(counted.withColumnsRenamed({"lang": "l2", "source": "s2"}), (F.col("lang") == F.col("l2")) & (F.col("source") == F.col("s2")), "left")
    groups = groups.join(langs, F.col("lang") == F.col("l"), "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), "lang_n")
    groups = groups.withColumn("absent", _share(F.lit(0), F.col("n"), F.col("v")))
    lists = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n", "absent"))).alias("all"), F.first("v").alias("v"), F.first("lang_n").alias("lang_n"))
    lists = written_table(lists)

    # A row per kept term of a language, with the language's sources.
    here = kept.join(lists.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l"))
    number = lambda s: F.array_position(F.col("names"), s["source"]).cast("int") - 1
    here = here.withColumn("names", F.col("all.source")).withColumn("sources", F.transform("sources", lambda s: F.struct(number(s).alias("at"), s["source"].alias("source"), s["n"].alias("n"))))
    here = here.withColumn("sources", F.transform("sources", lambda s: s.withField("p", _share(s["n"], F.get(F.col("all.n"), s["at"]), F.col("v")))))

    sums = here.select("lang", F.col("sources.at").alias("at"), F.col("sources.p").alias("p"), F.col("all.absent").alias("absent")).mapInArrow(_pairing, "lang string, s int, t int, high long, low long")
    sums = sums.groupBy("lang", "s", "t").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).withColumnsRenamed({"lang": "sl", "s": "ss", "t": "st"})
    one = lists.select("lang", "v", "all", F.posexplode("all").alias("s", "a"))
    two = one.select("lang", "v", "s", "a", F.posexplode("all").alias("t", "b")).where("s <> t")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    base = wide("v").cast("decimal(18,0)") * F.coalesce(_gap(F.col("a.absent"), F.col("b.absent")), F.lit(0)).cast("decimal(20,0)")
    more = F.coalesce(wide("high").cast("decimal(20,0)") * F.lit(1 << _DIGITS).cast("decimal(10,0)") + wide("low"), F.lit(0))
    pairs = two.join(sums, (F.col("lang") == F.col("sl")) & (F.col("s") == F.col("ss")) & (F.col("t") == F.col("st")), "left")
    pairs = pairs.select("lang", F.col("a.source").alias("source"), F.lit("pair").alias("part"), F.col("b.source").alias("item"), (base + more).cast("long").alias("value"))

    q = _share(F.col("total"), F.col("lang_n"), F.col("v"))
    single = here.select("lang", "term", q.alias("q"), F.explode("sources").alias("s")).where("s.p > q")
    single = single.select("lang", "s.source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("s.p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(single).where(F.col("rank") <= ranks))
