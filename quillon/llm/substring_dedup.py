"""Substring dedup: windows of WINDOW words that an earlier document has, too, are removed.

Every window has a Rabin-Karp hash; all of them come from one running sum of word hashes times
powers of an odd base modulo 2^64, since the sum over any span is a difference of two of its
values.  Windows are counted in Spark, but not one row each:

* Each window has an anchor, the smallest hash among its grams of GRAM words.  Equal windows
  have equal anchors, so only windows of one anchor must be told apart.
* Neighbouring windows of one anchor form a run, a row with the hash of all its words.  Of equal
  runs the smallest document is kept, all windows of the others are removed.
* Different runs of one anchor are opened, once each: their windows are counted one by one.

Removed windows are merged per document into maximal intervals of words.  Windows are told
apart by two 64-bit hashes (of the anchor and of the window), runs likewise.  Copies of whole
documents are found by the SHA-256 of their words and take no part but for the first of them.
Frequent runs and windows are reduced to their smallest document before they are exchanged; the
joins back are between plain exchanges, which adaptive execution splits where a key is hot.

Defined cases: null text counts as empty; documents under WINDOW words lose nothing; a null id
counts as larger than any other, and documents of one id (or of null ids) never remove from each
other; ids may be of any ordered type; repeated rows get equal results; words of any length
count whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import byte_hashes, mixed, whole_text, written_table

WINDOW, GRAM = 50, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once.
_PIECE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pieces(batches, column: str = "text"):
    """Batches cut so that the texts of a piece (or one long text) are some megabytes."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).cast(pa.binary()).to_pandas().str.len().to_numpy(np.int64, na_value=0)) // _PIECE
        cuts = np.r_[0, np.flatnonzero(np.diff(ends)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


class Rolling:
    """Word hashes of some texts in a row, and Rabin-Karp hashes of their spans."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" " + b" ".join([*texts, bytes(8)]), np.uint8)
        size = len(data) - 8
        space = _SPACE[data[:size]]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1  # the first and the last byte are spaces
        starts, ends = change[::2], change[1::2]
        closing = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.r_[0, np.searchsorted(starts, closing)])
        self.offsets = np.cumsum(self.counts) - self.counts
        words = byte_hashes(np.ndarray(size, "<u8", data, strides=(1,)), starts, ends - starts)
        n = len(words)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = _BASE
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(powers)[:n], out=self._sums[1:])
        powers[1:] = _UNBASE
        self._shift = np.multiply.accumulate(powers)

    def spans(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """Hashes of spans of words; those of other sizes differ, too."""
        sizes = np.asarray(sizes, np.int64)
        return mixed((self._sums[starts + sizes] - self._sums[starts]) * self._shift[starts] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows, and the text of each."""
        each = np.maximum(self.counts - window + 1, 0)
        text = np.repeat(np.arange(len(each)), each)
        return np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + self.offsets[text], text

    def anchors(self, starts: np.ndarray, window: int, gram: int) -> np.ndarray:
        """The smallest gram hash of each window: minima of blocks from the left and from the right."""
        width, n = window - gram + 1, int(self.counts.sum()) - gram + 1
        if not len(starts):
            return np.empty(0, np.uint64)
        grams = np.full(-(-n // width) * width + width, ~np.uint64(0))
        grams[:n] = self.spans(np.arange(n), gram)
        blocks = grams.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(after[starts], before[starts + width - 1])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(window: int, gram: int):
    """Per document: n_words, sha of its words, and its runs (anchor, digest, first window, windows)."""

    def run(batches):
        for batch in pieces(batches):
            texts = _texts(batch)
            rolling = Rolling(texts)
            starts, text = rolling.windows(window)
            anchor = rolling.anchors(starts, window, gram)
            head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])][: len(starts)])
            sizes = np.diff(np.r_[head, len(starts)])
            first = starts[head]
            digest = rolling.spans(first, sizes + window - 1)
            bounds = pa.array(np.searchsorted(text[head], np.arange(len(texts) + 1)).astype(np.int32))
            runs = pa.StructArray.from_arrays(
                [_signed(anchor[head]), _signed(digest), pa.array((first - rolling.offsets[text[head]]).astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["anchor", "digest", "first", "windows"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tie"), pa.array(rolling.counts.astype(np.int64)), pa.array([_sha(t.split()) for t in texts], pa.binary()), pa.ListArray.from_arrays(bounds, runs)],
                names=["id", "tie", "n_words", "sha", "runs"],
            )

    return run


def _opened(window: int):
    """A row (id, tie, window number, anchor, hash) for each window of the given runs of a document."""

    def run(batches):
        for batch in pieces(batches):
            rolling, lists = Rolling(_texts(batch)), batch.column("runs")
            runs = lists.flatten()
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            first, sizes, anchor = (runs.field(k).to_numpy() for k in ("first", "windows", "anchor"))
            row = np.repeat(np.arange(len(first)), sizes)
            number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            digest = rolling.spans(rolling.offsets[text[row]] + number, window)
            owner = pa.array(text[row])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(owner), batch.column("tie").take(owner), pa.array(number.astype(np.int32)), pa.array(anchor[row]), _signed(digest)],
                names=["id", "tie", "first", "anchor", "digest"],
            )

    return run


def intervals(firsts: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that runs of removed windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts.tolist(), (firsts + counts + window - 1).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(window: int):
    """Per document with removed windows: its number of words, removed ones, and the text that is left."""

    def run(batches):
        for batch in pieces(batches):
            n_words, n_removed, left = [], [], []
            for text, removed in zip(_texts(batch), batch.column("removed"), strict=True):
                words, at, kept = text.split(), 0, []
                runs = removed.values
                for a, b in intervals(runs.field("first").to_numpy(), runs.field("windows").to_numpy(), window):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                left.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tie"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())],
                names=["id", "tie", "n_words", "n_removed", "kept"],
            )

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, text); ``tie`` tells rows of one id apart by their text, and is 0 where ids are unique."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    return rows.select("id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("tie"), "text")


def _later(low: Column, mine: Column) -> Column:
    """True where ``low``, the smallest id of a group, comes before ``mine``; null comes last."""
    return F.coalesce(low < mine, low.isNotNull() & mine.isNull())


def _several() -> Column:
    """True for groups of which some document comes before another."""
    return F.coalesce(F.min("id") < F.max("id"), F.lit(False)) | (F.min("id").isNotNull() & (F.count("id") < F.count("*")))


def _of_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join of rows that belong to one document; the columns of ``left`` keep their names."""
    right = right.withColumnsRenamed({"id": "own_id", "tie": "own_tie"})
    return left.join(right, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie")), how).drop("own_id", "own_tie")


def _removals(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (id, tie, text), facts (id, tie, n_words, sha, copy), and removed windows per document (id, tie, removed)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _rows(docs, id_col, text_col)
    facts = written_table(texts.mapInArrow(_runs(window, gram), f"id {kind}, tie long, n_words long, sha binary, runs array<struct<anchor:long,digest:long,first:int,windows:int>>"))

    copied = written_table(facts.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("id").alias("low"), _several().alias("several")).where("several").select(F.col("sha").alias("copied"), "low"))
    facts = facts.join(copied, F.col("sha") == F.col("copied"), "left").withColumn("copy", F.col("copied").isNotNull() & _later(F.col("low"), F.col("id")))

    runs = facts.where("not copy").select("id", "tie", F.explode("runs").alias("run")).select("id", "tie", "run.*")
    distinct = written_table(runs.groupBy("anchor", "digest").agg(F.min("id").alias("low"), _several().alias("several")))
    forked = distinct.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("fork"))
    notable = distinct.join(forked, F.col("anchor") == F.col("fork"), "left").withColumn("forked", F.col("fork").isNotNull()).where("several or forked")
    notable = written_table(notable.select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "low", "forked"))
    judged = runs.join(notable, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d")))
    judged = written_table(judged.select("id", "tie", "first", "windows", "anchor", "forked", _later(F.col("low"), F.col("id")).alias("later")))

    # One document of each run opens it, so that every different window is there.
    asked = judged.where("forked and not later").groupBy("id", "tie").agg(F.collect_set(F.struct("first", "windows", "anchor")).alias("runs"))
    single = written_table(_of_row(texts, asked.hint("shuffle_hash"), "inner").mapInArrow(_opened(window), f"id {kind}, tie long, first int, anchor long, digest long"))
    shared = written_table(single.groupBy("anchor", "digest").agg(F.min("id").alias("low"), _several().alias("several")).where("several").select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "low"))
    alone = single.join(shared, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d"))).where(_later(F.col("low"), F.col("id")))

    removed = judged.where("later").select("id", "tie", "first", "windows").union(alone.select("id", "tie", "first", F.lit(1).alias("windows")))
    removed = removed.groupBy("id", "tie").agg(F.collect_set(F.struct("first", "windows")).alias("removed"))
    return texts, facts, removed


def _kept(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(documents that stay or go whole: id, tie, n_words, sha, copy), (those cut: id, tie, n_words, n_removed, kept)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts, facts, removed = _removals(docs, id_col, text_col, window, gram)
    removed = written_table(removed)
    whole = _of_row(facts.select("id", "tie", "n_words", "sha", "copy"), removed.select("id", "tie"), "left_anti")
    cut = _of_row(texts, removed.hint("shuffle_hash"), "inner").mapInArrow(_cut(window), f"id {kind}, tie long, n_words long, n_removed long, kept string")
    return whole, cut


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the words left, joined by one space)."""
    whole, cut = _kept(docs, id_col, text_col, window, gram)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = whole.select("id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"), F.when(F.col("copy"), F.lit(nothing)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    cut = cut.select("id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return whole.union(cut).withColumnRenamed("id", id_col)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, text): texts as they are where nothing is removed, else the words left, joined by one space."""
    whole, cut = _kept(docs, id_col, text_col, window, gram)
    bare = _of_row(_rows(docs, id_col, text_col), whole.select("id", "tie", "copy").distinct(), "inner").select("id", F.when(F.col("copy"), F.lit("")).otherwise(F.col("text")).alias("text"))
    return bare.union(cut.select("id", "kept")).withColumnsRenamed({"id": id_col, "text": text_col})
