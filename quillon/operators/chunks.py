"""Huge texts in chunks: many tasks share one text, and spans come back at its own offsets.

Two ways to cut.  ``model_chunks`` cuts where a named-entity model may lose little: at the last
paragraph end, else line end, sentence end or space in a window around the wanted size.
``detect_chunked`` needs equal results, so it cuts at seams that no rule's match can cross: behind
one of the characters of SEAM and a white space.  Only addresses of the web may hold such a
character, and these hold no white space; no rule starts with or looks back over one.  So matches,
and the overlap scan over them, are those of the whole text.  A stretch without a seam stays in
one chunk, whatever its length.

Defined cases: null and empty texts give no rows; texts up to the size stay where they are, only
longer ones are exchanged; an empty table gives an empty result; repeated ids give rows each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scan import joined, scanned

SIZE, SLACK = 10_000, 500
# Where chunks for a model end, best first.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SEAM = re.compile(r'[;!?()"]\s')


def model_cuts(text: str, size: int = SIZE, slack: int = SLACK) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a text."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in SEPARATORS:
                at = text.rfind(mark, start + size // 2, end + slack)
                if at > start:
                    end = at + len(mark)
                    break
        yield start, end
        start = end


def seam_cuts(text: str, size: int = SIZE) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks of about ``size`` that end at seams."""
    if len(text) <= size:
        if text:
            yield 0, len(text)
        return
    seams, start = [m.end() for m in SEAM.finditer(text)] + [len(text)], 0
    while start < len(text):
        last = bisect_right(seams, start + size) - 1
        end = seams[last] if last >= 0 and seams[last] > start else seams[last + 1]
        yield start, end
        start = end


def _chunks(docs: DataFrame, text: Column, id_col: str, cuts) -> DataFrame:
    """(id, chunk, offset, text); long texts are dealt over tasks by (id, chunk)."""
    size = cuts["size"]
    rows = docs.select(F.col(id_col), F.coalesce(text, F.lit("")).alias("text")).where("text <> ''")
    kind = docs.schema[id_col].dataType.simpleString()
    cut, small = cuts["cut"], F.length("text") <= size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                whole = value.as_py()
                spans = list(cut(whole))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(spans))), pa.array(range(len(spans)), pa.int32()), pa.array([a for a, _ in spans], pa.int32()), pa.array([whole[a:b] for a, b in spans], pa.string())],
                    names=[id_col, "chunk", "offset", "text"],
                )

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = rows.where(~small).mapInArrow(run, f"`{id_col}` {kind}, chunk int, offset int, text string").repartition(tasks, F.xxhash64(id_col, "chunk"))
    zero = F.lit(0).cast("int")
    return rows.where(small).select(id_col, zero.alias("chunk"), zero.alias("offset"), "text").union(long)


def model_chunks(docs: DataFrame, id_col: str, text_col: str = "text", size: int = SIZE, slack: int = SLACK) -> DataFrame:
    """(id, chunk, offset, text) for a named-entity model."""
    return _chunks(docs, F.col(text_col), id_col, {"size": size, "cut": lambda t: model_cuts(t, size, slack)})


def shifted(found: DataFrame, id_col: str) -> DataFrame:
    """Spans of chunks (id, offset, spans) as rows at the offsets of their text."""
    rows = found.select(id_col, "offset", F.explode_outer("spans").alias("s")).where("s is not null")
    return rows.select(id_col, (F.col("offset") + F.col("s.start")).alias("start"), (F.col("offset") + F.col("s.end")).alias("end"), "s.entity", "s.text", "s.score")


def _joined(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([joined(t) for t in batch.to_pylist()], pa.string())


def detect_chunked(docs: DataFrame, id_col: str, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, start, end, entity, text, score): the spans that detection of whole texts gives, offsets in normalised text."""
    parts = _chunks(docs, F.arrow_udf(_joined, "string")(F.coalesce(F.col(text_col), F.lit(""))), id_col, {"size": size, "cut": lambda t: seam_cuts(t, size)})
    return shifted(parts.withColumn("spans", scanned(F.col("text"))), id_col)
