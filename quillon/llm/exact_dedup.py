"""Exact dedup by a log-structured merge index over text digests.

* Memtables: every task collects (digest, id) pairs and flushes them as sorted,
  internally de-duplicated runs of bounded size, so one text that fills a third
  of the table leaves one entry per run.
* Compaction: the runs of one digest range (shard) meet in one task; a Bloom filter
  over the runs already seen lets digests that occur once pass without a merge;
  the others are merged, the smallest identifier staying.  The number of shards
  grows with the number of rows.
* Byte verification: every row whose digest was found elsewhere is compared, byte by
  byte, with the text of the row that stays.  Rows that differ (a digest collision)
  are regrouped by their texts themselves.

Defined cases: null text equals empty text; texts are equal when identical after
replacing each run of [\\x20\\x09-\\x0D] by one space; a null id counts as larger than
any other; of repeated rows (same id, same text) exactly one is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, numbered, whole_text

MEMTABLE_ROWS = 1 << 17
SHARD_ROWS = 1 << 19
NO_ID = (1 << 63) - 1


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def _reduce(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, width: int):
    """Sorted distinct digests with their smallest id and summed count."""
    order = np.argsort(digests, kind="stable")
    digests, ids, counts = digests[order], ids[order], counts[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
    return digests[first], np.minimum.reduceat(ids, first), np.add.reduceat(counts, first)


def _array(digests: np.ndarray, width: int) -> pa.Array:
    """Fixed-width numpy strings as Arrow binaries (trailing zero bytes kept)."""
    offsets = pa.py_buffer((np.arange(len(digests) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, offsets, pa.py_buffer(digests.tobytes())])


def _digests(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=f"S{width}") if len(column) else np.empty(0, f"S{width}")


def _memtables(width: int, shards: int, limit: int):
    def flush(parts, number):
        d, i = (np.concatenate(x) for x in zip(*parts, strict=True))
        d, i, c = _reduce(d, i, np.ones(len(i), np.int64), width)
        head = np.frombuffer(d.tobytes(), np.uint8).reshape(-1, width)[:, :4].astype(np.int64)
        prefix = (head * np.array([1 << 24, 1 << 16, 1 << 8, 1])).sum(1)
        return pa.RecordBatch.from_arrays(
            [pa.array((prefix * shards) >> 32, pa.int64()), pa.array(np.full(len(d), number), pa.int64()), _array(d, width), pa.array(i), pa.array(c)],
            names=["shard", "run", "digest", "id", "n"],
        )

    def run(batches):
        from pyspark import TaskContext

        number, parts, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 20, [], 0
        for batch in batches:
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids):
                parts.append((_digests(batch.column(0), width), ids))
                size += len(ids)
            if size >= limit:
                yield flush(parts, number)
                number, parts, size = number + 1, [], 0
        if size:
            yield flush(parts, number)

    return run


class _Filter:
    """Bloom filter whose probes are words of the digest itself."""

    def __init__(self, capacity: int, width: int):
        self.bits = np.zeros(1 << max(10, (capacity * 10).bit_length()), bool)
        self.width = width

    def _probes(self, digests: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, self.width).astype(np.uint64)
        base = np.zeros((2, len(raw)), np.uint64)
        for k in range(self.width):  # two running hashes over all digest bytes
            base[0] = base[0] * np.uint64(1099511628211) ^ raw[:, k]
            base[1] = (base[1] + raw[:, k]) * np.uint64(0x9E3779B97F4A7C15) ^ (base[1] >> np.uint64(29))
        steps = np.arange(4, dtype=np.uint64)[:, None]
        return (base[0] + steps * (base[1] | np.uint64(1))) & np.uint64(len(self.bits) - 1)

    def seen_then_add(self, digests: np.ndarray) -> np.ndarray:
        probes = self._probes(digests)
        seen = self.bits[probes].all(0)
        self.bits[probes] = True
        return seen


def _compaction(width: int):
    def compact(table: pa.Table) -> pa.Table:
        runs = table.column("run").to_numpy()
        digests = _digests(table.column("digest"), width)
        ids, counts = table.column("id").to_numpy(), table.column("n").to_numpy()
        filters, suspects = _Filter(len(digests), width), []
        for number in np.unique(runs):
            run = digests[runs == number]
            suspects.append(run[filters.seen_then_add(run)])
        merged = np.isin(digests, np.concatenate(suspects))
        d, i, c = _reduce(digests[merged], ids[merged], counts[merged], width) if merged.any() else (digests[:0], ids[:0], counts[:0])
        single = ~merged
        return pa.table(
            {
                "digest": pa.chunked_array([_array(d, width), _array(digests[single], width)]),
                "keep": pa.array(np.concatenate([i, ids[single]])),
                "size": pa.array(np.concatenate([c, counts[single]])),
            }
        )

    return compact


def build_index(rows: DataFrame, width: int = 32, memtable_rows: int = MEMTABLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(digest, keep, size) from (digest, id); ``keep`` is NO_ID where all ids are null."""
    shards = max(1, -(-rows.count() // shard_rows))
    runs = rows.select("digest", "id").mapInArrow(_memtables(width, shards, memtable_rows), "shard long, run long, digest binary, id long, n long")
    return runs.groupBy("shard").applyInArrow(_compaction(width), "digest binary, keep long, size long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` shortens the index key (tests force collisions with it).
    """
    id_type = dict(docs.dtypes)[id_col]
    norm = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("body"))
    sha = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    rows = checkpointed(norm.select("id", sha.alias("sha")).select("id", "sha", F.substring("sha", 1, digest_bytes).alias("digest")))
    index = checkpointed(build_index(rows, digest_bytes))
    groups = index.where("size > 1").withColumnRenamed("digest", "key")

    # Byte verification of every hit against the row that stays.
    hits = rows.join(groups, F.col("digest") == F.col("key")).select(F.coalesce("id", F.lit(NO_ID)).alias("hit"), "digest", "keep").distinct()
    texts = (
        norm.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
        .withColumn("digest", F.substring(sha, 1, digest_bytes))
        .join(hits.withColumnRenamed("digest", "hit_digest"), (F.col("id") == F.col("hit")) & (F.col("digest") == F.col("hit_digest")))
        .select("id", "digest", "keep", "body")
    )
    kept_texts = texts.where("id = keep").groupBy("digest").agg(F.min("body").alias("kept_body"))
    collided = checkpointed(
        texts.join(kept_texts.withColumnRenamed("digest", "kept_digest"), F.col("digest") == F.col("kept_digest"))
        .where(F.col("body").cast("binary") != F.col("kept_body").cast("binary"))
        .select("digest")
        .distinct()
    )
    verdict = rows.join(index.withColumnRenamed("digest", "key"), F.col("digest") == F.col("key"), "left")
    if not collided.isEmpty():
        bad = norm.withColumn("digest", F.substring(sha, 1, digest_bytes)).join(collided, "digest", "left_semi")
        exact = bad.groupBy("digest", "body").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("keep"), F.count("*").alias("size"))
        exact = exact.select(F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("key"), "keep", "size")
        clean = rows.join(collided, "digest", "left_anti").join(index.withColumnRenamed("digest", "key"), F.col("digest") == F.col("key"), "left")
        columns = ["id", "sha", "keep", "size"]
        verdict = clean.select(columns).union(
            rows.join(collided, "digest", "left_semi").join(exact, F.col("sha") == F.col("key")).select(columns)
        )
    keep = F.when(F.col("keep") != NO_ID, F.col("keep"))
    verdict = verdict.select("id", keep.alias("keep"), "size", "sha", F.col("id").eqNullSafe(keep).alias("first"))
    # Repeated rows share id and text: only one of them stays.
    staying = verdict.where("first")
    order = Window.partitionBy("sha", "id").orderBy("size")
    staying = staying.withColumn("first", F.row_number().over(order) == 1)
    return verdict.where("not first").unionByName(staying).select(
        F.col("id").cast(id_type).alias(id_col),
        F.col("keep").cast(id_type).alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("first").alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; all columns stay as they are."""
    names = docs.columns
    docs, id_col, text_col = numbered(docs, id_col, text_col)
    kept = dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__own", F.sha2(normalised(text_col).cast("binary"), 256))
    chosen = marked.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    repeated = checkpointed(
        docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id")
    )
    if repeated.isEmpty():
        return chosen.drop("__own").toDF(*names)
    once = chosen.join(repeated, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    more = chosen.join(repeated, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([id_col, "__own"])
    return once.unionByName(more).drop("__own").toDF(*names)
