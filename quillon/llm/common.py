"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels are learned from rows whose crc32(doc_id) mod FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where none is set, a temporary one serves a driver that runs its tasks itself (tests);
    on a cluster, whose executors would not share it, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session while a job runs; those that were there come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small ``df`` into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """``df`` written as (compressed) Parquet to the shared folder and read again.

    For results too large for an uncompressed checkpoint.  The files are removed
    when the driver ends, shuffles of the job as soon as it is through.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The ``written_table`` of ``df``, and what removes its files before the driver ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)

    def remove():
        try:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended already
            return

    atexit.register(remove)
    return spark.read.parquet(path), remove


def whole_text(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, ...]:
    """``df`` with its columns called c0, c1, ... and the new names of ``columns``: no helper column can clash with them."""
    lower = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(lower))]), *[f"c{lower.index(c.lower())}" for c in columns]


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` training labels (id, y), chosen by a hash of the id.

    The hash threshold is set from the number of rows, so that the final
    ordered limit sees little more than ``bound`` rows at any table size.
    """
    rows = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
        .where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .withColumn("__h", F.pmod(F.xxhash64(F.lit("sample"), F.col("__id")), F.lit(1 << 30)))
    )
    n = labels.count()
    if n > bound:
        rows = rows.where(F.col("__h") < int((1 << 30) * min(1.0, 1.5 * bound / n)))
    return rows.orderBy("__h", "__id").limit(bound).select("__id", "__y")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_heads(octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of byte strings, with their lengths; ``octets`` has the eight bytes from each position on."""
    return (octets[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_hashes(octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte strings, over all their bytes."""
    out = mixed(byte_heads(octets, starts, sizes) if heads is None else heads)
    more, at = np.flatnonzero(sizes > 8), 8
    while len(more):
        rest = sizes[more] - at
        out[more] = mixed(out[more] * np.uint64(3) + (octets[starts[more] + at] & _MASKS[np.minimum(rest, 8)]))
        more, at = more[rest > 8], at + 8
    return out


def slices(batches, rows: int = 256):
    """Arrow batches cut to few rows, so that what is made from one of them stays small."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def small_batches(df: DataFrame, limit: str = "8m") -> SparkSession:
    """Bound the Arrow batches that tasks of this session hold: long texts come few at a time."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    return spark
