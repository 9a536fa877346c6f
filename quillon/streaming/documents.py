"""Streams of documents and events: stateless rewriting, deduplication, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.rewrite import anonymise
from quillon.operators.stores import entity_of_token
from quillon.streaming import vault


def read_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rewritten(stream: DataFrame, mode: str = "two_step", text_col: str = "text", key: str | None = None) -> DataFrame:
    """Stateless: the same column expressions as in batch."""
    return anonymise(stream, mode, text_col, key)


def first_of_each(stream: DataFrame, time_col: str, text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """Drop repeated contents seen within the watermark."""
    return stream.withWatermark(time_col, delay).withColumn("content_hash", F.sha2(text_col, 256)).dropDuplicatesWithinWatermark(["content_hash"])


def event_counts(stream: DataFrame, time_col: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window; late rows beyond the delay are not counted."""
    counted = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, time_col: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def vault_entries(stream: DataFrame, at: str, text_col: str = "text", key: str | None = None) -> DataFrame:
    """(token, value, entity, written) of the tokens that rewriting leaves in a stream of texts."""
    rows = rewritten(stream, "two_step", text_col, key).select(F.explode("vault").alias("token", "value"), F.col(at).cast("long").alias("written"))
    return rows.select("token", "value", entity_of_token(F.col("token")).alias("entity"), "written")


def collected(rows: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there and read what it has emitted; ``folder`` keeps its progress and its rows."""
    spark = rows.sparkSession
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def start_vault(stream: DataFrame, path: str, checkpoint: str, at: str, key: str | None = None) -> StreamingQuery:
    """Tokens of a rewritten stream, kept as a latest-wins vault; changes are appended under ``path``."""
    return vault.start(vault_entries(stream, at, key=key), path, checkpoint)


def current_version(spark: SparkSession, path: str) -> DataFrame:
    """The vault from its appended changes; ``vault.current`` reads it from the state instead."""
    values = F.max(F.struct("written", "value", "entity", "seen")).alias("v")
    return spark.read.schema(vault.CHANGES).parquet(path).groupBy("token").agg(values).select("token", "v.value", "v.entity", "v.written", "v.seen")
