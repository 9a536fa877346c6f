"""Stores as append-only or latest-wins tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.rewrite import decrypted, traceback

#: Ranges of ids over which the copies of one text are dealt.
RANGES = 64


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key over both tables; one aggregate, no sort."""
    values = [c for c in old.columns if c not in keys]
    both = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(at)).alias("v"))
    return both.select(*keys, *[F.col("v")[c].alias(c) for c in values])


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key are replaced where the new table has the key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def reveal(tokens: DataFrame, vault: DataFrame, key: str) -> DataFrame:
    """(token, value) of the tokens that the vault knows."""
    return tokens.join(vault, "token").select("token", decrypted(F.col("ciphertext"), key).alias("value"))


def lookup(tokens: DataFrame, vault: DataFrame, key: str) -> DataFrame:
    """(token, status, value): found, not_found or decrypt_failed."""
    joined = tokens.join(vault.select("token", "ciphertext"), "token", "left")
    value = decrypted(F.col("ciphertext"), key, None)
    status = F.when(F.col("ciphertext").isNull(), "not_found").when(value.isNull(), "decrypt_failed").otherwise("found")
    return joined.select("token", status.alias("status"), value.alias("value"))


def entity_of_token(token: Column) -> Column:
    """Entity inside ``<ENTITY_hex>``; UNKNOWN without an underscore."""
    return F.coalesce(F.nullif(F.regexp_extract(token, "^<*(.*)_[^_]*>*$", 1), F.lit("")), F.lit("UNKNOWN"))


def search(entries: DataFrame, text: str) -> DataFrame:
    return entries.where(F.lower("token").contains(text.lower()))


def vault_info(entries: DataFrame) -> DataFrame:
    """One row: how many tokens and how many kinds of entity a vault holds."""
    distinct = entries.select("token").distinct().select(entity_of_token(F.col("token")).alias("entity"))
    return distinct.agg(F.count("*").alias("tokens"), F.count_distinct("entity").alias("entities"))


def traceback_files(texts: DataFrame, mappings: DataFrame, text_col: str) -> DataFrame:
    """``texts`` (with file_id) plus success, reconstructed_text, mappings_applied and error.

    ``mappings`` is (file_id, mapping), one row a file; a missing or empty mapping is an error
    of its row alone.
    """
    known = mappings.select(F.col("file_id").alias("mapped_file"), F.col("mapping").alias("of_file"))
    joined = texts.join(known, F.col("file_id") == F.col("mapped_file"), "left")
    some = F.coalesce(F.size("of_file"), F.lit(0)) > 0
    error = F.when(~some, F.concat(F.lit("No mapping found for file_id: "), F.coalesce(F.col("file_id").cast("string"), F.lit("None"))))
    return joined.select(
        *texts.columns, some.alias("success"), F.when(some, traceback(F.col(text_col), F.col("of_file"))).alias("reconstructed_text"),
        F.when(some, F.size("of_file")).alias("mappings_applied"), error.alias("error"),
    )


def history_view(log: DataFrame) -> DataFrame:
    """One row per file hash from an append-only log (file_hash, at, filename)."""
    # Counted by name first: a row holds the distinct names of a file, however often it was processed.
    named = log.groupBy("file_hash", "filename").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "filename"))), lambda x: x["filename"])
    return named.groupBy("file_hash").agg(F.min("at").alias("first_seen"), F.sum("n").alias("process_count"), names.alias("filenames"))


def duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, whether an earlier row has the same content, and the number of the run; ids are numbers.

    Rows are numbered within (content, range of ids), then moved on by the counts of the ranges
    before, so that the copies of one text are dealt over up to RANGES tasks.
    """
    rows = docs.select(id_col, F.sha2(text_col, 256).alias("__hash"))
    cuts = docs.agg(F.percentile_approx(id_col, [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("__cuts"))  # one row
    part = F.size(F.filter("__cuts", lambda c: c < F.col(id_col)))
    rows = rows.join(F.broadcast(cuts)).withColumn("__part", F.coalesce(part, F.lit(-1))).drop("__cuts")
    earlier = Window.partitionBy("__h").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("__hash").alias("__h"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__hash", "__part").orderBy(id_col)))
    run = numbered.join(before, F.col("__hash").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p"))).withColumn("run", (F.col("__k") + F.col("__before")).cast("int"))
    return run.select(id_col, (F.col("run") > 1).alias("duplicate"), "run")


def file_id(content: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.upper(F.substring(F.sha2(content, 256), 1, 12)))


def source_hash(content: Column) -> Column:
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), F.lit("..."))


def previews(docs: DataFrame, id_col: str, text_col: str, width: int = 500) -> DataFrame:
    return docs.select(id_col, F.substring(text_col, 1, width).alias("preview"))
