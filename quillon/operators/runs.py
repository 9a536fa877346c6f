"""A run over a folder of files: every file is read once, scanned, rewritten and saved; totals are observed on the way.

Pages of a text are what form feeds divide.  A file that cannot be read is a failed row with its error
and never fails the others.  The totals of the run are metrics that Spark observes while the results
are written (``DataFrame.observe``), so that they cost neither a second pass nor an exchange.

Defined cases: an empty folder gives no rows and totals of zero; empty files are passed over as by Spark's reader, or with
``empty`` are texts of one short page;
files of equal name in different folders are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators.rewrite import anonymise
from quillon.sources.ingest import digital_page, read_files

#: Columns of a result.
RESULT = "source string, source_type string, status string, error string, pages int, scanned_pages int, needs_ocr boolean, num_entities int, anonymised_text string"


def processed(files: DataFrame, mode: str = "two_step", key: str | None = None, join_letters: bool = True) -> DataFrame:
    """Rows of RESULT from ingested files; ``source`` is the name of the file."""
    pages = F.split(F.coalesce("text", F.lit("")), "\f")
    good = F.col("error").isNull()
    found = anonymise(files.withColumn("pages_of", F.when(good, pages)), mode, key=key, join_letters=join_letters)
    scanned = F.size(F.filter("pages_of", lambda p: ~digital_page(p)))
    return found.select(
        F.regexp_extract("source", r"([^/]*)$", 1).alias("source"), "source_type", F.when(good, "success").otherwise("failed").alias("status"), "error", F.when(good, F.size("pages_of")).alias("pages"),
        F.when(good, scanned).alias("scanned_pages"), F.when(good, scanned > 0).alias("needs_ocr"), F.when(good, F.size("spans")).alias("num_entities"), F.when(good, F.col("anonymised_text")).alias("anonymised_text"),
    )


def totals() -> dict[str, Column]:
    """Aggregates over rows of RESULT by name."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    amount = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return {
        "total_files": F.count(F.lit(1)), "successful": count(F.col("status") == "success"), "failed": count(F.col("status") == "failed"), "scanned_files": count(F.col("needs_ocr")),
        "digital_files": count(~F.col("needs_ocr")), "pages": amount("pages"), "scanned_pages": amount("scanned_pages"), "total_entities": amount("num_entities"),
    }


def folder_run(spark: SparkSession, path: str, out: str, mode: str = "two_step", key: str | None = None, join_letters: bool = True, empty: bool = False) -> dict[str, int]:
    """Process the files under ``path``, append rows of RESULT under ``out`` (Parquet), and return the totals."""
    # A session of its own: models fitted in one that has observed cannot be shipped to tasks.
    rows, seen = processed(read_files(spark.newSession(), path, empty=empty), mode, key, join_letters), Observation("folder run")
    watched = rows.observe(seen, *[c.alias(n) for n, c in totals().items()])
    watched.write.mode("append").parquet(out)
    return dict(seen.get)
