"""Streaming queries: each reads a table as a stream of files, runs over all of it, and returns what it emitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import rewrite as W
from quillon.plans import detection as P
from quillon.plans.narratives import narratives
from quillon.plans.sinks import new_folder
from quillon.streaming import documents as D
from quillon.streaming import vault as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks need instants; the table's times have no zone."""
    return stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; the pattern in the path lets it be one file or a folder of them."""
    return spark.readStream.schema(P.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query(f"""{P.DETECTED}, e AS (SELECT DISTINCT {P.TOKEN_SQL} AS token, entity, text AS value, id FROM resolved WHERE entity IN ('PERSON', 'MRN', 'DRUG_ID', 'CDSCO_FILE'))
SELECT token, arg_max(value, id) AS value, arg_max(entity, id) AS entity, max(id) AS written, count(*) AS seen FROM e GROUP BY token""")
def stream_vault(spark, sf_dir):
    folder = new_folder(spark)
    entries = D.vault_entries(narratives(stream_of(spark, sf_dir, "orders")), "id", key=W.DEMO_KEY)
    V.start(entries, f"{folder}/changes", f"{folder}/progress").awaitTermination()
    return V.current(spark, f"{folder}/progress")


@query(f"{P.DETECTED}, {P.apply_sql('narr', 'resolved', P.TWO_STEP_SQL)} SELECT id, anonymised_text FROM rewritten")
def stream_rewrite(spark, sf_dir):
    return D.collected(D.rewritten(narratives(stream_of(spark, sf_dir, "orders")), key=W.DEMO_KEY).select("id", "anonymised_text"), new_folder(spark))


#: Windows and sessions that the last watermark has closed.
@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL 1 hour, any_value(ts)) + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minutes FROM events)""")
def stream_event_counts(spark, sf_dir):
    rows = D.collected(D.event_counts(_events(spark, sf_dir)), new_folder(spark))
    return rows.withColumns({"total": F.round("total", 2), "start": F.col("start").cast("timestamp_ntz")})


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM numbered GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 minutes <= (SELECT max(ts) - INTERVAL 10 minutes FROM events)""")
def stream_sessions(spark, sf_dir):
    rows = D.collected(D.sessions(_events(spark, sf_dir)), new_folder(spark))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT sha256(props) AS content_hash FROM events GROUP BY 1")
def stream_first_of_each(spark, sf_dir):
    rows = D.first_of_each(_events(spark, sf_dir), "ts", "props")
    return D.collected(rows.select("content_hash"), new_folder(spark))
