"""Streams against their batch forms, over several files, late rows and restarts."""

import os
import random

from pyspark.sql import functions as F

from quillon.operators.stores import upsert
from quillon.streaming import documents as D
from quillon.streaming import vault as V

KIND = "token string, value string, entity string, written long"


def test_vault_state_equals_the_batch_upsert(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *"abcdefgh"]), str(rng.randrange(5)), "E", rng.choice([None, *range(20)])) for _ in range(120)]
    folder, everything = str(tmp_path), spark.createDataFrame(rows, KIND)
    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    taken = []
    for part in range(3):  # three runs of one checkpoint, each over several files; later ones bring older rows, too
        mine = rows[part * 40 : part * 40 + 40]
        taken += mine
        spark.createDataFrame(mine, KIND).repartition(3).write.mode("append").parquet(f"{folder}/in")
        query = V.start(stream(), f"{folder}/changes", f"{folder}/progress")
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] <= 40  # of the new files alone
        best, seen = {}, {}
        for t, v, e, w in taken:
            if t is not None:
                key = (-(1 << 63) if w is None else w, v)
                best[t], seen[t] = max(best.get(t, key), key), seen.get(t, 0) + 1
        got = {r.token: (r.written, r.value, r.seen) for r in V.current(spark, f"{folder}/progress").collect()}
        assert got == {t: (*best[t], seen[t]) for t in best}
    changes = spark.read.parquet(f"{folder}/changes")
    assert {r.token for r in changes.collect()} == set(best) and changes.count() >= len(best)
    timed = everything.where("token IS NOT NULL AND written IS NOT NULL")
    batch = upsert(timed.limit(0), timed, ["token"], "written").select("token", "written")
    assert {(t, w) for t, (w, _, _) in got.items() if w >= 0} == {tuple(r) for r in batch.collect()}
    again = V.start(stream(), f"{folder}/changes", f"{folder}/progress")  # nothing new
    again.awaitTermination()
    assert V.current(spark, f"{folder}/progress").count() == len(best)


def test_entries_of_texts(spark, tmp_path):
    texts = [("Patient Meera Iyer was admitted, MRN123456.", 1), ("Patient Meera Iyer visited AIIMS.", 2), (None, 3)]
    spark.createDataFrame(texts, "text string, at long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string, at long").parquet(f"{tmp_path}/in")
    V.start(D.vault_entries(stream, "at", key="k"), f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = {(r.entity, r.value, r.written) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("PERSON", "Meera Iyer", 2) in got and ("MRN", "MRN123456", 1) in got


def test_windows_sessions_and_first_contents(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", u, "click", 1.0, p) for i, (h, m, u, p) in enumerate([(0, 5, 1, "x"), (0, 20, 1, "y"), (0, 59, 2, "x"), (1, 30, 1, "z"), (5, 0, 1, "w")])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counts = D.collected(D.event_counts(stream()), f"{tmp_path}/counts")
    assert sorted((r.start.hour, r.n) for r in counts.collect()) == [(0, 3), (1, 1)]  # the window at 5 is open
    sessions = D.collected(D.sessions(stream()), f"{tmp_path}/sessions")
    assert sorted((r.user_id, r.start.hour, r.start.minute, r.n) for r in sessions.collect()) == [(1, 0, 5, 2), (1, 1, 30, 1), (2, 0, 59, 1)]
    firsts = D.collected(D.first_of_each(stream(), "ts", "props").select("props"), f"{tmp_path}/firsts")
    assert sorted(r.props for r in firsts.collect()) == ["w", "x", "y", "z"]
    assert os.path.exists(f"{tmp_path}/firsts/progress")
