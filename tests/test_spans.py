"""Spans applied to texts."""

from pyspark.sql import functions as F

from quillon.functions.spans import SPAN, apply_spans


def test_replacements_are_put_together_without_a_growing_state(spark):
    found = [(1, 3, "A", "bc", 1.0, 0), (3, 4, "B", "d", 1.0, 1), (6, 8, "C", "é日", 1.0, 2)]
    rows = [(1, "abcdefé日x", found), (2, "abc", []), (3, "abcd", [(0, 4, "A", "abcd", 1.0, 0)]), (4, "abc", None)]
    docs = spark.createDataFrame(rows, f"id long, text string, spans array<{SPAN}>")
    done = docs.select("id", apply_spans(F.col("text"), F.col("spans"), lambda s: F.when(s["entity"] != "B", F.concat(F.lit("<"), s["entity"], F.lit(">")))).alias("new"))
    assert dict(map(tuple, done.collect())) == {1: "a<A>ef<C>x", 2: "abc", 3: "<A>", 4: None}
    assert "aggregate(" not in done._jdf.queryExecution().optimizedPlan().toString()
