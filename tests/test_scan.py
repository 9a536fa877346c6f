"""The Arrow scan, the SQL functions and chunks against the column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import scan
from quillon.functions.sql import register
from quillon.operators import chunks
from quillon.operators import detect as D
from quillon.operators import rewrite as W
from quillon.plans.narratives import narratives, notes

PARTS = [
    "Patient Meera Iyer", "was admitted", "Dr. Amit Gupta", "Mr", "Reporter: Sunita Rao", "AIIMS", "apollo", "Fortis Hospital", "City Nursing Home", "Navi Mumbai", "Delhi",
    "1234 5678 9012", "ABCDE1234F", "HDFC0ABC123", "A1234567", "CDSCO/NDD/2024/1", "IND-12345", "MRN-123456", "a.b@example.com", "+91-9876543210", "98765-43210", "4111 1111 1111 1111",
    "10.0.0.1", "12/03/2024", "2024-03-12", "Mar 3, 2024", "411001", "https://x.org/a;b?c=(1)", "Address: 12, MG Road, Pune", "12 MG Road Nagar, Pune 411001", "K A T U R E", "A B", "é", "日本", "Name: ",
]
GLUE = [" ", ", ", ". ", "\n", "\n\n", "; ", "! ", "? ", ") ", '" ', ":", "", "(", "\t"]


def texts(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(GLUE) for _ in range(rng.randrange(parts))) for _ in range(n)]


def test_scan_equals_the_columns(spark):
    rows = [(i, t) for i, t in enumerate([*texts(1, 250, 14), None, "", " ", "x" * 5000])]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = docs.withColumn("norm", D.normalise(F.coalesce("text", F.lit(""))))
    differ = found.where(~D.detect(F.col("norm")).eqNullSafe(scan.scanned(F.col("norm"))))
    assert differ.select("text").collect() == []
    norms = found.select("text", "norm").collect()
    assert all(scan.joined(r.text) == r.norm for r in norms)


def test_sql_functions_equal_the_columns(spark):
    register(spark, "k" * 70)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts(2, 80, 9), None, ""])], "id long, text string")
    docs.createOrReplaceTempView("sql_docs")
    found = spark.sql(
        "SELECT d.id, s.*, mask_pii(s.entity, s.value) AS m, generalise_pii(s.entity, s.value) AS g, token_pii(s.entity, s.value) AS t, two_step_pii(s.entity, s.value) AS w"
        " FROM sql_docs d, LATERAL detect_spans(d.text) s"
    )
    wanted = D.with_spans(docs).select("id", F.explode("spans").alias("s"))
    wanted = wanted.select("id", "s.start", "s.end", "s.entity", F.col("s.text").alias("value"), "s.score", *[W.replacement(F.col("s"), mode, "k" * 70).alias(c) for mode, c in zip(("mask", "generalise", "pseudonymise", "two_step"), "mgtw", strict=True)])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert spark.sql("SELECT mask_pii('PAN', NULL), generalise_pii(NULL, 'x'), token_pii('PAN', NULL)").first() == (None, None, None)


@pytest.mark.parametrize("size", [1, 40, 300])
def test_chunks_give_the_spans_of_whole_texts(spark, size):
    rows = [(i % 30, t) for i, t in enumerate([*texts(3, 60, 60), None, "", "; " * 50, "no seam " * 100])]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    whole = D.span_rows(docs.select("id", F.lit(None).alias("offset"), "text").transform(D.with_spans), "id")
    got = chunks.detect_chunked(docs, "id", size=size)
    assert got.columns == whole.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_chunks_cover_the_text_and_keep_to_the_window():
    for text in [*texts(4, 40, 200), "", "x" * 999]:
        for cuts in (list(chunks.model_cuts(text, 100, 20)), list(chunks.seam_cuts(text, 100))):
            assert "".join(text[a:b] for a, b in cuts) == text
            assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]]
        assert all(b - a <= 120 for a, b in chunks.model_cuts(text, 100, 20))
    assert list(chunks.model_cuts("a" * 60 + "\n\n" + "b" * 60, 100, 20)) == [(0, 62), (62, 122)]


def test_one_huge_text_is_spread_over_tasks(spark):
    text = "; ".join(texts(5, 3000, 12))
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    parts = chunks._chunks(docs, F.col("text"), "id", {"size": 2000, "cut": lambda t: chunks.seam_cuts(t, 2000)})
    shares = [r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).collect()]
    assert len(shares) == 4 and max(shares) < 0.5 * len(text)


def test_notes_and_narratives_are_scanned_alike(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for rows in (narratives(orders).select("text"), notes(orders).select("text")):
        norm = rows.select(D.normalise(F.col("text")).alias("norm"))
        assert norm.where(~D.detect(F.col("norm")).eqNullSafe(scan.scanned(F.col("norm")))).isEmpty()


def test_rules_are_tried_only_where_they_can_match():
    rules = [*scan._RULES, *scan._FIELDS, *scan._INLINE]
    for text in [*texts(4, 600, 12), *(t.replace("é", "").replace("日本", "") for t in texts(5, 600, 12)), "Hospital: AIIMS\nDR X", "ſmt K 12", "_12/03/2024 1 2 3 4-5 6 7 8 9 0 1 2 3"]:
        seen = scan._Seen(text)
        for r in rules:
            assert [m.span() for m in r.matches(seen)] == [m.span() for m in r.pattern.finditer(text)], (r.name, text)


def test_reports_are_scanned_in_the_same_pass():
    found = scan.report_spans_of("Name: Meera Iyer : 3\nHospital: Sun Care, Pune\nPhone: 12")
    assert [(s[0], s[2], s[3]) for s in found] == [(6, "PERSON", "Meera Iyer"), (31, "ORGANIZATION", "Sun Care, Pune"), (53, "IN_PHONE", "12")]


def test_short_texts_share_a_pass(monkeypatch):
    many = ["", "Address: ", *texts(6, 800, 4), "Name:", "12345", "678 MRN", "-123456", *texts(7, 200, 4), "x" * (scan._AT_ONCE + 1), "Dr. Amit Gupta"]
    alone = [(scan.spans_of(t), scan.report_spans_of(t)) for t in many]
    passes, seen = [], scan._Seen
    monkeypatch.setattr(scan, "_Seen", lambda *own: passes.append(own) or seen(*own))
    for found, which in ((scan.scan, 0), (scan.scan_report, 1)):
        passes.clear()
        lists = next(found(iter([scan.pa.array(many)]))).to_pylist()
        assert [[tuple(s.values()) for s in x] for x in lists] == [x[which] for x in alone]
        assert len(passes) == 3  # two of ASCII texts, one of others
