import hashlib
import hmac
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quillon.functions.patterns import TOKEN_PREFIX
from quillon.operators.contracts import label_sample
from quillon.operators.rewrite import REPORT_KEY
from quillon.plans.narratives import NARRATIVES_SQL

DIR = "/root/testdata/sf0.001"
CHEAP = [
    "detect_email", "detect_card", "detect_names", "detect_hospital", "resolve_overlaps", "report_fields", "mask_documents", "documents_with_pii", "cell_rewrite",
    "k_anonymity", "class_distances", "ncp", "enforce_l", "generalise_levels", "html_to_text", "page_signals", "structured_sentences", "extract_sections",
    "detect_ifsc", "detect_passport", "detect_phone_split", "detect_address_pin", "detect_pin", "detect_url", "detect_date_ymd", "detect_date_month",
    "traceback_by_file", "vault_info", "report_masthead", "risk_and_rating", "small_text_functions", "scan_totals", "ocr_artefacts",
    "summary_frequency", "checklist_matrix", "version_diff", "completeness_flags", "history_view", "combine_files",
    "detect_spans_sql", "rewrite_values_sql", "detect_chunked", "model_chunks", "ordered_diff", "change_heat_map", "constraint_flags", "completeness_results", "artifact_roundtrip", "artifact_summary",
    "evaluation_report", "folder_rows", "folder_totals", "stream_event_counts", "stream_sessions", "stream_first_of_each",
    "report_bodies", "report_pages", "duplicate_check", "k_anonymity_if_known", "decisions_actions",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the generated tables")


def rounded(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(rounded(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    want = sql.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = Counter(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == Counter(tuple(rounded(r[i]) for i in at) for r in want.fetchall())


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


ON_ALL_LANGUAGES = ["page_signals", "scan_summary", "scan_totals", "collapse_whitespace", "sentence_boundaries", "word_counts", "summary_frequency"]


@pytest.mark.parametrize("name", ON_ALL_LANGUAGES)
def test_query_reads_documents_of_all_languages(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    text = __spark_entry__.oracle_sql()[name]
    assert "lang = 'en'" not in text
    want = sql.sql(text)
    at = [want.columns.index(c) for c in df.columns]
    rows = Counter(tuple(rounded(v) for v in r) for r in df.collect())
    assert rows == Counter(tuple(rounded(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["summary_luhn", "summary_lsa", "summary_lexrank", "summary_textrank", "section_summaries", "ocr_artefacts"])
def test_query_has_every_document(spark, sql, name):
    ids = {r.doc_id for r in __spark_entry__.queries()[name](spark, DIR).select("doc_id").distinct().collect()}
    assert ids == {i for (i,) in sql.sql("SELECT doc_id FROM documents").fetchall()}


def test_artefacts_are_repaired_in_every_text(spark, tmp_path):
    texts = ["x A|B|C y", "a|b", "É|A -- --- -", "A|", "\f1|2", "H|J", ""]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["fr", "en", None, "de", "es", "en", "fr"], strict=True))], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r.text for r in __spark_entry__.queries()["ocr_artefacts"](spark, str(tmp_path)).collect()}
    wanted = [re.sub(r"(?<=[A-Z])\|(?=[A-Z])", "I", re.sub("-{2,}", "—", ("A|B -- " + t).replace("\f", "\n"))) for t in texts]
    assert rows == dict(enumerate(wanted))


def test_preview_of_documents_of_every_source(spark, sql):
    rows = Counter((r.doc_id, r.preview) for r in __spark_entry__.queries()["output_preview"](spark, DIR).select("doc_id", "preview").collect())
    text = __spark_entry__.oracle_sql()["output_preview"]
    assert rows == Counter(sql.sql(text).fetchall())


@pytest.fixture(scope="module")
def forms(sql):
    """id -> (name, hospital, city, phone, record number, date) of the labelled forms."""
    rows = sql.sql(f"WITH {NARRATIVES_SQL} SELECT s.id, name, hospital, city, phone, mrn, date FROM slots s JOIN narr n USING (id) WHERE s.shape = 1").fetchall()
    return {i: rest for i, *rest in rows}


def test_report_mask_has_the_forms(spark, sql, forms):
    rows = {r.id: r.processed_text for r in __spark_entry__.queries()["report_mask"](spark, DIR).collect()}
    # A field's value is one span, city included; the record number and the date are found by their own rules.
    stars = "*" * 12
    assert {i: rows[i] for i in forms} == {i: f"Name: {stars}\nHospital: {stars}\nPhone: {stars}\nRecord {stars} dated {stars}" for i in forms}
    every = sql.sql(__spark_entry__.oracle_sql()["report_mask"])
    a, b = every.columns.index("id"), every.columns.index("processed_text")
    assert rows == {r[a]: r[b] for r in every.fetchall()}


def test_report_tokens_has_the_forms(spark, sql, forms):
    rows = Counter((r.id, r.token, r.value) for r in __spark_entry__.queries()["report_tokens"](spark, DIR).collect())

    def made(entity, value):
        digest = hmac.new(REPORT_KEY.encode(), f"{entity}:{value}".encode(), hashlib.sha256).hexdigest()
        return f"[ID-{TOKEN_PREFIX.get(entity, 'UNK')}-{digest[:6]}]", value

    wanted = Counter()
    for i, (name, hospital, city, phone, mrn, date) in forms.items():
        for entity, value in (("PERSON", name), ("ORGANIZATION", f"{hospital}, {city}"), ("IN_PHONE", phone), ("MRN", mrn), ("DATE_TIME", date)):
            wanted[i, *made(entity, value)] += 1
    every = sql.sql(__spark_entry__.oracle_sql()["report_tokens"])
    at = [every.columns.index(c) for c in ("id", "token", "value")]
    assert rows == Counter(tuple(r[i] for i in at) for r in every.fetchall())
    assert all(rows[k] == n for k, n in wanted.items())


def test_severity_of_every_document(spark, sql):
    rows = __spark_entry__.queries()["severity_model"](spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == [i for (i,) in sql.sql("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()]
    assert {r.label for r in rows} <= {0, 1} and all(0.5 <= r.confidence <= 1 for r in rows)


def test_label_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i if i % 50 else None, i % 2 if i % 7 else None) for i in range(5000)], "doc_id long, toxic int")
    few = [tuple(r) for r in label_sample(labels, "doc_id", "toxic", 100).collect()]
    assert len(few) == 100 and few == [tuple(r) for r in label_sample(labels.repartition(7), "doc_id", "toxic", 100).collect()]
    assert all(i is not None and y is not None for i, y in few) and {i % 2 for i, _ in few} == {0, 1}
    assert label_sample(labels, "doc_id", "toxic").count() == sum(1 for i in range(5000) if i % 50 and i % 7)


@pytest.mark.parametrize("name", ["mask_documents", "artifact_roundtrip", "folder_rows"])
def test_letters_that_stand_apart_stay_so(spark, tmp_path, name):
    texts = ["one A A A A two 10.0.0.1 B C D", "E E E", "Dr. Meera Iyer visited AIIMS on 12/03/2024. X Y Z"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "<p>A B C</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want, df = con.sql(__spark_entry__.oracle_sql()[name]), __spark_entry__.queries()[name](spark, str(tmp_path))
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(rounded(v) for v in r) for r in df.collect()) == Counter(tuple(rounded(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["folder_rows", "folder_totals"])
def test_empty_documents_are_files_of_the_run(spark, tmp_path, name):
    spark.createDataFrame([(i, "" if i in (1, 5, 6, 8, 9, 12) else f"Text {i} of 10.0.0.{i}") for i in range(16)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "<p>one</p>"), (2, "")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want, df = con.sql(__spark_entry__.oracle_sql()[name]), __spark_entry__.queries()[name](spark, str(tmp_path))
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
