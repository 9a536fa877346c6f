import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quillon.functions.spans import resolve
from quillon.operators import detect as D
from quillon.operators import rewrite as W

TEXT = (
    "Patient Ravi Nair (Aadhaar 1234 5678 9012, PAN ABCDE1234F) was admitted on 2024-03-12 at AIIMS Delhi. "
    "Contact +91-9876543210 or r.nair@example.com. Trial ID: IND-12345. File CDSCO/NDD/2024/112."
)


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_narrative_has_ten_spans(spark):
    spans = D.with_spans(frame(spark, TEXT)).first().spans
    assert [s.entity for s in spans] == ["PERSON", "AADHAAR", "PAN", "DATE_TIME", "ORGANIZATION", "LOCATION", "IN_PHONE", "EMAIL_ADDRESS", "DRUG_ID", "CDSCO_FILE"]
    assert all(TEXT[s.start : s.end] == s.text for s in spans)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_policies(spark):
    docs = frame(spark, TEXT, "", None)
    general = W.anonymise(docs, "generalise").orderBy("id").collect()
    assert general[0].anonymised_text == (
        "Patient [PERSON] (Aadhaar [AADHAAR], PAN [PAN]) was admitted on 2024-XX-XX at [ORG] INDIA. "
        "Contact [PHONE] or [CONTACT]. Trial ID: [DRUG_ID]. File [CDSCO_FILE]."
    )
    assert [r.anonymised_text for r in general[1:]] == ["", ""]
    masked = W.anonymise(docs, "mask").orderBy("id").first()
    assert "********4F" in masked.anonymised_text and len(masked.anonymised_text) == len(TEXT)
    two = W.anonymise(docs, "unknown name", key="k").orderBy("id").first()
    assert sorted(k.rsplit("_", 1)[0] for k in two.vault) == ["<CDSCO_FILE", "<DRUG_ID", "<PERSON"]
    assert all(k in two.anonymised_text for k in two.vault)
    want = hmac.new(b"k", b"PERSON:Ravi Nair", hashlib.sha256).hexdigest()[:12]
    assert two.vault[f"<PERSON_{want}>"] == "Ravi Nair"


@pytest.mark.parametrize("key", ["short", "x" * 64, "y" * 100])
def test_hmac_equals_the_library(spark, key):
    got = frame(spark, "é message").select(W.hmac_sha256(key, F.col("text"))).first()[0]
    assert got == hmac.new(key.encode(), "é message".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("host 999.1.1.1 up", ["IP_ADDRESS"]),
        ("MRN: 123456", ["IN_PIN_CODE"]),
        ("MRN:123456", ["MRN"]),
        ("IND IND-12345", ["DRUG_ID"]),
        ("card 4111 1111 1111 1111", ["AADHAAR"]),
        ("K A T U R E", []),
        ("Dr. Amit The Sharma", ["PERSON"]),
        ("Name: The Report", []),
        ("at Max Healthcare and city hospital", ["ORGANIZATION"]),
    ],
)
def test_edge_cases(spark, text, wanted):
    assert [s.entity for s in D.with_spans(frame(spark, text)).first().spans] == wanted


def test_card_leaves_its_end_uncovered_unless_asked(spark):
    from quillon.functions.patterns import REGEX_RULES
    from quillon.functions.spans import find_rules

    df = frame(spark, "card 4111 1111 1111 1111").select(find_rules(F.col("text"), REGEX_RULES).alias("s"))
    plain, covered = df.select(resolve(F.col("s")).alias("a"), resolve(F.col("s"), cover=True).alias("b")).first()
    assert [(s.start, s.end) for s in plain] == [(5, 19)] and [(s.start, s.end) for s in covered] == [(5, 24)]


def test_report_fields_and_round_trip(spark):
    text = "Name: Asha Rao: 52\nDoctor: 12345\nAddress:\n14, MG Road\nFilename: x1\nPatient Meera had fever; phone 9876543210."
    found = D.with_spans(frame(spark, text), report=True)
    got = [(s.entity, s.text) for s in found.first().spans]
    assert ("PERSON", "Asha Rao") in got and ("ADDRESS", "14, MG Road") in got and ("PERSON", "x1") in got and ("PERSON", "12345") not in got
    both = W.rewrite_report(found, True).first()
    assert spark.createDataFrame([(both.processed_text, both.mapping)], "t string, m map<string,string>").select(W.traceback(F.col("t"), F.col("m"))).first()[0] == text
    assert [e.start for e in both.entities] == sorted((e.start for e in both.entities), reverse=True)
    once = W.rewrite_report(found, False).first()
    assert "*" * 12 in once.processed_text and not once.mapping


def test_model_spans(spark):
    kind = "array<struct<start:int,end:int,entity:string,text:string,score:double,ord:int>>"
    rows = [([(0, 30, "LOCATION", "14 MG Road, Camp, Pune 411001", 0.9, 100)],), ([(0, 7, "PERSON", "Patient", 0.9, 100)],), ([(0, 9, "PERSON", "Asha\nRao", 0.9, 100)],), ([(0, 3, "ORGANIZATION", "Foo", 0.9, 100)],)]
    df = spark.createDataFrame(rows, f"s {kind}").select(D.filter_model_spans(D.relabel_locations(F.col("s"))).alias("s"))
    assert [[(x.entity, x.text) for x in r.s] for r in df.collect()] == [[("ADDRESS", "14 MG Road, Camp, Pune 411001")], [], [("PERSON", "Asha")], []]


def test_cells(spark):
    table = spark.createDataFrame([(1, "call 9876543210", None, True), (2, "  ", "x", False)], "id int, a string, b string, c boolean")
    out = W.rewrite_cells(table, ["a", "b", "c"], "mask").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "call **********", None, "true", 1), (2, "  ", "x", "false", 0)]
