import datetime
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import pii


def luhn_ok(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(iban):
    t = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


VALID = {
    "4111 1111 1111 1111": (r"\d{4} \d{4} \d{4} \d{4}", luhn_ok),
    "4111111111111111": (r"\d{16}", luhn_ok),
    "3782-822463-10005": (r"\d{4}-\d{6}-\d{5}", luhn_ok),
    "DE89370400440532013000": (r"DE\d{20}", iban_ok),
    "GB82 WEST 1234 5698 7654 32": (r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", iban_ok),
    "123-45-6789": (r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", lambda s: True),
    "+1 (017) 555-7713": (r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda s: True),
    "212-555-0198": (r"\d{3}-\d{3}-\d{4}", lambda s: True),
    "10.0.0.1": (r"\d+\.\d+\.\d+\.\d+", lambda s: all(int(x) < 256 for x in s.split("."))),
    "2024-02-29": (r"20\d\d-\d\d-\d\d", datetime.date.fromisoformat),
    "31/12/1999": (r"\d\d/\d\d/19\d\d", lambda s: datetime.datetime.strptime(s, "%d/%m/%Y")),
    "02/29/2024": (r"\d\d/\d\d/20\d\d", lambda s: datetime.datetime.strptime(s, "%m/%d/%Y")),
    "1.2.24": (r"\d+\.\d+\.\d\d", lambda s: datetime.datetime.strptime(s, "%d.%m.%y")),
    "12 Mar 2024": (r"\d\d [A-Z][a-z]{2} 20\d\d", lambda s: datetime.datetime.strptime(s, "%d %b %Y")),
    "March 5, 2024": (r"[A-Z][a-z]+ \d+, 20\d\d", lambda s: datetime.datetime.strptime(s, "%B %d, %Y")),
    "jo.smith42@mail.example.com": (r"[a-z]{2}\.[a-z]{5}\d\d@mail\.example\.com", lambda s: True),
}
INVALID = ["4111111111111112", "999.1.1.1", "666-12-1234", "30/02/2024", "2024-13-01", "DE88370400440532013000", "12 34", "v1.2.3.4.5", "A4111111111111111", "no @ here", "0000000000000000"]


def rewrite(spark, texts, key=pii.DEMO_KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in pii.rewritten(df, key).collect()}


def test_valid_values_change_within_their_format_and_stay_linked(spark):
    values = list(VALID)
    out = rewrite(spark, [f"x {v}, y" for v in values] + [f"Other ({v}) and again {v}." for v in values])
    for i, value in enumerate(values):
        shape, check = VALID[value]
        new = out[i].text[2:-3]
        assert out[i].n_replaced == 1 and new != value and re.fullmatch(shape, new) and check(new), (value, new)
        assert out[len(values) + i].text == f"Other ({new}) and again {new}."
    assert out[0].text[2:-3].replace(" ", "") == out[1].text[2:-3]  # one number, two spellings
    other = rewrite(spark, [f"x {v}, y" for v in values], "another key")
    assert sum(other[i].text != out[i].text for i in range(len(values))) == len(values)


def test_invalid_values_and_clean_texts_stay(spark):
    texts = [f"see {v} ok" for v in INVALID] + ["plain text\n\twith  spaces ", ""]
    out = rewrite(spark, texts)
    assert [out[i].text for i in range(len(texts))] == texts and all(r.n_replaced == 0 for r in out.values())


@pytest.mark.parametrize(("n1", "n2"), [(5, 7), (12, 1), (9, 30)])
def test_pairs_are_permuted(spark, n1, n2):
    df = spark.range(n1 * n2).select(pii.feistel_pair(F.floor(F.col("id") / n2), F.col("id") % n2, n1, n2, "k", "t").alias("p"))
    got = {(r.p.a, r.p.b) for r in df.collect()}
    assert got == {(a, b) for a in range(n1) for b in range(n2)}


def test_texts_are_permuted(spark):
    df = spark.range(1000).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("t"))
    assert {r.t for r in df.collect()} == {f"{i:03d}" for i in range(1000)}


def test_all_dates_of_a_century_are_permuted(spark):
    days = spark.range(36525).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    new = days.select(pii._moved_day(F.year("d"), F.month("d"), F.day("d"), "k").alias("n"))
    assert new.distinct().count() == 36525 and new.where("year(n) between 2000 and 2099").count() == 36525


def test_other_columns_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, None, "k", 2), (None, "10.0.0.1 " * 500 + "w " * 50_000, "k", 2), (3, "a", "k", 2), (3, "a", "k", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, found int")
    out = pii.pseudonymise(df)
    assert out.columns == [*df.columns, "__kinds"]
    got = out.collect()
    assert len(got) == 4 and {len(r["__kinds"]) for r in got} == {0, 500} and {r.text for r in got if r.doc_id == 1} == {""}
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@example.org", 5, "k")], "doc_id long, text string, __found int, __KINDS string")
    row = pii.pseudonymise(df).first().asDict()
    assert list(row) == [*df.columns, "__kinds_"]
    assert (row["__found"], row["__KINDS"], row["__kinds_"]) == (5, "k", ["email"]) and "a@example.org" not in row["text"]
