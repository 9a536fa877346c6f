import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import privacy as V

QI = ["age_band", "gender", "state"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [("20-30", "F", "MH", d) for d in ("Flu", "Cold", "Flu")] + [("30-40", "M", "DL", d) for d in ("TB", "Flu")]
    return spark.createDataFrame(rows, "age_band string, gender string, state string, disease string")


def test_metrics(people):
    report = V.privacy_report(people, QI, "disease").first()
    assert (report.k, report.l, report.t, report.num_classes, report.min_size, report.max_size, report.avg_size, report.total, report.dm, report.cavg) == (2, 2, 0.3, 2, 2, 3, 2.5, 5, 13.0, 2.6)


def test_enforcement(people):
    assert [V.enforce_l_diversity(people, QI, "disease", n).count() for n in (2, 3)] == [5, 0]
    assert [V.enforce_t_closeness(people, QI, "disease", t).count() for t in (0.31, 0.25, 0.1)] == [5, 3, 0]


def test_nulls_and_empty(spark, people):
    more = people.union(spark.createDataFrame([(None, None, None, None)], people.schema))
    assert V.k_anonymity(more, QI).first().k == 1 and V.l_diversity(more, QI, "disease").first().l == 0
    assert V.enforce_l_diversity(more, QI, "disease").count() == 5
    empty = people.limit(0)
    assert [V.k_anonymity(empty, QI).first().k, V.t_closeness(empty, QI, "disease").first().t, V.cavg(empty, QI).first().cavg] == [0, 0.0, 0.0]
    with pytest.raises(ValueError):
        V.k_anonymity(people, [])


def test_levels(spark):
    row = spark.range(1)
    g = lambda value, h, level: row.select(V.generalise_level(F.lit(value), h, level)).first()[0]
    assert [g("25", "age", i) for i in (0, 1, 2, 3, 9)] == ["25", "20-29", "<50", "*", "*"] and g("old", "age", 1) == "*"
    assert [g("2024-03-12", "dob", i) for i in (1, 2, 3)] == ["2024-03", "2024", "2020s"]
    assert [g("411001", "zip_code", i) for i in (1, 2, 3)] == ["411***", "4*****", "******"] and g("12345", "pin_code", 1) == "123**"


def test_level_search_raises_k(spark):
    df = spark.range(200).select((F.col("id") % 80).alias("age"), (F.lit(400000) + F.col("id")).cast("string").alias("zip_code"))
    levels, k = V.minimum_levels(df, {"age": "age", "zip_code": "zip_code"}, 5)
    assert k >= 5 and levels["zip_code"] >= 1
    _, impossible = V.minimum_levels(df.limit(3), {"age": "age"}, 5)
    assert impossible < 5


def test_noise(spark):
    df = spark.range(20_000).select(F.lit(10).alias("a"), F.lit(10.0).alias("b"), F.lit("x").alias("c"))
    noisy = V.laplace_noise(df, ["a", "b", "c"], epsilon=0.5, seed=3)
    assert noisy.dtypes == df.dtypes
    mean, spread = noisy.agg(F.avg("b"), F.avg(F.abs(F.col("b") - 10))).first()
    assert math.isclose(mean, 10, abs_tol=0.1) and math.isclose(spread, 2.0, rel_tol=0.05)


def test_hipaa(spark):
    kinds = ["PERSON", "EMAIL_ADDRESS", "IN_PHONE", "URL", "IP_ADDRESS", "DATE_TIME", "MRN", "ADDRESS", "IN_PASSPORT", "NRP"]
    got = V.hipaa_coverage(spark.createDataFrame([(k,) for k in kinds], "entity string")).first()
    assert got.covered_count == 9 and got.coverage_pct == 50.0 and len(got.missing) == 9
