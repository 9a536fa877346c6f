import math

from pyspark.sql import functions as F

from quillon.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate string, cdf int"


def docs(spark, n=3000):
    rows = [(i, "x" * (10 + i % 7), "hot" if i % 3 else f"s{i % 4}", "r", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_expected_shares_follow_the_weights(spark):
    d = docs(spark)
    mixed = mixing.mix(d, weights={"hot": 1.0, "s0": 2.0, "s1": 1.0, "s2": 0.0, "s3": 4.0})
    assert mixed.columns[: len(d.columns)] == d.columns
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(got.values())
    assert "s2" not in got
    for source, share in (("hot", 1 / 8), ("s0", 2 / 8), ("s3", 4 / 8)):
        assert math.isclose(got[source] / total, share, rel_tol=0.15)
    again = mixing.mix(d.repartition(7), weights={"hot": 1.0, "s0": 2.0, "s1": 1.0, "s2": 0.0, "s3": 4.0})
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixed.collect()), key=str)


def test_counts_are_poisson_even_for_high_rates(spark):
    d = docs(spark, 2000).withColumn("source", F.lit("only"))
    counts = [r.c for r in mixing.mix(d, budget=900 * 13 * 2000.0).groupBy("doc_id").agg(F.count("*").alias("c")).collect()]
    mean = sum(counts) / len(counts)
    var = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert math.isclose(mean, 900 * 13 * 2000 / sum(10 + i % 7 for i in range(2000)), rel_tol=0.01) and math.isclose(var, mean, rel_tol=0.15)


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (None, "a", None, None, None), (1, "", "z", None, None), (1, "", "z", None, None), (2, "long " * 90_000, "z", None, None)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len([r for r in mixed if r.doc_id == 1]) % 2 == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    only_empty = spark.createDataFrame([(i, "", "e", None, None) for i in range(300)], SCHEMA)
    assert 200 < mixing.mix(only_empty).count() < 400


def test_without_broadcast(spark, monkeypatch):
    d = docs(spark, 300)
    wanted = sorted(map(tuple, mixing.mix(d).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, mixing.mix(d).collect()), key=str) == wanted


def test_clashing_names(spark):
    d = docs(spark, 200)
    plain = mixing.mix(d)
    clash = d.withColumns({c: F.lit(7) for c in ("__draw", "__SRC", "__cdf", "__rate", "__copies", "__copy", "__shuffle_key")})
    mixed = mixing.mix(clash)
    assert mixed.columns == [*clash.columns, "__copies_", "__copy_", "__shuffle_key_"]
    rows = lambda df: sorted(map(tuple, df.select(*d.columns).collect()), key=str)
    assert rows(mixed) == rows(plain)
    assert {(r["__draw"], r["__rate"], r["__copies"]) for r in mixed.collect()} == {(7, 7, 7)}
