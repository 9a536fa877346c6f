import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm.common import held_out


def corpus(spark, n=600):
    good, bad = "The cat sat on the mat, and then it went home. ", "WIN!! $$$ CLICK!! ### "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 5) + str(i), "score") for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, n, 2)] + [(10**6, 1, 0), (None, 1, 0), (1, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == 600
    assert all(r.predicted == int(i % 3 > 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in out.items())
    share = sum(r.held_out for r in out.values()) / 600
    assert 0.15 < share < 0.35


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(spark)
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_compiled_rules_equal_the_numpy_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    z = np.full(500, model.bias)
    for conditions, weight in model.rules:
        z += weight * np.all([(x[:, "abc".index(n)] > c) == g for n, g, c in conditions], axis=0)
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-z)))) and ((got > 0.5).sum() - y.sum()) < 25
    assert 0 < len(model.rules) < 60


def test_degenerate_inputs(spark):
    docs, labels = corpus(spark, 60)
    odd = spark.createDataFrame([(None, None, None), (3, "", None), (3, "", None), (4, "w " * 100_000, None)], docs.schema)
    out = quality.classify(docs.union(odd), labels).collect()
    assert len(out) == 64 and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(docs.limit(0), labels).count() == 0
    alone = quality.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5]
    one = quality.classify(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.99


def test_each_statistic_is_computed_once_where_the_score_filters(spark):
    docs, labels = corpus(spark)
    model = quality.RuleModel(0.1, [((("upper_share", True, 0.1), ("distinct_words", False, 0.5)), 1.0), ((("upper_share", False, 0.2),), -2.0), ((("distinct_words", True, 0.3),), 0.5)])
    kept = quality.keep(docs, model).select("doc_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1 and plan.count("regexp_count") + plan.count("regexp_extract_all") == 1
    scored = {r.doc_id: r.quality_score for r in quality.with_quality(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s >= 0.7} and 0 < len(scored)


def test_clashing_names(spark):
    docs, labels = corpus(spark, 60)
    clash = docs.selectExpr("*", "1 as __id", "2 as __y", "'k' as __text", "3 as quality_score")
    assert quality.classify(clash, labels).count() == 60
    model = quality.RuleModel(1.0)
    assert quality.keep(clash, model).columns == clash.columns
    assert quality.with_quality(clash, model, "own").columns == [*clash.columns, "own"]
