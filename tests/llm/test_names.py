"""Columns of the input may have the names that operators use for their own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import exact_dedup, line_dedup, mixing, quality, queries, simhash

NAMES = "__id __own __sha __doc __tie __kept __d __t __lines __blank __text __y __h __draw __src __cdf __rate __copies __copy __shuffle_key n_copies copy_index shuffle_key fp first root count keep size c0 c1 __chars __passed chars held_out score".split()
WORDS = "one two three four five six seven eight nine ten".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{WORDS[i % 3]} alpha beta gamma delta\nline of {WORDS[i % 10]}", "en", f"s{i % 2}") for i in range(20)] + [(None, None, None, None), (5, "", "en", "s1"), (5, "", "en", "s1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return frame.select("*", *[F.concat(F.lit(f"own {n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


STAGES = {
    "exact": lambda d: exact_dedup.keep_first(d),
    "near": lambda d: simhash.one_per_group(d),
    "lines": lambda d: line_dedup.clean(d),
    "quality": lambda d: quality.keep(d, quality.RuleModel(-1.0, [((("chars", True, 40.0), ("word_length", True, 1.0)), 2.5), ((("chars", True, 10.0),), 0.5)])),
    "mixing": lambda d: mixing.mix(d).select(*d.columns),
}


@pytest.mark.parametrize("name", STAGES)
def test_all_columns_stay(docs, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[n] == f"own {n} {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    key = lambda r: (r.doc_id, r.text, r.source)
    assert Counter(map(key, rows)) == Counter(map(key, STAGES[name](plain(docs)).collect())) and rows
    assert STAGES[name](docs.limit(0)).count() == 0


def test_queries(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mixed = queries.op9_mixing(spark, str(tmp_path))
    assert mixed.columns == [*docs.columns, "n_copies_", "copy_index_", "shuffle_key_"]
    assert all(r.n_copies == f"own n_copies {r.doc_id}" and 0 <= r.copy_index_ < r.n_copies_ for r in mixed.where("doc_id is not null").collect())
    pages = spark.createDataFrame([(1, "u", "<p>hi</p>", "USER", "USER")], "page_id long, url string, html string, __text string, text string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op1_html(spark, str(tmp_path)).collect() == [(1, "u", "hi", 2)]


def test_pipeline(spark, docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, frame in (("clash", docs), ("empty", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        stage_docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, stage_docs, f"{tmp_path}/{name}").columns == docs.columns
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").where("not decoded_equal").count() == 0
