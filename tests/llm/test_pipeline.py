import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from quillon.llm import sentencepiece_lattice
from tests_llm_tools import near_groups, normal


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    good = [f"word{rng.randrange(900)}" for _ in range(4000)]
    rows = []
    for i in range(300):
        start = rng.randrange(3500)
        text = ". ".join(" ".join(good[start + k : start + k + 8]).capitalize() for k in range(0, 48, 8)) + "."
        if i % 5 == 0:
            text = "CLICK!! $$$ ### WIN!! " * 12 + str(i)
        if i % 17 == 3:
            text = rows[rng.randrange(len(rows))][1].replace(" ", "\t ", 3)
        rows.append((i, text, "en", "hot" if i % 3 == 0 else f"s{i % 7}", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (301, "", "en", "s1", 0)]
    labels = [(i, int(not r[1].startswith("CLICK")), 0) for i, r in enumerate(rows[:300])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL_PATH)
    for (name, stage), tables in zip(corpus_pipeline.STAGES, range(5), strict=True):
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        after = docs.collect()
        if tables < 4:
            assert docs.columns == columns, name
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if tables == 0:
            kept = {r.doc_id for r in after}
            assert all((i in kept) == (not (r.text or "").startswith("CLICK")) for r in before if r.text for i in [r.doc_id])
        elif tables == 1:
            first = {}
            for r in before:
                key = normal(r.text)
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif tables == 2:
            assert sorted(r.doc_id for r in after) == near_groups(before)
        elif tables == 3:
            counts = Counter(r.doc_id for r in after)
            assert len(counts) < len(before) and max(counts.values()) > 1
        else:
            texts = {r.doc_id: r.text or "" for r in before}
            assert len(after) == len(before)
            assert all(r.decoded_equal and r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in after)


def test_run_equals_the_stages_in_turn(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded_equal"] and out.count() > 50
    assert out.where("not decoded_equal").count() == 0
