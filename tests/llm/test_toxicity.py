import math
import random

import zstandard

from quillon.llm import toxicity

INSULTS = ["numpty", "blockhead", "wretched", "dimwit"]


def corpus(spark, n=700):
    rng = random.Random(1)
    syllables = ["an", "er", "th", "on", "re", "in", "st", "ou", "the", "of"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(60), rng.choice(INSULTS))
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, features string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = [r for r in toxicity.classify(docs, labels).collect() if r.held_out]
    assert len(out) > 100
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in out) / len(out) > 0.95


def slow_score(text, model):
    """The score from the definition, each window compressed by compressors of its own."""

    def size(window, content):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    words = (text or "").lower().split()
    starts = range(0, max(1, len(words) - 5 + 3), 3)
    saved = [size(w, model.ordinary) - size(w, model.toxic + model.ordinary) for w in (" ".join(words[i : i + 5]).encode() for i in starts)]
    saved.sort(reverse=True)
    counts = [sum(v >= cut for v in saved) for cut in model.cuts]
    values = [saved[0], sum(saved[:3]), sum(saved[:8]), *counts, *[c / len(saved) for c in counts], sum(saved) / len(saved)]
    total = model.weights[-1] + sum((v - m) / s * w for v, m, s, w in zip(values, model.mean, model.scale, model.weights, strict=False))
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_scores_match_the_definition(spark):
    docs, labels = corpus(spark, 240)
    model = toxicity.fit(docs, labels)
    assert len(model.cuts) == 2 and 1 <= model.cuts[0] <= model.cuts[1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert all(abs(got[i] - slow_score(texts[i], model)) < 1e-9 for i in list(texts)[:40])


def test_copies_of_a_passage_count_once(spark):
    shared = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"{shared} own{i} x{i} numpty y{i}") for i in range(20)] + [(0, f"z{i} common w{i}") for i in range(20)] + [(1, ""), (0, "")]
    got = {r.word: (r.toxic, r.ordinary) for r in toxicity._word_counts(spark.createDataFrame(rows * 3, "y int, text string")).collect()}
    assert got["p7"] == (1, 0) and got["numpty"] == (20, 0) and got["common"] == (0, 20) and got["own3"] == (1, 0)
    assert got[""][1] == 21 and 2 <= got[""][0] <= 21


def test_windows_cover_every_word():
    for n in range(40):
        words = [f"w{i}" for i in range(n)]
        found = {w for window in toxicity.windows(" ".join(words)) for w in window.decode().split()}
        assert found == set(words)


def test_degenerate_inputs(spark):
    docs, labels = corpus(spark, 80)
    odd = spark.createDataFrame([(None, None, None), (3, "", None), (3, "", None), (4, "w " * 60_000, None)], docs.schema)
    out = toxicity.classify(docs.union(odd), labels).collect()
    assert len(out) == 84 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3 and r.score is not None}) <= 2
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.classify(docs, labels.where("toxic = 1")).collect()} == {1}
