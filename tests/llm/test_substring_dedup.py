import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import substring_dedup as sd


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def slow(rows, window):
    """By definition: every window against all windows of smaller ids; null is the largest."""
    order = lambda i: (i is None, i if i is not None else 0)
    least = {}
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else text or ""))
    return sorted(out, key=repr)


def made_texts(rng, n, vocabulary, passages):
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(6))]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(w for p in parts for w in p))
    return texts


@pytest.mark.parametrize("window,gram,vocabulary", [(50, 16, 5000), (6, 3, 2), (4, 1, 9)])
def test_matches_brute_force(spark, window, gram, vocabulary):
    rng = random.Random(window * vocabulary)
    vocabulary = [f"w{i}é" if i % 3 else "W" * (i % 20 + 1) for i in range(vocabulary)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(window - 2, 2 * window + 9))] for _ in range(5)]
    texts = made_texts(rng, 60, vocabulary, passages)
    near = texts[3].split()
    for _ in range(6):  # near copies
        copy = list(near)
        if copy:
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[1]] * 4 + [None, "", " \t", "a\x1cb c", "z " * 3 * window, " ".join(passages[0])]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    rows += rows[:3] + [(rows[0][0], texts[5]), (None, texts[4]), (None, texts[4]), (None, "q " * window), (None, "q " * window)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, sha string, first int, own_id int").repartition(3)
    wanted = slow(rows, window)
    found = sd.dedup(docs, window=window, gram=gram)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [r[:4] for r in wanted]
    texts_left = sorted(((r.doc_id, r.text) for r in sd.cleaned(docs, window=window, gram=gram).collect()), key=repr)
    assert texts_left == sorted(((i, t) for i, _, _, _, t in wanted), key=repr)


def test_unique_ids_of_another_type_and_no_rows(spark):
    long = " ".join(map(str, range(120)))
    rows = [("b", long), ("a", "start " + long), ("c", "unlike " * 10)]
    found = sd.dedup(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found.collect()} == {"a": (121, 0), "b": (120, 120), "c": (10, 0)}
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rolling_hashes_depend_on_the_words_alone(monkeypatch):
    rolling = sd.Rolling([b"a bb ccc a bb", b"", b"  bb ccc", b"a bb"])
    assert rolling.counts.tolist() == [5, 0, 2, 2]
    assert len({*rolling.spans(np.array([0, 3, 7]), 2)}) == 1
    assert rolling.spans(np.array([1]), 2) == rolling.spans(np.array([5]), 2) != rolling.spans(np.array([0]), 2)
    assert rolling.spans(np.array([0]), 3) != rolling.spans(np.array([0]), 2)


def test_intervals_are_maximal():
    assert sd.intervals(np.array([7, 0, 1, 30]), np.array([1, 1, 2, 4]), 5) == [(0, 12), (30, 38)]
