"""Scores of sentences: products of the matrix against its decomposition, links as a matrix against sums, texts scored once."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import summarise as S


def _bags(seed, n, words):
    rng = random.Random(seed)
    return [[f"w{rng.randrange(words)}" for _ in range(rng.randrange(0, 12))] for _ in range(n)]


def test_textrank_links_as_matrix(monkeypatch):
    for seed, n in ((1, 9), (2, 40), (3, 300)):
        held = S.textrank(_bags(seed, n, 50))
        monkeypatch.setattr(S, "LINKED", 0)
        assert np.allclose(held, S.textrank(_bags(seed, n, 50)), rtol=0, atol=1e-11)
        monkeypatch.undo()


def test_lsa_without_decomposing_the_matrix(monkeypatch):
    svd, calls = np.linalg.svd, []
    monkeypatch.setattr(S.np.linalg, "svd", lambda *a, **k: calls.append(1) or svd(*a, **k))
    for seed, n, words in ((1, 30, 400), (2, 300, 40)):
        bags = _bags(seed, n, words)
        got = S.lsa(bags)
        assert not calls
        b = S._Bags(bags)
        u, s, _ = svd(b.dense(0, b.n, b.value * np.log((1 + b.n) / (1 + b.df) + 1e-9)[b.word]), full_matrices=False)
        k = max(3, len(s) // 3)
        assert np.allclose(got, np.sqrt((u[:, :k] ** 2) @ (s[:k] ** 2)), rtol=0, atol=1e-6)
    equal = [[f"a{i}"] for i in range(12)]  # topics of one strength: as the decomposition picks them
    S.lsa(equal)
    assert calls


def test_equal_texts_are_scored_once(monkeypatch):
    calls, text = [], " ".join(f"Sentence {w} has words about {w}s." for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    monkeypatch.setitem(S.METHODS, "lsa", lambda bags, f=S.lsa: calls.append(1) or f(bags))
    both = S.best_of_each([text, text + "\n", None], [8, 3, 3], "lsa")
    assert len(calls) == 1 and [len(x) for x in both] == [8, 3, 0] and both[1] == S.best_sentences(text, 3, "lsa")


def test_lines_are_judged_once_for_a_text(spark):
    """A text of many lines of fields: the shares of lines are not counted anew for each line."""
    lines = [f"part {i}, late, major" for i in range(8000)]
    start = time.monotonic()
    got = spark.createDataFrame([("\n".join(lines),)], "text string").select(X.structured_to_sentences(F.col("text")).alias("t")).first().t
    assert got == " ".join(f"part {i}. late. major." for i in range(8000))
    assert time.monotonic() - start < 15
