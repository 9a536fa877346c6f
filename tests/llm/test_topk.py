import math

import numpy as np
import pytest

from quillon.llm import topk

SCHEMA = "vec_id long, embedding array<float>, v string, dim int"


def brute(rows, k=10, step=100):
    out = []
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in good:
        if q is not None and q % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(set(out))


@pytest.mark.parametrize(("block", "group"), [(4096, 1024), (50, 2)])
def test_matches_brute_force_with_ties_and_bad_vectors(spark, block, group):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), "c", 1) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8, "c", 1) for i in range(40)]  # ties
    rows += [(700, [0.0] * 8, "c", 1), (800, None, "c", 1), (801, [1.0] * 7 + [None], "c", 1), (900, [float("nan")] + [1.0] * 7, "c", 1), (901, [float("inf")] * 8, "c", 1), (902, [], "c", 1), (1100, [1.0, 2.0], "c", 1), (903, [3.0, 4.0], "c", 1)]
    out = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), vector_block=block, query_block=group)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_stops_early_on_skewed_lists():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (5000, 4))
    rows[:20] += 2000
    lists = topk.SortedLists(rows, np.arange(5000))
    best, scores, scored = lists.top((np.array([3, 2, 1, 4]), 0), 10)
    wanted = sorted(((-int(r @ np.array([3, 2, 1, 4])), i) for i, r in enumerate(rows) if i != 0))[:10]
    assert [(-s, i) for s, i in zip(scores, best, strict=True)] == wanted and scored < 500


def test_large_components_are_exact():
    rows = np.array([[1 << 40, -(1 << 20)], [3, 1 << 22]])
    assert topk._dot(rows, np.array([1 << 20, 5])).tolist() == [(1 << 60) - 5 * (1 << 20), (3 << 20) + 5 * (1 << 22)]


def test_scores_beyond_a_long_are_bounded(spark):
    most = (1 << 63) - 1
    rows = [(0, [1e15, 0.0], "c", 1), (1, [1e15, 1.0], "c", 1), (2, [-1e15, 1.0], "c", 1), (3, [0.0, 1.0], "c", 1)]
    out = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, most), (3, 0), (2, -most)]


def test_few_rows_repeated_rows_and_empty_table(spark):
    rows = [(0, [1.0], "c", 1), (0, [1.0], "c", 1), (1, [2.0], "c", 1), (1, [2.0], "c", 1), (None, [2.0], "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(map(tuple, topk.top_k(df).collect()), key=str)
    assert out == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 1, 2 * 1024 * 1024), (0, 3, None, 2 * 1024 * 1024)]
    assert topk.top_k(df.limit(0)).count() == 0
