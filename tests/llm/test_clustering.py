import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import clustering


def slow(rows, k=40, rounds=5, dim=64):
    """Lloyd's rounds in Python's integers, by definition."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in seeds[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), z) for z, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for z, vs in groups.items():
            centroids[z] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    last = (1 << 63) - 1
    inertia = {z: min(last, sum(min(d, last) for _, y, d in found if y == z)) for _, z, _ in found}
    total = min(last, sum(min(d, last) for _, _, d in found))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, z, min(d, last), inertia[z], total, sha[z]) for i, z, d in found), key=repr)


def got(spark, rows, columns="vec_id long, embedding array<double>", **how):
    docs = spark.createDataFrame(rows, columns).repartition(3)
    out = clustering.cluster(docs, **how)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def blobs(n, dim, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [(i, [float(x) for x in centres[i % 7] + spread * rng.normal(size=dim)]) for i in range(n)]


def test_defined_cases_match_brute_force(spark):
    rows = blobs(110, 64, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # copies, and repeated rows
    rows += [rows[5]] * 5 + [(None, rows[9][1]), (None, None), (7, [0.5] * 63), (8, []), (9, [0.1] * 63 + [None])]
    rows += [(10_001, [0.1] * 63 + [float("nan")]), (10_002, [0.1] * 63 + [float("inf")])]
    clashing = [(*r, "x", 1.0, 2) for r in rows]
    columns = "vec_id long, embedding array<double>, id string, distance double, cluster int"
    assert got(spark, clashing, columns, tree_rows=100) == slow(rows)


@pytest.mark.parametrize("dim,k", [(2, 9)])
def test_ties_and_pruned_nodes_match_brute_force(spark, dim, k):
    """Points of a small grid: many ties and equal centroids; tight groups: whole nodes."""
    rng = random.Random(dim)
    grid = [(i, [rng.randrange(4) / 256 for _ in range(dim)]) for i in range(400)]
    assert got(spark, grid, k=k, dim=dim) == slow(grid, k, 5, dim)
    tight = blobs(400, dim, 4, 0.001)
    assert got(spark, tight, k=k, dim=dim) == slow(tight, k, 5, dim)


@pytest.mark.parametrize("scale", [3e5, 1e305])
def test_wide_components_stay_exact(spark, scale):
    rows = [(i, [x * scale if i % 4 == 0 else x for x in v]) for i, v in blobs(60, 4, 5)]
    assert got(spark, rows, k=6, dim=4) == slow(rows, 6, 5, 4)


def test_few_and_no_vectors(spark):
    rows = blobs(3, 64, 6)
    assert got(spark, rows) == slow(rows)
    assert got(spark, []) == []
    text = [(f"id{i}", v) for i, v in blobs(9, 4, 7)]
    assert got(spark, text, "vec_id string, embedding array<double>", k=3, dim=4) == slow(text, 3, 5, 4)


def test_whole_nodes_are_assigned_without_their_rows():
    rows = np.r_[np.zeros((100, 2), np.int64), np.full((100, 2), 1000)]
    rows[:, 0] += np.arange(200) % 7
    tree, _ = clustering.KdTree.build(rows)
    tree.rows = np.zeros((0, 2), np.int64)  # counts and sums alone must do
    counts, sums = tree.assign(np.array([[0, 0], [1000, 1000]]))
    assert counts.tolist() == [100, 100] and sums.sum(0).tolist() == rows.sum(0).tolist()
