import random
import re

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash
from quillon.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids):
    root = dict(zip(ids, ids, strict=True))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


TEXTS = ["", None, " \t ", "One", "one", "ONE two", "É È", "é È", "a b c", "A\nB\x0bC", "a b c d", "word " * 30_000, "x y z " * 20]


def test_fingerprints_match_the_definition(monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 7)
    rng = random.Random(1)
    texts = TEXTS[:11] + [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in range(1, 60)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(120)] for _ in range(12)]
    texts = list(TEXTS)
    for words in base:
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(120)] = "changed"
            texts.append(" ".join(copy))
    rows = [(1000 - i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    fps = [slow_fingerprint(t) for t in texts]
    ids = [r[0] for r in rows]
    wanted = {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, slow_components(fps, ids), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(docs).collect()} == wanted
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in wanted.values()})


@pytest.mark.parametrize("part", [16, 90])
def test_links_of_hot_blocks_in_many_parts(spark, part):
    rng = random.Random(3)
    fps = {0}
    while len(fps) < 400:  # chains of neighbours share most bits
        f = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 3, 5])):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(distinct, part=part, bucket_rows=100)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") >= 1 for r in edges.collect())
    got = {r.node: r.root for r in connected_components(edges).collect()}
    wanted = slow_components(fps, signed)
    groups = {}
    for f, c in zip(signed, wanted, strict=True):
        groups.setdefault(c, set()).add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in got if got[n] == r) for r in set(got.values())}


def test_index_finds_every_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), (base[:, None] ^ flips ^ flips[:, ::-1]).ravel()]))
    index, root = simhash.GrayIndex(fps, turn=16), np.zeros(1, np.int64)
    found = {tuple(sorted((int(index.fps[i]), int(index.fps[j])))) for a, b in index.links(3, root, root, chunk=512) for i, j in zip(a, b, strict=True)}
    wanted = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(int(a) ^ int(b)).count("1") <= 3}
    assert found == wanted


@pytest.mark.parametrize("sizes", [(1, 2, 16, 17, 300), (3,) * 50])
def test_groups_of_every_size_go_through_their_trees(sizes):
    rng = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    group = np.repeat(np.arange(len(sizes)), sizes)
    fps = base ^ (np.uint64(1) << rng.integers(0, 64, (4, len(group))).astype(np.uint64)).sum(0, dtype=np.uint64)
    index = simhash.GrayIndex(fps, group)
    assert len(index.levels[-1][0]) == len(sizes)
    groups = np.arange(len(sizes))
    found = sorted((int(i), int(j)) for a, b in index.links(3, groups, groups, chunk=600) for i, j in zip(a, b, strict=True))
    wanted = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and bin(int(index.fps[i] ^ index.fps[j])).count("1") <= 3]
    assert found == wanted


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.near_dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    empty = docs.limit(0)
    assert simhash.near_dedup(empty).count() == 0 and simhash.one_per_group(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(200)}
