import hashlib
import re
from collections import defaultdict

import pytest

from quillon.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, keep long"
ROWS = [
    (5, "a  b", "x", 1),
    (3, "a\tb", "x", 1),
    (9, "a\x0b\x0c b", None, 1),
    (4, None, "x", None),
    (2, "", "x", 1),
    (7, " ", "x", 1),
    (8, "long " * 50_000, "x", 1),
    (1, "long\n" * 50_000, "x", 1),
    (6, "a b", "x", 1),
    (10, "é", "x", 1),
    (11, "é", "x", 1),
]


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", row[1] or "")].append(row[0])
    return sorted(
        (i, min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest()) for text, ids in groups.items() for i in ids
    )


@pytest.mark.parametrize("width", [32, 1])
def test_matches_brute_force_even_when_digests_collide(spark, width):
    rows = ROWS + [(100 + i, f"text {i % 40}", "x", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, exact_dedup.dedup(docs, digest_bytes=width).collect())) == expected(rows)


def test_small_memtables_and_shards(spark):
    rows = [(i, f"t{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = docs.selectExpr("doc_id id", "unhex(sha2(text, 256)) digest")
    index = exact_dedup.build_index(keyed, memtable_rows=10, shard_rows=60)
    assert sorted((r.keep, r["size"]) for r in index.collect()) == sorted((k, len(range(k, 300, 7))) for k in range(7))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.dedup(docs).collect()
    assert len(out) == 7 and sum(r.kept for r in out) == 4
    assert {r.keep_id for r in out if r.group_size == 3} == {1}
    assert {r.keep_id for r in out if r.group_size == 2} == {None}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a"), (None, "b"), (2, "c"), (2, "d")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup(docs).count() == 0
    assert exact_dedup.keep_first(docs).count() == 0
