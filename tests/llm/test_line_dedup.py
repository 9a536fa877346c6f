import random

import numpy as np
import pytest

from quillon.llm import line_dedup


def brute(rows):
    """Kept line numbers by id; ids are unique."""
    lines = sorted((i if i is not None else 1 << 70, k, frozenset(x.split())) for i, t in rows for k, x in enumerate((t or "").split("\n")))
    earlier, kept = [], {}
    for i, k, words in lines:
        gone = bool(words) and any(5 * len(words & w) >= 4 * len(words | w) for w in earlier)
        earlier += [words] if words else []
        if not gone:
            kept.setdefault(i if i < 1 << 70 else None, []).append(k)
    return {i: kept.get(i, []) for i, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    pool = [[rng.choice(words[: rng.choice([8, 60, 400])]) for _ in range(rng.choice([1, 2, 4, 5, 9, 14, 30]))] for _ in range(60)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 7)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line) if rng.random() > 0.1 else "  ")
        rows.append((1000 - i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("part", "bucket", "leaf"), [(2048, 16384, 48), (8, 50, 4)])
def test_matches_brute_force(spark, monkeypatch, part, bucket, leaf):
    monkeypatch.setattr(line_dedup, "LEAF", leaf)
    monkeypatch.setattr(line_dedup.kept_lines, "__defaults__", (part, bucket))
    monkeypatch.setattr(line_dedup, "PART", part)
    rows = [*corpus(part), (2000, None), (2001, ""), (None, "w1 w2 w3\nonly here"), (5, "long " * 40_000 + "\nx y")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, line string").repartition(4)
    wanted = brute(rows)
    out = {r.doc_id: r for r in line_dedup.decisions(docs).collect()}
    assert {i: r.kept_lines for i, r in out.items()} == wanted
    assert all(r.n_lines == len((t or "").split("\n")) and r.n_removed == r.n_lines - len(wanted[i]) for i, t in rows for r in [out[i]])
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts == {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k in wanted[i]) for i, t in rows}


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (1, "x y z"), (2, "a b c\nq r s")]
    out = line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.kept_lines) for r in out) == [(1, 1, [0]), (1, 2, [0, 1]), (1, 2, [0, 1]), (2, 2, [1])]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.decisions(docs).count() == 0 and line_dedup.clean(docs).count() == 0


def test_prefix_length():
    assert [line_dedup.prefix_length(n) for n in (1, 4, 5, 10, 41)] == [1, 1, 2, 3, 9]
    assert line_dedup.prefix_length(np.array([5, 10])).tolist() == [2, 3]


def test_lines_of_unicode_white_space_stay(spark):
    spaces = [chr(c) for c in range(0x11000) if chr(c).isspace() and chr(c) != "\n"]
    rows = [(1, "\n".join(["a b c", *spaces, "".join(spaces), "a b c"])), (2, "​\n x\n　"), (3, " x\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows)
    assert {r.doc_id: r.kept_lines for r in line_dedup.decisions(docs).collect()} == wanted
    assert {r.doc_id: r.text for r in line_dedup.clean(docs).collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k in wanted[i]) for i, t in rows}


def test_words_are_those_of_split():
    import pyarrow as pa

    texts = ["", "a b\n\n c", "\u3000x\u00a0y\x1cz\x85", "\n", "long" * 99 + " \u2003é\u1680 \u205f\u2028q\u202f", "ééé  日本語\n \n"]
    words = line_dedup.Words(pa.array(texts))
    data = "\n".join(texts).encode()
    lines = "\n".join(texts).split("\n")
    assert words.lines_of.tolist() == [len(t.split("\n")) for t in texts]
    found = [data[a : a + n].decode() for a, n in zip(words.starts, words.sizes, strict=True)]
    assert found == [w for x in lines for w in x.split()]
    assert np.diff(np.r_[0, words.ends_at]).tolist() == [len(x.split()) for x in lines]
    assert len(set(words.hashes().tolist())) == len(set(found))


def test_sets_with_a_clash_of_half_hashes_keep_their_size():
    hashes = np.array([5 | 1 << 45, 5 | 1 << 50, 7 | 1 << 55, 5 | 1 << 45, 5 | 1 << 50, 9 | 1 << 56], np.uint64)
    found = line_dedup.line_sets(hashes, np.zeros(6, np.int64), np.array([0, 0, 0, 1, 1, 1]), np.zeros(8, np.uint64))
    assert found["n"].tolist() == [3, 3] and found["line"].tolist() == [0, 1]
    same = line_dedup.line_sets(hashes[[2, 1, 0, 0, 1, 2, 2]], np.zeros(7, np.int64), np.array([0, 0, 0, 3, 3, 3, 3]), np.zeros(8, np.uint64))
    assert all(len(set(same[k].tolist())) == 1 for k in ("n", "set", "other", *line_dedup.BITS))
