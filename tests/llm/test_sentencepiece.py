import itertools
import os
import random

import pytest
import sentencepiece

from quillon.llm import sentencepiece_lattice as lattice

MODEL = os.environ.get("PIECE_MODEL", lattice.MODEL_PATH)
TEXTS = [
    "", None, "a  b", "    four spaces", "\tx\n\n\ny ", "日本語 テキスト 😀 é", "http://foo.bar/" + "abc1/" * 40, "x" * 300, " lead", "trail ", "  ",
    "don't ²x ².5 x²y", "ﬁ naïve \x00 nul", "A" * 61 + " " + "ab" * 33, "Plain words, as in any text; twice. Plain words!", "tion " * 20_000,
]


@pytest.fixture(scope="module")
def model():
    return lattice.Model.load(MODEL)


@pytest.mark.parametrize("frequent", [1 << 18, 3, 0])
def test_ids_equal_the_library_and_decode_exactly(spark, model, frequent):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[:4])] + [(None, "no id here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string").repartition(3)
    coded = lattice.decode(lattice.encode(docs, model, frequent=frequent), model)
    again = lattice.encode(docs, model, frequent=frequent, decoded_col="decoded")
    assert sorted(map(str, again.collect())) == sorted(map(str, coded.collect()))
    assert coded.columns == ["doc_id", "text", "unit", "ids", "decoded"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = coded.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == library.encode(r.text or "") and r["decoded"] == (r.text or "")


def test_unit_of_any_length_encodes_alike(model):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    for n in (1, 2, 30, 59, 60, 61, 500):
        unit = "".join(rng.choice("abcdeiou") for _ in range(n))
        assert model.encode_unit(lattice.SPACE + unit) == library.encode(unit)


def toy(unigram):
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "aa"]
    scores = [0.0, -2.5, -3.0, -3.1, -3.3, -4.0, -3.7, -5.9, -3.9, -4.2, -6.1, -4.9]
    return lattice.Model(tuple(pieces), tuple(scores), (2, *[1] * 11), unigram)


def best_score(model, unit):
    miss, best = min(model.scores) - 10, None
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(unit)]
        parts = [unit[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(p in model.table or len(p) == 1 for p in parts):
            score = sum(model.table[p][1] if p in model.table else miss for p in parts)
            best = score if best is None else max(best, score)
    return best


def test_viterbi_fold_reaches_the_best_score(spark):
    model = toy(True)
    units = [("▁" + "".join(u), 1) for n in (1, 2, 3, 5) for u in itertools.product("abcx", repeat=n)][::3]
    got = lattice.encode_units(spark.createDataFrame(units, "unit string, n long"), model).collect()
    assert len(got) == len(units)
    miss = min(model.scores) - 10
    for r in got:
        assert abs(sum(model.scores[i] if i else miss for i in r.ids) - best_score(model, r.unit)) < 1e-9
        assert len(r.ids) >= 1


def test_merge_fold_equals_the_heap(spark):
    model = toy(False)
    units = [("▁" + "".join(u), 1) for n in (1, 2, 3, 6) for u in itertools.product("abc", repeat=n)]
    for r in lattice.encode_units(spark.createDataFrame(units, "unit string, n long"), model).collect():
        assert r.ids == model.encode_unit(r.unit)


def test_candidates_are_those_that_can_be_pieces(spark, model):
    units = ["▁transformations", "▁qzxqzxqzxq", "▁", "é", "日本語", "aa", "▁the"]
    rows = lattice.candidates(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), model).collect()
    got = {(r.unit, r.s, r.l) for r in rows}
    every = {(u, s, n) for u in units for s in range(len(u)) for n in range(1, len(u) - s + 1) if n <= model.longest}
    assert len(got) == len(rows) and got - {(u, 0, 0) for u in units} <= every and {(u, 0, 0) for u in units} <= got
    assert {(u, s, n) for u, s, n in every if u[s : s + n] in model.table} <= got
    assert len(rows) < 0.6 * len(every)


def test_empty_table(spark, model):
    assert lattice.encode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_clashing_names(spark, model):
    docs = spark.createDataFrame([(1, "a  b", 7, "k", "r", "p")], "doc_id long, text string, key long, c0 string, rare string, packed string")
    out = lattice.encode(docs, model, equal_col="same").first()
    assert out.asDict() == {"doc_id": 1, "key": 7, "c0": "k", "rare": "r", "packed": "p", "ids": out.ids, "same": True}
    with pytest.raises(ValueError):
        lattice.encode(docs.withColumn("ids", docs.key), model)


def test_known_units_are_found_by_themselves(monkeypatch):
    import numpy as np
    import pyarrow as pa

    for weak in (False, True):
        if weak:  # all hashes collide
            monkeypatch.setattr(lattice, "_hashes", lambda units: np.zeros(len(units), np.uint64))
        known = lattice._Known.of(pa.array(["a", "bb", "c" * 40]), pa.array([[1], [2, 3], [4]], pa.list_(pa.int32())))
        at = known.find(pa.array(["bb", "x", "c" * 40, "a", ""]))
        assert [known.ids[known.starts[k] : known.starts[k] + known.sizes[k]].tolist() if k >= 0 else None for k in at] == [[2, 3], None, [4], [1], None]
    assert lattice._Known.of(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))).find(pa.array(["a"])).tolist() == [-1]


def test_words_are_cut_as_by_the_pattern(model):
    import re

    import pyarrow as pa

    words = ["the", "end.", "end..", ".", "x1,", "naïve?", "²x", "a.\nB", "日本語", "😀!", "don't", "a_b", "é", "\n", "12"]
    for pattern in (model.unit_pattern, rf"{lattice.SPACE}*[^{lattice.SPACE}]+|{lattice.SPACE}+", r"(?s:.+)"):
        find = re.compile(pattern).findall
        units, sizes = lattice._units_of(pa.array(words), find)
        assert units.to_pylist() == [u for w in words for u in find(lattice.SPACE + w)] and sizes.tolist() == [len(find(lattice.SPACE + w)) for w in words]
    units, sizes = lattice._units_of(pa.array([], pa.string()), re.compile(model.unit_pattern).findall)
    assert len(units) == len(sizes) == 0


def test_units_of_one_batch_keep_other_columns(spark, model):
    rows = [(u, [i, i + 1]) for i, u in enumerate(["▁the", "é", "😀", "▁" + "ab" * 40, "▁qzx", "a" * 60, "a" * 61])]
    got = lattice.encode_units(spark.createDataFrame(rows, "unit string, keys array<long>"), model).collect()
    assert sorted((r.unit, r["keys"], r.ids) for r in got) == sorted((u, k, model.encode_unit(u)) for u, k in rows)


def test_folds_take_all_units_of_a_batch_at_once():
    import numpy as np
    import pyarrow as pa

    for unigram in (False, True):
        model = toy(unigram)
        units = ["▁" + "".join(u) for n in (1, 2, 4) for u in itertools.product("abcx", repeat=n)]
        edges = [(k, s, n, model.table[u[s : s + n]][0]) for k, u in enumerate(units) for s in range(len(u)) for n in range(1, len(u) - s + 1) if u[s : s + n] in model.table]
        got = lattice.folded(model, pa.array(units), *np.array(edges).T).to_pylist()
        if not unigram:
            assert got == [model.encode_unit(u) for u in units]
        miss = min(model.scores) - 10
        for u, ids in zip(units, got, strict=True):
            assert not unigram or abs(sum(model.scores[i] if i else miss for i in ids) - best_score(model, u)) < 1e-9


def test_each_rare_unit_is_encoded_once_and_no_table_of_all_encodings_is_kept(spark, model, monkeypatch):
    shapes, own = [], lattice.encode_units
    monkeypatch.setattr(lattice, "encode_units", lambda units, model: shapes.append(units.columns) or own(units, model))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "two three", "two"])], "doc_id long, text string")
    assert len(lattice.encode(docs, model, frequent=1).collect()) == 3
    assert shapes == [["unit"], ["unit", "keys"]]
