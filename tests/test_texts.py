import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import contracts as C
from quillon.operators import summarise as S
from quillon.sources import ingest as I


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_prepare(spark):
    raw = "<b>GMP</b> audit.The  QA team--fine\n\n\n\nﬁne line."
    docs = spark.createDataFrame([(raw,), ("  ",), (None,)], "text string")
    got = [r.prepared for r in X.prepared(docs).collect()]
    assert got[1:] == ["", ""] and got[0] == "Good Manufacturing Practice audit. The Quality Assurance team—fine\n\nfine line."


def test_sections(spark):
    got = one(spark, X.sections, "intro\nFindings: a\nb\nNon-compliance: c\nCAPA - d\nSuggestions: e")
    assert got == {"general_remarks": "intro", "observations": "Findings: a\nb", "deficiencies": "Non-compliance: c", "capa": "CAPA - d", "recommendations": "Suggestions: e"}


def test_ocr_cleanup(spark):
    assert one(spark, X.ocr_cleanup, "ab-\ncd  is|here .Next\n\n\n\nline “q”") == "ab- cd isIhere. Next\n\nline \"q\""
    assert one(spark, X.ocr_cleanup, " \n ") == ""


@pytest.mark.parametrize("method", sorted(S.METHODS))
def test_summaries_keep_order_and_length(method):
    rng = random.Random(1)
    sentences = [" ".join(rng.choice(["audit", "batch", "label", "risk", "trial", "the"]) for _ in range(8)) + f" s{i}." for i in range(900)]
    best = S.best_sentences(" ".join(sentences), 8, method)
    at = [sentences.index(b) for b in best]
    assert len(best) == 8 and at == sorted(at)
    assert S.best_sentences("One. Two.", 8, method) == ["One.", "Two."] and S.best_sentences(None, 8, method) == []


@pytest.mark.parametrize("method", sorted(S.METHODS))
def test_long_texts_are_scored_as_a_whole(method):
    """Sentences beyond the first 3,200 that are best by far; each run of 400 used to get one sentence."""
    plain = ["The of and."] * 3600
    best = [f"{'risk audit batch ' * 4}{chr(97 + i) * 7}." for i in range(8)]
    assert S.best_sentences(" ".join(plain[:3400] + best + plain[3400:]), 8, method) == best


def test_graph_scores_match_dense_matrices():
    rng = random.Random(3)
    bags = [[rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.choice([0, 1, 1, 2, 5, 9]))] for _ in range(700)]
    names = sorted({w for b in bags for w in b})
    m = np.array([[b.count(w) for w in names] for b in bags], float)

    def power(links):
        n, sums = len(links), links.sum(1, keepdims=True)
        moves, rank = np.divide(links, sums, out=np.full_like(links, 1 / n), where=sums > 0), np.full(n, 1 / n)
        for _ in range(200):
            rank = 0.15 / n + 0.85 * (moves.T @ rank)
        return rank

    w = m * (np.log(len(m) / np.maximum(1, (m > 0).sum(0))) + 1)
    norm = np.linalg.norm(w, axis=1)
    cosine = (w @ w.T) / np.maximum(norm[:, None] * norm[None], 1e-12)
    assert np.allclose(S.lexrank(bags), power((cosine > 0.1).astype(float)), atol=1e-8)
    size = np.log(np.maximum((m > 0).sum(1), 1))
    links = (m > 0).astype(float) @ (m > 0).T / np.maximum(size[:, None] + size[None], 1e-9)
    np.fill_diagonal(links, 0)
    assert np.allclose(S.textrank(bags), power(links), atol=1e-8)


def test_files_and_isolated_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.html").write_text("<script>x</script><p>Hi</p>")
    (tmp_path / "c.json").write_text('[{"a": 1, "b": {"c": [2]}}]')
    (tmp_path / "d.csv").write_text("x;y\n1;2\n")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "f.docx").write_bytes(book.getvalue())
    got = {r.source.rsplit("/", 1)[1]: r for r in I.read_files(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in got.items()} == {"a.txt": "café", "b.html": "Hi", "c.json": "0.a: 1\n0.b.c.0: 2", "d.csv": "x | y\n1 | 2", "e.pdf": "", "f.docx": "para\n1 | 2"}
    assert got["e.pdf"].source_type == "unknown" and "pdf" in got["e.pdf"].error and got["d.csv"].structured == [{"x": "1", "y": "2"}]
    with pytest.raises(ValueError):
        I.read_files(spark, str(tmp_path), "nonsense")
    assert I.read_csv(spark, str(tmp_path / "d.csv")).columns == ["x", "y"]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    texts = [" ".join(base)] * 3 + [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in (0, 1, 30, 58, 59)] + ["a b", "a b", "", None]
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(50)) for _ in range(20)]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    got = {r.id: r for r in C.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    for i, s in enumerate(sets):
        assert got[i].class_id == min(j for j, o in enumerate(sets) if o == s)
        assert got[i].links == len({frozenset(o) for o in sets if o != s and s and len(s & o) / len(s | o) >= 0.8})


def test_near_duplicates_send_sets_once(spark):
    """Many near copies: a set goes to a cell once, not once for each pair, and a pair is met in few places."""
    base = [f"w{i}" for i in range(500)]
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(0, 500, 2)]
    texts += [" ".join(f"d{j}x{i}" for i in range(200)) for j in range(40)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        every = store.executorList(True)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = C.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.links for r in rows if r.id < 250} == {249} and {r.links for r in rows if r.id >= 250} == {0}
    assert written() - before < 8_000_000


def test_stream(spark, tmp_path):
    from quillon.streaming import documents as D

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Patient Asha Rao was seen", 5), (2, "IND-12345", 6), (3, "IND-12345 again", 9)], "doc_id long, text string, at long").repartition(2).write.parquet(src)
    stream = D.read_documents(spark, src, "doc_id long, text string, at long", 1)
    D.start_vault(stream, str(tmp_path / "vault"), str(tmp_path / "cp"), "at", key="k").awaitTermination(120)
    rows = {r.value: r.written for r in D.current_version(spark, str(tmp_path / "vault")).collect()}
    assert rows == {"Asha Rao": 5, "IND-12345": 9}
