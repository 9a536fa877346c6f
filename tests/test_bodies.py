import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import bodies as B
from quillon.operators import summarise as S
from quillon.operators.privacy import k_anonymity_if_known
from quillon.operators.stores import duplicates, history_view

POINTS = ["GMP certificate missing", "Committee approved it", "Applicant to submit data", "note", "HVAC checked", "rest"]


def report(spark, kind, points, **fields):
    names = ["id", "doc_type", "key_points", *fields]
    schema = ", ".join("key_points array<string>" if n == "key_points" else f"{n} string" for n in names)
    docs = spark.createDataFrame([("r", kind, points, *fields.values())], schema)
    return B.report_lines(docs, "id").first().lines


def test_application(spark):
    lines = report(spark, "SUGAM", POINTS, license_no="L1", deficiency_class="Major", summary="one\ntwo", capa=None)
    assert lines[5:7] == ["Document Class     : SUGAM Application Summary", "File / SUGAM Ref   : L1"]
    assert "1    Manufacturing Licence / Form        OK              -" in lines
    assert "2    GMP Compliance Certificate          INCOMPLETE *    GMP certificate missing" in lines
    assert "3    HVAC Qualification Records          REVIEWED        HVAC checked" in lines
    at = lines.index("C.1  Summary of Observations:")
    assert lines[at + 1 : at + 3] == ["     one", "two"]
    assert "  [1] GMP certificate missing" in lines and "  To be determined by reviewing officer." in lines
    assert lines[-4:] == [B.RULE, "RESTRICTED - For CDSCO Internal Use Only", "Prepared under CDSCO Schedule M / MDR 2017 / DPDP Act 2023", B.RULE]


def test_meeting(spark):
    lines = report(spark, "Meeting", POINTS, inspectors="A, B ,C", summary="x" * 400)
    assert "Chairperson        : A" in lines and "CDSCO Moderator    : B" in lines and "    " + "x" * 300 in lines
    at = lines.index("(f) Key Points Presented:")
    assert lines[at + 1 : at + 5] == [f"    * {POINTS[k]}" for k in (0, 3, 4, 5)]
    assert lines[lines.index("(g) Decisions / Recommendations:") + 1] == "    * Committee approved it"
    assert "1    Applicant to submit data                 Applicant            TBD" in lines


@pytest.mark.parametrize(("kind", "line"), [("SUGAM", "  (not extracted)"), ("SAE", "  (see narrative)"), ("Meeting", "(f) Key Points Presented:"), (None, "  None identified.")])
@pytest.mark.parametrize("points", [None, []])
def test_nothing_known(spark, kind, line, points):
    lines = report(spark, kind, points, summary=None)
    assert line in lines and None not in lines and not any("{" in x for x in lines)


def test_few_points_stand_in(spark):
    lines = report(spark, "Meeting", ["p", "q"])
    assert lines.count("    * p") == 2 and "2    q                                        Applicant            TBD" in lines


def greedy(text, width):
    if not text:
        return [""]
    out = []
    while text:
        cut = next((k for k in range(min(width, len(text)), 0, -1) if k == len(text) or text[k] in " \t"), None)
        if cut is None:
            out.append(text[:width])
            text = text[width:]
        else:
            out.append(text[:cut].rstrip(" "))
            text = text[cut:].lstrip(" \t")
    return out


def test_pages(spark):
    rng = random.Random(3)
    lines = [" ".join("w" * rng.choice([1, 3, 9, 40]) for _ in range(rng.randrange(9))) for _ in range(200)] + ["", "x" * 25]
    docs = spark.createDataFrame([("a", lines), ("b", []), ("c", None)], "id string, lines array<string>")
    got = B.pages(docs, "id", width=12).collect()
    want, page, y = [], 1, 15
    for line in (x for text in lines for x in greedy(text, 12)):
        if y > 280:
            page, y = page + 1, 15
        want.append(("a", page, y, line))
        y += 5
    assert [tuple(r) for r in got] == want


def by_lines(text):
    now, out = "general_remarks", {}
    for line in re.split(r"\r\n?|[\x0b\f\n]", text):
        now = next((k for k, p in X.SECTIONS.items() if re.search(p, line)), now)
        out.setdefault(now, []).append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


def test_sections_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["Findings: a", "CAPA - b", "x", "", "Suggestions: c", "y  ", "Deficiency: d\r\nmore", "observation : e"]
    texts = ["", "Findings:", "\n\n", *["\n".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", X.sections(F.col("text")).alias("s"))
    assert {r.id: r.s for r in docs.collect()} == {i: by_lines(t) for i, t in enumerate(texts)}
    long = spark.range(1).select(X.sections(F.repeat(F.lit("Findings: a\nline\n"), 20_000)).alias("s")).first().s
    assert long["observations"].count("\n") == 39_999 and set(long) == {"observations"}


def test_composed_summary_equals_its_parts(spark):
    text = ". ".join(f"Sentence {k} tells of batch {k % 4} and its records" for k in range(20)) + ".\nFindings: labels were late. Records were lost."
    rows = [(1, text, "SAE"), (2, "too short", "SAE"), (3, None, None), (4, "• One two three four five six seven eight nine ten eleven.", None)]
    docs = spark.createDataFrame(rows, "id long, text string, kind string")
    got = {r.id: r for r in S.composed(docs, "id", "text", "kind", 3).collect()}
    assert got[2].error == got[3].error == S.TOO_SHORT and got[2].summary is got[2].sections is None and got[3].doc_type == ""
    made = X.prepared(docs.where("id = 1")).first().prepared
    assert got[1].error is None and got[1].algorithm == "luhn" and got[4].algorithm == "lsa"
    assert got[1].summary == " ".join(S.best_sentences(made, 3, "luhn")) and got[1].sentence_count == 3 and got[1].word_count == len(got[1].summary.split())
    assert got[1].sections == {k: " ".join(S.best_sentences(v, 3, "luhn")) for k, v in by_lines(made).items() if v}
    assert got[4].key_points[0].startswith("One two") and S.composed(docs.limit(0), "id", "text", "kind").count() == 0


def test_runs_of_equal_content(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "b", None, f"t{i}"])) for i in rng.sample(range(-500, 2000), 400)] + [(7000, "hot")]
    seen, want = {}, {}
    for i, text in sorted(rows):
        seen[text] = seen.get(text, 0) + 1
        want[i] = (seen[text] > 1, seen[text])
    got = duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {r.id: (r.duplicate, r.run) for r in got} == want and len(got) == len(rows)


def test_history_lists_a_name_once(spark):
    log = [("h", 3, "b"), ("h", 1, "c"), ("h", 2, "b"), ("h", 9, "c"), ("g", 1, "x")]
    got = {r.file_hash: tuple(r) for r in history_view(spark.createDataFrame(log, "file_hash string, at long, filename string")).collect()}
    assert got == {"h": ("h", 1, 4, ["c", "b"]), "g": ("g", 1, 1, ["x"])}


def test_unknown_quasi_identifiers_skip_the_metric(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "x long, y string")
    assert [tuple(k_anonymity_if_known(rows, q).first()) for q in (["x", "y"], ["x", "z"], [])] == [(2, []), (None, ["z"]), (None, [])]
