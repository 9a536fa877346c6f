"""Reports over whole documents: bodies, pages, composed summaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillon.operators import bodies as B
from quillon.operators import reports as R
from quillon.operators import summarise as S
from quillon.plans.detection import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_KINDS = ["SAE Case", "Meeting Minutes", "SUGAM Application"]


def report_data(spark, sf_dir):
    """A report of each document: its text is the summary, its lines that are not blank are the points."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.get(F.lit(_KINDS), (k % 3).cast("int")).alias("doc_type"), F.concat(F.lit("L"), k.cast("string")).alias("license_no"),
        F.when(k % 2 == 0, F.concat(F.lit("S"), k.cast("string"))).alias("sugam_ref"), F.col("source").alias("firm_name"), F.col("lang").alias("product_category"),
        F.get(F.lit(["", "A. Rao", "A. Rao, B. Sen"]), (k % 4).cast("int")).alias("inspectors"), text.alias("summary"), F.lit("lsa").alias("algorithm"),
        F.get(F.lit(["Critical", "MAJOR issue", ""]), (k % 5).cast("int")).alias("deficiency_class"), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("key_points"),
    )


def _any(words: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _first(item: str) -> str:
    return f"list_filter(ps, lambda q: {_any(item.lower().split(), 'q')})[1]"


def _row(number: int, item: str) -> str:
    f = f"f[{number}]"
    flag = f"CASE WHEN {f} IS NULL THEN 'OK             ' WHEN {_any(R.NEGATIVE, f)} THEN 'INCOMPLETE *   ' ELSE 'REVIEWED       ' END"
    return f"'{number:<4} {item:<35} ' || {flag} || ' ' || coalesce(nullif(substr({f}, 1, 60), ''), '-')"


_STARRED = "list_transform({}, lambda x: '    * ' || x)"
_LISTED = "CASE WHEN len(ps) > 0 THEN list_transform(ps, lambda x: '  ' || x) ELSE ['{}'] END"
_BLOCKS = {
    "checklist": "[" + ", ".join(_row(i + 1, x) for i, x in enumerate(R.CHECKLIST)) + "]",
    "extracted": _LISTED.format("  (not extracted)"), "narrated": _LISTED.format("  (see narrative)"),
    "deficiencies": "CASE WHEN len(short) > 0 THEN list_transform(short, lambda x, i: '  [' || i || '] ' || x) ELSE ['  None identified.'] END",
    "presented": _STARRED.format("(CASE WHEN len(other) > 0 THEN other ELSE ps END)[1:4]"),
    "decided": _STARRED.format("CASE WHEN len(decided) > 0 THEN decided ELSE ps[1:3] END"),
    "register": "list_transform(CASE WHEN len(acted) > 0 THEN acted WHEN len(ps) > 3 THEN ps[4:] ELSE ps END, lambda x, i: i || repeat(' ', greatest(0, 4 - len(i::VARCHAR))) || ' ' || substr(x, 1, 38) || repeat(' ', 40 - len(substr(x, 1, 38))) || ' Applicant            TBD')",
}
_SQL_FIELDS = {
    "rule": f"'{B.RULE}'", "dashes": f"'{B.DASHES}'", "document_class": "['SAE Case Summary', 'Committee Meeting Summary', 'SUGAM Application Summary'][doc_id % 3 + 1]",
    "reference": "ref", "reference_or_na": "ref", "algorithm_upper": "'LSA'", "reviewer": "coalesce(nullif(insp, ''), '___________________')", "duration_or_na": "'N/A'", "hash_or_na": "'N/A'",
    "form": "'Form CT-04 / Form 44 / Form MD-14'", "firm_name": "firm", "product_category": "cat", "inspectors": "insp", "summary": "txt", "license_no": "'L' || doc_id",
    "risk": f"['{B.RULE}'][2]", "permission": "CASE WHEN doc_id % 2 = 0 THEN 'S' || doc_id ELSE 'N/A' END", "narrative": "coalesce(nullif(txt, ''), '(Narrative not provided)')",
    "class_or_pending": "coalesce(cls, 'Pending Review')", "class_or_assessment": "coalesce(cls, 'Pending reviewer assessment')", "capa_or_officer": "'To be determined by reviewing officer.'",
    "committee": "coalesce(nullif(cat, ''), 'SEC / Technical Committee / DTAB')", "venue": "'FDA Bhawan, New Delhi'", "chair": "CASE doc_id % 4 WHEN 1 THEN 'A. Rao' WHEN 2 THEN 'A. Rao' ELSE '___' END",
    "moderator": "CASE doc_id % 4 WHEN 2 THEN 'B. Sen' ELSE '___' END", "background": "coalesce(nullif(substr(txt, 1, 300), ''), '(see full summary below)')", "conclusion_or_pending": f"'{B.PENDING}'",
}
_SQL_FIELDS["risk"] = (
    "CASE doc_id % 5 WHEN 0 THEN 'Risk outweighs benefit pending resolution of critical deficiencies.' WHEN 1 THEN 'Benefit acceptable subject to resolution of major deficiencies within 45 days.' "
    "ELSE 'Benefit-risk profile acceptable based on current inspection findings.' END"
)


def _lines_sql(template: str) -> str:
    def one(line: str) -> str:
        block = re.fullmatch(r"\{\*(\w+)\}", line)
        if block:
            return _BLOCKS[block[1]]
        return "['" + re.sub(r"\{(\w+)\}", lambda m: f"' || {_SQL_FIELDS.get(m[1], repr(''))} || '", line) + "']"

    return "flatten([" + ", ".join(map(one, template.split("\n"))) + "])"


_LINES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS txt, coalesce(source, '') AS firm, coalesce(lang, '') AS cat, CASE doc_id % 4 WHEN 1 THEN 'A. Rao' WHEN 2 THEN 'A. Rao, B. Sen' ELSE '' END AS insp,
CASE WHEN doc_id % 2 = 0 THEN 'S' ELSE 'L' END || doc_id AS ref, CASE doc_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'MAJOR issue' END AS cls FROM documents),
p AS (SELECT *, list_filter(string_split(txt, chr(10)), lambda x: trim(x) <> '') AS ps FROM d),
b AS (SELECT *, [{", ".join(map(_first, R.CHECKLIST))}] AS f, list_filter(ps, lambda x: {_any(R.DEFICIENT, "x")}) AS short, list_filter(ps, lambda x: {_any(R.DECISION, "x")}) AS decided,
list_filter(ps, lambda x: {_any(R.ACTION, "x")}) AS acted, list_filter(ps, lambda x: NOT {_any(R.DECISION + R.ACTION, "x")}) AS other FROM p),
l AS (SELECT doc_id, string_split(array_to_string(flatten([{_lines_sql(B.MASTHEAD)}, CASE doc_id % 3 WHEN 0 THEN {_lines_sql(B.CASE)} WHEN 1 THEN {_lines_sql(B.MEETING)} ELSE {_lines_sql(B.APPLICATION)} END, {_lines_sql(B.FOOTER)}]), chr(10)), chr(10)) AS lines FROM b)"""


@query(f"{_LINES} SELECT doc_id, len(lines)::INT AS n, sha256(array_to_string(lines, chr(10))) AS body FROM l")
def report_bodies(spark, sf_dir):
    lines = B.report_lines(report_data(spark, sf_dir), "doc_id")
    return lines.select("doc_id", F.size("lines").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("body"))


@query(
    rf"""{_LINES}, w AS (SELECT doc_id, flatten(list_transform(lines, lambda x: CASE WHEN x = '' THEN [''] ELSE list_transform(regexp_extract_all(x, '[^\n]{{1,90}}(?:[ \t]+|\z)|[^\n]{{90}}'), lambda y: rtrim(y)) END)) AS ls FROM l),
r AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM w)
SELECT doc_id, (i // 54 + 1)::INT AS page, (15 + 5 * (i % 54))::INT AS y, line FROM r"""
)
def report_pages(spark, sf_dir):
    return B.pages(B.report_lines(report_data(spark, sf_dir), "doc_id"), "doc_id")


@query()
def summary_run(spark, sf_dir):
    kind = F.get(F.lit(_KINDS), (F.col("doc_id") % 3).cast("int"))
    return S.composed(table(spark, sf_dir, "documents").withColumn("kind", kind), "doc_id", "text", "kind")
