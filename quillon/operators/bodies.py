"""Report bodies as ordered lines, and lines dealt over pages.

A template is plain text: ``{name}`` stands for a field, and a line ``{*name}`` for a block of
as many lines as the report has.  Templates are compiled to array expressions, so that the
reports of a table are one narrow stage and their pages an explode without a shuffle.

Defined cases: a null field counts as empty, and an empty one takes the text that stands in
for it; without points a block has its line for that case; lines of fields that hold
several lines are taken apart; a blank line takes a place on its page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.spans import let
from quillon.functions.text import strip
from quillon.operators import reports as R

FIELDS = (
    "doc_type sugam_ref license_no form_type firm_name firm_address product_category inspection_type inspection_date inspectors summary deficiency_class "
    "capa conclusion division algorithm confidence input_modality audio_duration source_hash generated_at tool"
).split()

# Texts of the reports.
RULE, DASHES = "=" * 60, "-" * 80
PENDING = "Based on the above, the matter is submitted for kind consideration and orders of the reviewing officer."
CLASSES = {"application": "SUGAM Application Summary", "case": "SAE Case Summary", "meeting": "Committee Meeting Summary"}
MASTHEAD = """\
GOVERNMENT OF INDIA
MINISTRY OF HEALTH & FAMILY WELFARE
CENTRAL DRUGS STANDARD CONTROL ORGANISATION (CDSCO)
FDA Bhawan, Kotla Road, New Delhi - 110002

Document Class     : {document_class}
File / SUGAM Ref   : {reference_or_na}
Division           : {division}
Prepared by (AI)   : {tool} | Algo: {algorithm_upper}
Human Reviewer     : {reviewer} | Date: {inspection_date}
Confidence Score   : {confidence}  (fields below 0.7 flagged)
Classification     : RESTRICTED - For CDSCO Internal Use Only

SOURCE PROVENANCE
{rule}
Input Modality     : {input_modality}
Audio Duration     : {duration_or_na}
ASR Engine         : Vosk vosk-model-en-in-0.5 (offline)
File Hash (SHA-256): {hash_or_na}
{rule}
"""
APPLICATION = """\
PART A - APPLICATION IDENTIFICATION
{rule}
A.1  SUGAM Application No.   : {reference}
A.2  Form Type / Rule         : {form}
A.3  Applicant / Sponsor      : {firm_name}
A.4  Registered Address       : {firm_address}
A.5  Product / Drug / Device  : {product_category}
A.6  Category                 : {product_category}
A.7  Inspection Type          : {inspection_type}
A.8  Date of Submission       : {inspection_date}
A.9  Officers / Reviewers     : {inspectors}

PART B - CHECKLIST COMPLIANCE MATRIX
{rule}
Sl.  Checklist Item                      Status          Finding
{dashes}
{*checklist}

PART C - TECHNICAL PARTICULARS
{rule}
C.1  Summary of Observations:
     {summary}

C.2  Key Extracted Findings:
{*extracted}

C.3  Risk-Benefit One-liner   : {risk}

PART D - DEFICIENCIES & QUERIES
{rule}
D.1  Deficiency Classification: {class_or_pending}

D.2  Deficiencies Identified:
{*deficiencies}

D.3  CAPA / Draft Query Letter Points:
  {capa_or_officer}

PART E - RECOMMENDATION (FOR HUMAN REVIEWER ONLY)
{rule}
  [ ] Accept for further processing
  [ ] Raise Query to Applicant
  [ ] Refer to SEC
  [ ] Reject with reasons
  [ ] Refer to CDL/CDTL for testing
  [ ] Escalate to Jt. DC / DCG(I)

Reviewer Signature: _______________  Date: _______________
Dy. Drugs Controller: _____________  Jt. Drugs Controller: _______________"""
CASE = """\
SECTION I - REPORT METADATA & TIMELINE COMPLIANCE
{rule}
I.1  SAE Report No.            : {license_no}
I.2  Report Type               : [ ] Initial  [ ] Follow-up
I.3  Date of Event             : {inspection_date}
I.4  Sponsor / CRO / Site / PI : {firm_name}
I.5  Institution               : {firm_address}
I.6  Reporting Officer         : {inspectors}
I.7  Timeline Compliance       : [ ] Within 14 calendar days  [ ] DELAYED
I.8  Protocol / CT Permission  : {permission}

SECTION II - SUBJECT PROFILE
{rule}
II.1  Subject Code / Initials  : (anonymised per DPDP Act 2023)
II.2  Age / Sex / Ethnicity    : (extracted from narrative)
II.3  Relevant Medical History : (see Section IV narrative)
II.4  Concomitant Medications  : (see Section IV narrative)

SECTION III - INVESTIGATIONAL PRODUCT EXPOSURE
{rule}
III.1 IP / Drug Name           : {product_category}
III.2 Dose / Route / Regimen   : (extracted from narrative)
III.3 Blinding Status          : [ ] Blinded  [ ] Unblinded
III.4 Time-to-Onset from Dose  : (extracted from narrative)

SECTION IV - SAE CLINICAL NARRATIVE
{rule}
{narrative}

SECTION V - SERIOUSNESS CRITERIA (Schedule Y)
{rule}
  [ ] Death                    [ ] Life-threatening
  [ ] Hospitalisation          [ ] Persistent disability
  [ ] Congenital anomaly        [ ] Other medically important
  AI-extracted indication: {class_or_assessment}

SECTION VI - CAUSALITY ASSESSMENT
{rule}
  VI.1 Investigator Opinion    : [ ] Certain  [ ] Probable  [ ] Possible  [ ] Unlikely
  VI.2 Sponsor Medical Monitor : _______________
  VI.3 Ethics Committee View   : _______________
  VI.4 WHO-UMC Category       : (reviewer to assign)
  VI.5 Expectedness vs IB      : [ ] Expected  [ ] Unexpected

SECTION VII - COMPENSATION (Rule 42, NDCT Rules 2019)
{rule}
  VII.1 Compensation Applicable: Y / N
  VII.2 Amount Proposed        : Rs. _______
  VII.3 Status of Payment      : _______________

SECTION VIII - AI-EXTRACTED KEY POINTS
{rule}
{*narrated}

SECTION VIII-B - CAPA / ACTIONS
  {capa_or_officer}

SECTION IX - REVIEWER DECISION PANEL
{rule}
  [ ] Accept - Related / compensation payable
  [ ] Accept - Not related / no compensation
  [ ] Refer to SAE Independent Expert Committee
  [ ] Query to Sponsor
  [ ] Trigger GCP Inspection at site
  [ ] Show-cause / Warning recommended

Reviewing Officer: _______________  DDC (CT Division): _______________"""
MEETING = """\
COMMITTEE MEETING IDENTIFICATION
{rule}
Committee          : {committee}
Meeting Ref        : {reference}
Date               : {inspection_date}
Venue / Mode       : {venue}
Chairperson        : {chair}
CDSCO Moderator    : {moderator}
Members Present    : {inspectors}
Quorum Met         : [ ] Yes (min. 4 incl. 1 Pharmacologist)  [ ] No
Pre-brief circulated: [ ] Yes (>=5 days)  [ ] Delayed

AGENDA ITEMS
{rule}
(a) File No. / Ref   : {license_no}
(b) Applicant        : {firm_name}
(c) Nature           : {inspection_type}

(e) Background / Context (AI-extracted):
    {background}

(f) Key Points Presented:
{*presented}

(g) Decisions / Recommendations:
{*decided}

(h) Rationale for Decision (MANDATORY per SEC Guidance 2025):
    {conclusion_or_pending}

(i) DECISION:
    [ ] Recommended
    [ ] Recommended with minor changes
    [ ] Recommended with major changes (re-evaluation required)
    [ ] Not Recommended
    [ ] Further review - additional data sought
    [ ] Deferred to next meeting

CONSOLIDATED ACTION-ITEM REGISTER
{rule}
#    Action                                   Owner                Due Date
{dashes}
{*register}

ANY OTHER BUSINESS: _______________

NEXT MEETING: _______________  Provisional Agenda: _______________

ANNEXURES
{rule}
Annex-I:   Attendance Sheet
Annex-II:  Briefing Materials Index
Annex-III: Declarations of Conflict of Interest
Annex-IV:  Slides / Data Shown

Minutes Drafted by (AI): {tool} | {generated_at}
Verified by CDSCO Moderator: _______________
Approved by Chairperson:     _______________"""
FOOTER = """
{rule}
RESTRICTED - For CDSCO Internal Use Only
Prepared under CDSCO Schedule M / MDR 2017 / DPDP Act 2023
{rule}"""
TEMPLATES = {"application": APPLICATION, "case": CASE, "meeting": MEETING}

#: Derived field -> (the fields of which the first that is not empty counts, the text without any).
STAND_INS = {
    "reference": (("sugam_ref", "license_no"), ""),
    "reference_or_na": (("sugam_ref", "license_no"), "N/A"),
    "permission": (("sugam_ref",), "N/A"),
    "form": (("form_type",), "Form CT-04 / Form 44 / Form MD-14"),
    "reviewer": (("inspectors",), "___________________"),
    "duration_or_na": (("audio_duration",), "N/A"),
    "hash_or_na": (("source_hash",), "N/A"),
    "class_or_pending": (("deficiency_class",), "Pending Review"),
    "class_or_assessment": (("deficiency_class",), "Pending reviewer assessment"),
    "capa_or_officer": (("capa",), "To be determined by reviewing officer."),
    "narrative": (("summary",), "(Narrative not provided)"),
    "committee": (("product_category",), "SEC / Technical Committee / DTAB"),
    "venue": (("firm_address",), "FDA Bhawan, New Delhi"),
    "conclusion_or_pending": (("conclusion",), PENDING),
}

#: Height of a page's first and last line and of a step between lines, as the page export has them.
TOP, BOTTOM, STEP = 15, 280, 5
PER_PAGE = (BOTTOM - TOP) // STEP + 1


def _values(field) -> dict[str, Column]:
    given = {k: F.coalesce(field(k).cast("string"), F.lit("")) for k in FIELDS}
    full = lambda k: F.nullif(given[k], F.lit(""))
    out = given | {k: F.coalesce(*map(full, names), F.lit(text)) for k, (names, text) in STAND_INS.items()}
    names = F.split(given["inspectors"], ",")
    kind = R.body_kind(given["doc_type"])
    return out | {
        "rule": F.lit(RULE),
        "dashes": F.lit(DASHES),
        "document_class": F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), kind),
        "algorithm_upper": F.upper(given["algorithm"]),
        "risk": R.risk_line(given["deficiency_class"]),
        "background": F.coalesce(F.nullif(F.substring(given["summary"], 1, 300), F.lit("")), F.lit("(see full summary below)")),
        "chair": F.when(given["inspectors"] != "", F.get(names, F.lit(0))).otherwise("___"),
        "moderator": F.coalesce(strip(F.get(names, F.lit(1))), F.lit("___")),
    }


def _padded(text: Column, width: int) -> Column:
    """As long as ``width`` at least; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _blocks(points: Column) -> dict[str, Column]:
    """Name -> lines of the block."""
    split = R.decisions_actions(points)

    def listed(lines: Column, none: str) -> Column:
        return F.when(F.size(lines) > 0, F.transform(lines, lambda x: F.concat(F.lit("  "), x))).otherwise(F.array(F.lit(none)))

    def starred(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.concat(F.lit("    * "), x))

    row = lambda r: F.concat_ws(" ", _padded(r["no"].cast("string"), 4), _padded(r["item"], 35), _padded(r["flag"], 15), F.coalesce(F.nullif(r["finding"], F.lit("")), F.lit("-")))
    entry = lambda a, i: F.concat_ws(" ", _padded((i + 1).cast("string"), 4), _padded(F.substring(a, 1, 38), 40), F.rpad(F.lit("Applicant"), 20, " "), F.lit("TBD"))
    short = R.deficiency_points(points)
    last = F.slice(points, F.greatest(F.size(points) - 2, F.lit(1)), 3)
    return {
        "checklist": F.transform(R.checklist(points), row),
        "extracted": listed(points, "  (not extracted)"),
        "narrated": listed(points, "  (see narrative)"),
        "deficiencies": F.when(F.size(short) > 0, F.transform(short, lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), x))).otherwise(F.array(F.lit("  None identified."))),
        "presented": let(split["other"], lambda other: starred(F.slice(F.when(F.size(other) > 0, other).otherwise(points), 1, 4))),
        "decided": starred(split["decisions"]),
        "register": let(split["actions"], lambda acts: F.transform(F.when(F.size(acts) > 0, acts).otherwise(last), entry)),
    }


def compiled(template: str, values: dict[str, Column], blocks: dict[str, Column]) -> Column:
    """The lines of a template as an array."""
    parts: list[Column] = []
    plain: list[Column] = []
    for line in template.split("\n"):
        block = re.fullmatch(r"\{\*(\w+)\}", line)
        if block:
            parts += [F.array(*plain)] * bool(plain) + [blocks[block[1]]]
            plain = []
            continue
        pieces = [values[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", line)) if i % 2 or x]
        plain.append(F.concat(*pieces) if pieces else F.lit(""))
    return F.concat(*parts, *[F.array(*plain)] * bool(plain))


def report_lines(docs: DataFrame, id_col: str, points_col: str = "key_points") -> DataFrame:
    """(id, lines): masthead, the body of the kind of document, and footer.

    ``docs`` has the points and, by name, those of FIELDS that it knows.
    """
    have = set(docs.columns)
    values = _values(lambda k: F.col(k) if k in have else F.lit(""))
    none = F.array().cast("array<string>")

    def body(points: Column) -> Column:
        blocks = _blocks(points)
        kind = R.body_kind(values["doc_type"])
        made = {k: compiled(t, values, blocks) for k, t in TEMPLATES.items()}
        return F.when(kind == "case", made["case"]).when(kind == "meeting", made["meeting"]).otherwise(made["application"])

    # Null points count as empty ones.
    points = F.transform(F.coalesce(F.col(points_col), none), lambda x: F.coalesce(x, F.lit("")))
    lines = F.concat(compiled(MASTHEAD, values, {}), let(points, body), compiled(FOOTER, values, {}))
    return docs.select(id_col, F.split(F.array_join(lines, "\n"), "\n").alias("lines"))


def wrapped(lines: Column, width: int) -> Column:
    """Lines cut at blanks to at most ``width`` characters; longer words are cut within."""
    pattern = rf"[^\n]{{1,{width}}}(?:[ \t]+|\z)|[^\n]{{{width}}}"
    pieces = F.transform(lines, lambda x: F.when(x == "", F.array(F.lit(""))).otherwise(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda y: F.rtrim(y))))
    return F.flatten(pieces)


def pages(reports: DataFrame, id_col: str, lines_col: str = "lines", width: int = 90) -> DataFrame:
    """(id, page from 1, y, line): a new page begins where a line would stand below BOTTOM.

    All lines have one height, so that the page of a line follows from its number.
    """
    rows = reports.select(id_col, F.posexplode(wrapped(F.col(lines_col), width)).alias("at", "line"))
    page = F.floor(F.col("at") / PER_PAGE).cast("int")
    return rows.select(id_col, (page + 1).alias("page"), (F.col("at") - page * PER_PAGE).cast("int").alias("place"), "line").select(
        id_col, "page", (F.col("place") * STEP + TOP).alias("y"), "line"
    )
