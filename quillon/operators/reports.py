"""Report rows: checklist, decisions, risk and ratings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.spans import let

# Checklist items and phrases.
CHECKLIST = [
    "Manufacturing Licence / Form", "GMP Compliance Certificate", "HVAC Qualification Records", "Water System Validation", "BMR / BPR Records",
    "QC Training Records", "SOP Currency", "CAPA Register", "Storage Conditions", "Complaint Investigation",
]
NEGATIVE = ["missing", "overdue", "not signed", "invalid", "without", "incomplete", "failed", "no valid", "not current", "last revised", "last performed"]
DEFICIENT = ["missing", "overdue", "without", "not have", "not signed", "incomplete", "invalid", "failed", "no valid", "not current", "two missing", "last revised", "last performed"]
#: Ratings by the gravest observation.
RATINGS = ["Critical — Immediate Action Required", "Major — Action Required", "Minor — Advisory", "Satisfactory"]
DECISION = ["decision", "decided", "approved", "recommended", "rejected"]
ACTION = ["action", "to submit", "to provide", "to conduct", "to draft"]


def _any(text: Column, phrases: list[str]) -> Column:
    """One pass over the lower-cased text for all phrases."""
    return F.lower(text).rlike("|".join(map(re.escape, phrases)))


def deficiency_points(points: Column) -> Column:
    return F.filter(points, lambda p: _any(p, DEFICIENT))


def checklist(points: Column) -> Column:
    """array of struct(no, item, flag, finding): the first point with a keyword of the item decides."""
    def row(number: int, item: str) -> Column:
        keywords = item.lower().split()
        first = F.get(F.filter(points, lambda p: _any(p, keywords)), F.lit(0))

        def made(hit: Column) -> Column:
            flag = F.when(hit.isNull(), "OK").when(_any(hit, NEGATIVE), "INCOMPLETE *").otherwise("REVIEWED")
            return F.struct(F.lit(number).alias("no"), F.lit(item).alias("item"), flag.alias("flag"), F.coalesce(F.substring(hit, 1, 60), F.lit("-")).alias("finding"))

        return let(first, made)

    return F.array(*[row(i + 1, item) for i, item in enumerate(CHECKLIST)])


def decisions_actions(points: Column) -> Column:
    """struct(decisions, actions, other); the first three and the rest stand in where none is marked."""
    decided = F.filter(points, lambda p: _any(p, DECISION))
    acted = F.filter(points, lambda p: _any(p, ACTION))
    other = F.filter(points, lambda p: ~_any(p, DECISION) & ~_any(p, ACTION))
    return F.struct(
        F.when(F.size(decided) > 0, decided).otherwise(F.slice(points, 1, 3)).alias("decisions"),
        F.when(F.size(acted) > 0, acted).otherwise(F.slice(points, 4, F.greatest(F.size(points), F.lit(1)))).alias("actions"),
        other.alias("other"),
    )


def action_register(actions: Column) -> Column:
    return F.transform(actions, lambda a, i: F.concat(F.rpad((i + 1).cast("string"), 4, " "), F.substring(a, 1, 38)))


def risk_line(deficiency_class: Column) -> Column:
    text = F.lower(F.coalesce(deficiency_class, F.lit("")))
    return (
        F.when(text.contains("critical"), "Risk outweighs benefit pending resolution of critical deficiencies.")
        .when(text.contains("major"), "Benefit acceptable subject to resolution of major deficiencies within 45 days.")
        .otherwise("Benefit-risk profile acceptable based on current inspection findings.")
    )


def severity(text: Column) -> Column:
    """Class of one observation by keywords."""
    low = F.lower(text)
    return F.when(low.rlike("critical|death|fatal|contaminat|falsif"), "critical").when(low.rlike("major|overdue|missing|not signed|failed|invalid"), "major").otherwise("minor")


def inspection_rating(critical: Column, major: Column, minor: Column) -> Column:
    rating = F.when(F.size(critical) > 0, RATINGS[0]).when(F.size(major) > 0, RATINGS[1]).when(F.size(minor) > 0, RATINGS[2]).otherwise(RATINGS[3])
    return F.struct(rating.alias("rating"), (F.size(critical) + F.size(major) + F.size(minor)).alias("total"))


def override(field: Column, parsed: Column) -> Column:
    """A field given by hand wins unless it is blank."""
    return F.coalesce(F.nullif(F.trim(field), F.lit("")), parsed)


def shown(value: Column) -> Column:
    return (F.trim(F.coalesce(value, F.lit(""))) != "") & (value != "Not Specified")


def csv_line(*columns: Column) -> Column:
    """Quoted cells, quotes doubled."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def masthead(kind: Column, report_id: Column, firm: Column, confidence: Column, source_hash: Column) -> Column:
    return F.array(
        F.concat(F.lit("DOCUMENT CLASS     : "), kind), F.concat(F.lit("REPORT ID          : "), report_id), F.concat(F.lit("FIRM               : "), firm),
        F.concat(F.lit("CONFIDENCE         : "), F.format_string("%.2f", confidence)), F.concat(F.lit("SOURCE HASH        : "), source_hash),
    )


def body_kind(doc_type: Column) -> Column:
    return F.when(doc_type.contains("SAE"), "case").when(doc_type.contains("Meeting"), "meeting").otherwise("application")
