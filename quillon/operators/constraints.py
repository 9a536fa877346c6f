"""Completeness of records under constraints within a record and across records.

Each field of each record gets one flag, the gravest that holds of: missing (null or blank),
invalid (its own test fails), inconsistent (a denial of that kind, a dependency or a reference
is violated), warning (a denial of that kind), ok.

A denial is a condition over one record that should not hold.  A dependency says that records
equal in some fields are equal in another one; the value that most of them have (the smallest of
equally many) is expected of all.  A reference says that a value occurs in another table.
Dependencies are two aggregates (counts of values before the exchange, the best of a key after)
and a join of the keys that have more than one value: no record meets another one, and only a
key with a conflict is joined back.

Defined cases: blank values take no part in dependencies and references; a test or condition
that is null counts as holding for tests and as not holding for denials; records with a null in
the determining fields form no group; repeated records get a row each; empty tables give an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("missing", "invalid", "inconsistent", "warning", "ok")


@dataclass(frozen=True)
class Field:
    name: str
    section: str
    severity: str
    label: str = ""
    valid: Column | None = None
    required: bool = True


@dataclass(frozen=True)
class Denial:
    field: str
    status: str  # inconsistent or warning
    message: str
    condition: Column


@dataclass(frozen=True)
class Dependency:
    given: tuple[str, ...]
    field: str


@dataclass(frozen=True)
class Reference:
    field: str
    table: DataFrame
    column: str


def _blank(field: str) -> Column:
    return F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == "")


def _expected(records: DataFrame, rule: Dependency, name: str) -> DataFrame:
    """Keys with several values and the one that is expected of them (as text)."""
    there = records.where(~_blank(rule.field)).na.drop(subset=list(rule.given))
    values = there.groupBy(*rule.given, F.col(rule.field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    # The smallest of the most frequent: max_by over (n) of the smallest value needs both in one order.
    best = values.groupBy(*rule.given).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))).alias("best"), F.count("*").alias("several")).where("several > 1")
    return best.select(*[F.col(g).alias(f"{name}_{i}") for i, g in enumerate(rule.given)], F.col("best.value").alias(name))


def flags(records: DataFrame, id_col: str, fields: list[Field], denials: list[Denial] = (), dependencies: list[Dependency] = (), references: list[Reference] = ()) -> DataFrame:
    """(id, field_id, field_label, section, severity, status, message, value, expected) for every field of every record."""
    checked, found, columns = records, {f.name: [] for f in fields}, list(records.columns)
    for k, rule in enumerate(dependencies):
        name = f"dependency_{k}__"
        keys = reduce(Column.__and__, (F.col(g) == F.col(f"{name}_{i}") for i, g in enumerate(rule.given)))
        checked = checked.join(_expected(records, rule, name), keys, "left")
        broken = F.col(name).isNotNull() & (F.col(rule.field).cast("string") != F.col(name))
        found[rule.field].append(("inconsistent", broken, F.lit(f"differs from other records of equal {', '.join(rule.given)}"), F.col(name)))
        columns.append(name)
        checked = checked.select(*columns)
    for k, rule in enumerate(references):
        name = f"reference_{k}__"
        known = rule.table.select(F.col(rule.column).alias(name)).where(F.col(name).isNotNull()).distinct()
        checked = checked.join(known, F.col(rule.field) == F.col(name), "left")
        found[rule.field].append(("inconsistent", F.col(name).isNull(), F.lit(f"is not among {rule.column}"), F.lit(None).cast("string")))
        columns.append(name)
    for rule in denials:
        found[rule.field].append((rule.status, rule.condition, F.lit(rule.message), F.lit(None).cast("string")))
    return checked.select(F.col(id_col), F.explode(F.array(*[_flag(f, found[f.name]) for f in fields])).alias("f")).select(id_col, "f.*")


def _flag(f: Field, found: list[tuple]) -> Column:
    nothing = F.lit(None).cast("string")
    cases = [("missing" if f.required else "ok", _blank(f.name), F.lit("has no value" if f.required else ""), nothing)]
    if f.valid is not None:
        cases.append(("invalid", ~f.valid, F.lit("fails its test"), nothing))
    cases += sorted(found, key=lambda c: STATUSES.index(c[0]))
    made = lambda status, message, expected: F.struct(F.lit(status).alias("status"), message.alias("message"), expected.alias("expected"))
    verdict = made("ok", F.lit(""), nothing)
    for status, holds, message, expected in reversed(cases):
        verdict = F.when(F.coalesce(holds, F.lit(False)), made(status, message, expected)).otherwise(verdict)
    return F.struct(
        F.lit(f.name).alias("field_id"), F.lit(f.label or f.name).alias("field_label"), F.lit(f.section).alias("section"), F.lit(f.severity).alias("severity"),
        verdict["status"].alias("status"), verdict["message"].alias("message"), F.col(f.name).cast("string").alias("value"), verdict["expected"].alias("expected"),
    )


def results(found: DataFrame, *keys: str) -> DataFrame:
    """Totals over flags by ``keys`` (an id, a section, or none): fields, one count a status, and the score from 0 to 100."""
    of = lambda s: F.count_if(F.col("status") == s)
    score = F.round(of("ok") * 100 / F.count("*"), 1)
    return found.groupBy(*keys).agg(
        F.count("*").alias("total_fields"), of("ok").alias("complete_fields"), of("missing").alias("missing_fields"), of("invalid").alias("invalid_fields"),
        of("inconsistent").alias("inconsistent_fields"), of("warning").alias("warning_fields"), score.alias("completeness_score"),
    )
