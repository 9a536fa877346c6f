"""Detection of personal and health identifiers: text column in, span column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions.scan import scanned
from quillon.functions.spans import find_rules, let, resolve


def normalise(text: Column) -> Column:
    """Join runs of three or more single capitals that stand apart by single spaces.

    Inside such a run every space lies between a capital that follows a word
    boundary and one that precedes one; both ends of the run must do so, too.
    """
    p = "(?U)" + P.SPACED_LETTERS
    joined = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit("")))
    pieces = F.flatten(F.transform(F.arrays_zip(F.split(text, p, -1).alias("gap"), joined.alias("run")), lambda x: F.array(x["gap"], F.coalesce(x["run"], F.lit("")))))
    return F.when(text.rlike(p), F.array_join(pieces, "")).otherwise(text)


def regex_spans(text: Column) -> Column:
    return find_rules(text, P.REGEX_RULES)


def name_spans(text: Column) -> Column:
    """Names by title, role, narrative and context, less short ones, acronyms and common words."""
    return F.filter(
        find_rules(text, P.NAME_RULES, 200),
        lambda s: (F.length(s["text"]) >= 3) & (F.upper(s["text"]) != s["text"]) & ~F.regexp_extract(s["text"], r"(?U)^\s*(\S+)", 1).isin(P.NAME_SKIP),
    )


def hospital_spans(text: Column) -> Column:
    return F.filter(find_rules(text, P.HOSPITAL_RULES, 300), lambda s: F.length(s["text"]) >= 3)


def city_spans(text: Column) -> Column:
    return find_rules(text, P.CITY_RULES, 400)


def relabel_locations(spans: Column) -> Column:
    """Long locations with a comma and a digit are addresses."""
    return F.transform(
        spans,
        lambda s: F.when(
            (s["entity"] == "LOCATION") & (F.length(s["text"]) > 20) & s["text"].contains(",") & s["text"].rlike(r"(?U)\d"), s.withField("entity", F.lit("ADDRESS"))
        ).otherwise(s),
    )


def filter_model_spans(spans: Column) -> Column:
    """Drop what a name model tags wrongly; spans over lines are cut to their first line."""
    false = P.NER_FALSE

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def first_line(s: Column) -> Column:
        line = strip(F.substring_index(s["text"], "\n", 1))
        return s.withField("text", line).withField("end", s["start"] + F.length(line))

    def keep(s: Column) -> Column:
        clean = strip(F.regexp_replace(strip(s["text"]), ":+$", ""))
        words = F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")
        lines = s["text"].contains("\n")
        head = strip(F.substring_index(s["text"], "\n", 1))
        one = F.size(words) == 1
        bad_org = one & (s["entity"] == "ORGANIZATION") & ~F.upper(clean).isin(P.SHORT_ORGS)
        bad_person = one & (s["entity"] == "PERSON") & (F.length(clean) < 3)
        return ~F.lower(clean).isin(false) & F.when(lines, (F.length(head) >= 3) & ~F.lower(head).isin(false)).otherwise(
            ~bad_org & ~bad_person & F.exists(words, lambda w: ~F.lower(w).isin(false))
        )

    return F.transform(F.filter(spans, keep), lambda s: F.when(s["text"].contains("\n"), first_line(s)).otherwise(s))


def detect(text: Column, model_spans: Column | None = None) -> Column:
    """Resolved spans of all layers over *normalised* text; a model's spans are optional."""
    layers = [regex_spans(text)]
    if model_spans is not None:
        layers.append(filter_model_spans(relabel_locations(model_spans)))
    return resolve(F.concat(*layers, name_spans(text), hospital_spans(text), city_spans(text)))


def field_spans(text: Column) -> Column:
    """``Label: value`` fields of reports."""
    raw = find_rules(text, P.FIELD_RULES, 500)

    def trimmed(s: Column) -> Column:
        value = F.regexp_replace(s["text"], r"(?U)^\s+|\s+$", "")
        bare = F.regexp_replace(F.regexp_replace(value, r"(?U)\s*:\s*\d+\s*$", ""), r"(?U)\s+\d{1,3}\s*$", "")
        person = s["entity"] == "PERSON"
        kept = F.when(person, F.when(F.replace(value, F.lit(" "), F.lit("")).rlike(r"(?U)^\d+$"), F.lit("")).otherwise(bare)).otherwise(value)
        return let(kept, lambda v: s.withField("text", v).withField("end", s["start"] + F.length(v)))

    return F.filter(F.transform(raw, trimmed), lambda s: F.length(s["text"]) >= 2)


def inline_spans(text: Column) -> Column:
    return F.filter(find_rules(text, P.INLINE_RULES, 600), lambda s: ~F.regexp_extract(s["text"], r"(?U)^(\S+)", 1).isin(P.INLINE_SKIP))


def detect_report(text: Column, general: Column | None = None) -> Column:
    """``detect`` (or its result), then label fields and inline names, resolved once more."""
    general = F.transform(detect(text) if general is None else general, lambda s, i: s.withField("ord", i))
    return resolve(F.concat(general, field_spans(text), inline_spans(text)))


def with_spans(docs: DataFrame, text_col: str = "text", report: bool = False, join_letters: bool = True) -> DataFrame:
    """``docs`` plus ``norm`` (normalised text; the text itself without ``join_letters``) and ``spans``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.withColumn("norm", normalise(text) if join_letters else text)
    return norm.withColumn("spans", scanned(F.col("norm"), report))


def span_rows(found: DataFrame, id_col: str) -> DataFrame:
    """One row per span."""
    # The outer form keeps Spark from computing the spans twice for an inferred size filter.
    return found.select(id_col, F.explode_outer("spans").alias("s")).where("s is not null").select(id_col, "s.start", "s.end", "s.entity", "s.text", "s.score")


def entity_counts(found: DataFrame, *keys: str) -> DataFrame:
    rows = found.select(*keys, F.explode_outer("spans").alias("s")).where("s is not null").select(*keys, "s.entity")
    return rows.groupBy(*keys, "entity").agg(F.count("*").alias("n"))
