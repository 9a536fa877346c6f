"""Text preparation as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.spans import let

# Abbreviations and their full forms, in order.
ABBREVIATIONS = {
    "GMP": "Good Manufacturing Practice",
    "GLP": "Good Laboratory Practice",
    "GCP": "Good Clinical Practice",
    "SOP": "Standard Operating Procedure",
    "CAPRA": "Corrective and Preventive Action",
    "CAPA": "Corrective and Preventive Action",
    "QC": "Quality Control",
    "QA": "Quality Assurance",
    "AR": "Analytical Report",
    "BMR": "Batch Manufacturing Record",
    "BPR": "Batch Packing Record",
    "MDR": "Medical Device Rules",
    "CTD": "Common Technical Document",
    "IEC": "Independent Ethics Committee",
    "IRB": "Institutional Review Board",
    "ICF": "Informed Consent Form",
    "AE": "Adverse Event",
    "SAE": "Serious Adverse Event",
    "ADR": "Adverse Drug Reaction",
    "PV": "Pharmacovigilance",
    "DCGI": "Drugs Controller General of India",
    "CDSCO": "Central Drugs Standard Control Organisation",
    "FDA": "Food and Drug Administration",
}
# Words of a table's header row.
HEADER_WORDS = "area finding severity details checklist observation status item description remarks".split()
# Section headings, first match wins.
SECTIONS = {
    "observations": r"(?i)(observations?|findings?)\s*[:\-]",
    "deficiencies": r"(?i)(deficien\w+|non[\-\s]?complian\w+)\s*[:\-]",
    "capa": r"(?i)(capa|corrective\s+action|preventive\s+action)\s*[:\-]",
    "recommendations": r"(?i)(recommendations?|suggestions?)\s*[:\-]",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def html_to_text(c: Column) -> Column:
    """Drop scripts and styles, turn tags into spaces, collapse white space."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"(?U)\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no such function."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def ocr_artefacts(c: Column) -> Column:
    made = F.regexp_replace(F.replace(c, F.lit("\f"), F.lit("\n")), "-{2,}", "—")
    return F.regexp_replace(made, r"(?<=[A-Z])\|(?=[A-Z])", "I")


def expand_abbreviations(c: Column) -> Column:
    """One replacement after another: a full form may hold no later abbreviation."""

    def expanded(short: str, full: str):
        # Patterns are slow to search; most texts lack the letters.
        return lambda x: F.when(x.contains(short), F.regexp_replace(x, rf"(?U)\b{short}\b", full)).otherwise(x)

    for short, full in ABBREVIATIONS.items():
        c = let(c, expanded(short, full))
    return c


def collapse_whitespace(c: Column) -> Column:
    """Single spaces, trimmed lines, one blank line at most."""
    lines = F.regexp_replace(F.regexp_replace(c, "\r\n?|[\x0b\f\x1c-\x1e\x85  ]", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"(?Um)^[^\S\n]+|[^\S\n]+$", ""), "\n{3,}", "\n\n"))


def sentence_boundaries(c: Column) -> Column:
    return F.regexp_replace(c, r"([.!?])([A-Z])", "$1 $2")


def structured_to_sentences(c: Column) -> Column:
    """Rows of comma- or pipe-separated fields, or bare phrases, as sentences."""
    def body(lines: Column) -> Column:
        n = F.size(lines)

        def share(test) -> Column:
            return F.size(F.filter(lines, test)) / F.greatest(n, F.lit(1))

        commas = share(lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) >= 2) > 0.4
        pipes = share(lambda x: x.contains("|")) > 0.4
        bare = (share(lambda x: ~x.rlike("[.!?]$")) > 0.6) & (n > 2)
        # Once for a text, not once for each line.
        return let(F.struct(lines.alias("lines"), commas.alias("commas"), pipes.alias("pipes"), bare.alias("bare")), written)

    def written(f: Column) -> Column:
        lines, n = f["lines"], F.size(f["lines"])
        head = words(F.translate(F.lower(F.get(lines, F.lit(0))), ",|", "  "))
        rows = F.when(F.arrays_overlap(head, F.lit(HEADER_WORDS)), F.slice(lines, 2, F.greatest(n, F.lit(1)))).otherwise(lines)

        def sentence(row: Column) -> Column:
            cells = F.filter(F.transform(F.when(f["commas"], F.split(row, ",")).otherwise(F.split(row, r"\|")), strip), lambda x: x != "")

            def ended(cells: Column) -> Column:
                joined, one = F.array_join(cells, ". "), F.get(cells, F.lit(0))
                many = F.when(joined.endswith("."), joined).otherwise(F.concat(joined, F.lit(".")))
                single = F.when(one.rlike("[.!?]$"), one).otherwise(F.concat(one, F.lit(".")))
                return F.when(F.size(cells) >= 2, many).when(F.size(cells) == 1, single)

            return let(cells, ended)

        table = F.when(f["commas"] | f["pipes"], F.filter(F.transform(rows, sentence), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
        shout = lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.size(words(x)) <= 4)
        phrases = F.transform(F.filter(lines, lambda x: ~shout(x)), lambda x: F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))
        return let(table, lambda t: F.when(F.size(t) > 0, F.array_join(t, " ")).when(f["bare"], F.array_join(phrases, " ")).otherwise(c))

    lines = F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0b\f]"), strip), lambda x: x != "")
    return let(lines, body)


def prepare(c: Column, expand: bool = True) -> Column:
    """All preparation steps but NFKC, in order; blank text gives an empty text."""
    made = structured_to_sentences(ocr_artefacts(strip_tags(c)))
    made = expand_abbreviations(made) if expand else made
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit("")).otherwise(sentence_boundaries(collapse_whitespace(made)))


def prepared(docs: DataFrame, text_col: str = "text", out_col: str = "prepared", expand: bool = True) -> DataFrame:
    """``docs`` plus the text after NFKC and all other steps."""
    return docs.withColumn(out_col, nfkc(F.coalesce(F.col(text_col), F.lit("")))).withColumn(out_col, prepare(F.col(out_col), expand))


def sections(c: Column) -> Column:
    """map(section -> text): each line belongs to the last heading seen, headings included."""

    def heading(line: Column) -> Column:
        found = F.lit(None).cast("string")
        for key, pattern in reversed(SECTIONS.items()):
            found = F.when(line.rlike(pattern), key).otherwise(found)
        return found

    def cut(lines: Column) -> Column:
        """Stretches of lines from one heading to the next; each line is copied once."""
        marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), heading(x).alias("name"))), lambda m: m["name"].isNotNull())
        starts = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("general_remarks").alias("name"))), marks)

        def stretch(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1)["at"], F.size(lines))
            made = F.transform(starts, lambda m, k: F.struct(m["name"].alias("name"), F.slice(lines, m["at"] + 1, end(k) - m["at"]).alias("lines")))
            return let(F.filter(made, lambda x: F.size(x["lines"]) > 0), grouped)

        return let(starts, stretch)

    def grouped(made: Column) -> Column:
        names = F.array_distinct(F.transform(made, lambda x: x["name"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: strip(F.array_join(F.flatten(F.transform(F.filter(made, lambda x: x["name"] == n), lambda x: x["lines"])), "\n"))))

    return let(F.split(F.regexp_replace(c, "\r\n?|[\x0b\f]", "\n"), "\n"), cut)


def first_sentences(c: Column, n: int) -> Column:
    return F.slice(F.split(strip(c), r"(?<=[.!?])\s+"), 1, n)


def ocr_cleanup(c: Column) -> Column:
    """Usual misreadings, broken lines, spacing and identifiers of recognised text."""
    # Characters and what they stand for.
    made = F.translate(c, "|¢©‘’“”–— ", "IcC''\"\"-- ")
    made = F.regexp_replace(made, "\n{3,}", "\n\n")

    def joined(out: Column, line: Column) -> Column:
        last = F.element_at(out, -1)
        open_end = (F.size(out) > 0) & (last != "") & ~last.rlike(r"(?U)[.!?:;]\s*$")
        return F.when((line != "") & open_end, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit(" "), line)))).otherwise(F.concat(out, F.array(line)))

    lines = F.transform(F.split(made, "\n"), strip)
    made = F.array_join(F.aggregate(lines, F.array().cast("array<string>"), joined), "\n")
    for pattern, new in (
        (r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"),
        ("[ \t]{2,}", " "),
        (r"(?U)\s+([.,;:!?])", "$1"),
        ("([.,;:!?])([A-Za-z])", "$1 $2"),
        (r"(?U)\b(\d{4})[.\-\s]?(\d{4})[.\-\s]?(\d{4})\b", "$1 $2 $3"),
        (r"(?U)\b([A-Z]{3})\s?([A-Z])\s?([A-Z])\s?(\d{4})\s?([A-Z])\b", "$1$2$3$4$5"),
        (r"(?U)(\+91|0)\s*[-.]?\s*(\d{5})\s*[-.]?\s*(\d{5})", "$1 $2 $3"),
        (r"(?U)[^\S\n]+", " "),
        (r"[^\x20-\x7E\nऀ-ॿ]", ""),
        ("(?m)^ +| +$", ""),
        ("\n{3,}", "\n\n"),
    ):
        made = F.regexp_replace(made, pattern, new)
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit("")).otherwise(strip(made))


def confidence(raw: Column, summary: Column) -> Column:
    n = word_count(summary)
    ratio = F.length(summary) / F.length(raw)
    score = F.lit(0.5) + F.when(n > 30, 0.3).otherwise(0.1) + F.when(ratio < 0.6, 0.15).otherwise(0.05)
    return F.when(F.length(raw) == 0, 0.0).otherwise(F.round(F.least(F.lit(0.95), score), 2))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"(?U)[^\w-]", "_"), 1, 50)


def ascii_punctuation(c: Column) -> Column:
    return F.translate(c, "–—‘’“”•", "--''\"\"*")


def strip_bullet(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"^[•\-*]+\s*", ""))


def duration(ms: Column) -> Column:
    seconds = ms / 1000
    return (
        F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.round(seconds % 60).cast("long").cast("string"), F.lit("s")))
    )


@F.pandas_udf(T.DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of the lower-cased texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])
