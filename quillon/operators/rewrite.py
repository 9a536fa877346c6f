"""Rewrite policies: mask, generalise, keyed pseudonyms, two steps; report tokens and traceback."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions.scan import scanned
from quillon.functions.spans import apply_spans
from quillon.operators.detect import normalise, with_spans

DEMO_KEY, REPORT_KEY = "quillon-demo-hmac-key", "quillon-demo-report-key"
#: Entities that keep a reversible token under the two-step policy.
TOKENISED = ["PERSON", "MRN", "DRUG_ID", "CDSCO_FILE"]
# Entities that are replaced by their own label.
OWN_LABEL = ["PERSON", "ADDRESS", "AADHAAR", "PAN", "MRN", "DRUG_ID", "CDSCO_FILE", "IN_PASSPORT", "IFSC"]
# Names of the policies.
MODES = {
    "de-identification": "generalise",
    "irreversible-anonymisation": "mask",
    "reversible-anonymisation": "pseudonymise",
    "pseudonymise": "pseudonymise",
    "generalise": "generalise",
    "two_step": "two_step",
    "mask": "mask",
}


def mode_of(name: str) -> str:
    """Policy of a name; unknown names mean two_step."""
    return MODES.get(name, "two_step")


def secret() -> str:
    return os.environ.get("ANON_HMAC_SECRET") or DEMO_KEY


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 from two SHA-256 calls over padded keys."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def token(entity: Column, value: Column, key: str | None = None) -> Column:
    return F.concat(F.lit("<"), entity, F.lit("_"), F.substring(hmac_sha256(key or secret(), F.concat(entity, F.lit(":"), value)), 1, 12), F.lit(">"))


def generalised(entity: Column, value: Column) -> Column:
    year = F.regexp_extract(value, r"\b((?:19|20)\d{2})\b", 1)
    return (
        F.when(entity == "DATE_TIME", F.when(year != "", F.concat(year, F.lit("-XX-XX"))).otherwise("[DATE]"))
        .when(entity.isin("LOCATION", "GPE"), "INDIA")
        .when(entity.isin("EMAIL_ADDRESS", "URL"), "[CONTACT]")
        .when(entity.isin("IN_PHONE", "PHONE_NUMBER"), "[PHONE]")
        .when(entity == "ORGANIZATION", "[ORG]")
        .when(entity == "IN_PIN_CODE", "[PIN_CODE]")
        .when(entity.isin(OWN_LABEL), F.concat(F.lit("["), entity, F.lit("]")))
        .otherwise("[REDACTED]")
    )


def masked(entity: Column, value: Column) -> Column:
    n = F.length(value)
    return F.when((entity == "PAN") & (n >= 3), F.concat(F.repeat(F.lit("*"), n - 2), F.right(value, F.lit(2)))).otherwise(F.repeat(F.lit("*"), F.greatest(n, F.lit(3))))


def replacement(span: Column, mode: str, key: str | None = None) -> Column:
    entity, value = span["entity"], span["text"]
    if mode == "mask":
        return masked(entity, value)
    if mode == "generalise":
        return generalised(entity, value)
    if mode == "pseudonymise":
        return token(entity, value, key)
    return F.when(entity.isin(TOKENISED), token(entity, value, key)).otherwise(generalised(entity, value))


def anonymise(docs: DataFrame, mode: str = "two_step", text_col: str = "text", key: str | None = None, join_letters: bool = True) -> DataFrame:
    """``docs`` plus norm, spans, anonymised_text and vault (token -> original).

    Without ``join_letters``, capitals that stand apart stay so, as everything outside the spans.
    """
    mode = mode_of(mode)
    found = with_spans(docs, text_col, join_letters=join_letters)
    out = found.withColumn("anonymised_text", apply_spans(F.col("norm"), F.col("spans"), lambda s: replacement(s, mode, key)))
    if mode in ("mask", "generalise"):
        return out.withColumn("vault", F.create_map().cast("map<string,string>"))
    kept = F.col("spans") if mode == "pseudonymise" else F.filter("spans", lambda s: s["entity"].isin(TOKENISED))
    entries = F.array_distinct(F.transform(kept, lambda s: F.struct(token(s["entity"], s["text"], key).alias("key"), s["text"].alias("value"))))
    return out.withColumn("vault", F.map_from_entries(entries))


def vault_rows(found: DataFrame, id_col: str, key: str | None = None) -> DataFrame:
    """(id, token, value) of the entities that the two-step policy can reveal again."""
    spans = found.select(id_col, F.explode_outer("spans").alias("s")).where(F.col("s.entity").isin(TOKENISED))
    return spans.select(id_col, token(F.col("s.entity"), F.col("s.text"), key).alias("token"), F.col("s.text").alias("value"))


def vault_values(found: DataFrame, key: str | None = None) -> DataFrame:
    """(token, value) once for each value of those entities; a token is made once for a value, not once for a span."""
    spans = found.select(F.explode_outer("spans").alias("s")).where(F.col("s.entity").isin(TOKENISED))
    once = spans.select("s.entity", F.col("s.text").alias("value")).distinct()
    return once.select(token(F.col("entity"), F.col("value"), key).alias("token"), "value")


def rewrite_cells(table: DataFrame, columns: list[str], mode: str = "two_step", key: str | None = None) -> DataFrame:
    """Each cell as text, rewritten; blank and null cells stay.  Adds ``n_spans``."""
    mode = mode_of(mode)

    made = table
    for name in columns:
        blank = F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")
        made = made.withColumn(f"__norm_{name}", F.when(~blank, normalise(F.col(name).cast("string"))))
        made = made.withColumn(f"__spans_{name}", scanned(F.col(f"__norm_{name}")))
        made = made.withColumn(f"__{name}", apply_spans(F.col(f"__norm_{name}"), F.col(f"__spans_{name}"), lambda x: replacement(x, mode, key)))
    total = sum((F.size(f"__spans_{c}") for c in columns), F.lit(0))
    others = [c for c in table.columns if c not in columns]
    return made.select(*others, *[F.coalesce(F.col(f"__{c}"), F.col(c).cast("string")).alias(c) for c in columns], total.alias("n_spans"))


def report_token(entity: Column, value: Column, key: str = REPORT_KEY, width: int = 6) -> Column:
    """``[ID-PPP-hhhhhh]``; ``width`` hex digits (24 bits by default, so collisions grow with data)."""
    pairs = [F.lit(x) for item in P.TOKEN_PREFIX.items() for x in item]
    prefix = F.coalesce(F.element_at(F.create_map(*pairs), entity), F.lit("UNK"))
    return F.concat(F.lit("[ID-"), prefix, F.lit("-"), F.substring(hmac_sha256(key, F.concat(entity, F.lit(":"), value)), 1, width), F.lit("]"))


def rewrite_report(found: DataFrame, reversible: bool, key: str = REPORT_KEY) -> DataFrame:
    """norm, spans -> processed_text, entities (last to first) and mapping (token -> original)."""
    def new(s: Column) -> Column:
        return report_token(s["entity"], s["text"], key) if reversible else F.lit("*" * 12)

    entities = F.reverse(
        F.transform(
            "spans",
            lambda s: F.struct(s["entity"].alias("entity"), (s["text"] if reversible else F.lit(None).cast("string")).alias("original"), new(s).alias("replacement"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")),
        )
    )
    # Of equal tokens the entry written last (the first in the text) stays.
    entries = F.transform(F.reverse("spans"), lambda s: F.struct(report_token(s["entity"], s["text"], key).alias("key"), s["text"].alias("value")))
    mapping = F.map_from_entries(F.array_distinct(entries)) if reversible else F.create_map().cast("map<string,string>")
    blank = F.trim("norm") == ""
    return (
        found.withColumn("processed_text", F.when(blank, F.col("norm")).otherwise(apply_spans(F.col("norm"), F.col("spans"), new)))
        .withColumn("entities", entities)
        .withColumn("mapping", mapping)
    )


def traceback(text: Column, mapping: Column) -> Column:
    """Put the originals back, in the order of the tokens."""
    return F.aggregate(F.array_sort(F.map_entries(mapping)), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def encrypted(value: Column, key: str) -> Column:
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"))


def decrypted(cipher: Column, key: str, failure: str | None = "[DECRYPT_FAILED]") -> Column:
    plain = F.try_aes_decrypt(cipher, F.lit(key), F.lit("GCM")).cast("string")
    return plain if failure is None else F.coalesce(plain, F.lit(failure))


#: What placeholders look like in rewritten text.
PLACEHOLDER = r"<[A-Z_]+_[0-9a-f]{12}>|\[ID-[A-Z]{3}-[0-9a-f]{6}\]|\[[A-Z_]+\]|\*{3,}|(?:19|20)\d{2}-XX-XX|INDIA"


def placeholder_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))
