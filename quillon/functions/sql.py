"""Detection and rewriting for SQL users.

``register`` adds a table function and scalar functions to a session:

    SELECT d.doc_id, s.* FROM documents d, LATERAL detect_spans(d.text) s
    SELECT mask_pii('PAN', 'ABCDE1234F'), token_pii('PERSON', 'Meera Iyer')

The table function is a SQL function, too, over an Arrow function that takes texts in batches.  The scalar functions are SQL functions, which Spark inlines into the plan of the query; they run
inside generated code, without Python.  Null in, null out; a null or empty text has no spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions.scan import joined, scan
from quillon.operators.rewrite import OWN_LABEL, TOKENISED


_ROW = ["start", "end", "entity", "text", "score"]


def _joined(texts: pa.Array) -> pa.Array:
    """Runs of single capitals joined, where there can be any."""
    if not pc.any(pc.match_substring_regex(texts, "[A-Z] [A-Z] [A-Z]")).as_py():
        return texts.fill_null("")
    return pa.array([joined(t) for t in texts.to_pylist()], pa.string())


def _listed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Resolved spans of texts; offsets are those of the normalised texts."""
    for found in scan(map(_joined, texts)):
        spans = found.values
        rows = pa.StructArray.from_arrays([spans.field(n) for n in _ROW], names=["start", "end", "entity", "value", "score"])
        yield pa.ListArray.from_arrays(found.offsets, rows)


def _words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _bodies(key: str) -> dict[str, str]:
    """SQL bodies over the parameters entity and value."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw).hex() for pad in (0x36, 0x5C))
    message = "encode(concat(entity, ':', value), 'UTF-8')"
    digest = f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', {message}), 256))), 256)"
    year = r"regexp_extract(value, '\\b((?:19|20)\\d{2})\\b', 1)"
    bodies = {
        "mask_pii": "CASE WHEN value IS NULL THEN NULL WHEN entity = 'PAN' AND length(value) >= 3 THEN concat(repeat('*', length(value) - 2), right(value, 2)) ELSE repeat('*', greatest(length(value), 3)) END",
        "generalise_pii": f"""CASE WHEN value IS NULL OR entity IS NULL THEN NULL
            WHEN entity = 'DATE_TIME' THEN CASE WHEN {year} <> '' THEN concat({year}, '-XX-XX') ELSE '[DATE]' END
            WHEN entity IN ('LOCATION', 'GPE') THEN 'INDIA' WHEN entity IN ('EMAIL_ADDRESS', 'URL') THEN '[CONTACT]'
            WHEN entity IN ('IN_PHONE', 'PHONE_NUMBER') THEN '[PHONE]' WHEN entity = 'ORGANIZATION' THEN '[ORG]'
            WHEN entity = 'IN_PIN_CODE' THEN '[PIN_CODE]' WHEN entity IN ({_words(OWN_LABEL)}) THEN concat('[', entity, ']') ELSE '[REDACTED]' END""",
        "token_pii": f"concat('<', entity, '_', substring({digest}, 1, 12), '>')",
    }
    bodies["two_step_pii"] = f"CASE WHEN entity IN ({_words(TOKENISED)}) THEN {bodies['token_pii']} ELSE {bodies['generalise_pii']} END"
    return bodies


def register(spark: SparkSession, key: str) -> None:
    """Add detect_spans, mask_pii, generalise_pii, token_pii and two_step_pii to the session."""
    kind = "array<struct<start:int,end:int,entity:string,value:string,score:double>>"
    spark.udf.register("spans_of_text", F.arrow_udf(_listed, kind))
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION detect_spans(document STRING) RETURNS TABLE (start INT, `end` INT, entity STRING, value STRING, score DOUBLE)
           RETURN SELECT s.start, s.`end`, s.entity, s.value, s.score FROM (SELECT explode(spans_of_text(document)) AS s)"""
    )
    for name, body in _bodies(key).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(entity STRING, value STRING) RETURNS STRING RETURN {body}")
