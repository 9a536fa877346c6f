"""Narratives with identifiers, derived from ``orders`` alone, in Spark and in SQL.

The driver tables hold hardly any of the identifiers that the detectors know; these
texts hold all of them at computable places, so that detection can be compared with an
independent query and scored against true spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = ["Rajesh", "Priya", "Amit", "Sunita", "Vikram", "Meera"]
LAST = ["Sharma", "Patel", "Reddy", "Iyer", "Gupta"]
CITY = ["Mumbai", "Pune", "Kochi"]
HOSPITAL = ["Apollo Hospitals", "Fortis Hospital", "AIIMS"]


def slots() -> dict[str, Column]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(names: list[str], at: Column) -> Column:
        return F.get(F.lit(names), (at % len(names)).cast("int"))

    def four(n: Column) -> Column:
        return (F.lit(1000) + n % 9000).cast("string")

    def padded(n: Column, width: int) -> Column:
        return F.lpad(n.cast("string"), width, "0")

    return {
        "first": pick(FIRST, c),
        "last": pick(LAST, k),
        "city": pick(CITY, c),
        "hospital": pick(HOSPITAL, c),
        "aadhaar": F.concat_ws(" ", four(k), four(c), four(k * 7)),
        "pan": F.concat(F.lit("ABCDE"), padded(k % 10000, 4), F.lit("F")),
        "phone": F.concat(F.lit("+91-9"), padded((k * 7919) % 1000000000, 9)),
        "mrn": F.concat(F.lit("MRN"), (F.lit(100000) + k % 900000).cast("string")),
        "drug": F.concat(F.lit("IND-"), (F.lit(10000) + k % 90000).cast("string")),
        "file": F.concat(F.lit("CDSCO/NDD/2024/"), (F.lit(100) + k % 900).cast("string")),
        "date": F.date_format("o_orderdate", "dd/MM/yyyy"),
        "host": F.concat(F.lit("10.0.0."), (k % 256).cast("string")),
    }


#: (literal, slot, entity) pieces of the three shapes; the last literal has no slot.
SHAPES: list[list[tuple[str, str | None, str | None]]] = [
    [("Patient ", "name", "PERSON"), (" (Aadhaar ", "aadhaar", "AADHAAR"), (", PAN ", "pan", "PAN"), (") was admitted to ", "hospital", "ORGANIZATION"), (" on ", "date", "DATE_TIME"), (". Contact ", "phone", "IN_PHONE"), (", email ", "email", "EMAIL_ADDRESS"), (". Trial ", "drug", "DRUG_ID"), (", file ", "file", "CDSCO_FILE"), (".", None, None)],
    [("Name: ", "name", "PERSON"), ("\nHospital: ", "hospital", "ORGANIZATION"), (", ", "city", "LOCATION"), ("\nPhone: ", "phone", "IN_PHONE"), ("\nRecord ", "mrn", "MRN"), (" dated ", "date", "DATE_TIME"), ("", None, None)],
    [("Dr. ", "name", "PERSON"), (" visited ", "hospital", "ORGANIZATION"), (" in ", "city", "LOCATION"), (" on ", "date", "DATE_TIME"), (". Card ", "card", "CREDIT_CARD"), (", host ", "host", "IP_ADDRESS"), (".", None, None)],
]


def narratives(orders: DataFrame) -> DataFrame:
    """id, shape, text, truth (array of struct(start, end, entity))."""
    s = slots()
    s["name"] = F.concat_ws(" ", s["first"], s["last"])
    s["email"] = F.concat(F.lower(s["first"]), F.lit("."), F.lower(s["last"]), F.lit("@example.com"))
    s["card"] = F.lit("4111 1111 1111 1111")
    shape = (F.col("o_orderkey") % 3).cast("int")
    filled = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("day"), shape.alias("shape"), *[v.alias(k) for k, v in s.items()])

    def text(pieces) -> Column:
        return F.concat(*[x for literal, slot, _ in pieces for x in ([F.lit(literal), F.col(slot)] if slot else [F.lit(literal)])])

    def truth(pieces) -> Column:
        at, out = F.lit(0), []
        for literal, slot, entity in pieces:
            if slot:
                start = at + len(literal)
                at = start + F.length(slot)
                out.append(F.struct(start.cast("int").alias("start"), at.cast("int").alias("end"), F.lit(entity).alias("entity")))
        return F.array(*out)

    def by_shape(f) -> Column:
        return F.when(F.col("shape") == 0, f(SHAPES[0])).when(F.col("shape") == 1, f(SHAPES[1])).otherwise(f(SHAPES[2]))

    return filled.withColumn("text", by_shape(text)).withColumn("truth", by_shape(truth)).select("id", "cust", "day", "shape", "text", "truth")


def notes(orders: DataFrame) -> DataFrame:
    """id, text: short notes with the identifiers that the narratives lack."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("IFSC HDFC0"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(", passport K"), (F.lit(1000000) + k % 9000000).cast("string"),
        F.lit(", call 98765-"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit(". See https://example.com/r/"), k.cast("string"),
        F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" and "), F.date_format("o_orderdate", "MMM d, yyyy"),
        F.lit(". "), (k % 90 + 1).cast("string"), F.lit(" Hill Road, Pune "), (F.lit(100000) + k % 900000).cast("string"), F.lit("."),
    )
    return orders.select(k.alias("id"), text.alias("text"))


NOTES_SQL = """SELECT o_orderkey AS id, 'IFSC HDFC0' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || ', passport K' || (1000000 + o_orderkey % 9000000)
  || ', call 98765-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || '. See https://example.com/r/' || o_orderkey
  || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ' and ' || strftime(o_orderdate, '%b %-d, %Y')
  || '. ' || (o_orderkey % 90 + 1) || ' Hill Road, Pune ' || (100000 + o_orderkey % 900000) || '.' AS text FROM orders"""


def _sql_list(names: list[str], at: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], ({at} % {len(names)} + 1)::INT)"


_SLOT_SQL = f"""
  SELECT o_orderkey AS id, o_custkey AS cust, (o_orderkey % 3)::INT AS shape,
    {_sql_list(FIRST, 'o_custkey')} || ' ' || {_sql_list(LAST, 'o_orderkey')} AS name,
    lower({_sql_list(FIRST, 'o_custkey')}) || '.' || lower({_sql_list(LAST, 'o_orderkey')}) || '@example.com' AS email,
    {_sql_list(CITY, 'o_custkey')} AS city, {_sql_list(HOSPITAL, 'o_custkey')} AS hospital,
    (1000 + o_orderkey % 9000) || ' ' || (1000 + o_custkey % 9000) || ' ' || (1000 + (o_orderkey * 7) % 9000) AS aadhaar,
    'ABCDE' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'F' AS pan,
    '+91-9' || lpad(((o_orderkey * 7919) % 1000000000)::VARCHAR, 9, '0') AS phone,
    'MRN' || (100000 + o_orderkey % 900000) AS mrn, 'IND-' || (10000 + o_orderkey % 90000) AS drug,
    'CDSCO/NDD/2024/' || (100 + o_orderkey % 900) AS file, strftime(o_orderdate, '%d/%m/%Y') AS date,
    '10.0.0.' || (o_orderkey % 256) AS host, '4111 1111 1111 1111' AS card
  FROM orders
"""


def _sql_text(pieces) -> str:
    return " || ".join(x for literal, slot, _ in pieces for x in ([f"'{literal}'", slot] if slot else [f"'{literal}'"]))


def _sql_truth(number: int, pieces) -> str:
    rows, before = [], []
    for literal, slot, entity in pieces:
        before.append(f"'{literal}'")
        if slot:
            start = f"length({' || '.join(before)})"
            rows.append(f"SELECT id, {start}::INT AS start, ({start} + length({slot}))::INT AS \"end\", '{entity}' AS entity FROM slots WHERE shape = {number}")
            before.append(slot)
    return " UNION ALL ".join(rows)


#: Common table expressions ``slots`` and ``narr`` (id, cust, shape, text).
NARRATIVES_SQL = f"""slots AS ({_SLOT_SQL}), narr AS (
  SELECT id, cust, shape, CASE shape WHEN 0 THEN {_sql_text(SHAPES[0])} WHEN 1 THEN {_sql_text(SHAPES[1])} ELSE {_sql_text(SHAPES[2])} END AS text FROM slots
)"""
TRUTH_SQL = f"truth AS ({' UNION ALL '.join(_sql_truth(i, p) for i, p in enumerate(SHAPES))})"
