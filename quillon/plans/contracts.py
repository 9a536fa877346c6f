"""Queries of field comparison and completeness, with SQL that decides by enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import constraints as K
from quillon.operators import versions as V
from quillon.plans.detection import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---------------------------------------------------------------- versions

#: Six fields of a customer's sheet; the new version has them in one of all 720 orders.
_FIELDS = ["name", "nation", "balance", "segment", "code", "note"]
_WEIGHT = {"name": "critical", "balance": "critical", "nation": "substantive", "segment": "substantive"}
_SECTION = {"name": "identity", "nation": "identity", "balance": "finance", "segment": "finance"}
_VALUES = {"name": "c_name", "nation": "CAST(c_nationkey AS STRING)", "balance": "CAST(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS STRING)", "segment": "c_mktsegment", "code": "CAST(c_custkey % 7 AS STRING)", "note": "CAST(NULL AS STRING)"}
_EDITED = _VALUES | {"segment": "CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END", "note": "CASE WHEN c_custkey % 11 = 0 THEN 'new note' END"}
#: Digits of the order's number, each the place of a field among those that are left.
_DIGITS = [f"(c_custkey // {d} % {r})" for d, r in ((120, 6), (24, 5), (6, 4), (2, 3), (1, 2))]


def _sheet(customer: DataFrame, values: dict[str, str]) -> DataFrame:
    return customer.selectExpr("c_custkey", *[f"{v} AS {n}" for n, v in values.items()])


def _changes(spark, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    digits = [F.expr(d.replace("//", "div")).cast("int") for d in _DIGITS]
    begin = F.struct(F.array().cast("array<int>").alias("order"), F.lit(list(range(6))).alias("left"))
    take = lambda s, d: F.struct(F.concat(s["order"], F.array(F.get(s["left"], d))).alias("order"), F.concat(F.slice(s["left"], 1, d), F.slice(s["left"], d + 2, 6)).alias("left"))
    order = F.aggregate(F.array(*digits, F.lit(0)), begin, take, lambda s: s["order"])
    old = V.cells(_sheet(customer, _VALUES), "c_custkey", _FIELDS).where("NOT (field_name = 'code' AND c_custkey % 4 = 0) AND c_custkey % 97 <> 0")
    sheet = _sheet(customer, _EDITED)
    new = V.cells(sheet, "c_custkey", _FIELDS, order).where("NOT (field_name = 'balance' AND c_custkey % 6 = 0) AND c_custkey % 89 <> 0")
    return V.compare(old, new, "c_custkey", _WEIGHT, _SECTION)


def _cells_sql(values: dict[str, str], place: list[str]) -> str:
    cast = lambda v: v.replace("STRING", "VARCHAR")
    rows = ", ".join(f"{{'f': '{f}', 'p': {p}, 'v': {cast(values[f])}}}" for f, p in zip(_FIELDS, place, strict=True))
    return f"SELECT c_custkey, unnest([{rows}], recursive := true) FROM c"


def _permutation_sql() -> str:
    """Places of the fields, taken one after another from a list."""
    out = "SELECT *, [0, 1, 2, 3, 4, 5] AS left0 FROM customer"
    for i, d in enumerate([*_DIGITS, "0"]):
        out = f"SELECT *, left{i}[{d} + 1] AS p{i}, list_concat(left{i}[:{d}], left{i}[{d} + 2:]) AS left{i + 1} FROM ({out})"
    return out


#: All subsets of the matched fields; the largest ascending one, then that of the earliest fields.
_CHANGES_SQL = f"""WITH c AS ({_permutation_sql()}),
a AS (SELECT * FROM ({_cells_sql(_VALUES, [str(i) for i in range(6)])}) WHERE NOT (f = 'code' AND c_custkey % 4 = 0) AND c_custkey % 97 <> 0),
b AS (SELECT * FROM ({_cells_sql(_EDITED, [f"p{i}" for i in range(6)])}) WHERE NOT (f = 'balance' AND c_custkey % 6 = 0) AND c_custkey % 89 <> 0),
matched AS (SELECT a.c_custkey, list(b.p ORDER BY a.p) AS places, list(a.f ORDER BY a.p) AS names FROM a JOIN b ON a.c_custkey = b.c_custkey AND a.f = b.f GROUP BY 1),
subsets AS (SELECT c_custkey, names, places, list_filter(range(1, len(places) + 1), lambda i: (s >> (i - 1)) & 1 = 1) AS chosen FROM matched, range(0, 64) t(s) WHERE s < 2 ** len(places)),
ascending AS (SELECT *, list_transform(chosen, lambda i: places[i]) AS q FROM subsets),
best AS (SELECT c_custkey, names, chosen FROM ascending WHERE q = list_sort(q) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY len(chosen) DESC, chosen) = 1),
stay AS (SELECT c_custkey, unnest(list_transform(chosen, lambda i: names[i])) AS f FROM best),
d AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.f, b.f) AS field_name, a.v AS old_value, b.v AS new_value, a.p AS op, b.p AS np,
  CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'deleted' WHEN a.v IS DISTINCT FROM b.v THEN 'modified' WHEN stay.f IS NULL THEN 'reordered' ELSE 'unchanged' END AS change_type
  FROM a FULL JOIN b ON a.c_custkey = b.c_custkey AND a.f = b.f LEFT JOIN stay ON stay.c_custkey = a.c_custkey AND stay.f = a.f),
changes AS (SELECT c_custkey, field_name, CASE WHEN field_name IN ('name', 'nation') THEN 'identity' WHEN field_name IN ('balance', 'segment') THEN 'finance' ELSE 'document' END AS section, change_type,
  CASE WHEN change_type = 'unchanged' THEN 'no_change' WHEN field_name IN ('name', 'balance') THEN 'critical' WHEN field_name IN ('nation', 'segment') THEN 'substantive' ELSE 'editorial' END AS significance, old_value, new_value,
  field_name || CASE change_type WHEN 'modified' THEN ' changed from ' || coalesce(old_value, 'nothing') || ' to ' || coalesce(new_value, 'nothing') WHEN 'reordered' THEN ' moved from place ' || op || ' to ' || np
    WHEN 'unchanged' THEN ' is unchanged' ELSE ' was ' || change_type END AS description FROM d)"""


@query(f"{_CHANGES_SQL} SELECT * FROM changes")
def ordered_diff(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(
    f"""{_CHANGES_SQL} SELECT section, {", ".join(f"count(*) FILTER (change_type = '{c}') AS {c}" for c in V.CHANGES)}, count(*) AS fields,
round(count(*) FILTER (change_type <> 'unchanged') * 100 / count(*), 1) AS heat FROM changes GROUP BY section"""
)
def change_heat_map(spark, sf_dir):
    return V.heat_map(_changes(spark, sf_dir))


@query(
    f"""{_CHANGES_SQL} SELECT c_custkey, count(*) AS total_fields_compared, count(*) FILTER (change_type IN ('modified', 'reordered')) AS fields_changed, count(*) FILTER (change_type = 'added') AS fields_added,
count(*) FILTER (change_type = 'deleted') AS fields_deleted, count(*) FILTER (change_type = 'unchanged') AS fields_unchanged, count(*) FILTER (significance = 'critical') AS critical_changes,
count(*) FILTER (significance = 'substantive') AS substantive_changes, count(*) FILTER (significance = 'editorial') AS editorial_changes FROM changes GROUP BY 1"""
)
def comparison_results(spark, sf_dir):
    return V.results(_changes(spark, sf_dir), "c_custkey")


# ---------------------------------------------------------------- completeness


def _flags(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN -o_custkey ELSE o_custkey END").alias("customer"),
        F.expr("CASE WHEN o_orderkey % 30 = 7 THEN '  ' WHEN o_orderkey % 30 = 8 THEN '?' ELSE o_orderstatus END").alias("status"), F.col("o_totalprice").alias("price"),
        F.expr("CASE WHEN o_orderkey % 40 = 3 THEN '' ELSE o_orderpriority END").alias("priority"), F.year("o_orderdate").alias("year"),
    )
    fields = [
        K.Field("customer", "party", "critical", "Customer"), K.Field("status", "order", "major", valid=F.col("status").isin("O", "F", "P")),
        K.Field("price", "order", "critical", "Total price", F.col("price") > 0), K.Field("priority", "order", "minor", required=False), K.Field("year", "order", "info"),
    ]
    denials = [
        K.Denial("price", "inconsistent", "a closed order under 2000", (F.col("status") == "F") & (F.col("price") < 2000)),
        K.Denial("price", "warning", "unusually high", F.col("price") > 450000),
        K.Denial("status", "warning", "still open after 1998", (F.col("status") == "O") & (F.col("year") < 1999)),
    ]
    customer = table(spark, sf_dir, "customer")
    return K.flags(orders, "o_orderkey", fields, denials, [K.Dependency(("customer",), "priority"), K.Dependency(("customer", "year"), "status")], [K.Reference("customer", customer, "c_custkey")])


_FLAGS_SQL = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN -o_custkey ELSE o_custkey END AS customer,
  CASE WHEN o_orderkey % 30 = 7 THEN '  ' WHEN o_orderkey % 30 = 8 THEN '?' ELSE o_orderstatus END AS status, o_totalprice AS price,
  CASE WHEN o_orderkey % 40 = 3 THEN '' ELSE o_orderpriority END AS priority, year(o_orderdate) AS year FROM orders),
e AS (SELECT o.*,
  (SELECT p.priority FROM o p WHERE p.customer = o.customer AND trim(p.priority) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS ep,
  (SELECT p.status FROM o p WHERE p.customer = o.customer AND p.year = o.year AND trim(p.status) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS es FROM o),
f AS (SELECT o_orderkey, unnest([
  {'field_id': 'customer', 'field_label': 'Customer', 'section': 'party', 'severity': 'critical', 'value': customer::VARCHAR, 'expected': NULL,
   'm': CASE WHEN customer IS NULL THEN 'missing|has no value' WHEN customer NOT IN (SELECT c_custkey FROM customer) THEN 'inconsistent|is not among c_custkey' ELSE 'ok|' END},
  {'field_id': 'status', 'field_label': 'status', 'section': 'order', 'severity': 'major', 'value': status, 'expected': CASE WHEN trim(status) <> '' AND status IN ('O', 'F', 'P') AND status <> es THEN es END,
   'm': CASE WHEN trim(status) = '' THEN 'missing|has no value' WHEN status NOT IN ('O', 'F', 'P') THEN 'invalid|fails its test' WHEN status <> es THEN 'inconsistent|differs from other records of equal customer, year'
     WHEN status = 'O' AND year < 1999 THEN 'warning|still open after 1998' ELSE 'ok|' END},
  {'field_id': 'price', 'field_label': 'Total price', 'section': 'order', 'severity': 'critical', 'value': NULL, 'expected': NULL,
   'm': CASE WHEN price <= 0 THEN 'invalid|fails its test' WHEN status = 'F' AND price < 2000 THEN 'inconsistent|a closed order under 2000' WHEN price > 450000 THEN 'warning|unusually high' ELSE 'ok|' END},
  {'field_id': 'priority', 'field_label': 'priority', 'section': 'order', 'severity': 'minor', 'value': priority, 'expected': CASE WHEN trim(priority) <> '' AND priority <> ep THEN ep END,
   'm': CASE WHEN trim(priority) <> '' AND priority <> ep THEN 'inconsistent|differs from other records of equal customer' ELSE 'ok|' END},
  {'field_id': 'year', 'field_label': 'year', 'section': 'order', 'severity': 'info', 'value': year::VARCHAR, 'expected': NULL, 'm': 'ok|'}], recursive := true) FROM e),
flags AS (SELECT * EXCLUDE (m), split_part(m, '|', 1) AS status, split_part(m, '|', 2) AS message FROM f)"""
_TOTALS_SQL = "count(*) AS total_fields, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {n}_fields" for s, n in (("ok", "complete"), ("missing", "missing"), ("invalid", "invalid"), ("inconsistent", "inconsistent"), ("warning", "warning"))
) + ", round(count(*) FILTER (status = 'ok') * 100 / count(*), 1) AS completeness_score"


@query(f"{_FLAGS_SQL} SELECT * FROM flags")
def constraint_flags(spark, sf_dir):
    # Texts of floating-point numbers differ between engines; the price is compared through its flags.
    return _flags(spark, sf_dir).withColumn("value", F.when(F.col("field_id") != "price", F.col("value")))


@query(f"{_FLAGS_SQL} SELECT o_orderkey, {_TOTALS_SQL} FROM flags GROUP BY 1")
def completeness_results(spark, sf_dir):
    return K.results(_flags(spark, sf_dir), "o_orderkey")


@query(f"{_FLAGS_SQL} SELECT section, severity, {_TOTALS_SQL} FROM flags GROUP BY 1, 2")
def completeness_sections(spark, sf_dir):
    return K.results(_flags(spark, sf_dir), "section", "severity")
