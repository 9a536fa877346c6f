"""Privacy queries over lineitem, customer and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import detect as D
from quillon.operators import privacy as V
from quillon.plans.detection import DETECTED, detected, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


QI, SA = ["l_returnflag", "l_linestatus"], "l_quantity"
_Q = ", ".join(QI)
_SIZES = f"WITH s AS (SELECT {_Q}, count(*) AS size, count(DISTINCT {SA}) AS d FROM lineitem GROUP BY {_Q})"
_DIST = f"""WITH c AS (SELECT {_Q}, {SA} AS v, count(*) AS n FROM lineitem GROUP BY {_Q}, {SA}),
p AS (SELECT {_Q}, v, n / sum(n) OVER (PARTITION BY {_Q}) AS p FROM c), g AS (SELECT {SA} AS v, count(*) / (SELECT count(*) FROM lineitem) AS g FROM lineitem GROUP BY {SA}),
k AS (SELECT DISTINCT {_Q} FROM lineitem),
d AS (SELECT k.l_returnflag, k.l_linestatus, sum(abs(coalesce(p.p, 0) - g.g)) / 2 AS distance FROM k CROSS JOIN g LEFT JOIN p ON p.l_returnflag = k.l_returnflag AND p.l_linestatus = k.l_linestatus AND p.v = g.v GROUP BY 1, 2)"""


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query(f"{_SIZES} SELECT min(size) AS k FROM s")
def k_anonymity(spark, sf_dir):
    return V.k_anonymity(items(spark, sf_dir), QI)


@query(f"{_SIZES} SELECT min(size) AS k, []::VARCHAR[] AS missing FROM s UNION ALL SELECT NULL, ['l_region']")
def k_anonymity_if_known(spark, sf_dir):
    rows = items(spark, sf_dir)
    return V.k_anonymity_if_known(rows, QI).unionByName(V.k_anonymity_if_known(rows, [*QI, "l_region"]))


@query(f"{_SIZES} SELECT min(d) AS l FROM s")
def l_diversity(spark, sf_dir):
    return V.l_diversity(items(spark, sf_dir), QI, SA)


@query(f"{_DIST} SELECT round(max(distance), 8) AS t FROM d")
def t_closeness(spark, sf_dir):
    return V.t_closeness(items(spark, sf_dir), QI, SA).select(F.round("t", 8).alias("t"))


@query(f"{_DIST} SELECT {_Q}, round(distance, 8) AS distance FROM d")
def class_distances(spark, sf_dir):
    return V.class_distances(items(spark, sf_dir), QI, SA).select(*QI, F.round("distance", 8).alias("distance"))


@query("SELECT l_returnflag AS value, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1")
def sa_distribution(spark, sf_dir):
    return V.distribution(items(spark, sf_dir), "l_returnflag")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS size, list(c_custkey ORDER BY c_custkey) AS record_ids FROM customer GROUP BY 1, 2")
def equivalence_classes(spark, sf_dir):
    return V.equivalence_classes(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query(f"{_SIZES} SELECT count(*) AS num_classes, min(size) AS min_size, max(size) AS max_size, round(avg(size), 2) AS avg_size, sum(size)::BIGINT AS total, min(d) AS min_diversity, max(d) AS max_diversity FROM s")
def class_summary(spark, sf_dir):
    return V.class_summary(items(spark, sf_dir), QI, SA)


@query(f"{_SIZES} SELECT sum((size * size)::DOUBLE) AS dm FROM s")
def discernability(spark, sf_dir):
    return V.discernability(items(spark, sf_dir), QI)


@query(f"{_SIZES} SELECT round(sum((size * size)::DOUBLE) / sum(size), 4) AS cavg FROM s")
def cavg(spark, sf_dir):
    return V.cavg(items(spark, sf_dir), QI)


@query(
    """WITH p AS (SELECT o_orderkey, o_custkey::DOUBLE AS a, floor(o_custkey / 10) AS x, o_totalprice::DOUBLE AS b, floor(o_totalprice / 1000) AS y FROM orders),
t AS (SELECT count(*) AS n, max(a) - min(a) AS ra, max(b) - min(b) AS rb FROM p),
l AS (SELECT sum(r / ra * s / n) AS loss FROM (SELECT x, max(a) - min(a) AS r, count(*) AS s FROM p GROUP BY x), t UNION ALL SELECT sum(r / rb * s / n) FROM (SELECT y, max(b) - min(b) AS r, count(*) AS s FROM p GROUP BY y), t)
SELECT round(avg(loss), 4) AS ncp FROM l"""
)
def ncp(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    coarse = orders.select("o_orderkey", F.floor(F.col("o_custkey") / 10).alias("o_custkey"), F.floor(F.col("o_totalprice") / 1000).alias("o_totalprice"))
    return V.ncp(orders, coarse, "o_orderkey", ["o_custkey", "o_totalprice", "o_orderstatus"])


@query(
    f"""{_DIST}, s AS (SELECT {_Q}, count(*) AS size, count(DISTINCT {SA}) AS dd FROM lineitem GROUP BY {_Q})
SELECT min(size) AS k, count(*) AS num_classes, min(size) AS min_size, max(size) AS max_size, round(avg(size), 2) AS avg_size, sum(size)::BIGINT AS total,
  sum((size * size)::DOUBLE) AS dm, round(sum((size * size)::DOUBLE) / sum(size), 4) AS cavg, min(dd) AS l, (SELECT round(max(distance), 4) FROM d) AS t FROM s"""
)
def privacy_report(spark, sf_dir):
    return V.privacy_report(items(spark, sf_dir), QI, SA)


@query(
    f"""{DETECTED}, m(entity, category) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in V.P.HIPAA_OF.items())}), c AS (SELECT list_sort(list(DISTINCT category)) AS covered FROM resolved JOIN m USING (entity))
SELECT covered, list_filter([{", ".join(repr(x) for x in V.P.HIPAA_CATEGORIES)}], lambda x: NOT list_contains(covered, x)) AS missing, len(covered)::INT AS covered_count, 18 AS total, round(len(covered) / 18 * 100, 1) AS coverage_pct FROM c"""
)
def hipaa_coverage(spark, sf_dir):
    return V.hipaa_coverage(D.entity_counts(detected(spark, sf_dir)))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 5)")
def enforce_l(spark, sf_dir):
    return V.enforce_l_diversity(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", 5)


@query(
    """WITH c AS (SELECT c_nationkey q, c_mktsegment v, count(*) n FROM customer GROUP BY 1, 2), p AS (SELECT q, v, n / sum(n) OVER (PARTITION BY q) p FROM c),
g AS (SELECT c_mktsegment v, count(*) / (SELECT count(*) FROM customer) g FROM customer GROUP BY 1),
d AS (SELECT k.q, sum(abs(coalesce(p, 0) - g)) / 2 t FROM (SELECT DISTINCT q FROM c) k CROSS JOIN g LEFT JOIN p ON p.q = k.q AND p.v = g.v GROUP BY 1)
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer JOIN d ON q = c_nationkey WHERE t <= 0.2"""
)
def enforce_t(spark, sf_dir):
    return V.enforce_t_closeness(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", 0.2)


@query(
    """WITH b AS (SELECT c_custkey, (c_custkey % 90)::INT AS age, lpad((c_custkey * 37 % 1000000)::VARCHAR, 6, '1') AS pin FROM customer)
SELECT c_custkey, (age // 10 * 10) || '-' || (age // 10 * 10 + 9) AS age1, CASE WHEN age < 50 THEN '<50' ELSE '50+' END AS age2, '*' AS age3,
  pin[1:3] || '***' AS zip1, pin[1:1] || '*****' AS zip2, '******' AS zip3, '[CITY]' AS city1, 'INDIA' AS city9, '*' AS gender1 FROM b"""
)
def generalise_levels(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("int").alias("age"), F.lpad((F.col("c_custkey") * 37 % 1000000).cast("string"), 6, "1").alias("pin"))
    g = V.generalise_level
    return b.select(
        "c_custkey", *[g(F.col("age"), "age", i).alias(f"age{i}") for i in (1, 2, 3)], *[g(F.col("pin"), "pin_code", i).alias(f"zip{i}") for i in (1, 2, 3)],
        g(F.col("pin"), "city", 1).alias("city1"), g(F.col("pin"), "city", 9).alias("city9"), g(F.col("pin"), "sex", 1).alias("gender1"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS d1, strftime(o_orderdate, '%Y') AS d2, strftime(o_orderdate, '%Y')[1:3] || '0s' AS d3 FROM orders")
def generalise_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return o.select("o_orderkey", *[V.generalise_level(F.col("d"), "dob", i).alias(f"d{i}") for i in (1, 2, 3)])


@query("SELECT * FROM (VALUES ('age', 0, 0.0::DOUBLE), ('age', 1, 1 / 3), ('age', 3, 1.0), ('age', 7, 1.0), ('gender', 1, 1.0)) v(hierarchy, level, loss)")
def level_loss(spark, sf_dir):
    rows = [(h, i, V.level_loss(h, i)) for h, i in (("age", 0), ("age", 1), ("age", 3), ("age", 7), ("gender", 1))]
    return spark.createDataFrame(rows, "hierarchy string, level int, loss double")


@query()
def minimum_level_search(spark, sf_dir):
    """Levels and the k reached; tested against a plain Python search."""
    people = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 90).alias("age"), F.lpad((F.col("c_custkey") * 37 % 1000000).cast("string"), 6, "1").alias("pin_code"))
    levels, k = V.minimum_levels(people, {"age": "age", "pin_code": "pin_code"}, 5)
    return spark.createDataFrame([(c, level, int(k)) for c, level in levels.items()], "qi string, level int, k long")


@query()
def laplace_noise(spark, sf_dir):
    """Random by nature: rows and schema only; its distribution is tested."""
    return V.laplace_noise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 1.0, seed=7)
