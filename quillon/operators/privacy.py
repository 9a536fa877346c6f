"""Tabular privacy: metrics, enforcement, generalisation hierarchies and noise.

Null quasi-identifiers form a class of their own; l-diversity counts non-null values only;
t-closeness treats null as a value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import patterns as P


def _check(qi: Sequence[str]) -> None:
    if not qi:
        raise ValueError("at least one quasi-identifier is needed")


def class_sizes(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    _check(qi)
    return df.groupBy(*qi).agg(F.count("*").alias("size"))


def k_anonymity(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    return class_sizes(df, qi).agg(F.coalesce(F.min("size"), F.lit(0)).alias("k"))


def k_anonymity_if_known(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """One row (k, missing): k is null where ``df`` lacks a quasi-identifier, as ``missing`` names, or none is given."""
    missing = [c for c in qi if c not in df.columns]
    named = F.lit(missing) if missing else F.array().cast("array<string>")
    if missing or not qi:
        return df.sparkSession.range(1).select(F.lit(None).cast("long").alias("k"), named.alias("missing"))
    return k_anonymity(df, qi).select("k", named.alias("missing"))


def l_diversity(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    _check(qi)
    per_class = df.groupBy(*qi).agg(F.count_distinct(sensitive).alias("n"))
    return per_class.agg(F.coalesce(F.min("n"), F.lit(0)).alias("l"))


def distribution(df: DataFrame, sensitive: str) -> DataFrame:
    """value, share; the few distinct values are counted before the window sees them."""
    counts = df.groupBy(F.col(sensitive).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("share"))


def class_distances(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    """(qi..., distance): total variation of each class against the whole table.

    Half the sum of |p - q| over all values equals the sum of the positive parts of
    p - q, which only values that occur in the class can have: no class is paired with
    values that it lacks.
    """
    _check(qi)
    counts = df.groupBy(*qi, F.col(sensitive).alias("__v")).agg(F.count("*").alias("__n"))
    sizes = counts.groupBy(*qi).agg(F.sum("__n").alias("__size"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__q_{c}")) for c in qi])
    shares = counts.join(sizes.withColumnsRenamed({c: f"__q_{c}" for c in qi}), on).select(*qi, "__v", (F.col("__n") / F.col("__size")).alias("__p"))
    whole = distribution(df, sensitive).withColumnsRenamed({"value": "__w", "share": "__g"})
    gaps = shares.join(whole, F.col("__v").eqNullSafe(F.col("__w")))
    return gaps.groupBy(*qi).agg(F.sum(F.greatest(F.col("__p") - F.col("__g"), F.lit(0.0))).alias("distance"))


def t_closeness(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    return class_distances(df, qi, sensitive).agg(F.coalesce(F.max("distance"), F.lit(0.0)).alias("t"))


def equivalence_classes(df: DataFrame, qi: Sequence[str], row_id: str) -> DataFrame:
    _check(qi)
    return df.groupBy(*qi).agg(F.count("*").alias("size"), F.sort_array(F.collect_list(row_id)).alias("record_ids"))


def class_summary(df: DataFrame, qi: Sequence[str], sensitive: str | None = None) -> DataFrame:
    extra = [F.count_distinct(sensitive).alias("__d")] if sensitive else []
    classes = df.groupBy(*qi).agg(F.count("*").alias("size"), *extra)
    diversity = [F.min("__d").alias("min_diversity"), F.max("__d").alias("max_diversity")] if sensitive else []
    return classes.agg(
        F.count("*").alias("num_classes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.round(F.avg("size"), 2).alias("avg_size"), F.sum("size").alias("total"), *diversity,
    )


def discernability(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    square = F.sum((F.col("size") * F.col("size")).cast("double"))
    return class_sizes(df, qi).agg(F.coalesce(square, F.lit(0.0)).alias("dm"))


def cavg(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    square, n = F.sum((F.col("size") * F.col("size")).cast("double")), F.sum("size")
    return class_sizes(df, qi).agg(F.coalesce(F.round(square / n, 4), F.lit(0.0)).alias("cavg"))


def ncp(original: DataFrame, anonymised: DataFrame, row_id: str, qi: Sequence[str]) -> DataFrame:
    """Normalised certainty penalty over the numeric quasi-identifiers of ``original``."""
    numeric = [c for c in qi if isinstance(original.schema[c].dataType, T.NumericType)]
    if not numeric:
        return original.sparkSession.createDataFrame([(0.0,)], "ncp double")
    pairs = original.select(row_id, *[F.col(c).cast("double").alias(f"__o_{c}") for c in numeric]).join(anonymised.select(row_id, *[F.col(c).alias(f"__a_{c}") for c in numeric]), row_id)
    total = pairs.agg(F.count("*").alias("__n"), *[(F.max(f"__o_{c}") - F.min(f"__o_{c}")).alias(f"__r_{c}") for c in numeric])
    parts = []
    for c in numeric:
        groups = pairs.groupBy(f"__a_{c}").agg((F.max(f"__o_{c}") - F.min(f"__o_{c}")).alias("__range"), F.count("*").alias("__size"))
        loss = groups.join(F.broadcast(total)).agg(F.sum(F.when(F.col(f"__r_{c}") > 0, F.col("__range") / F.col(f"__r_{c}") * F.col("__size") / F.col("__n"))).alias("loss"))
        parts.append(loss)
    return reduce(DataFrame.unionAll, parts).agg(F.coalesce(F.round(F.avg("loss"), 4), F.lit(0.0)).alias("ncp"))


def privacy_report(df: DataFrame, qi: Sequence[str], sensitive: str | None = None) -> DataFrame:
    """One row of all metrics."""
    parts = [k_anonymity(df, qi), class_summary(df, qi), discernability(df, qi), cavg(df, qi)]
    if sensitive:
        parts += [l_diversity(df, qi, sensitive), t_closeness(df, qi, sensitive).select(F.round("t", 4).alias("t"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # all of one row


def hipaa_coverage(entities: DataFrame, entity_col: str = "entity") -> DataFrame:
    """covered, missing, covered_count, total, coverage_pct."""
    pairs = [F.lit(x) for item in P.HIPAA_OF.items() for x in item]
    every = F.lit(P.HIPAA_CATEGORIES)
    found = entities.agg(F.sort_array(F.collect_set(F.element_at(F.create_map(*pairs), F.col(entity_col)))).alias("covered"))
    return found.select(
        "covered", F.array_except(every, F.col("covered")).alias("missing"), F.size("covered").alias("covered_count"), F.lit(len(P.HIPAA_CATEGORIES)).alias("total"),
        F.round(F.size("covered") / F.lit(len(P.HIPAA_CATEGORIES)) * 100, 1).alias("coverage_pct"),
    )


# ---------------------------------------------------------------- enforcement


def _without(df: DataFrame, bad: DataFrame, qi: Sequence[str]) -> DataFrame:
    named = bad.select(*[F.col(c).alias(f"__b_{c}") for c in qi])
    return df.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in qi]), "left_anti")


def enforce_l_diversity(df: DataFrame, qi: Sequence[str], sensitive: str, l: int = 2) -> DataFrame:  # noqa: E741
    return _without(df, df.groupBy(*qi).agg(F.count_distinct(sensitive).alias("__n")).where(F.col("__n") < l), qi)


def enforce_t_closeness(df: DataFrame, qi: Sequence[str], sensitive: str, t: float = 0.3) -> DataFrame:
    """Classes strictly beyond ``t`` go; the whole-table distribution is that before."""
    return _without(df, class_distances(df, qi, sensitive).where(F.col("distance") > t), qi)


# ---------------------------------------------------------------- hierarchies


def _age(level: int, c: Column) -> Column:
    n = c.cast("string").try_cast("int")
    low = (F.floor(n / 10) * 10).cast("int")
    made = [F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")), F.when(n < 50, "<50").otherwise("50+"), F.lit("*")][level - 1]
    return F.when(n.isNull(), F.lit("*")).otherwise(made)


def _date(level: int, c: Column) -> Column:
    text = c.cast("string")
    decade = F.when(F.length(text) >= 4, F.concat(F.substring(text, 1, 3), F.lit("0s"))).otherwise("*")
    return [F.substring(text, 1, 7), F.substring(text, 1, 4), decade][level - 1]


def _location(level: int, c: Column) -> Column:
    return F.lit(["[CITY]", "[STATE]", "INDIA"][level - 1])


def _gender(level: int, c: Column) -> Column:
    return F.lit("*")


def _zip(level: int, c: Column) -> Column:
    text = c.cast("string")
    n = F.length(text)
    first = F.when(n >= 3, F.concat(F.substring(text, 1, 3), F.repeat(F.lit("*"), n - 3))).otherwise("******")
    second = F.when(n >= 1, F.concat(F.substring(text, 1, 1), F.repeat(F.lit("*"), n - 1))).otherwise("******")
    return [first, second, F.lit("******")][level - 1]


#: name -> (number of levels, highest function, function of (level, column))
HIERARCHIES: dict[str, tuple[int, int, Callable[[int, Column], Column]]] = {
    **dict.fromkeys(["age"], (4, 3, _age)),
    **dict.fromkeys(["date", "date_of_birth", "dob"], (4, 3, _date)),
    **dict.fromkeys(["location", "city", "address"], (4, 3, _location)),
    **dict.fromkeys(["gender", "sex"], (2, 1, _gender)),
    **dict.fromkeys(["zip_code", "pin_code", "postal_code"], (4, 3, _zip)),
}


def generalise_level(c: Column, hierarchy: str, level: int) -> Column:
    """Level 0 and below keep the value; beyond the top is the top."""
    _, top, f = HIERARCHIES[hierarchy.lower()]
    return c.cast("string") if level <= 0 else f(min(level, top), c)


def level_loss(hierarchy: str, level: int) -> float:
    levels, _, _ = HIERARCHIES[hierarchy.lower()]
    return min(1.0, level / (levels - 1)) if levels > 1 else 0.0


def minimum_levels(df: DataFrame, qi: dict[str, str], target: int = 5, rounds: int = 20) -> tuple[dict[str, int], int]:
    """Levels of each quasi-identifier (column -> hierarchy) and the k that they reach.

    Each round is one aggregate over counts of the distinct combinations, which are
    computed once; the column with most distinct current values goes up next.
    """
    base = df.groupBy(*qi).agg(F.count("*").alias("__n")).persist()
    levels, k = dict.fromkeys(qi, 0), 0
    try:
        for _ in range(rounds):
            now = base.select("__n", *[generalise_level(F.col(c), h, levels[c]).alias(c) for c, h in qi.items()])
            classes = now.groupBy(*qi).agg(F.sum("__n").alias("__n"))
            row = classes.agg(F.coalesce(F.min("__n"), F.lit(0)).alias("k"), *[F.count_distinct(c).alias(c) for c in qi]).first()
            k = row["k"]
            open_columns = [c for c, h in qi.items() if levels[c] < HIERARCHIES[h][0] - 1]
            if k >= target or not open_columns:
                break
            levels[max(open_columns, key=lambda c: row[c])] += 1
    finally:
        base.unpersist()
    return levels, k


def laplace_noise(df: DataFrame, columns: Sequence[str], epsilon: float, sensitivity: float = 1.0, seed: int | None = None) -> DataFrame:
    """Noise of scale sensitivity / epsilon on numeric columns; integers are rounded back."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        if not isinstance(kind, T.NumericType):
            continue
        u = (F.rand(seed + i) if seed is not None else F.rand()) - 0.5
        noisy = F.col(c).cast("double") - F.lit(sensitivity / epsilon) * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))
        df = df.withColumn(c, F.round(noisy).cast(kind) if isinstance(kind, T.IntegralType) else noisy.cast(kind))
    return df
