"""Strict entity-level evaluation: exact (start, end, entity) matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scores() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def by_entity(found: DataFrame, id_col: str, spans: str = "spans", truth: str = "truth") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each entity.

    Both sets are compared inside each row, so nothing but counts is shuffled.
    """
    def keys(column: str) -> Column:
        return F.array_distinct(F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"))))

    sets = found.select(keys(spans).alias("p"), keys(truth).alias("t"))

    def marked(values: Column, kind: str) -> Column:
        return F.transform(values, lambda k: F.struct(k["entity"].alias("entity"), F.lit(kind).alias("kind")))

    rows = sets.select(
        F.explode(F.concat(marked(F.array_intersect("p", "t"), "tp"), marked(F.array_except("p", "t"), "fp"), marked(F.array_except("t", "p"), "fn"))).alias("r")
    ).select("r.*")
    counts = rows.groupBy("entity").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    return counts.select("entity", "tp", "fp", "fn", *[F.round(s, 4).alias(n) for s, n in zip(_scores(), ("precision", "recall", "f1"), strict=True)])


def micro_macro(entities: DataFrame) -> DataFrame:
    """Two rows: micro (from totals) and macro (plain mean over entities)."""
    micro = entities.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro").alias("kind"), *_scores())
    macro = entities.select(*_scores()).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("macro").alias("kind"), "precision", "recall", "f1")
    return micro.union(macro).select("kind", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])
