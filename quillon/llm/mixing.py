"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Each source gets a mean repetition rate so that its expected share of the mixture's
characters is its target weight.  A hash of (seed, id) is a uniform draw that inverts the
Poisson distribution with that mean; each document is repeated that often, and the
result is dealt over all partitions by a keyed hash and sorted by it, so neighbours in
the output are unrelated.

Defined cases: a null source is a source of its own; null text counts as empty; a
null id draws by its text; repeated rows draw alike; sources without characters keep
rate 1; a source that is missing from explicit weights gets rate 0; an empty table
gives an empty result; where a column of the input has the name of one that is added, the
added one has underscores appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, free_name, whole_text

#: Most numbers in all sources' distributions together that are broadcast (8 MB).
BROADCAST_NUMBERS = 1_000_000
SEED = "quillon-mix-1"
#: Weight of a source without explicit weights: its characters to this power.
TEMPERATURE = 0.5


def _hash52(*parts: Column) -> Column:
    """Uniform integer below 2^52 from an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(src, chars, rate, cdf): one row per source with its cumulative Poisson probabilities.

    ``budget``: expected characters of the mixture (default: as many as there are).
    """
    sizes = docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(F.length(whole_text(text_col))).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.element_at(F.create_map(*named), F.col("src")), F.lit(0.0)) if named else F.lit(0.0)
        sizes = sizes.withColumn("weight", F.when(F.col("src").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(weight))
    total = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))  # one row
    goal = F.lit(float(budget)) if budget is not None else F.col("all_chars").cast("double")
    rates = sizes.join(F.broadcast(total)).withColumn(
        "rate", F.when(F.col("chars") > 0, F.col("weight") / F.col("all_weight") * goal / F.col("chars")).otherwise(F.lit(1.0))
    )
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    state = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log_p = F.when(k == 0, -F.col("rate")).otherwise(s["log_p"] + F.ln(F.col("rate")) - F.ln(k))
        grown = s["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), grown.alias("sum"), F.concat(s["cdf"], F.array(grown)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(0), last), state, step, lambda s: s["cdf"])
    return rates.select("src", "chars", "rate", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(2.0))).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", added: tuple[str, str, str] = ("__copies", "__copy", "__shuffle_key")) -> DataFrame:
    """Repeated rows of ``docs`` plus the columns ``added``: number of copies, which of them (from 0) and shuffle key."""
    draw_col, src, cdf, rate, copies_col, copy, order = (free_name(docs, x) for x in ("__draw", "__src", "__cdf", "__rate", *added))
    rates = checkpointed(source_rates(docs, weights, budget, source_col, text_col).select(F.col("src").alias(src), "cdf", "rate"))
    numbers = rates.agg(F.sum(F.size("cdf") + 8)).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:  # else a shuffled join, which adaptive execution splits at hot sources
        rates = F.broadcast(rates)
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(whole_text(text_col).cast("binary")))
    draw = (_hash52(F.lit(seed), name).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    # The number of values that the draw exceeds in the cumulative distribution; rate 0 never repeats.
    copies = F.when(F.col(rate) > 0, F.size(F.filter(cdf, lambda c: c < F.col(draw_col)))).otherwise(F.lit(0))
    repeated = (
        docs.withColumn(draw_col, draw)
        .join(rates.withColumnsRenamed({"cdf": cdf, "rate": rate}), F.col(source_col).eqNullSafe(F.col(src)))
        .withColumn(copies_col, copies)
        .where(F.col(copies_col) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies_col) - 1)))
        .withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col(copy)).cast("binary")))
        .drop(draw_col, src, cdf, rate)
    )
    return repeated.repartition(order).sortWithinPartitions(order, F.col(id_col), copy)
