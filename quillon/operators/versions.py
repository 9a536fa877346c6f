"""Comparison of two versions of documents field by field, with order and a heat map.

Fields of both versions are matched by name.  Of the matched fields, those on a longest
increasing subsequence of the new places (read in the old order) kept their order; an equal field
off it is ``reordered``.  The subsequence is found with patience piles in one fold over the fields
from the last to the first, and read off in a second one; of several longest ones it is the one
that takes the earliest fields.  A changed value counts as modified wherever the field stands.

Defined cases: repeated names of a version count once, at their first place; null values are
equal; ids and names that are null match each other; equal places are ordered by name; a version
without a document has all its fields added or deleted; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = ("added", "deleted", "modified", "reordered", "unchanged")
_SPOT = "struct<old:int,new:int>"


def cells(records: DataFrame, id_col: str, fields: list[str], place: Column | None = None) -> DataFrame:
    """(id, field_name, place, value) of a wide table; ``place`` is an array of places by field, else the order of ``fields``."""
    places = place if place is not None else F.array(*[F.lit(i) for i in range(len(fields))])
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.get(places, F.lit(i)).cast("int").alias("place"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])
    return records.select(id_col, F.explode(each).alias("c")).select(id_col, "c.*")


def kept_in_order(spots: Column) -> Column:
    """Old places of a longest subsequence with ascending new places, from array<struct<old, new>>."""
    ordered = F.reverse(F.array_sort(spots))  # by (old, new), last first
    start = F.struct(F.array().cast("array<int>").alias("tops"), F.array().cast("array<struct<old:int,new:int,rest:int>>").alias("seen"))

    def pile(s: Column, x: Column) -> Column:
        # tops[k]: the largest new place from which k + 1 places ascend; it falls with k.
        k = F.size(F.filter(s["tops"], lambda t: t > x["new"]))
        tops = F.concat(F.slice(s["tops"], 1, k), F.array(x["new"]), F.slice(s["tops"], k + 2, F.size(s["tops"])))
        seen = F.array(F.struct(x["old"].alias("old"), x["new"].alias("new"), (k + 1).alias("rest")))
        return F.struct(tops.alias("tops"), F.concat(seen, s["seen"]).alias("seen"))

    def walk(s: Column) -> Column:
        begin = F.struct(F.size(s["tops"]).alias("need"), F.lit(-2147483648).alias("last"), F.array().cast("array<int>").alias("kept"))
        step = lambda w, x: F.when(
            (x["rest"] == w["need"]) & (x["new"] > w["last"]), F.struct((w["need"] - 1).alias("need"), x["new"].alias("last"), F.concat(w["kept"], F.array(x["old"])).alias("kept"))
        ).otherwise(w)
        return F.aggregate(s["seen"], begin, step, lambda w: w["kept"])

    return F.aggregate(ordered, start, pile, walk)


def compare(old: DataFrame, new: DataFrame, id_col: str, significance: dict[str, str], sections: dict[str, str] | None = None) -> DataFrame:
    """Changes (id, field_name, section, change_type, significance, old_value, new_value, description) of cells (id, field_name, place, value).

    Fields that are not in ``significance`` count as editorial; unchanged ones have no_change.
    Everything is keyed by the document: one exchange.
    """
    kind = old.schema[id_col].dataType
    sides = [side.select(F.col(id_col).cast(kind).alias("id"), "field_name", F.lit(n).alias("side"), F.struct("place", "value").alias("cell")) for n, side in (("old", old), ("new", new))]
    both = sides[0].unionByName(sides[1]).repartition("id")
    first = lambda n: F.min(F.when(F.col("side") == n, F.col("cell")))
    named = both.groupBy("id", "field_name").agg(first("old").alias("old"), first("new").alias("new"))
    docs = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field_name", "old", "new"))).alias("fields"))

    def ranks(side: str) -> Column:
        """Names in the order of a side, so that equal places have an order, too."""
        there = F.filter("fields", lambda f: f["old"].isNotNull() & f["new"].isNotNull())
        return F.transform(F.array_sort(F.transform(there, lambda f: F.struct(f[side]["place"].alias("p"), f["field_name"].alias("n")))), lambda x: F.coalesce(x["n"], F.lit("")))

    docs = docs.withColumn("by_old", ranks("old")).withColumn("by_new", ranks("new"))
    spots = F.transform("by_old", lambda n, i: F.struct(i.alias("old"), (F.array_position(F.col("by_new"), n) - 1).cast("int").alias("new")))
    docs = docs.withColumn("stay", F.transform(kept_in_order(spots), lambda i: F.get(F.col("by_old"), i)))
    rows = docs.select("id", "stay", F.explode("fields").alias("f")).select("id", "stay", "f.*")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old.value").eqNullSafe(F.col("new.value")), "modified")
        .when(~F.array_contains("stay", F.coalesce("field_name", F.lit(""))), "reordered").otherwise("unchanged")
    )
    weight, where = (F.coalesce(F.create_map(*[F.lit(x) for p in m.items() for x in p])[F.col("field_name")], F.lit(other)) if m else F.lit(other) for m, other in ((significance, "editorial"), (sections, "document")))
    shown = lambda c: F.coalesce(c, F.lit("nothing"))
    said = (
        F.when(F.col("change_type") == "modified", F.concat(F.lit(" changed from "), shown(F.col("old.value")), F.lit(" to "), shown(F.col("new.value"))))
        .when(F.col("change_type") == "reordered", F.format_string(" moved from place %d to %d", F.col("old.place"), F.col("new.place")))
        .when(F.col("change_type") == "unchanged", F.lit(" is unchanged")).otherwise(F.concat(F.lit(" was "), F.col("change_type")))
    )
    rows = rows.withColumn("change_type", change)
    return rows.select(
        F.col("id").alias(id_col), "field_name", where.alias("section"), "change_type", F.when(F.col("change_type") == "unchanged", "no_change").otherwise(weight).alias("significance"),
        F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"), F.concat(F.coalesce("field_name", F.lit("")), said).alias("description"),
    )


def heat_map(changes: DataFrame, *keys: str) -> DataFrame:
    """By section: fields, one count for each kind of change, and the share (0 to 100) that is not unchanged."""
    counts = [F.count_if(F.col("change_type") == c).alias(c) for c in CHANGES]
    heat = F.round(F.count_if(F.col("change_type") != "unchanged") * 100 / F.count("*"), 1)
    return changes.groupBy(*keys, "section").agg(*counts, F.count("*").alias("fields"), heat.alias("heat"))


def results(changes: DataFrame, id_col: str) -> DataFrame:
    """Totals of a comparison, one row per document."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    return changes.groupBy(id_col).agg(
        F.count("*").alias("total_fields_compared"), (of("change_type", "modified") + of("change_type", "reordered")).alias("fields_changed"), of("change_type", "added").alias("fields_added"),
        of("change_type", "deleted").alias("fields_deleted"), of("change_type", "unchanged").alias("fields_unchanged"), of("significance", "critical").alias("critical_changes"),
        of("significance", "substantive").alias("substantive_changes"), of("significance", "editorial").alias("editorial_changes"),
    )
