"""Typed character spans as array columns: find, resolve, apply.

A span is struct(start, end, entity, text, score, ord): half-open code-point offsets and the
place of its rule, which decides ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.patterns import Rule

SPAN = "struct<start:int,end:int,entity:string,text:string,score:double,ord:int>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, rule: Rule, order: int) -> Column:
    """Spans of all matches; the text is only split where the rule matches at all.

    A rule with a group has its group at the end of the match.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    columns = [F.split(text, rule.java, -1).alias("gap"), matches.alias("whole")]
    if rule.group:
        columns.append(F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)).alias("value"))
    pieces = F.arrays_zip(*columns)
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(s: Column, p: Column) -> Column:
        end, value = s["at"] + F.length(p["gap"]) + F.length(p["whole"]), p["value" if rule.group else "whole"]
        span = F.struct(
            (end - F.length(value)).alias("start"), end.alias("end"), F.lit(rule.entity).alias("entity"), value.alias("text"),
            F.lit(rule.score).alias("score"), F.lit(order).alias("ord"),
        )
        return F.when(p["whole"].isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out")))

    return F.when(text.rlike(rule.java), F.aggregate(pieces, start, step, lambda s: s["out"])).otherwise(no_spans())


def find_rules(text: Column, rules: Iterable[Rule], first: int = 0) -> Column:
    """Spans of several rules, one after another."""
    return F.concat(no_spans(), *[find_all(text, r, first + i) for i, r in enumerate(rules)])


def resolve(spans: Column, cover: bool = False) -> Column:
    """Disjoint spans by a greedy scan in order of (start, longest first).

    A span that overlaps the last kept one replaces it if its (score, length) is greater and
    is dropped otherwise.  ``cover=True`` is a safer variant: the winner also takes over the
    part of the loser that it does not cover.
    """
    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        better = F.struct(s["score"], s["end"] - s["start"]) > F.struct(last["score"], last["end"] - last["start"])
        winner = s
        if cover:
            def wide(span: Column) -> Column:
                return span.withField("start", F.least(s["start"], last["start"])).withField("end", F.greatest(s["end"], last["end"]))

            swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.when(better, wide(s)).otherwise(wide(last))))
            return F.when((F.size(kept) > 0) & (s["start"] < last["end"]), swapped).otherwise(F.concat(kept, F.array(s)))
        return F.when(
            (F.size(kept) > 0) & (s["start"] < last["end"]),
            F.when(better, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(winner))).otherwise(kept),
        ).otherwise(F.concat(kept, F.array(s)))

    def scan(found: Column) -> Column:
        keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), s["ord"].alias("c"), s.alias("s"))))
        return F.when(F.size(found) <= 1, found).otherwise(F.aggregate(F.transform(keyed, lambda k: k["s"]), no_spans(), step))

    return let(spans, scan)


def apply_spans(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """``text`` with each (disjoint, sorted) span replaced by ``new(span)``."""
    def after(i: Column | int) -> Column:
        """Where the span before ends."""
        return F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1

    def piece(x: Column, i: Column) -> Column:
        return F.concat(F.substring(text, after(i), x["start"] + 1 - after(i)), F.coalesce(new(x), F.lit("")))

    rest = F.substring(text, after(F.size(spans)), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(spans, piece), ""), rest))
