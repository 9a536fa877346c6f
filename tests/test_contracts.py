"""Comparison with order, and completeness under constraints, against brute force."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from quillon.operators import constraints as K
from quillon.operators import versions as V


def slow_kept(places):
    """The largest ascending subset; of several, that of the earliest fields."""
    for size in range(len(places), 0, -1):
        for chosen in itertools.combinations(range(len(places)), size):
            if all(places[a] < places[b] for a, b in itertools.pairwise(chosen)):
                return list(chosen)
    return []


def test_every_order_of_six_fields(spark):
    orders = [list(p) for n in range(7) for p in itertools.permutations(range(n))]
    rng = random.Random(1)
    orders += [rng.sample(range(9), 9) for _ in range(100)]
    rows = spark.createDataFrame([(i, [(k, p) for k, p in rng.sample(list(enumerate(o)), len(o))]) for i, o in enumerate(orders)], "id int, spots array<struct<old:int,new:int>>")
    got = {r.id: r.kept for r in rows.select("id", V.kept_in_order(F.col("spots")).alias("kept")).collect()}
    assert got == {i: slow_kept(o) for i, o in enumerate(orders)}


def test_kinds_of_change(spark):
    old = [(1, "a", 0, "x"), (1, "b", 1, None), (1, "c", 2, "z"), (1, "gone", 3, "1"), (2, "a", 0, "x"), (1, "a", 9, "later"), (4, None, 0, "n")]
    new = [(1, "c", 0, "z"), (1, "a", 1, "x"), (1, "b", 2, None), (1, "more", 3, "2"), (3, "a", 0, "x"), (4, None, 0, "n")]
    kind = "id long, field_name string, place int, value string"
    changes = V.compare(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), "id", {"c": "critical"}, {"a": "top"})
    got = {(r.id, r.field_name): (r.section, r.change_type, r.significance) for r in changes.collect()}
    assert got == {
        (1, "a"): ("top", "unchanged", "no_change"), (1, "b"): ("document", "unchanged", "no_change"), (1, "c"): ("document", "reordered", "critical"), (1, "gone"): ("document", "deleted", "editorial"),
        (1, "more"): ("document", "added", "editorial"), (2, "a"): ("top", "deleted", "editorial"), (3, "a"): ("top", "added", "editorial"), (4, None): ("document", "unchanged", "no_change"),
    }
    assert {r.description for r in changes.where("change_type = 'reordered'").collect()} == {"c moved from place 2 to 0"}
    heat = {r.section: (r.fields, r.reordered, r.heat) for r in V.heat_map(changes).collect()}
    assert heat == {"top": (3, 0, 66.7), "document": (5, 1, 60.0)}
    totals = {r.id: (r.total_fields_compared, r.fields_changed, r.critical_changes) for r in V.results(changes, "id").collect()}
    assert totals == {1: (5, 1, 1), 2: (1, 0, 0), 3: (1, 0, 0), 4: (1, 0, 0)}
    empty = spark.createDataFrame([], kind)
    assert V.compare(empty, empty, "id", {}).count() == 0


def test_flags_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i % 50, rng.choice([None, 1, 2, 3]), rng.choice(["", " ", None, "x", "y", "z"]), rng.choice([None, -1.0, 5.0, 50.0])) for i in range(200)]
    records = spark.createDataFrame(rows, "id int, k int, v string, n double").repartition(3)
    known = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    fields = [K.Field("k", "s", "major"), K.Field("v", "s", "minor", required=False), K.Field("n", "t", "info", "Number", F.col("n") > 0)]
    denials = [K.Denial("n", "warning", "high", F.col("n") > 10), K.Denial("n", "inconsistent", "x is low", (F.col("v") == "x") & (F.col("n") > 10))]
    found = K.flags(records, "id", fields, denials, [K.Dependency(("k",), "v")], [K.Reference("k", known, "k")])
    best = {}
    for k in (1, 2, 3):
        seen = Counter(v for _, g, v, _ in rows if g == k and v and v.strip())
        best[k] = min(seen, key=lambda v: (-seen[v], v))
    wanted = []
    for i, k, v, n in rows:
        wanted.append((i, "k", "missing" if k is None else "ok" if k in (1, 2) else "inconsistent", None))
        off = v and v.strip() and k and v != best[k]
        wanted.append((i, "v", "inconsistent" if off else "ok", best[k] if off else None))
        wanted.append((i, "n", "missing" if n is None else "invalid" if n < 0 else "inconsistent" if n > 10 and v == "x" else "warning" if n > 10 else "ok", None))
    assert sorted(((r.id, r.field_id, r.status, r.expected) for r in found.collect()), key=repr) == sorted(wanted, key=repr)
    totals = K.results(found).first()
    assert (totals.total_fields, totals.complete_fields) == (600, sum(w[2] == "ok" for w in wanted))
    assert K.flags(records.limit(0), "id", fields, denials, [K.Dependency(("k",), "v")], [K.Reference("k", known, "k")]).count() == 0
