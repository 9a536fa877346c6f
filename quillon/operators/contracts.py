"""Capabilities that are known by their results only; the algorithms are this package's choice."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.spans import let
from quillon.operators.kept import cut_lineage

#: Most labelled rows that a severity model is fitted on.
SAMPLE_ROWS = 12_000
#: Documents, and shingles of them, that set the order of prefixes; any order gives the same links.
ORDER_DOCS, ORDER_SHINGLES = 8_000, 1 << 17
#: Blocks of classes, pairs of which are cells; numbers of a table that is broadcast; least number of tasks over cells.
BLOCKS, SENT_NUMBERS, CELL_PARTS = 512, 8_000_000, 64
#: Hashes of words that a task remembers.
KNOWN_WORDS = 500_000
_SPACE = r"[ \t\n\x0b\f\r]+"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def completeness(records: DataFrame, id_col: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Flags (id, field_id, section, severity, status) from rules (field, section, severity, validity)."""
    flags = []
    for field, section, severity, valid in rules:
        blank = F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == "")
        status = F.when(blank, "missing").when(~valid, "invalid").otherwise("ok")
        flags.append(F.struct(F.lit(field).alias("field_id"), F.lit(section).alias("section"), F.lit(severity).alias("severity"), status.alias("status")))
    return records.select(id_col, F.explode(F.array(*flags)).alias("f")).select(id_col, "f.*")


def completeness_scores(flags: DataFrame) -> DataFrame:
    """Section scores from 0 to 100."""
    ok = F.count_if(F.col("status") == "ok")
    return flags.groupBy("section").agg(F.count("*").alias("fields"), ok.alias("ok"), F.round(ok / F.count("*") * 100, 1).alias("score"))


def compare(old: DataFrame, new: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field_name, change_type, significance, old_value, new_value); ``fields`` maps names to significance."""
    def stacked(df: DataFrame, value: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias(value)) for f in fields])
        return df.select(id_col, F.explode(cells).alias("c")).select(id_col, "c.*")

    left, right = stacked(old, "old_value").withColumn("__o", F.lit(1)), stacked(new, "new_value").withColumn("__n", F.lit(1))
    both = left.join(right, [id_col, "field_name"], "full")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("modified")
    pairs = [F.lit(x) for item in fields.items() for x in item]
    return both.select(id_col, "field_name", change.alias("change_type"), F.element_at(F.create_map(*pairs), F.col("field_name")).alias("significance"), "old_value", "new_value")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type", "significance").agg(F.count("*").alias("n"))


def chain_text(changes: DataFrame, id_col: str) -> DataFrame:
    """One ``[significance] field: old -> new`` line per change, as the next module's input."""
    line = F.format_string("[%s] %s: %s -> %s", "significance", "field_name", F.coalesce("old_value", F.lit("")), F.coalesce("new_value", F.lit("")))
    real = changes.where("change_type <> 'unchanged'")
    rows = real.groupBy(id_col).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return rows.select(id_col, F.array_join("lines", "\n").alias("text"))


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, c, s) of (id, text): sorted distinct hashes of the runs of so many words, and a name of that set.

    A text of fewer words is one run, a blank one has none.
    """

    def hashed(h: np.ndarray) -> np.ndarray:
        size = min(words, len(h))
        out = np.full(max(0, len(h) - size + 1) if size else 0, size, np.uint64)
        for k in range(size):
            out = _mixed(out * np.uint64(3) + h[k : len(h) - size + 1 + k])
        return np.unique(out.view(np.int64))

    def word_hashes(texts: pa.Array, known: dict[str, int]) -> list[np.ndarray]:
        found = pc.split_pattern_regex(texts, _SPACE)
        coded = found.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        for w in different:
            if w not in known:
                known[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
        table = np.array([known[w] for w in different], np.uint64)
        code, blank = coded.indices.to_numpy(), pc.index(coded.dictionary, "").as_py()
        ends = found.offsets.to_numpy()
        ends = ends - ends[0]
        parts = [code[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return [table[x[x != blank]] for x in parts]  # blanks stand before a first and after a last separator

    def made(batches):
        known: dict[str, int] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets = [hashed(h) for h in word_hashes(batch.column("text"), known)]
                names = [int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.int64()), values], ["id", "c", "s"])
                if len(known) > KNOWN_WORDS:
                    known = {}

    rows = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(made, f"id {docs.schema['id'].dataType.simpleString()}, c long, s array<long>")


def _frequent(texts: DataFrame, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles of a sample of documents; they only set the order of prefixes."""
    some = texts.where(F.pmod(F.xxhash64(F.lit("order"), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, ORDER_DOCS / max(n, 1))))
    found = _shingle_sets(some, words).select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "t").limit(ORDER_SHINGLES).orderBy("t").toPandas()
    return found["t"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(t, c, n, at, before, block): the rarest shingles of each set, with their place and the shingle before them.

    Two sets within the threshold share a shingle of their prefixes under any order. ``block`` is made
    of a set's smallest hash, which near copies mostly share.
    """

    def cut(batches):
        hashes, counts = frequent
        for batch in batches:
            s, c = batch.column("s"), batch.column("c").to_numpy()
            n = np.diff(s.offsets.to_numpy()).astype(np.int64)
            values = s.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(values), np.int64)
            if len(hashes):
                near = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                rank = np.where(hashes[near] == values, counts[near], 0)
            start, block = np.concatenate([[0], np.cumsum(n)])[:-1], np.zeros(len(n), np.int64)
            block[n > 0] = values[start[n > 0]] % BLOCKS
            values = values[np.lexsort((values, rank, row))]
            at = np.arange(len(values)) - start[row]
            keep = at < (n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)[row]
            before = np.where(at > 0, np.roll(values, 1), 0)
            row, at = row[keep], at[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (values[keep], c[row], n[row].astype(np.int32), at.astype(np.int32), before[keep], block[row].astype(np.int32))], ["t", "c", "n", "at", "before", "block"]
            )

    return rows.select("c", "s").mapInArrow(cut, "t long, c long, n int, at int, before long, block int")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """(id, class_id, links): documents of equal shingle sets are one class; classes within
    the Jaccard threshold are linked by an exact prefix-filtered join.

    ``links`` counts the other classes of at least that similarity. Classes are told apart by 64 bits of a
    digest of their sets. Prefixes are of the rarest shingles; a pair is met where a run of common ones begins
    and passed on if lengths and places leave room for the similarity. Whole sets go to cells, two blocks each, once for
    all pairs of the cell, and only those of classes with candidates.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = _shingle_sets(texts, words)
    keyed = cut_lineage(rows.select("id", "c"))
    classes = keyed.groupBy("c").agg(F.min("id").alias("class_id"))

    index = _prefixes(rows, _frequent(texts, words, keyed.count()), threshold).repartition("t").dropDuplicates(["t", "c"])
    a, b = (index.select("t", *[F.col(x).alias(k + x) for x in ("c", "n", "at", "before", "block")]) for k in "ab")
    least = threshold - 1e-9
    room = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) >= (F.col("an") + F.col("bn")) * (least / (1 + least)) - 1e-6
    begun = (F.col("aat") == 0) | (F.col("bat") == 0) | (F.col("abefore") != F.col("bbefore"))
    near = (F.col("ac") < F.col("bc")) & (F.least("an", "bn") >= F.greatest("an", "bn") * threshold - 1e-9) & room & begun
    cell = F.least("ablock", "bblock").cast("long") * BLOCKS + F.greatest("ablock", "bblock")
    pairs = cut_lineage(a.join(b, "t").where(near).select("ac", "bc", cell.alias("cell")).distinct())

    sent = pairs.select(F.explode(F.array("ac", "bc")).alias("c"), "cell").groupBy("c").agg(F.collect_set("cell").alias("cells"))
    sent = cut_lineage(sent.join(classes, "c").select("class_id", F.col("c").alias("__c"), "cells"))
    if sent.agg(F.coalesce(F.sum(F.size("cells") + 4), F.lit(0))).first()[0] <= SENT_NUMBERS:
        sent = F.broadcast(sent)
    # Of an id that repeats, only the text of the class counts.
    named = _shingle_sets(texts.join(sent.select("class_id"), F.col("id").eqNullSafe(F.col("class_id")), "left_semi"), words)
    held = named.join(sent, (F.col("c") == F.col("__c")) & F.col("id").eqNullSafe(F.col("class_id"))).select(F.explode("cells").alias("cell"), "c", "s")
    spark = docs.sparkSession
    parts = max(CELL_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = held.repartition(parts, "cell")
    x, y = (held.select("cell", F.col("c").alias(f"{k}c"), F.col("s").alias(k)).hint("shuffle_hash") for k in "ab")
    common = F.size(F.array_intersect("a", "b"))
    alike = common / (F.size("a") + F.size("b") - common) >= threshold - 1e-9
    before = spark.conf.get(_ALL_KEYS, "true")
    spark.conf.set(_ALL_KEYS, "false")  # rows of a cell stay where they are for both joins
    try:
        good = cut_lineage(pairs.repartition(parts, "cell").join(x, ["cell", "ac"]).join(y, ["cell", "bc"]).where(alike).select("ac", "bc").distinct())
    finally:
        spark.conf.set(_ALL_KEYS, before)
    degree = good.select(F.explode(F.array("ac", "bc")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    return keyed.join(classes, "c").join(degree, "c", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def priority(serious: Column, severity: Column, age_days: Column) -> Column:
    """0 to 100 from seriousness, severity class and waiting time."""
    level = F.when(severity == "critical", 40).when(severity == "major", 25).otherwise(10)
    return F.least(F.lit(100.0), level + F.when(serious, 30).otherwise(0) + F.least(age_days, F.lit(30.0)))


def label_sample(labels: DataFrame, id_col: str, label_col: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``bound`` rows (id, label) with a label, chosen by a hash of the id.

    The hash threshold is set from the number of rows, so that the final ordered limit
    sees little more than ``bound`` rows at any table size.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col)
    keyed = rows.withColumn("__h", F.pmod(F.xxhash64(F.lit("severity"), id_col), F.lit(1 << 30)))
    n = rows.count()
    if n > bound:
        keyed = keyed.where(F.col("__h") < int((1 << 30) * min(1.0, 1.5 * bound / n)))
    return keyed.orderBy("__h", id_col).limit(bound).select(id_col, label_col)


def severity_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, features: int = 1 << 12, seed: int = 7):
    """A fitted pipeline (hashed words, random forest) for severity classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"\W+"), HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features), IDF(inputCol="__tf", outputCol="features"),
        RandomForestClassifier(labelCol=label_col, numTrees=20, maxDepth=5, seed=seed),
    ]
    return Pipeline(stages=stages).fit(docs.join(labels.select(id_col, label_col), id_col))


def combine_files(files: DataFrame, batch_col: str) -> DataFrame:
    """One result of several files: (scanned, text with separators, total, files)."""
    part = F.concat(F.lit("=== "), F.col("filename"), F.lit(" ===\n"), F.col("text"))
    rows = files.groupBy(batch_col).agg(F.bool_or("is_scanned").alias("is_scanned"), F.array_sort(F.collect_list(F.struct("filename", part.alias("part")))).alias("parts"), F.sum("num_entities").alias("num_entities"), F.count("*").alias("files"))
    return rows.select(batch_col, "is_scanned", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"), "num_entities", "files")
