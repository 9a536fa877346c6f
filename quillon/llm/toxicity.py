"""Toxicity by compression distance with separate zstandard dictionaries.

Two dictionaries are trained on the labelled fold: one on windows of ordinary documents,
one on the fragments of toxic documents whose words mark them (found in far more
different toxic texts than ordinary ones; copies of a passage count once).  Every text is cut into overlapping windows; a window
is compressed with the ordinary dictionary alone and with the toxic one in front of it.
The saved bytes of all windows are summarised (largest, sums of the largest, mean, counts
and shares above two thresholds).  The thresholds are calibrated on ordinary windows that
trained no dictionary, and a logistic calibration on labelled rows that trained none
turns the summary into a score.

Defined cases: null text counts as empty; an empty text is one empty window and is
scored like any other; very long texts are processed window by window; repeated
rows get equal scores; null ids are scored; without labels of both classes the score is
the share of label 1 (0.0 without labels); where an id has both labels it counts as
toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import held_out, labelled_sample, whole_text

#: Most labelled rows used for a fit, windows of ordinary text and marking words collected.
SAMPLE_ROWS, ORDINARY_WINDOWS, MARKS = 12_000, 30_000, 2_000
THRESHOLD = 0.3
WINDOW_WORDS, STEP_WORDS = 5, 3
LEVEL, TOXIC_BYTES, ORDINARY_BYTES = 6, 8192, 8192
#: A word marks toxic text if it is this many times as frequent there and the log-likelihood ratio against equal
#: shares exceeds MARK_EVIDENCE (four different toxic texts and no ordinary one, where a tenth of the texts is toxic).
MARK_RATIO, MARK_EVIDENCE = 6.0, 14.0
#: Shares of ordinary windows that do not save more bytes than a threshold.
QUIET = (0.99, 0.998)
_WORD = re.compile(r"\w+")
_LARGEST = (1 << 63) - 1
_FEATURES = 8


def windows(text: str):
    """Overlapping windows of lower-cased words; every word is in one at least."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    for i in range(0, max(1, len(words) - WINDOW_WORDS + STEP_WORDS), STEP_WORDS):
        yield b" ".join(words[i : i + WINDOW_WORDS])


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """Dictionary content; plain samples where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, k=32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[-size:].rjust(8, b" ")


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    cuts: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[(features - self.mean) / self.scale, np.ones(len(features))] @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def saved_bytes(window: bytes, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> int:
    return len(plain.compress(window)) - len(toxic.compress(window))


def window_features(text: str, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, cuts: tuple[int, ...]) -> list[float]:
    """Summary of the bytes that the toxic dictionary saves in each window."""
    saved = Counter(saved_bytes(w, plain, toxic) for w in windows(text))
    n, largest = sum(saved.values()), []
    for value in sorted(saved, reverse=True):
        largest += [value] * min(saved[value], 8 - len(largest))
    over = [sum(c for v, c in saved.items() if v >= k) for k in cuts]
    total = sum(v * c for v, c in saved.items())
    return [largest[0], sum(largest[:3]), sum(largest), *over, *[c / n for c in over], total / n]


def _thresholds(ordinary: list[bytes], plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[int, ...]:
    """Fewest saved bytes that all but the loudest of ordinary windows stay below."""
    saved = [saved_bytes(w, plain, toxic) for w in ordinary] or [0]
    return tuple(max(1, int(np.quantile(saved, q, method="lower")) + 1) for q in QUIET)


def _features(rows: DataFrame, ordinary: bytes, toxic: bytes, cuts: tuple[int, ...], schema: str) -> DataFrame:
    """``rows`` (text last) with an array of features in place of the text."""
    names = rows.columns[:-1]

    def run(batches):
        plain, other = _compressor(ordinary), _compressor(toxic + ordinary)
        for batch in batches:
            values = [window_features(x.as_py() or "", plain, other, cuts) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))], names=[*names, "features"])

    return rows.mapInArrow(run, schema)


def first_contexts(text: str) -> dict[str, int]:
    """Word -> least hash of its uses with both neighbours; the empty word stands for the whole text.

    Copies of a passage have the same contexts, so that counting distinct ones counts a passage once.
    """
    words, least = _WORD.findall(text.lower()), {"": _LARGEST}
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        h = xxhash.xxh64_intdigest(f"{before} {word} {after}".encode("utf-8", "surrogatepass")) >> 1
        if h < least.get(word, _LARGEST):
            least[word] = h
            least[""] = min(least[""], h)
    return least


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): distinct first contexts of the word in documents of each kind."""

    def run(batches):
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = first_contexts(text.as_py() or "")
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64()), pa.array([int(y == 1)] * n, pa.int64()), pa.array([int(y == 0)] * n, pa.int64())],
                    names=["word", "context", "toxic", "ordinary"],
                )

    parts = rows.mapInArrow(run, "word string, context long, toxic long, ordinary long")
    distinct = parts.groupBy("word", "context").agg(F.max("toxic").alias("toxic"), F.max("ordinary").alias("ordinary"))
    return distinct.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p))[:, None]) / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, z.T @ (p - y) / len(y) + ridge * w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    chosen = labelled_sample(labels, "toxic", sample_rows)
    rows = docs.select(F.col("doc_id").alias("__id"), whole_text("text").alias("text")).join(F.broadcast(chosen), "__id")  # bounded by sample_rows
    calibrates = F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(4)) == 0
    train = rows.where(~calibrates).select("__y", "text", "__id")
    words = F.sum(F.size(F.split("text", r"\s+")).cast("long")).alias("words")
    groups = {r["__y"]: r for r in train.groupBy("__y").agg(F.count(F.lit(1)).alias("n"), words).collect()}
    sizes = {y: r["n"] for y, r in groups.items()}
    constant = ToxicModel(b"ordinary", b"toxic", (1,) * len(QUIET), np.zeros(_FEATURES), np.ones(_FEATURES), np.r_[np.zeros(_FEATURES), -30.0])
    if len(sizes) < 2:
        if sizes:
            constant.weights[-1] = 30.0 if 1 in sizes else -30.0
        return constant
    counts = _word_counts(train).persist()
    whole = counts.where("word = ''").first()
    n1, n0 = whole.toxic, whole.ordinary  # different texts
    toxic, ordinary, share = F.col("toxic"), F.col("ordinary"), n1 / (n1 + n0)
    uses = toxic + ordinary
    evidence = 2 * (toxic * F.ln(toxic / (uses * share)) + F.when(ordinary > 0, ordinary * F.ln(ordinary / (uses * (1 - share)))).otherwise(0.0))
    marks = (
        counts.where((F.col("word") != "") & (toxic > 0) & (toxic / n1 > MARK_RATIO * (ordinary + 0.5) / n0))
        .withColumn("evidence", evidence)
        .where(F.col("evidence") > MARK_EVIDENCE)
        .orderBy(F.desc("evidence"), "word")
        .limit(MARKS)
        .collect()
    )
    counts.unpersist()
    fragments = [f" {r.word} ".encode() for r in marks for _ in range(min(r.toxic, 50))]

    def cut(batches):
        for batch in batches:
            for i, text in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
                found = list(windows(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), batch.schema.field(2).type), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], names=["i", "k", "w"])

    # Windows are drawn by a hash of their place; a threshold set from the number of words keeps what tasks send near the bound.
    share = min(1.0, 1.5 * ORDINARY_WINDOWS * STEP_WORDS / max(1, groups[0]["words"]))
    drawn = F.pmod(F.xxhash64(F.lit("window"), "i", "k"), F.lit(1 << 30))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordinary_windows = train.where("__y = 0").mapInArrow(cut, f"i {kind}, k long, w binary").withColumn("h", drawn).where(F.col("h") <= int(share * (1 << 30)))
    plain = [bytes(r.w) for r in ordinary_windows.orderBy("h", "w").limit(ORDINARY_WINDOWS).collect()]
    ordinary = train_dictionary(plain[::2], ORDINARY_BYTES)
    toxic = train_dictionary(fragments, TOXIC_BYTES) if fragments else b" " * 8
    cuts = _thresholds(plain[1::2], _compressor(ordinary), _compressor(toxic + ordinary))
    seen = _features(rows.where(calibrates).select("__id", "__y", "text"), ordinary, toxic, cuts, f"__id {kind}, __y int, features array<double>").toPandas()
    if not len(seen) or seen["__y"].nunique() < 2:
        return constant
    seen = seen.sort_values("__id", kind="stable")
    return ToxicModel(ordinary, toxic, cuts, *_logistic(np.array(seen["features"].tolist()), seen["__y"].to_numpy(float)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = _features(docs.select("doc_id", whole_text("text").alias("text")), model.ordinary, model.toxic, model.cuts, f"doc_id {kind}, features array<double>")
    mean, scale, weights = model.mean.tolist(), model.scale.tolist(), model.weights.tolist()
    total = F.lit(weights[-1])
    for k in range(_FEATURES):
        total = total + (F.col("features")[k] - F.lit(mean[k])) / F.lit(scale[k]) * F.lit(weights[k])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int")
    )
