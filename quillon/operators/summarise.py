"""Extractive summaries: frequency clusters, latent semantics and sentence graphs.

Written from the published methods (Luhn 1958; Gong and Liu 2001; Erkan and Radev 2004;
Mihalcea and Tarau 2004); scores of other libraries are not reproduced.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X

STOP = frozenset("a an and are as at be been by for from had has have he her his i in is it its of on or she that the their they this to was were which with you".split())
# The shortest text that is summarised, and what is said of a shorter one.
MIN_WORDS, TOO_SHORT = 10, "Text too short — need at least 10 words."
#: Sentences whose word counts are held as a dense block at once.
BLOCK = 256
#: Sentences of a text whose links are held as a matrix (32 MB).
LINKED = 2048
_SPLIT, _WORD = re.compile(r"(?<=[.!?])\s+"), re.compile(r"[^\W\d_]+")


def algorithm(doc_type: Column) -> Column:
    return F.when(doc_type.contains("SAE"), "luhn").when(doc_type.contains("Meeting"), "lexrank").otherwise("lsa")


def split_sentences(text: str) -> list[str]:
    return [s for s in _SPLIT.split(text.strip()) if s]


@lru_cache(1 << 16)
def _stem(word: str) -> str:
    return re.sub(r"(?:ing|edly|ed|ly|es|s)$", "", word) if len(word) > 5 else word


def stems(sentence: str) -> list[str]:
    """Lower-cased content words with common English endings cut."""
    return [_stem(w) for w in _WORD.findall(sentence.lower()) if w not in STOP]


def luhn(bags: list[list[str]]) -> np.ndarray:
    counts = Counter(w for b in bags for w in b)
    least = max(2, np.quantile(list(counts.values()), 0.9)) if counts else 2
    significant = {w for w, n in counts.items() if n >= least}

    def score(bag):
        hits = [i for i, w in enumerate(bag) if w in significant]
        best, cluster = 0.0, []
        for i in hits:
            cluster = [*cluster, i] if cluster and i - cluster[-1] <= 4 else [i]
            best = max(best, len(cluster) ** 2 / (cluster[-1] - cluster[0] + 1))
        return best

    return np.array([score(b) for b in bags])


class _Bags:
    """Word counts of sentences as (sentence, word, count) triples, sorted by sentence."""

    def __init__(self, bags: list[list[str]]):
        index = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
        self.n, self.words = len(bags), max(1, len(index))
        pairs = np.array([i * self.words + index[w] for i, b in enumerate(bags) for w in b], np.int64)
        pairs, counts = np.unique(pairs, return_counts=True)
        self.row, self.word, self.value = pairs // self.words, pairs % self.words, counts.astype(float)
        self.df = np.bincount(self.word, minlength=self.words)
        self.at = np.searchsorted(self.row, np.arange(self.n + 1))

    def dense(self, first: int, last: int, values: np.ndarray) -> np.ndarray:
        """Rows first to last - 1."""
        out, cut = np.zeros((last - first, self.words)), slice(self.at[first], self.at[last])
        out[self.row[cut] - first, self.word[cut]] = values[cut]
        return out

    def blocks(self) -> list[tuple[int, int]]:
        return [(i, min(i + BLOCK, self.n)) for i in range(0, self.n, BLOCK)]


def lsa(bags: list[list[str]]) -> np.ndarray:
    """Squared lengths along the strongest topics, from the smaller of the two products of the matrix with itself."""
    b = _Bags(bags)
    m = b.dense(0, b.n, b.value * np.log((1 + b.n) / (1 + b.df) + 1e-9)[b.word])
    size = min(m.shape)
    k = min(size, max(3, size // 3))
    strength, topics = np.linalg.eigh(m @ m.T if b.n <= b.words else m.T @ m)
    if k < size and strength[-k] - strength[-k - 1] < 1e-9 * strength[-1]:
        # Topics of equal strength on both sides of the cut: which of them count is left to the decomposition of the matrix itself.
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        return np.sqrt((u[:, :k] ** 2) @ (s[:k] ** 2))
    squares = (topics[:, -k:] ** 2) @ np.maximum(strength[-k:], 0) if b.n <= b.words else ((m @ topics[:, -k:]) ** 2).sum(axis=1)
    # What the products' rounding leaves of a sentence without a part in these topics is no score.
    return np.sqrt(np.where(squares > 1e-13 * squares.max(), squares, 0))


def _power(n: int, sums: np.ndarray, times, damping: float = 0.85) -> np.ndarray:
    """Ranks of a symmetric graph with row sums ``sums``; ``times(x)`` is its matrix times x."""
    rank, lone = np.full(n, 1 / n), sums <= 0
    for _ in range(100):
        moved = times(np.divide(rank, sums, out=np.zeros(n), where=~lone)) + rank[lone].sum() / n
        new = (1 - damping) / n + damping * moved
        if np.abs(new - rank).sum() < 1e-9:
            break
        rank = new
    return rank


def lexrank(bags: list[list[str]], threshold: float = 0.1) -> np.ndarray:
    """Links are made block by block and kept as bits, one for a pair of sentences."""
    b = _Bags(bags)
    values = b.value * (np.log(b.n / np.maximum(1, b.df)) + 1)[b.word]
    values = values / np.sqrt(np.bincount(b.row, values**2, b.n))[b.row]
    links = []
    for first in b.blocks():
        part = b.dense(*first, values)
        links.append(np.packbits(np.hstack([part @ b.dense(*at, values).T > threshold for at in b.blocks()]), axis=1))

    def times(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.unpackbits(rows, axis=1, count=b.n) @ x for rows in links])

    return _power(b.n, times(np.ones(b.n)), times)


def textrank(bags: list[list[str]]) -> np.ndarray:
    """Links are shared words by log lengths; in long texts sentences of one length are summed at once and no pair is stored."""
    b = _Bags(bags)
    lengths, kind = np.unique(np.bincount(b.row, minlength=b.n), return_inverse=True)
    size = np.log(np.maximum(lengths, 1))
    weights = 1 / np.maximum(size[:, None] + size[None], 1e-9)
    if b.n <= LINKED:
        links = np.empty((b.n, b.n))
        for first in b.blocks():
            part = b.dense(*first, np.ones(len(b.row)))
            links[slice(*first)] = np.hstack([part @ b.dense(*at, np.ones(len(b.row))).T for at in b.blocks()])
        links *= weights[kind[:, None], kind[None]]
        np.fill_diagonal(links, 0)
        return _power(b.n, links.sum(axis=1), links.__matmul__)
    groups = [kind[b.row] == g for g in range(len(lengths))]

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros(b.n)
        for g, of in enumerate(groups):
            by_word = np.bincount(b.word[of], x[b.row[of]], b.words)
            # A sentence's own share goes word by word, which leaves an exact 0 where no other has the word.
            out += weights[kind, g] * np.bincount(b.row, by_word[b.word] - np.where(of, x[b.row], 0), b.n)
        return out

    return _power(b.n, times(np.ones(b.n)), times)


METHODS = {"luhn": luhn, "lsa": lsa, "lexrank": lexrank, "textrank": textrank}


def _ranked(found: list[str], method: str) -> np.ndarray:
    """Places of sentences, the best first; of equal scores the earlier one."""
    scores = METHODS[method]([stems(s) for s in found])
    # Rounded, so that sums in another order do not part equal scores.
    return np.argsort(-np.round(scores / max(scores.max(), 1e-12), 9), kind="stable")


def best_sentences(text: str | None, n: int = 8, method: str = "lsa") -> list[str]:
    """The best n sentences in document order, scored over the whole text."""
    return best_of_each([text], [n], method)[0]


def best_of_each(texts: list[str | None], limits: list[int], method: str) -> list[list[str]]:
    """best_sentences of several texts with a limit each; texts of the same sentences are scored once."""
    known, out = {}, []
    for text, n in zip(texts, limits, strict=True):
        found = split_sentences(text or "")
        if len(found) > n:
            key = tuple(found)
            if key not in known:
                known[key] = _ranked(found, method)
            found = [found[i] for i in sorted(known[key][:n].tolist())]
        out.append(found)
    return out


def summarise(docs: DataFrame, id_col: str, text_col: str, n: int = 8, method: str | None = None, type_col: str | None = None) -> DataFrame:
    """id, algorithm, sentences, summary, word_count, sentence_count."""
    chosen = F.lit(method) if method else algorithm(F.col(type_col)) if type_col else F.lit("lsa")

    @F.pandas_udf("array<string>")
    def pick(text: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([best_sentences(t, n, m) for t, m in zip(text, how, strict=True)])

    made = docs.select(id_col, chosen.alias("algorithm"), F.col(text_col).alias("__t")).withColumn("sentences", pick("__t", "algorithm"))
    summary = F.array_join("sentences", " ")
    return made.select(id_col, "algorithm", "sentences", summary.alias("summary"), F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != "")).alias("word_count"), F.size("sentences").alias("sentence_count"))


def section_summaries(docs: DataFrame, id_col: str, sections_col: str, n: int = 3, method: str = "lsa") -> DataFrame:
    """One summary for each section that is not blank."""
    rows = docs.select(id_col, F.explode(sections_col).alias("section", "text")).where(F.trim("text") != "")
    keyed = rows.withColumn("__key", F.struct(id_col, "section"))
    out = summarise(keyed, "__key", "text", n, method)
    return out.select(F.col("__key")[id_col].alias(id_col), F.col("__key.section").alias("section"), "summary", "sentence_count")


def composed(docs: DataFrame, id_col: str, text_col: str, type_col: str, n: int = 8, section_n: int = 3) -> DataFrame:
    """Preparation, sections and summaries of both in one narrow stage.

    id, doc_type, algorithm, summary, key_points, word_count, sentence_count, sections (name -> summary)
    and error: a text of fewer than ten words (null: none) has an error and nothing else.
    """

    def pick(frames):
        for f in frames:
            # A text without headings is its only section, too.
            rows = zip(f.pop("text"), f["parts"], f["algorithm"], strict=True)
            best = [best_of_each([t, *ps], [n, *[section_n] * len(ps)], m) for t, ps, m in rows]
            f["sentences"] = [b[0] for b in best]
            f["parts"] = [[" ".join(p) for p in b[1:]] for b in best]
            yield f

    kind = F.coalesce(F.col(type_col).cast("string"), F.lit(""))
    enough = X.word_count(F.coalesce(F.col(text_col), F.lit(""))) >= MIN_WORDS
    rows = X.prepared(docs.select(id_col, kind.alias("doc_type"), enough.alias("__enough"), F.when(enough, F.col(text_col)).otherwise("").alias("__raw")), "__raw", "__text")
    rows = rows.withColumn("sections", X.sections(F.col("__text"))).select(
        F.col(id_col).alias("id"), "doc_type", algorithm(F.col("doc_type")).alias("algorithm"), F.col("__enough").alias("enough"),
        F.map_keys("sections").alias("names"), F.map_values("sections").alias("parts"), F.col("__text").alias("text"),
    )
    chosen = rows.mapInPandas(pick, rows.drop("text").withColumn("sentences", F.array().cast("array<string>")).schema)
    summary = F.array_join("sentences", " ")
    made = chosen.select(
        F.col("id").alias(id_col), "doc_type", "algorithm", "enough", summary.alias("summary"), F.transform("sentences", lambda x: X.strip(F.regexp_replace(x, "^[• ]+", ""))).alias("key_points"),
        X.word_count(summary).alias("word_count"), F.size("sentences").alias("sentence_count"), F.map_filter(F.map_from_arrays("names", "parts"), lambda k, v: v != "").alias("sections"),
    )
    known = ["algorithm", "summary", "key_points", "word_count", "sentence_count", "sections"]
    return made.select(id_col, "doc_type", *[F.when(F.col("enough"), F.col(c)).alias(c) for c in known], F.when(~F.col("enough"), TOO_SHORT).alias("error"))


def top_by_frequency(docs: DataFrame, id_col: str, text_col: str, n: int = 8) -> DataFrame:
    """id, position, sentence: sentences by the mean frequency of their words, built-in only."""
    sentence = F.posexplode(F.filter(F.split(F.trim(text_col), r"(?<=[.!?])\s+"), lambda s: s != ""))
    rows = docs.select(id_col, sentence.alias("position", "sentence"))
    split = F.filter(F.split(F.lower("sentence"), "[^a-z]+"), lambda w: w != "")
    tokens = rows.select(id_col, "position", F.explode(split).alias("w"))
    counts = tokens.groupBy(id_col, "w").agg(F.count("*").alias("c"))
    scores = tokens.join(counts, [id_col, "w"]).groupBy(id_col, "position").agg(F.round(F.avg("c"), 6).alias("score"))
    from pyspark.sql import Window

    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "position")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return best.join(rows, [id_col, "position"]).select(id_col, "position", "sentence", "score")
