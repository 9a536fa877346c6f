"""Quality classifier: a sparse rule ensemble compiled to column expressions.

1. Text statistics are built-in column expressions over the whole text.
2. Boosted shallow trees are grown on a bounded labelled sample; every path from
   a root becomes a conjunctive rule (thresholds on statistics).
3. A lasso logistic regression over the rule indicators keeps few of them.
4. The surviving rules are compiled to one Spark expression, so that scoring is a
   narrow projection with no Python.

Defined cases: a null text counts as empty; an empty text is scored from its
statistics like any other; null or repeated ids are scored row by row; labels other than 0 and 1, or
without a document, are ignored; of conflicting labels of one id the larger counts, and of
documents with one labelled id the one with the smallest statistics; without labels of both classes the score is the
share of label 1 (0.5 without labels).  Extra input columns never matter to a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free_name, held_out, labelled_sample, whole_text

#: Most labelled rows that a fit collects (documented bound of the sample).
SAMPLE_ROWS = 16_000
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Name -> expression, each a double over the whole text."""
    chars = F.length(text)
    n = F.greatest(chars, F.lit(1)).cast("double")

    def count(piece: str) -> Column:
        return (chars - F.length(F.replace(text, F.lit(piece), F.lit("")))) / F.lit(float(len(piece)))

    spaces, lines = count(" "), count("\n")
    words = spaces + lines + 1
    split_lines = F.split(text, "\n")
    marks = {"!": "bang", "|": "pipe", "#": "hash", "$": "dollar", "%": "percent", "&": "amp", "*": "star"}
    out = {
        "chars": chars.cast("double"),
        "word_length": (chars - spaces - lines) / words,
        "line_length": n / (lines + 1),
        "upper_share": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "digit_share": F.regexp_count(text, F.lit("[0-9]")) / n,
        "stop_share": (count(". ") + count(".\n")) / words,
        "comma_share": count(",") / words,
        "distinct_lines": F.size(F.array_distinct(split_lines)) / F.size(split_lines),
        "distinct_words": F.size(F.array_distinct(F.split(text, " "))) / F.greatest(spaces + 1, F.lit(1.0)),
    }
    out |= {f"{name}_share": count(mark) / words for mark, name in marks.items()}
    return {k: v.cast("double") for k, v in out.items()}


@dataclass
class RuleModel:
    """Rules: (conditions, weight); a condition is (statistic, is_greater, threshold)."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def score(self, stats: dict[str, Column] | None = None) -> Column:
        """Spark expression for P(label 1) over columns named like the statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            hit = F.lit(True)
            for name, greater, cut in conditions:
                column = stats[name] if stats else F.col(name)
                hit = hit & ((column > F.lit(cut)) if greater else (column <= F.lit(cut)))
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [
            f"{weight:+.3f} if " + " and ".join(f"{n} {'>' if g else '<='} {c:.4g}" for n, g, c in conditions)
            for conditions, weight in sorted(self.rules, key=lambda r: -abs(r[1]))
        ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _grow(x, cuts, residual, rows, path, depth, min_leaf, paths, out):
    """Grow one regression tree; adds node paths to ``paths`` and fitted values to ``out``."""
    value = residual[rows].mean() if len(rows) else 0.0
    if path:
        paths.append(path)
    best = None
    if depth and len(rows) >= 2 * min_leaf:
        total, r = residual[rows].sum(), residual[rows]
        for j, candidates in enumerate(cuts):
            if not len(candidates):
                continue
            where = np.searchsorted(candidates, x[rows, j], side="left")
            n = np.cumsum(np.bincount(where, minlength=len(candidates) + 1))[:-1]
            s = np.cumsum(np.bincount(where, weights=r, minlength=len(candidates) + 1))[:-1]
            m = len(rows) - n
            ok = (n >= min_leaf) & (m >= min_leaf)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -np.inf)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-12:
                    best = (gain[k], j, float(candidates[k]))
        if best and best[0] - total**2 / len(rows) < 1e-9:
            best = None
    if best is None:
        out[rows] = value
        return
    _, j, cut = best
    low = x[rows, j] <= cut
    _grow(x, cuts, residual, rows[low], path + ((j, False, cut),), depth - 1, min_leaf, paths, out)
    _grow(x, cuts, residual, rows[~low], path + ((j, True, cut),), depth - 1, min_leaf, paths, out)


def tree_paths(x, y, trees: int, depth: int, rate: float = 0.3, seed: int = 7):
    """Paths (conjunctions over column numbers) of boosted trees on row subsamples."""
    rng, paths = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 66)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(200, len(y) // 2)])
        residual, out = y - _sigmoid(f), np.zeros(len(y))
        found: list = []
        _grow(x, cuts, residual, rows, (), depth, max(5, len(rows) // 200), found, out)
        grown = np.zeros(len(y))
        for path in found:  # leaves are written last
            hit = _hits(x, path)
            inside = hit[rows]
            if inside.any():
                grown[hit] = residual[rows][inside].mean() * 4
        f += rate * grown
        paths += found
    return paths


def _hits(x, path) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, greater, cut in path:
        hit &= (x[:, j] > cut) if greater else (x[:, j] <= cut)
    return hit


def lasso_logistic(a, y, strength: float, steps: int = 300):
    """Weights and bias of L1-regularised logistic regression (accelerated proximal gradient)."""
    n, d = a.shape
    step = 4.0 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, v, b, c, t = np.zeros(d), np.zeros(d), 0.0, 0.0, 1.0
    for _ in range(steps):
        g = _sigmoid(a @ v + c) - y
        new = v - step * (a.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        bias = c - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3) -> RuleModel:
    """Fit on arrays; the lasso strength is chosen on a fifth of the rows."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleModel(float(np.log(p / (1 - p))))
    paths = tree_paths(x, y, trees, depth)
    columns, kept, seen = [], [], set()
    for path in paths:
        hit = _hits(x, path)
        key = hit.tobytes()
        if key not in seen and 0 < hit.sum() < len(y):
            seen.add(key)
            columns.append(hit)
            kept.append(path)
    a = np.column_stack(columns).astype(np.float64)
    test = np.arange(len(y)) % 5 == 0
    best = None
    for strength in (0.01, 0.004, 0.0015, 0.0006):
        w, b = lasso_logistic(a[~test], y[~test], strength)
        p = np.clip(_sigmoid(a[test] @ w + b), 1e-6, 1 - 1e-6)
        loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, strength)
    w, b = lasso_logistic(a, y, best[1], steps=600)
    rules = [
        (tuple((names[j], g, c) for j, g, c in path), float(v))
        for path, v in zip(kept, w, strict=True)
        if abs(v) > 1e-3
    ]
    return RuleModel(float(b), rules)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "quality") -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    chosen = labelled_sample(labels, label, sample_rows)
    stats = statistics(F.col("__text"))
    rows = (
        docs.select(F.col("doc_id").alias("__id"), whole_text("text").alias("__text"))
        .join(F.broadcast(chosen), "__id")  # bounded by sample_rows
        .select("__id", "__y", *[v.alias(k) for k, v in stats.items()])
        .groupBy("__id", "__y")  # one row an id, however often it repeats: the sample bounds what is collected
        .agg(F.min(F.struct(*stats)).alias("s"))
        .select("__id", "__y", "s.*")
        .toPandas()
        .sort_values(["__id", *stats], kind="stable")
    )
    return fit_rules(rows[list(stats)].to_numpy(float), rows["__y"].to_numpy(float), list(stats))


def measured(docs: DataFrame, text_col: str, model: RuleModel) -> tuple[DataFrame, Column]:
    """``docs`` plus each statistic that a rule uses, as a column of its own, and the score over these columns.

    Columns that the score reads more than once are not merged into it, so that each is
    computed once a row, in compiled code.
    """
    used = {name for conditions, _ in model.rules for name, _, _ in conditions}
    stats = {k: v for k, v in statistics(whole_text(text_col)).items() if k in used}
    names = {k: free_name(docs, f"__{k}") for k in stats}
    return docs.select("*", *[v.alias(names[k]) for k, v in stats.items()]), model.score({k: F.col(names[k]) for k in stats})


def with_quality(docs: DataFrame, model: RuleModel, score_col: str = "quality_score", text_col: str = "text") -> DataFrame:
    """``docs`` plus the score; a column that is there under that name already is refused."""
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is a column of the input; name another one")
    rows, score = measured(docs, text_col, model)
    return rows.select(*docs.columns, score.alias(score_col))


def keep(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that reach the threshold; no column is added."""
    rows, score = measured(docs, text_col, model)
    # A filter is not pushed below a generator, so that the statistics are not computed anew for each rule.
    passed = free_name(rows, "__passed")
    return rows.select(*docs.columns, F.explode(F.array(score)).alias(passed)).where(F.col(passed) >= F.lit(threshold)).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows, score = measured(docs.select("doc_id", "text"), "text", fit(docs, labels))
    scored = rows.select("doc_id", score.alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )
