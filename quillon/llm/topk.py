"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are turned into integers and dealt into blocks of bounded size; queries too.
Each pair of a vector block and a query block is one task: it sorts one list per
dimension and reads the lists from the end that favours the query, deeper and deeper,
scoring each newly met vector in full.  It stops when the sum of the values at the
current depth (the bound of all unmet vectors) is below the k-th best score; at equality
it reads on, since an unmet vector could win the tie.  The lists of results of the
blocks are merged by a window whose group limit works before the shuffle.

Defined cases: vectors that are null, empty or hold null, non-finite or too large
components (beyond a long after scaling) take no part; scores
beyond a long count as the largest (or smallest) long; vectors meet queries of their own
length only; rows with the query's own id are not its candidates; ties go to the smaller id;
rows with a null id are no queries and lose ties; repeated rows count as rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K, QUERY_STEP = 1024, 10, 100
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
_LAST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    parts = F.transform(F.col(vector_col), lambda x: F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.floor(F.lit(float(SCALE)) * x.cast("double"))))
    whole = F.transform(parts, lambda x: F.when(F.abs(x.cast("double")) < 2.0**62, x.cast("long")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())).withColumn("dim", F.size("v"))


class SortedLists:
    """One list of row numbers per dimension, ascending by value."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers and scores of the k best rows (own id left out), and rows scored."""
        n, used = len(self.rows), np.flatnonzero(query[0])
        own, q = query[1], query[0][used]
        down = q > 0
        met = np.zeros(n, bool)
        best, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step, scored = 0, max(16, k), 0
        while depth < n:
            end = min(n, depth + step)
            front = self.order[depth:end][:, used[~down]].ravel()
            back = self.order[n - end : n - depth][:, used[down]].ravel()
            new = np.zeros(n, bool)
            new[front] = True
            new[back] = True
            if not len(used):  # a zero query scores zero everywhere
                new[:] = True
                end = n
            rows = np.flatnonzero(new & ~met)
            met |= new
            scored += len(rows)
            rows = rows[self.ids[rows] != own]
            best, best_scores = self._merge(best, best_scores, rows, _dot(self.rows[rows], query[0]), k)
            if end < n:
                at = np.where(down, self.values[n - end, used], self.values[end - 1, used])
                if len(best) == k and int(_dot(at[None], q)[0]) < best_scores[-1]:
                    break
            depth, step = end, step * 2
        return best, best_scores, scored

    def _merge(self, best, best_scores, rows, scores, k):
        rows, scores = np.concatenate([best, rows]), np.concatenate([best_scores, scores])
        if len(rows) > 4 * k:
            enough = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= enough], scores[scores >= enough]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where that is exact, too."""
    if not len(rows) or not len(query):
        return np.zeros(len(rows), np.int64)
    high = int(np.abs(rows).max()) * int(np.abs(query).max()) * len(query)
    if high < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if high < 1 << 63:
        return rows @ query
    exact = (sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows)
    return np.array([max(-_LAST, min(_LAST, x)) for x in exact], np.int64)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids = table.column("id").fill_null(_LAST).to_numpy()
        rows = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        lists = SortedLists(rows[~asks], ids[~asks])
        out: list[list] = [[], [], []]
        for own, query in zip(ids[asks], rows[asks], strict=True):
            best, scores, _ = lists.top((query, own), k)
            out[0].append(np.full(len(best), own))
            out[1].append(lists.ids[best])
            out[2].append(scores)
        return pa.table({name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def _upto(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``query_step``."""
    rows = integer_vectors(vectors, id_col, vector_col)
    n = vectors.count()
    blocks, groups = max(1, -(-n // vector_block)), max(1, -(-n // (query_step * query_block)))
    asks = F.col("id") % query_step == 0
    stored = rows.select("id", "v", "dim", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.explode(_upto(groups)).alias("group"))
    asked = rows.where(asks).distinct().select("id", "v", "dim", F.lit(True).alias("asks"), F.explode(_upto(blocks)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"))
    found = stored.unionByName(asked).groupBy("dim", "block", "group").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(_LAST)).alias("vec_id"), "score")
