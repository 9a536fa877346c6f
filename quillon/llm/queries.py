"""The operators of this subpackage as registered queries, with DuckDB SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import clustering, divergence, exact_dedup, html_layout, line_dedup, mixing, pii, quality, sentencepiece_lattice, simhash, substring_dedup, topk, toxicity
from quillon.llm.common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out_col="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.round_trip(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.rewritten(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), added=("n_copies", "copy_index", "shuffle_key"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_html,
        op2_exact_dedup,
        op3_sentencepiece,
        op4_topk,
        op5_pii,
        op6_line_dedup,
        op7_toxicity,
        op8_simhash,
        op9_mixing,
        op10_quality,
        op11_clustering,
        op12_substring_dedup,
        op13_divergence,
    )
}

_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

_MIX_SQL = f"""
WITH sizes AS (
  SELECT source AS src, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source
), rates AS (
  SELECT src, CASE WHEN chars > 0
    THEN chars ** {mixing.TEMPERATURE} / (SELECT sum(chars ** {mixing.TEMPERATURE}) FROM sizes) * (SELECT sum(chars) FROM sizes) / chars
    ELSE 1.0 END AS rate FROM sizes
), cdf AS (
  SELECT src, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS c
  FROM (SELECT src, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM rates)
), lists AS (
  SELECT src, list(c ORDER BY c) AS cs FROM cdf GROUP BY src
), drawn AS (
  SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name,
    (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
      / {1 << 52}.0 AS u
  FROM documents d
), counted AS (
  SELECT drawn.*, len(list_filter(cs, lambda c: c < u)) AS n
  FROM drawn JOIN lists ON drawn.source IS NOT DISTINCT FROM lists.src
), copied AS (
  SELECT *, unnest(range(0, n)) AS k FROM counted WHERE n > 0
)
SELECT doc_id, text, lang, source, n_chars, n::INTEGER AS n_copies, k::INTEGER AS copy_index,
       md5('{mixing.SEED}:order:' || name || ':' || k) AS shuffle_key
FROM copied
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""



def _clustering_sql() -> str:
    """One assignment and one update per round, written out; floor division by hand."""
    n, dim = clustering.K, clustering.DIM
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS z, e FROM (SELECT e, sha256('{clustering.SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {n})
)"""]
    for r in range(clustering.ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, min(struct_pack(d := d, z := z)) AS best FROM (
    SELECT vec_id, z, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT AS d FROM v, c{r} c
  ) GROUP BY vec_id
)""")
        if r < clustering.ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.z, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
    SELECT z, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS e FROM (
      SELECT best.z AS z, i, sum(v.e[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id), range(1, {dim + 1}) t(i) GROUP BY 1, 2
    ) GROUP BY z
  ) m ON m.z = c.z
)""")
    last = clustering.ROUNDS
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, best.z::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.z)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} c ON c.z = best.z
"""


_SUBSTRING_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, k, md5(array_to_string(ws[k:k + {substring_dedup.WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring_dedup.WINDOW - 2})) AS k FROM d)
), repeated AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT w) AS ks FROM (SELECT doc_id, unnest(range(k, k + {substring_dedup.WINDOW})) AS w FROM repeated) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS w FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY w) AS text
  FROM words ANTI JOIN (SELECT doc_id, unnest(ks) AS w FROM gone) g ON g.doc_id = words.doc_id AND g.w = words.w GROUP BY 1
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT cells.lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY cells.lang, source) + v) AS p
  FROM cells JOIN v ON v.lang = cells.lang
), whole AS (
  SELECT l.lang, term, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY l.lang) + v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL) l JOIN v ON v.lang = l.lang
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    (SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, ((p - q) * (p - q) // q)::BIGINT FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.RANKS}
"""

LLM_ORACLES = {
    "op2_exact_dedup": _DEDUP_SQL,
    "op4_topk": _TOPK_SQL,
    "op9_mixing": _MIX_SQL,
    "op11_clustering": _clustering_sql(),
    "op12_substring_dedup": _SUBSTRING_SQL,
    "op13_divergence": _DIVERGENCE_SQL,
}
