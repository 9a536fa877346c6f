"""Text, source, summary, report and contract queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import contracts as C
from quillon.operators import reports as R
from quillon.operators import summarise as S
from quillon.operators.stores import source_hash
from quillon.plans.detection import table
from quillon.sources import ingest as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("""SELECT event_id, list_aggregate(list_transform(json_keys(props), lambda k: k || ': ' || (props::JSON ->> k)), 'string_agg', chr(10)) AS text FROM events""")
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", I.json_text("props").alias("text"))


@query("SELECT c_custkey, concat_ws(' | ', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment) AS text FROM customer")
def csv_row_text(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return rows.select("c_custkey", I.row_text(rows).alias("text"))


@query("SELECT c_custkey, c_name AS text, c_name || chr(233) AS latin FROM customer")
def utf8_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("a"), F.encode(F.concat("c_name", F.lit("é")), "ISO-8859-1").alias("b"))
    return rows.select("c_custkey", I.decode_text(F.col("a")).alias("text"), I.decode_text(F.col("b")).alias("latin"))


_KINDS = [("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("524946460000000057454250", "image/webp"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("00", "application/octet-stream")]


@query(f"SELECT c_custkey, list_extract([{', '.join(repr(k) for _, k in _KINDS)}], (c_custkey % 8 + 1)::INT) AS mime FROM customer")
def mime_sniff(spark, sf_dir):
    content = F.unhex(F.get(F.lit([h for h, _ in _KINDS]), (F.col("c_custkey") % 8).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", I.mime(content, F.lit("file.bin")).alias("mime"))


@query(r"""WITH t AS (SELECT doc_id, text, length(trim(text, E' \t\n\r\x0b\f')) AS chars, list_unique(string_split(regexp_replace(text, '\s', '', 'g'), ''))::INT AS distinct_chars,
  list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents)
SELECT doc_id, chars::INT AS chars, round(len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]{2,}'))) / greatest(len(ws), 1), 6) AS wordlike, chars >= 80 AS digital FROM t""")
def page_signals(spark, sf_dir):
    signals = table(spark, sf_dir, "documents").select("doc_id", I.page_signals(F.col("text")).alias("s"), I.digital_page(F.col("text")).alias("digital"))
    return signals.select("doc_id", "s.chars", "s.wordlike", "digital")


@query("""WITH p AS (SELECT source AS file, length(trim(text)) >= 80 AS d FROM documents)
SELECT file, count(*) AS pages, count(*) FILTER (d) AS digital_pages, count(*) FILTER (NOT d) AS scanned_pages, count(*) FILTER (NOT d) > 0 AS needs_ocr,
  CASE WHEN count(*) FILTER (NOT d) = 0 THEN 'pdf_digital' WHEN count(*) FILTER (d) = 0 THEN 'pdf_scanned' ELSE 'pdf_mixed' END AS kind FROM p GROUP BY file""")
def scan_summary(spark, sf_dir):
    return I.scan_summary(table(spark, sf_dir, "documents").withColumnRenamed("source", "file"))


@query("""WITH p AS (SELECT source AS file, count(*) AS pages, count(*) FILTER (length(trim(text)) < 80) AS s FROM documents GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (s > 0) AS scanned_files, count(*) FILTER (s = 0) AS digital_files, sum(pages)::BIGINT AS pages, sum(s)::BIGINT AS scanned_pages FROM p""")
def scan_totals(spark, sf_dir):
    return I.scan_totals(scan_summary(spark, sf_dir))


@query("SELECT o_orderkey, ['left ' || o_orderkey || '  right', 'below'] AS lines, CASE WHEN o_totalprice > 170000 THEN 'high' ELSE 'low' END AS level FROM orders")
def ocr_lines(spark, sf_dir):
    def box(top, left, text):
        return F.struct(F.lit(top).alias("top"), F.lit(top + 20.0).alias("bottom"), F.lit(left).alias("left"), text.alias("text"))

    boxes = F.array(box(3.0, 90.0, F.lit("right")), box(0.0, 5.0, F.concat(F.lit("left "), F.col("o_orderkey").cast("string"))), box(40.0, 1.0, F.lit("below")))
    level = I.recognition_quality(F.when(F.col("o_totalprice") > 170000, 0.9).otherwise(0.3))
    return table(spark, sf_dir, "orders").select("o_orderkey", I.assemble_lines(boxes).alias("lines"), level.alias("level"))


# ---------------------------------------------------------------- text


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(r"SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('A|B -- ' || replace(text, chr(12), chr(10)), '-{2,}', '—', 'g'), '([A-Z])\|([A-Z])', '\1I\2', 'g'), '([A-Z])\|([A-Z])', '\1I\2', 'g') AS text FROM documents")
def ocr_artefacts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.ocr_artefacts(F.concat(F.lit("A|B -- "), F.col("text"))).alias("text"))


def _abbreviated_sql(c: str) -> str:
    for short, full in X.ABBREVIATIONS.items():
        c = rf"regexp_replace({c}, '\b{short}\b', '{full}', 'g')"
    return c


@query(f"SELECT o_orderkey, {_abbreviated_sql(chr(39) + 'GMP and SOP, QC/QA; CAPA of AE SAE (FDA) not GMPs ' + chr(39) + ' || o_orderkey')} AS text FROM orders")
def abbreviations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.expand_abbreviations(F.concat(F.lit("GMP and SOP, QC/QA; CAPA of AE SAE (FDA) not GMPs "), F.col("o_orderkey").cast("string"))).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text || E'\n\n\n\n  end \t x', '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), E'\n{3,}', E'\n\n', 'g'), E' \n') AS text FROM documents")
def collapse_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.collapse_whitespace(F.concat(F.col("text"), F.lit("\n\n\n\n  end \t x"))).alias("text"))


@query(r"SELECT doc_id, regexp_replace(replace(text, '. ', '.'), '([.!?])([A-Z])', '\1 \2', 'g') AS text FROM documents")
def sentence_boundaries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.sentence_boundaries(F.replace("text", F.lit(". "), F.lit("."))).alias("text"))


@query("SELECT o_orderkey, 'HVAC' || o_orderkey || '. Overdue. Major. Water. Ok. Minor.' AS csv, 'first ' || o_orderkey || '. second. third done.' AS phrases FROM orders".replace("Major. Water.", "Major. Water."))
def structured_sentences(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    csv = F.concat(F.lit("Area,Finding,Severity\nHVAC"), key, F.lit(",Overdue,Major\nWater, Ok ,Minor"))
    phrases = F.concat(F.lit("TITLE LINE\nfirst "), key, F.lit("\nsecond\nthird done."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.structured_to_sentences(csv).alias("csv"), X.structured_to_sentences(phrases).alias("phrases"))
    return rows.withColumn("csv", F.regexp_replace("csv", r"\. \.", "."))


@query("SELECT o_orderkey, 'general_remarks' AS section, 'Intro ' || o_orderkey AS text FROM orders UNION ALL SELECT o_orderkey, 'observations', 'Observations: a' || chr(10) || 'more' FROM orders UNION ALL SELECT o_orderkey, 'capa', 'Corrective action - b' FROM orders")
def extract_sections(spark, sf_dir):
    text = F.concat(F.lit("Intro "), F.col("o_orderkey").cast("string"), F.lit("\nObservations: a\nmore\nCorrective action - b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(X.sections(text)).alias("section", "text"))


@query(r"SELECT o_orderkey, ['One is here.', 'Two!'] AS sentences, 0.65::DOUBLE AS confidence, 'a_b_' || o_orderkey AS safe, '- ''x'' *' AS plain, 'point' AS bullet FROM orders")
def small_text_functions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.first_sentences(F.lit("One is here. Two! Three?"), 2).alias("sentences"), X.confidence(F.lit("w " * 10), F.lit("w " * 9)).alias("confidence"),
        X.safe_name(F.concat(F.lit("a b/"), F.col("o_orderkey").cast("string"))).alias("safe"), X.ascii_punctuation(F.lit("– ‘x’ •")).alias("plain"), X.strip_bullet(F.lit(" • point ")).alias("bullet"),
    )


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INT AS words, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 10 AS enough FROM documents")
def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("words"), I.text_long_enough(F.col("text")).alias("enough"))


@query("SELECT o_orderkey, 'The cat sat down. Id 1234 5678 ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' PAN ABCDE1234F' AS text FROM orders")
def ocr_cleanup(spark, sf_dir):
    raw = F.concat(F.lit("The cat\nsat   down. Id 1234-5678-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit(" PAN ABC DE 1234 F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.ocr_cleanup(raw).alias("text"))


@query("SELECT o_orderkey, 'fi ' || o_orderkey || ' A1' AS text FROM orders")
def nfkc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.nfkc(F.concat(F.lit("ﬁ "), F.col("o_orderkey").cast("string"), F.lit(" Ａ１"))).alias("text"))


@query("SELECT c_custkey, 0.75::DOUBLE AS ratio FROM customer")
def char_similarity(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.char_similarity(F.lit("ABCD"), F.lit("bcde")).alias("ratio"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_text(spark, sf_dir):
    line = F.concat_ws(": ", "role", "text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.count("*").alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), "turns")


# ---------------------------------------------------------------- summaries and reports


def _summaries(method):
    def run(spark, sf_dir):
        return S.summarise(_docs(spark, sf_dir), "doc_id", "text", 8, method)

    return run


for _method in S.METHODS:
    QUERIES[f"summary_{_method}"] = _summaries(_method)


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents),
r AS (SELECT doc_id, i - 1 AS position, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
t AS (SELECT doc_id, position, unnest(list_filter(string_split_regex(lower(sentence), '[^a-z]+'), lambda w: w <> '')) AS w FROM r),
c AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY 1, 2), m AS (SELECT doc_id, position, round(avg(c), 6) AS score FROM t JOIN c USING (doc_id, w) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS n FROM m)
SELECT doc_id, position::INT AS position, sentence, score FROM k JOIN r USING (doc_id, position) WHERE n <= 8""")
def summary_frequency(spark, sf_dir):
    return S.top_by_frequency(_docs(spark, sf_dir), "doc_id", "text", 8)


@query()
def section_summaries(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("sections", X.sections(F.concat(F.col("text"), F.lit("\nFindings: late. Records: none."))))
    return S.section_summaries(rows, "doc_id", "sections")


_TYPES = "['SAE Case', 'Meeting Minutes', 'SUGAM Application']"


@query(f"SELECT o_orderkey, list_extract(['luhn', 'lexrank', 'lsa'], (o_orderkey % 3 + 1)::INT) AS algorithm, list_extract(['case', 'meeting', 'application'], (o_orderkey % 3 + 1)::INT) AS body FROM orders")
def algorithm_choice(spark, sf_dir):
    kind = F.get(F.lit(["SAE Case", "Meeting Minutes", "SUGAM Application"]), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.algorithm(kind).alias("algorithm"), R.body_kind(kind).alias("body"))


_POINTS = ["GMP certificate missing since {k}", "Water system reviewed", "Committee approved protocol {k}", "Applicant to submit data", "General note / remark"]


def _points():
    return F.array(*[F.format_string(p.replace("{k}", "%s"), F.col("o_orderkey").cast("string")) if "{k}" in p else F.lit(p) for p in _POINTS])


_POINTS_SQL = "[" + ", ".join("'" + p.replace("{k}", "' || o_orderkey || '") + "'" for p in _POINTS) + "]"
_NEG = " OR ".join(f"contains(lower(f), '{w}')" for w in R.NEGATIVE)


@query(
    f"""WITH p AS (SELECT o_orderkey, {_POINTS_SQL} AS ps FROM orders), i(no, item) AS (VALUES {", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(R.CHECKLIST))}),
h AS (SELECT o_orderkey, no, item, list_filter(ps, lambda q: len(list_filter(string_split(lower(item), ' '), lambda k: contains(lower(q), k))) > 0)[1] AS f FROM p CROSS JOIN i)
SELECT o_orderkey, no, item, CASE WHEN f IS NULL THEN 'OK' WHEN {_NEG} THEN 'INCOMPLETE *' ELSE 'REVIEWED' END AS flag, coalesce(substr(f, 1, 60), '-') AS finding FROM h"""
)
def checklist_matrix(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(R.checklist(_points())).alias("r")).select("o_orderkey", "r.*")


@query(f"SELECT o_orderkey, [{_POINTS_SQL}[3]] AS decisions, [{_POINTS_SQL}[4]] AS actions, [{_POINTS_SQL}[1], {_POINTS_SQL}[2], {_POINTS_SQL}[5]] AS other, [{_POINTS_SQL}[1]] AS deficient, ['1   Applicant to submit data'] AS register FROM orders")
def decisions_actions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", R.decisions_actions(_points()).alias("d"), R.deficiency_points(_points()).alias("deficient"))
    return rows.select("o_orderkey", "d.*", "deficient", R.action_register(F.col("d.actions")).alias("register"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Risk outweighs benefit pending resolution of critical deficiencies.' WHEN '2-HIGH' THEN 'Benefit acceptable subject to resolution of major deficiencies within 45 days.'
ELSE 'Benefit-risk profile acceptable based on current inspection findings.' END AS risk, CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical — Immediate Action Required' WHEN '2-HIGH' THEN 'Major — Action Required' WHEN '3-MEDIUM' THEN 'Minor — Advisory' ELSE 'Satisfactory' END AS rating,
chr(34) || o_orderkey || chr(34) || ',' || chr(34) || 'a ' || chr(34) || chr(34) || 'q' || chr(34) || chr(34) || chr(34) AS csv FROM orders""")
def risk_and_rating(spark, sf_dir):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "Critical").when(p == "2-HIGH", "MAJOR issue")
    none, one = F.array().cast("array<string>"), F.array(F.lit("x"))
    rating = R.inspection_rating(F.when(p == "1-URGENT", one).otherwise(none), F.when(p == "2-HIGH", one).otherwise(none), F.when(p == "3-MEDIUM", one).otherwise(none))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.risk_line(kind).alias("risk"), rating["rating"].alias("rating"), R.csv_line(F.col("o_orderkey"), F.lit('a "q"')).alias("csv"))


@query("""SELECT o_orderkey, ['DOCUMENT CLASS     : ' || o_orderpriority, 'REPORT ID          : R' || o_orderkey, 'FIRM               : F' || o_custkey, 'CONFIDENCE         : ' || printf('%.2f', (o_orderkey % 100) / 100.0::DOUBLE), 'SOURCE HASH        : ' || sha256(o_orderkey::VARCHAR)[1:16] || '...'] AS rows,
CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000) || 'ms' ELSE (o_orderkey % 50 + 1) || 'm ' || (o_orderkey % 60) || 's' END AS took FROM orders""")
def report_masthead(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = R.masthead(F.col("o_orderpriority"), F.concat(F.lit("R"), k.cast("string")), F.concat(F.lit("F"), F.col("o_custkey").cast("string")), (k % 100) / F.lit(100.0), source_hash(k.cast("string")))
    ms = F.when(k % 3 == 0, k % 1000).otherwise(((k % 50 + 1) * 60 + k % 60) * 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", rows.alias("rows"), X.duration(ms).alias("took"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'given' ELSE o_orderstatus END AS field, o_orderkey % 2 = 0 AS shown, CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' WHEN o_orderpriority = '2-HIGH' THEN 'major' ELSE 'minor' END AS severity FROM orders""")
def overrides(spark, sf_dir):
    given = F.when(F.col("o_orderkey") % 2 == 0, " given ").otherwise("  ")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "Fatal event").when(F.col("o_orderpriority") == "2-HIGH", "Form not signed").otherwise("note")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.override(given, F.col("o_orderstatus")).alias("field"), R.shown(F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("Not Specified")).alias("shown"), R.severity(text).alias("severity"))


# ---------------------------------------------------------------- contracts


def _versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    new = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return C.compare(orders.where("o_orderkey % 13 <> 0"), new, "o_orderkey", {"o_orderstatus": "critical", "o_orderpriority": "minor"})


_DIFF = """WITH a AS (SELECT o_orderkey, unnest([{'f': 'o_orderstatus', 'v': o_orderstatus}, {'f': 'o_orderpriority', 'v': o_orderpriority}]) AS c FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_orderkey, unnest([{'f': 'o_orderstatus', 'v': CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END}, {'f': 'o_orderpriority', 'v': o_orderpriority}]) AS c FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.c.f, b.c.f) AS field_name, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.c.v = b.c.v THEN 'unchanged' ELSE 'modified' END AS change_type,
  CASE coalesce(a.c.f, b.c.f) WHEN 'o_orderstatus' THEN 'critical' ELSE 'minor' END AS significance, a.c.v AS old_value, b.c.v AS new_value FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.c.f = b.c.f)"""


@query(f"{_DIFF} SELECT * FROM d")
def version_diff(spark, sf_dir):
    return _versions(spark, sf_dir)


@query(f"{_DIFF} SELECT change_type, significance, count(*) AS n FROM d GROUP BY 1, 2")
def change_counts(spark, sf_dir):
    return C.change_counts(_versions(spark, sf_dir))


@query(f"{_DIFF}, l AS (SELECT o_orderkey, '[' || significance || '] ' || field_name || ': ' || coalesce(old_value, '') || ' -> ' || coalesce(new_value, '') AS line FROM d WHERE change_type <> 'unchanged') SELECT o_orderkey, string_agg(line, chr(10) ORDER BY line) AS text FROM l GROUP BY 1")
def chain_text(spark, sf_dir):
    return C.chain_text(_versions(spark, sf_dir), "o_orderkey")


_FLAGS = """WITH f AS (SELECT c_custkey, unnest([{'field_id': 'c_name', 'section': 'identity', 'severity': 'major', 'status': 'ok'},
 {'field_id': 'c_mktsegment', 'section': 'identity', 'severity': 'minor', 'status': CASE WHEN c_mktsegment = 'BUILDING' THEN 'invalid' ELSE 'ok' END},
 {'field_id': 'c_acctbal', 'section': 'finance', 'severity': 'critical', 'status': CASE WHEN c_acctbal < 0 THEN 'invalid' ELSE 'ok' END}], recursive := true) FROM customer)"""


def _flags(spark, sf_dir):
    rules = [("c_name", "identity", "major", F.lit(True)), ("c_mktsegment", "identity", "minor", F.col("c_mktsegment") != "BUILDING"), ("c_acctbal", "finance", "critical", F.col("c_acctbal") >= 0)]
    return C.completeness(table(spark, sf_dir, "customer"), "c_custkey", rules)


@query(f"{_FLAGS} SELECT c_custkey, field_id, section, severity, status FROM f")
def completeness_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


@query(f"{_FLAGS} SELECT section, count(*) AS fields, count(*) FILTER (status = 'ok') AS ok, round(count(*) FILTER (status = 'ok') / count(*) * 100, 1) AS score FROM f GROUP BY section")
def completeness_scores(spark, sf_dir):
    return C.completeness_scores(_flags(spark, sf_dir))


@query()
def near_duplicate_documents(spark, sf_dir):
    """Exact on whole tables; compared with brute force on a fixture in the tests."""
    return C.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT o_orderkey, least(100.0, CASE o_orderpriority WHEN '1-URGENT' THEN 40 WHEN '2-HIGH' THEN 25 ELSE 10 END + CASE WHEN o_orderstatus = 'F' THEN 30 ELSE 0 END + least(o_orderkey % 50, 30.0))::DOUBLE AS priority FROM orders")
def priority_score(spark, sf_dir):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "major").otherwise("minor")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.priority(F.col("o_orderstatus") == "F", level, (F.col("o_orderkey") % 50).cast("double")).alias("priority"))


@query()
def severity_model(spark, sf_dir):
    """Class and probability of every document (a fitted forest: rows only).

    The forest is fitted on a sample of the labelled rows; those rows are scored like any other.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), table(spark, sf_dir, "labels")
    fitted = C.severity_model(docs, C.label_sample(labels, "doc_id", "toxic"), "doc_id", "text", "toxic")
    scored = fitted.transform(docs)
    from pyspark.ml.functions import vector_to_array

    return scored.select("doc_id", F.col("prediction").cast("int").alias("label"), F.array_max(vector_to_array("probability")).alias("confidence"))


@query("""SELECT source AS batch, bool_or(lang = 'de') AS is_scanned, string_agg('=== ' || lpad(doc_id::VARCHAR, 9, '0') || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS text, sum(n_chars)::BIGINT AS num_entities, count(*) AS files FROM documents GROUP BY 1""")
def combine_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), (F.col("lang") == "de").alias("is_scanned"), "text", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("filename"), F.col("n_chars").alias("num_entities"))
    return C.combine_files(rows, "batch")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def timing_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS run FROM events QUALIFY run = 1")
def first_seen(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.row_number().over(order).alias("run")).where("run = 1")
