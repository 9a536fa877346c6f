"""Texts are scanned once where the vault is read twice; a token is made once for a value."""

from quillon.operators import detect as D
from quillon.operators import rewrite as W
from quillon.plans import detection as P


def test_lookup_scans_once(spark):
    rows = P.token_lookup(spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.status for r in rows.collect()} == {"found", "not_found"}


def test_vault_values(spark):
    texts = spark.createDataFrame([(1, "MRN123456 and IND-12345"), (2, "MRN123456 again"), (3, None)], "id long, text string")
    found = D.with_spans(texts)
    once = sorted(map(tuple, W.vault_values(found, "k").collect()))
    assert once == sorted(map(tuple, W.vault_rows(found, "id", "k").select("token", "value").distinct().collect())) and len(once) == 2
