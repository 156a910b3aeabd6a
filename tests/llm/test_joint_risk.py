"""The rules together refuse at most the allowed share of a stratum's good documents."""

import pytest
from pyspark.sql import functions as F

from claimscope.llm import risk_rules
from claimscope.llm.risk_rules import RISK, fit_cutoffs, kept_documents

PLAIN = " ".join(f"word{i}" for i in range(60))
#: Texts that one rule each refuses at its stricter cutoffs.
ODD = [PLAIN + " %" * 20, PLAIN.replace("word", "WORd"), PLAIN + "!" * 30, PLAIN + "\na line\na line\na line"]


@pytest.fixture(scope="module")
def tables(spark):
    """Of 4,000 good documents of a stratum each rule would refuse 0.5 %, all others together 2 %; junk has symbols only."""
    good = spark.range(8000).selectExpr("id AS doc_id", "if(id < 4000, 'en', NULL) AS lang", "if(id % 200 < 4 AND id < 4000, id % 200, -1) AS odd")
    junk = spark.range(8000, 8100).selectExpr("id AS doc_id", "if(id % 2 = 0, 'en', NULL) AS lang", "0 AS odd")
    text = F.coalesce(*[F.when(F.col("odd") == n, F.lit(t)) for n, t in enumerate(ODD)], F.lit(PLAIN))
    docs = good.unionByName(junk).select("doc_id", "lang", text.alias("text"))
    return docs, docs.select("doc_id", F.expr("CAST(doc_id < 8000 AS INT)").alias("quality"))


def test_all_rules_together_keep_the_risk(tables):
    docs, labels = tables
    kept = {r.doc_id for r in kept_documents(docs, labels).select("doc_id").collect()}
    refused = [d for d in range(4000) if d not in kept]
    assert 0 < len(refused) <= RISK * 4000
    assert set(range(4000, 8000)) <= kept
    assert not {d for d in range(8000, 8100) if d % 2} & kept


@pytest.mark.parametrize("limit", ["BROADCAST_LABELS", "BROADCAST_STRATA"])
def test_shuffled_joins_give_the_same(tables, monkeypatch, limit):
    docs, labels = tables
    expected = (sorted(map(str, fit_cutoffs(docs, labels).collect())), kept_documents(docs, labels).count())
    monkeypatch.setattr(risk_rules, limit, 0)
    assert (sorted(map(str, fit_cutoffs(docs, labels).collect())), kept_documents(docs, labels).count()) == expected
