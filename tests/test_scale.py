"""Shared tables stay narrow and tasks keep their size as the input grows."""

import datetime

from clauselens.operators import findings as FN, textmine as TM
from clauselens.operators.crossref import attach_party_stats
from clauselens.plans.portfolio import Portfolio
from clauselens.sources import contracts as C

from test_rules import A, B, D


def pf(spark):
    docs = spark.createDataFrame([("a", A), ("b", B), ("d", D), ("n", None)], "doc_id string, text string")
    return Portfolio(spark, "", docs=docs)


def test_contracts_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    day = datetime.date(2001, 2, 3)
    orders = [(i, i % 3, day, 1000.0 * i) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"C{i}", 1) for i in range(3)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(C, "CONTRACTS_PER_TASK", 1)
    got = C.contracts(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 40
    assert got.where("text IS NOT NULL").select("doc_id").distinct().count() == 40


def test_kept_tables_carry_no_clause(spark):
    p = pf(spark)
    for kept in (p.facts, p.marked):
        assert kept.is_cached and not {"payment_terms", "termination_clause", "text"} & set(kept.columns)
    assert not p.first_pass.is_cached and not p.validated.is_cached
    p.release()


def test_findings_of_two_passes_are_those_of_whole_records(spark):
    p = pf(spark)
    key = lambda r: (r["doc_id"], r["issue_pos"])
    assert sorted(p.findings.collect(), key=key) == sorted(FN.findings(p.validated).collect(), key=key)
    assert {r["issue_type"] for r in p.findings.collect()} >= {"AMBIGUOUS", "MISSING", "PAYMENT_AMOUNT_HIGH"}
    p.release()


def test_rows_without_party_are_kept_once(spark):
    v = spark.createDataFrame([("a", "P"), ("b", None), (None, None)], "doc_id string, party_key string")
    stats = spark.createDataFrame([("P", 3.0, "X")], "party_key string, party_median double, party_mode string")
    assert sorted(map(tuple, attach_party_stats(v, stats).collect()), key=str) == [("a", "P", 3.0, "X"), ("b", None, None, None), (None, None, None, None)]


def test_terms_are_not_written(spark):
    s = spark.createDataFrame([(1, "The buyer shall pay within thirty days."), (2, "No.")], "sid int, sentence string")
    c = TM.SentenceCorpus(s)
    assert set(c.distinct.columns) == {"h1", "h2", "sentence", "m", "first_sid"}
    assert "buyer" in {r["term"] for r in c.counts.collect()}
