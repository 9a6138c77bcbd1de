"""Issues are computed once per contract: no filter repeats their patterns below the extraction."""

import datetime

import pytest

from clauselens.operators import kpis as K
from clauselens.plans.queries import REGISTRY

NAMES = ("issue_bad_date", "issue_ambiguous", "issue_missing", "strict_missing", "nonstandard_law", "ambiguous_terms",
         "issue_type_counts", "strict_high_risk", "payment_amounts", "norm_party_name")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    day = datetime.date(2001, 2, 3)
    orders = [(i, i % 3, day, 1000.0 * i) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{to}/orders.parquet")
    spark.createDataFrame([(i, f"C{i}", 1) for i in range(3)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{to}/customer.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{to}/nation.parquet")
    return to


@pytest.mark.parametrize("name", NAMES)
def test_no_pattern_in_filters_and_joins(spark, tables, name):
    df = REGISTRY[name](spark, tables)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    held = [x for x in plan.split("\n") if "Filter" in x.split("(")[0] or "Join" in x]
    assert held and not [x for x in held if "regexp_extract" in x or "RLIKE" in x]


def test_rows_without_issues_give_none(spark):
    v = spark.sql("SELECT 1 AS doc, array(struct('A' AS type), struct('B' AS type), struct('A' AS type)) AS _issues UNION ALL SELECT 2, array() UNION ALL SELECT 3, NULL")
    assert sorted(map(tuple, K.issue_type_counts(v).collect())) == [("A", 2), ("B", 1)]


def test_high_risk_is_cut_among_the_high(spark):
    """The bucket decides, also where a score of another bucket is as high."""
    rows = [("a", 7, "medium"), ("b", 7, "high"), ("c", 9, "high"), ("d", 9, None), ("e", 1, "low"), ("f", 7, "high")]
    d = spark.createDataFrame([(*r, ["x"]) for r in rows], "doc_id string, risk_score int, risk_bucket string, _strict_issues array<string>")
    assert [tuple(r) for r in K.strict_high_risk(d, 2).collect()] == [("c", 9, ["x"]), ("b", 7, ["x"])]
    assert [r["doc_id"] for r in K.strict_high_risk(d).collect()] == ["c", "b", "f"]


def test_white_space_at_hand_collapses_as_the_class_does(spark):
    from clauselens.functions.text import PY_WHITESPACE, collapse_ws, collapse_ws_at_hand
    texts = ["", " ", "a b", " a  b   c ", "a\tb", "a \n\n b  c", "é  è", "a   b  c", "x\x7f  y", None] + [f"a{w}{w} b{w}" for w in PY_WHITESPACE]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(collapse_ws_at_hand(d.t).alias("a"), collapse_ws(d.t).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and None in [r["a"] for r in got]


def test_spans_count_characters(spark):
    """Also after characters of two UTF-16 units, and no head within a word counts."""
    from clauselens.functions.extract import TERMINATION_HEAD_RX, find_span
    d = spark.createDataFrame([("Predetermination. Termination now.",), ("\U0001F600 é \U0001F600 termination",), ("é Termination",), ("none",), ("",), (None,)], "t string")
    got = [r[0] and r[0]["start"] for r in d.select(find_span(d.t, TERMINATION_HEAD_RX, 5).alias("s")).collect()]
    assert got == [18, 6, 2, None, None, None]


def test_distinct_sentences_stay_dealt_by_their_digest(spark):
    """The written table tells how it is dealt: terms of a sentence and their sums need no exchange."""
    from clauselens.operators import textmine as TM
    was = spark.conf.get("spark.sql.adaptive.enabled")
    c = TM.SentenceCorpus(spark.createDataFrame([(1, "The buyer shall pay within thirty days."), (2, "The seller shall deliver.")], "sid int, sentence string"))
    assert "hashpartitioning(h1" in c.distinct._jdf.queryExecution().executedPlan().outputPartitioning().toString()
    assert spark.conf.get("spark.sql.adaptive.enabled") == was
    for df in (c.counts, c.norms, c.scores()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    assert {r["sentence"]: r["m"] for r in c.scores().collect()} == {"The buyer shall pay within thirty days.": 1, "The seller shall deliver.": 1}
