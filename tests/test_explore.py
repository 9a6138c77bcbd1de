"""Exploration: selections, empty-selection semantics, bounds and question rules."""

from pyspark.sql import functions as F

from clauselens.operators import explore as EX

ROWS = [("a", "high", "Delaware", "K1", 30, 12.0), ("b", "low", "the State of California", "K1", None, 1.0),
        ("c", "medium", "Texas", "K2", 90, 6.0)]
SCHEMA = ("doc_id string, risk_bucket string, governing_law string, party_key string, "
          "payment_net_days int, risk_score double")


def per_doc(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_selection_keeps_null_net_days(spark):
    sel = EX.Selection(risk_buckets=("high", "low"), net_days=(0, 60))
    assert ids(EX.apply_filters(per_doc(spark), sel)) == ["a", "b"]
    assert ids(EX.apply_filters(per_doc(spark), EX.Selection())) == ["a", "b", "c"]


def test_findings_of_empty_selection_returns_all(spark):
    pd_ = per_doc(spark)
    fnd = spark.createDataFrame([("a", "MISSING"), ("c", "AMBIGUOUS")], "doc_id string, issue_type string")
    none = EX.apply_filters(pd_, EX.Selection(risk_buckets=("nope",)))
    assert ids(EX.findings_of(fnd, none, pd_)) == ["a", "c"]
    some = EX.apply_filters(pd_, EX.Selection(risk_buckets=("medium",)))
    assert ids(EX.findings_of(fnd, some, pd_)) == ["c"]


def test_net_days_bounds(spark):
    r = EX.net_days_bounds(per_doc(spark)).collect()[0]
    assert (r["nd_min"], r["nd_max"]) == (30, 90)
    empty = spark.createDataFrame([], SCHEMA)
    r = EX.net_days_bounds(empty).collect()[0]
    assert (r["nd_min"], r["nd_max"]) == (0, 200)
    narrow = spark.createDataFrame([ROWS[0]], SCHEMA)
    assert EX.net_days_bounds(narrow).collect()[0]["nd_max"] == 40


def test_question_rules(spark):
    pd_ = per_doc(spark)
    assert ids(EX.question_filter(pd_, "Which contracts are governed by California law?")) == ["b"]
    assert ids(EX.question_filter(pd_, "which contracts are governed by the laws of Texas")) == ["c"]
    assert ids(EX.question_filter(pd_, "show everything")) == ["a", "b", "c"]
    t = spark.createDataFrame([("x", "Termination upon sixty (60) days notice."), ("y", "Termination on 90 days notice.")],
                              "doc_id string, t string").select(
        "doc_id", EX.termination_notice_days(F.col("t")).alias("termination_notice_days"))
    assert ids(EX.question_filter(t, "Termination with less than 61 days?")) == ["x"]


def test_question_names_a_place_anywhere(spark):
    df = spark.createDataFrame([("a", "State of California"), ("b", "Texas"), ("c", None)], "doc_id string, governing_law string")
    for q in ("List contracts governed by California law with high risk", "Show California contracts governed by state law",
              "Which are governed by the laws of the State of California?", "Is California the governing law of any?"):
        assert ids(EX.question_filter(df, q)) == ["a"], q
    assert ids(EX.question_filter(df, "governed by Texas or California law")) == ["a", "b"]
    assert ids(EX.question_filter(df, "Termination in less than 30 days")) == ["a", "b", "c"]   # no such column: all


def test_filter_options_are_sorted(spark):
    df = spark.createDataFrame([("low", "b", "p"), ("high", "a", None), ("low", "", "p")], "risk_bucket string, governing_law string, party_key string")
    assert [tuple(r) for r in EX.filter_options(df).collect()] == [
        ("governing_law", "a"), ("governing_law", "b"), ("party_key", "p"), ("risk_bucket", "high"), ("risk_bucket", "low")]
