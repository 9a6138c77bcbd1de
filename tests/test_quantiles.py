"""Medians and modes from counts, against Python."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauselens.operators import crossref
from clauselens.operators.quantiles import medians, modes


@pytest.mark.parametrize("seed", [1, 2])
def test_medians_equal_python(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdef"), rng.choice([None, *range(6)])) for _ in range(400)]
    rows += [("only null", None), ("one", 7), ("two", 1), ("two", 4), (None, 3), (None, 5), ("neg", -3), ("neg", -4), ("hot", 1)] + [("hot", 2)] * 300
    got = {r["k"]: (r["rows"], r["median"]) for r in medians(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        v = [x for kk, x in rows if kk == k]
        known = [x for x in v if x is not None]
        want[k] = (len(v), float(statistics.median(known)) if known else None)
    assert got == want


def test_medians_of_nothing(spark):
    assert medians(spark.createDataFrame([], "k string, v int"), ["k"], "v").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_modes_equal_python(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdef"), rng.choice("xyz"), f"d{i:04d}") for i in range(60)]
    rows += [("tie", "q", "d9002"), ("tie", "r", "d9001"), ("tie", "q", "d9003"), ("tie", "r", "d9004"), ("tie", "s", "d0000")]
    rng.shuffle(rows)
    got = {r["k"]: r["mode"] for r in modes(spark.createDataFrame(rows, "k string, v string, d string"), "k", "v", "d").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        n = Counter(v for kk, v, _ in rows if kk == k)
        want[k] = min((d, v) for kk, v, d in rows if kk == k and n[v] == max(n.values()))[1]
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sort_aggregates(spark):
    v = spark.createDataFrame([("d1", "p", "Ohio", 30, 1.0), ("d2", "p", "Utah", 60, None), ("d3", None, None, None, None)],
                              "doc_id string, party_key string, governing_law string, payment_net_days int, payment_amount_normalized double")
    for df in (crossref.party_stats(v), crossref.governing_law_top(v), crossref.governing_law_counts(v)):
        assert "SortAggregate" not in plan_of(df) and "ObjectHashAggregate" not in plan_of(df)
    assert crossref.governing_law_top(v).first()[0] == "Ohio"
    assert crossref.governing_law_top(v.where(F.col("governing_law").isNull())).count() == 0
