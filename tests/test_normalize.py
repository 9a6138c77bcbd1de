"""Literal unit cases for the normalisation functions."""

import datetime as dt

from pyspark.sql import functions as F

from clauselens.functions import normalize as N
from conftest import one_col


def run(spark, fn, values, dtype="string"):
    df = one_col(spark, values, dtype=dtype)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_normalize_amount(spark):
    got = run(spark, N.normalize_amount, ["pay $5000 now", "USD 1,250.50", "us$ 75000.00", "no currency", None])
    assert got == [500.0, 1250.5, 750.0, None, None]


def test_normalize_amount_full_option(spark):
    got = run(spark, lambda c: N.normalize_amount(c, full_amounts=True), ["pay $5000 now", "USD 1,250.50"])
    assert got == [5000.0, 1250.5]


def test_net_days(spark):
    assert run(spark, N.net_days, ["net 30", "internet 45", "net 4500", "due in 30 days", "NET30"]) == \
        [30, 45, 450, None, 30]


def test_normalize_date(spark):
    vals = ["March 3, 2011", "Mar 3, 2011", "3/4/75", "3/4/68", "2/30/2020", "Sept 5, 2000",
            "  12/25/2020 ", "dated Jan 5, 2020 and later", "31/12/2020", "", None, "mar  3,   2011"]
    exp = [dt.date(2011, 3, 3), dt.date(2011, 3, 3), dt.date(1975, 3, 4), dt.date(2068, 3, 4), None, None,
           dt.date(2020, 12, 25), dt.date(2020, 1, 5), None, None, None, dt.date(2011, 3, 3)]
    assert run(spark, N.normalize_date, vals) == exp


def test_norm_party_name(spark):
    got = run(spark, N.norm_party_name, ["  Acme  Corp., ", '("Heritage")', None])
    assert got == ["ACME CORP", "HERITAGE", ""]


def test_party_key(spark):
    df = spark.createDataFrame([(["b", "a", "c"],), ([],), ([" "],), (None,), (["x", " ", "a"],),
                                (["p1", "p2", "p3", "p4", "p5", "b", "a"],)], "x array<string>")
    got = [r[0] for r in df.select(N.party_key(F.col("x"))).collect()]
    assert got == ["A | B", None, None, None, "A | X", "P1 | P2"]


def test_clamp_quote(spark):
    long = "word " * 100
    got = run(spark, lambda c: N.clamp_quote(c, 12), ["a  b\n c", long, None, ""])
    assert got == ["a b c", "word word wo…", "", ""]


def test_risk_bucket(spark):
    got = run(spark, lambda c: N.risk_bucket(c, 5.0, 10.0), [0.0, 4.999, 5.0, 9.9, 10.0], dtype="double")
    assert got == ["low", "low", "medium", "medium", "high"]
