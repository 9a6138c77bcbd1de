"""Extraction, rules, cross-reference and scoring on small literal contracts."""

from pyspark.sql import functions as F

from clauselens import policy as P
from clauselens.operators import crossref, risk
from clauselens.operators.extraction import extract_fields
from clauselens.operators.validate import validate_first_pass

A = ("This Agreement is made by and between Acme Corp and Beta LLC, effective. Effective Date: March 3, 2011. "
     "Payment Terms: Buyer shall pay $5000 net 30 days. This Agreement is governed by the laws of the State of "
     "Delaware, as agreed. Termination. Either party may terminate upon notice.")
B = ("Agreement between acme  corp. and Beta LLC. Commencement Date: 3/4/75. Payment Terms: pay USD 1,250,000.00 "
     "net 45 days using commercially reasonable efforts. This Agreement is governed by the laws of the State of "
     "Texas, as agreed. Termination. Either party may terminate after a material breach.")
C = ("Agreement between Acme Corp and Beta LLC. Effective Date: Sept 5, 2000. Payment Terms: net 150. "
     "This Agreement is governed by the laws of the State of Delaware (see above).")
D = "Offered by Gamma Holdings Inc. and Delta Company, to whom it may concern."


def portfolio(spark, texts):
    docs = spark.createDataFrame([(f"d{i}.txt", t) for i, t in enumerate(texts)], "doc_id string, text string")
    fp = validate_first_pass(extract_fields(docs))
    return fp, crossref.cross_reference(fp, keep_stats=True)


def test_extraction_fields(spark):
    fp, _ = portfolio(spark, [A, B, C, D])
    r = {x["doc_id"]: x for x in fp.collect()}
    a = r["d0.txt"]
    assert a["parties"] == ["Acme Corp", "Beta LLC"]
    assert a["effective_date"] == "March 3, 2011"
    assert a["governing_law"] == "the State of Delaware"
    assert a["payment_terms"]["text"].startswith("Payment Terms: Buyer shall pay $5000")
    assert A[a["payment_terms"]["start"]:].startswith("Payment Terms")
    assert a["payment_amount_normalized"] == 500.0 and a["payment_net_days"] == 30
    assert a["party_key"] == "ACME CORP | BETA LLC"
    b = r["d1.txt"]
    assert b["party_key"] == "ACME CORP | BETA LLC"
    assert str(b["effective_date_normalized"]) == "1975-03-04"
    c = r["d2.txt"]
    assert c["governing_law"] == "Delaware" and c["_provenance"]["governing_law"]["source"] == "fallback"
    assert [i["type"] for i in c["_issues"]] == ["BAD_DATE", "MISSING"]
    d = r["d3.txt"]
    assert d["parties"] == ["Gamma Holdings Inc.", "Delta Company"]
    assert d["_provenance"]["parties"]["source"] == "entity"
    assert [i["field"] for i in d["_issues"]] == ["payment_terms", "termination_clause", "governing_law"]


def test_cross_reference_and_scores(spark):
    _, xr = portfolio(spark, [A, B, C, D])
    r = {x["doc_id"]: x for x in xr.collect()}
    types = {k: [i["type"] for i in v["_issues"]] for k, v in r.items()}
    # net days 30, 45, 150 -> median 45; 30 is 1/3 off (no outlier), 150 is over max and an outlier.
    assert types["d0.txt"] == []
    assert types["d1.txt"] == ["AMBIGUOUS", "AMBIGUOUS", "GOVERNING_LAW_INCONSISTENT", "PAYMENT_AMOUNT_HIGH"]
    assert types["d2.txt"] == ["BAD_DATE", "MISSING", "NET_DAYS_OVER_MAX", "NET_DAYS_OUTLIER",
                               "GOVERNING_LAW_INCONSISTENT", "NET_DAYS_DRIFT_VS_PARTY"]
    assert r["d1.txt"]["party_mode"] == "the State of Delaware"
    per = {x["doc_id"]: x for x in risk.per_doc_metrics(xr).collect()}
    # B: 2 x AMBIGUOUS (2) + INCONSISTENT (2) + HIGH (2.5) + nd (45-30)/30 + amount 0.25
    assert per["d1.txt"]["risk_score"] == 9.25 and per["d1.txt"]["risk_bucket"] == "medium"
    # D: three MISSING = 9.0 -> medium (high starts at 10)
    assert per["d3.txt"]["risk_score"] == 9.0 and per["d3.txt"]["risk_bucket"] == "medium"
    assert per["d0.txt"]["issue_types"] == ""


def test_strict_profile_goldens(spark):
    fp, _ = portfolio(spark, [A, D])
    s = {x["doc_id"]: x for x in risk.strict_per_doc(fp, P.strict()).collect()}
    # A: law "the State of Delaware" is not on the approved list -> NOTICE; date present.
    assert [i["type"] for i in s["d0.txt"]["_strict_issues"]] == ["NOTICE"]
    assert s["d0.txt"]["risk_score"] == 1 and s["d0.txt"]["risk_bucket"] == "low"
    assert s["d0.txt"]["tags"] == ["law:the State of Delaware", "net:fast"]
    # D: four missing fields (date, law, payment, termination) = 12 -> high.
    assert s["d1.txt"]["risk_score"] == 12 and s["d1.txt"]["risk_bucket"] == "high"
    assert s["d1.txt"]["tags"] == ["incomplete"]


def test_findings_rows_equal_issue_counts(spark):
    from clauselens.operators.findings import findings
    _, xr = portfolio(spark, [A, B, C, D])
    n_issues = xr.select(F.sum(F.size("_issues"))).collect()[0][0]
    f = findings(xr)
    assert f.count() == n_issues
    d = {(x["doc_id"], x["issue_pos"]): x for x in f.collect()}
    assert d[("d1.txt", 3)]["details"] == '{"value":1250000.00,"warn_above":1000000.00}'
    assert d[("d2.txt", 3)]["details"] == '{"value":150,"median":45.0,"pct_dev":2.33}'
    assert d[("d2.txt", 0)]["quote"] == "Sept 5, 2000"
