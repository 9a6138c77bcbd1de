"""A folder of texts to all outputs, with rules files; reports with long lists."""

import json
import os

import pytest

from clauselens import policy as P
from clauselens.operators import report as RP
from clauselens.plans.run import check_unique, run_documents, run_folder

TEXT = ("This Agreement is made by and between {a} and {b}, as follows. Effective Date: March 3, 2024. Payment Terms: Buyer shall pay "
        "US$ 12,000.00 per invoice, net {n} days, using commercially reasonable efforts. This Agreement is governed by the laws of the State of "
        "{law}, as amended. Termination. Either party may terminate this Agreement upon 30 days written notice to the other party.")


def lines(path):
    out = []
    for f in sorted(os.listdir(path)):
        if f.startswith("part-"):
            out += open(os.path.join(path, f), encoding="utf-8").read().splitlines()
    return out


def rows(path):
    return [json.loads(x) for x in lines(path)]


def test_folder_to_outputs(spark, tmp_path):
    src, rules, out = (tmp_path / x for x in ("texts", "rules", "out"))
    src.mkdir(), rules.mkdir()
    for i, (law, n) in enumerate([("Delaware", 30), ("Delaware", 30), ("Texas", 200), ("Delaware", 60)]):
        (src / f"c{i}.txt").write_text(TEXT.format(a="Alpha Corp", b=f"Beta{i % 2} Ltd", n=n, law=law), encoding="utf-8")
    (rules / "validationrules.json").write_text(json.dumps({"standards": {"max_net_days": 100}}))
    pf = run_folder(spark, str(src), str(out), str(rules))
    assert pf.policy.max_net_days == 100 and pf.policy.net_days_standard == P.current().net_days_standard
    docs = {r["doc_id"]: r for r in rows(out / "validate/documents")}
    assert len(docs) == 4 and len(rows(out / "extract/records")) == 4
    assert any(i["type"] == "NET_DAYS_OVER_MAX" for i in docs["c2.txt"]["_issues"])
    laws = {r["governing_law"]: r["contracts"] for r in rows(out / "validate/crossref/governing_law_counts")}
    assert laws == {"the State of Delaware": 3, "the State of Texas": 1}
    md = lines(out / "validate/crossref/report.md")
    assert md[0] == "# Cross-Reference Report (Validator)" and md.index("- the State of Delaware: 3") < md.index("- the State of Texas: 1")
    assert len(rows(out / "analyze/per_doc_json")) == 4 and json.loads(rows(out / "analyze/kpis")[0]["kpis"])["net_days_max"] == 200
    assert any("Key Risk Sentences" in x for x in lines(out / "analyze/summary.md"))
    assert any("Highest Avg Risk" in x for x in lines(out / "report/report.md"))
    types = {r["issue_type"] for r in rows(out / "report/findings_json")}
    assert "NET_DAYS_OVER_MAX" in types
    pf.release()


def test_report_lists_all_parties_and_laws(spark):
    from clauselens.operators import crossref
    v = spark.createDataFrame([(f"d{i:04d}", f"p{i:04d}", f"law{i:04d}") for i in range(450)], "doc_id string, party_key string, governing_law string")
    parties, laws = crossref.party_contract_counts(v), crossref.governing_laws_listed(v)
    assert parties.count() == laws.count() == 450
    part = RP._part(parties, 3, -RP.F.col("contracts"), RP.F.col("party_key"), RP.F.col("party_key"))
    assert [r["line"] for r in RP.in_order(part).collect()] == [f"p{i:04d}" for i in range(450)]


def test_ids_must_be_unique(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "doc_id string, text string")
    with pytest.raises(ValueError):
        check_unique(df)
    with pytest.raises(ValueError):
        run_documents(df, str(tmp_path))


def test_rules_keep_defaults():
    p = P.from_rules({"ambiguity_terms": ["x"]}, {"weights": {"MISSING": 9}, "risk_buckets": {"medium": 1}, "caps": {"max_risk_score_per_doc": 20}},
                     {"chunk_size": 10})
    d = P.current()
    assert p.ambiguity_terms == ("x",) and p.weight_map["MISSING"] == 9 and p.weight_map["BAD_DATE"] == d.weight_map["BAD_DATE"]
    assert p.medium == 1 and p.high == d.high and p.score_cap == 20 and p.chunk_size == 10 and p.required_fields == d.required_fields
    assert P.from_rules() == d
