"""A public filing from text to record, with every step's result pinned."""

from clauselens.operators import model as MD
from clauselens.operators.extraction import extract_fields, extract_record
from clauselens.operators.validate import validate_first_pass
from clauselens.policy import current

FILING = (
        'Exhibit 99.1 JOINT FILING AGREEMENT The undersigned hereby agree that the Schedule 13G/A with respect to the shares of '
        'Class A Common Stock, $0.001 par value per share, of The RMR Group Inc., dated as of December 31, 2019, is, and any '
        'amendments thereto (including amendments on Schedule 13D) signed by each of the undersigned shall be, filed on behalf of'
        ' each of us pursuant to and in accordance with the provisions of Rule 13d-1(k) under the Securities Exchange Act of '
        '1934, as amended. January 22, 2020 (Date) ABP TRUST /s/ Adam D. Portnoy (Signature) Adam D. Portnoy, President '
        '(Name/Title) ADAM D. PORTNOY /s/ Adam D. Portnoy (Signature) 10')

#: What an entity recogniser finds in it, repeats and short names included.
ENTITIES = [("Schedule", "ORG"), ("Class A Common Stock", "ORG"), ("The RMR Group Inc.", "ORG"), ("December 31, 2019", "DATE"), ("Schedule", "ORG"),
            ("Adam D. Portnoy", "PERSON"), ("Adam D. Portnoy", "PERSON"), ("ADAM D. PORTNOY", "PERSON")]


def test_a_filing_without_clauses(spark):
    docs = spark.createDataFrame([("filing.txt", FILING)], "doc_id string, text string")
    rules_only = extract_fields(docs, current().with_(use_fallback=False), keep_text=True)
    r = extract_record(MD.apply_recognizer(rules_only, lambda: lambda text: ENTITIES)).first()
    assert r["parties"] == ["Schedule", "Class A Common Stock", "The RMR Group Inc.", "Adam D. Portnoy"]
    assert r["effective_date"] is r["governing_law"] is r["payment_terms"] is r["termination_clause"] is None
    assert (r["_doc_id"], r["_char_count"]) == ("filing.txt", 645)
    assert {k: v["source"] for k, v in r["_provenance"].items()} == {"parties": "entity"}


def test_its_first_pass(spark):
    docs = spark.createDataFrame([("filing.txt", FILING)], "doc_id string, text string")
    v = validate_first_pass(MD.apply_recognizer(extract_fields(docs, current().with_(use_fallback=False), keep_text=True), lambda: lambda text: ENTITIES)).first()
    assert v["party_key"] == "CLASS A COMMON STOCK | SCHEDULE"
    assert [(i["type"], i["field"]) for i in v["_issues"]] == [("MISSING", f) for f in current().required_fields if f != "parties"]
