"""The whole run, from a folder of texts to every output (the four stages in turn).

``run_folder`` reads ``*.txt`` files, extracts, validates, analyses and reports, and
writes under ``out_dir`` (all by Spark's writers):

    extract/records           extract records, JSON
    validate/documents        documents with all issues, JSON
    validate/crossref         law counts, party counts, evidence: JSON; report.md
    analyze/per_doc_csv|json  per-document metrics
    analyze/kpis              the KPI document, JSON
    analyze/summary.md        KPIs and the key risk sentences
    report/findings_csv|json  findings with quotes
    report/report.md          analysis report

``doc_id`` is the file name; names must be unique (``check_unique`` raises otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P
from ..operators import crossref, findings as FN, kpis as K, report as RP
from ..operators.extraction import extract_record
from ..session import apply_defaults, ensure_checkpoint_dir
from ..sources import files as FS
from .portfolio import Portfolio


def check_unique(docs: DataFrame, id_col: str = "doc_id") -> None:
    """Every later join is on the document id, so it must be unique."""
    twice = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"document ids are not unique: {[r[0] for r in twice]}")


def run_documents(docs: DataFrame, out_dir: str, policy: P.Policy = P.current()) -> Portfolio:
    """All outputs of ``(doc_id, text)``; returns the portfolio (release it when done)."""
    spark = apply_defaults(docs.sparkSession)
    ensure_checkpoint_dir(spark)
    docs = docs.select("doc_id", "text")
    check_unique(docs)
    out = out_dir.rstrip("/")
    pf = Portfolio(spark, "", policy, docs=docs)
    FS.write_json(extract_record(pf.extracted), f"{out}/extract/records")
    FS.write_json(pf.validated, f"{out}/validate/documents")
    for name, part in crossref.crossref_report(pf.marked).items():
        FS.write_json(part, f"{out}/validate/crossref/{name}")
    RP.write_lines(RP.crossref_lines(pf.marked), f"{out}/validate/crossref/report.md")
    FS.write_csv(pf.per_doc, f"{out}/analyze/per_doc_csv")
    FS.write_json(pf.per_doc, f"{out}/analyze/per_doc_json")
    FS.write_json(K.kpi_document(pf.per_doc), f"{out}/analyze/kpis")
    top = pf.clause_corpus.summary(policy.top_k_summary, policy.risk_keywords)
    RP.write_lines(RP.text_lines(spark, RP.summary_markdown(pf.per_doc, top), 0), f"{out}/analyze/summary.md")
    findings = pf.findings
    FS.write_csv(findings, f"{out}/report/findings_csv")
    FS.write_json(findings, f"{out}/report/findings_json")
    RP.write_lines(RP.text_lines(spark, RP.analysis_markdown(pf.per_doc, findings, policy), 0), f"{out}/report/report.md")
    return pf


def run_folder(spark: SparkSession, text_dir: str, out_dir: str, rules_dir: str | None = None) -> Portfolio:
    """``run_documents`` over the ``*.txt`` files of a folder, with the rules files of ``rules_dir``."""
    policy = P.load_rules(spark, rules_dir) if rules_dir else P.current()
    return run_documents(FS.scan_text(spark, text_dir), out_dir, policy)
