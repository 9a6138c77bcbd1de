"""Markdown reports (S15, F5). Sections whose length follows the corpus are DataFrames of
lines, sorted and written by Spark; only top-k sections are formatted on the driver. The
headings and line formats are fixed values (the original's)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from . import crossref, findings as FN, kpis as K

LIST_ROWS = P.REPORT_EVIDENCE_ROWS


LINES = "part int, number double, name string, line string"


def text_lines(spark, lines, part: int) -> DataFrame:
    """Fixed lines of a report as a part of it."""
    return spark.createDataFrame([(part, float(i), "", s) for i, s in enumerate(lines)], LINES)


def _part(df: DataFrame, part: int, number, name, line) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.lit(number).cast("double").alias("number") if not hasattr(number, "cast")
                     else number.cast("double").alias("number"), name.alias("name"), line.alias("line"))


def in_order(lines: DataFrame) -> DataFrame:
    """The lines sorted for writing (a distributed range sort)."""
    return lines.orderBy("part", "number", "name")


def write_lines(lines: DataFrame, path: str) -> None:
    """One markdown text folder; part files are in the order of the report."""
    in_order(lines).select("line").write.mode("overwrite").text(path)


def crossref_lines(xr: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    """The cross-reference report as lines ``(part, number, name, line)``.

    All governing laws and all parties are listed (their number grows with the corpus, so
    the lines stay distributed); each of the four evidence lists shows at most ``n``.
    """
    spark = xr.sparkSession
    head = crossref.crossref_summary(xr).collect()[0]
    laws, parties = crossref.governing_laws_listed(xr), crossref.party_contract_counts(xr)
    shown = crossref.first_evidence(crossref.crossref_evidence(xr), n)
    out = [text_lines(spark, [
        "# Cross-Reference Report (Validator)\n", f"- Documents: **{head['doc_count']}**",
        f"- Median Net Days: **{head['net_days_median']}**", f"- Top Governing Law: **{head['governing_law_top']}**\n",
        "## Governing Law Distribution\n", *(["_none_"] if laws.isEmpty() else [])], 0)]
    out.append(_part(laws, 1, -F.col("contracts"), F.col("first_doc"),
                     F.concat(F.lit("- "), "governing_law", F.lit(": "), F.col("contracts").cast("string"))))
    out.append(text_lines(spark, ["", "## Per-Party Contract Counts\n", *(["_none_"] if parties.isEmpty() else [])], 2))
    out.append(_part(parties, 3, -F.col("contracts"), F.col("party_key"),
                     F.concat(F.lit("- "), "party_key", F.lit(": "), F.col("contracts").cast("string"))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    doc = F.concat(F.lit("- "), F.col("doc_id"), F.lit(": "))
    sections = (
        ("Inconsistent Governing Law (by Party)", "inconsistent_governing_law",
         F.concat(doc, text("party_key"), F.lit(" — value="), text("value"), F.lit(" vs party_mode="), text("reference"))),
        ("Net Days Outliers", "net_days_outliers",
         F.concat(doc, text("value"), F.when(F.col("reason") == "far_from_median", F.concat(F.lit(" (median "), text("reference"), F.lit(")")))
                  .otherwise(F.concat(F.lit(" ("), text("reason"), F.lit(")"))))),
        ("Net Days Drift vs Party Median", "net_days_party_drifts",
         F.concat(doc, text("party_key"), F.lit(" — "), text("value"), F.lit(" vs party_median "), text("reference"))),
        ("High Payment Amount Warnings", "amount_high_warnings", F.concat(doc, F.lit("amount="), text("value"))),
    )
    name = F.concat("doc_id", F.lit(" "), F.lpad(F.col("issue_pos").cast("string"), 6, "0"))
    text_of = F.coalesce(*[F.when(F.col("section") == sec, line) for _, sec, line in sections])
    rows = shown.select("section", name.alias("name"), text_of.alias("line")).collect()      # n rows a list at most
    for k, (title, sec, _) in enumerate(sections):
        listed = [(5 + 2 * k, 0.0, r["name"], r["line"]) for r in rows if r["section"] == sec]
        out.append(text_lines(spark, ["", f"## {title}\n", *([] if listed else ["_none_"])], 4 + 2 * k))
        if listed:
            out.append(spark.createDataFrame(listed, LINES))
    out.append(text_lines(spark, [""], 4 + 2 * len(sections)))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def summary_markdown(per_doc: DataFrame, sentences: DataFrame) -> list:
    """The analyst's summary: KPIs and the extractive sentences (``TOP_K`` of them)."""
    nd = K.kpi_net_days(per_doc).collect()[0]
    avg = K.kpi_avg_risk(per_doc).collect()[0]["avg_risk_score"]
    buckets = {r["risk_bucket"]: r["documents"] for r in K.kpi_risk_buckets(per_doc).collect()}
    lines = ["# Corpus Summary (Analyst)\n", f"- Documents: **{per_doc.count()}**", f"- Average Risk Score: **{avg}**",
             f"- Risk Buckets: **{buckets}**", f"- Net Days (Median / P90): **{nd['net_days_median']} / {nd['net_days_p90']}**\n",
             "## Key Risk Sentences\n"]
    rows = sentences.collect()                     # top-k sentences
    return lines + ([f"- {r['sentence']}" for r in rows] or ["_none_"]) + [""]


def analysis_markdown(per_doc: DataFrame, fnd: DataFrame, policy: P.Policy = P.current()) -> list:
    """The analysis report: KPIs, top risky documents, issue sections with quotes."""
    nd = K.kpi_net_days(per_doc).collect()[0]
    avg = K.kpi_avg_risk(per_doc).collect()[0]["avg_risk_score"]
    buckets = {r["risk_bucket"]: r["documents"] for r in K.kpi_risk_buckets(per_doc).collect()}
    laws = {r["governing_law"]: r["documents"] for r in K.kpi_top_law(per_doc).collect()}
    lines = ["# Contract Analysis Report (Reporter)\n", "## Portfolio KPIs\n",
             f"- **Average Risk Score:** {avg}", f"- **Risk Buckets:** {buckets}",
             f"- **Net Days (Median / P90):** {nd['net_days_median']} / {nd['net_days_p90']}",
             f"- **Top Governing Law:** {laws}",
             *[f"- **Highest Avg Risk:** {r['party_key']} ({r['avg_risk_score']})" for r in K.kpi_party_avg_risk(per_doc, 1).collect()], "",
             f"## Top {policy.top_risky_docs} Risky Documents\n"]
    cols = ["doc_id", "risk_score", "risk_bucket", "issues_count", "payment_net_days", "governing_law"]
    lines += FN.markdown_table(per_doc, cols, [F.desc("risk_score"), "doc_id"], policy.top_risky_docs)
    lines.append("")
    shown = sorted(FN.report_sections(fnd).collect(), key=lambda r: r["row"])     # ten rows a section at most
    for title, _ in FN.SECTIONS:
        lines.append(f"## {title}\n")
        rows = [r for r in shown if r["section"] == title]
        if not rows:
            lines.append("_none_\n")
            continue
        c2 = ["doc_id", "issue_type", "field", "payment_net_days", "payment_amount"]
        lines += ["|" + "|".join(c2) + "|", "|" + "|".join(["---"] * len(c2)) + "|"]
        lines += ["|" + "|".join("-" if r[c] in (None, "") else str(r[c]) for c in c2) + "|" for r in rows]
        lines += ["", "**Representative Quotes:**"]
        lines += [f"> {r['quote'].strip()}" for r in rows if r["quote"] and r["quote"].strip()]
        lines.append("")
    return lines
