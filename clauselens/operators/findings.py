"""Findings and report queries.

``findings`` explodes the issue array once (``posexplode`` keeps the issue
position, the row identity). Report sections take the first rows per section
with a window over the already-small findings of that section; only bounded
row sets are ever collected (for markdown rendering in ``report``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.normalize import clamp_quote

# Report sections and the issue types each one lists.
SECTIONS = (
    ("Missing Fields", ("MISSING",)),
    ("Ambiguous Clauses", ("AMBIGUOUS",)),
    ("Net Days Outliers", ("NET_DAYS_OUTLIER", "NET_DAYS_OVER_MAX", "NET_DAYS_DRIFT_VS_PARTY")),
    ("Governing Law Inconsistencies", ("GOVERNING_LAW_INCONSISTENT",)),
    ("High Payment Amount Warnings", ("PAYMENT_AMOUNT_HIGH",)),
)


def details_json(i: Column) -> Column:
    """Issue payload without ``type``/``field`` as compact JSON, keys in rule order."""
    t = i["type"]
    j = lambda *cols: F.to_json(F.struct(*cols))
    as_int = i["value"].try_cast("int")
    money = lambda c: c.cast("decimal(38,2)")
    return (
        F.when(t == "BAD_DATE", j(i["value"].alias("value")))
        .when(t == "AMBIGUOUS", j(i["reason"].alias("reason"),
                                  F.struct(i["span"]["start"].alias("start"), i["span"]["end"].alias("end")).alias("span")))
        .when(t == "MISSING", F.lit("{}"))
        .when(t == "NET_DAYS_OVER_MAX", j(as_int.alias("value"), i["max"].alias("max")))
        .when(t == "NET_DAYS_OUTLIER", j(as_int.alias("value"), i["median"].alias("median"),
                                         i["pct_dev"].alias("pct_dev")))
        .when(t == "GOVERNING_LAW_INCONSISTENT", j(i["party_key"].alias("party_key"),
                                                   i["value"].alias("value"),
                                                   i["party_mode"].alias("party_mode")))
        .when(t == "NET_DAYS_DRIFT_VS_PARTY", j(i["party_key"].alias("party_key"), as_int.alias("value"),
                                                i["party_median"].alias("party_median"),
                                                i["tolerance"].alias("tolerance")))
        .when(t == "PAYMENT_AMOUNT_HIGH", j(money(i["value"]).alias("value"),
                                            money(i["warn_above"]).alias("warn_above")))
        .otherwise(F.to_json(i.dropFields("type", "field")))
    )


def field_text(field: Column) -> Column:
    """The text of the field an issue names (span text or plain string)."""
    return (F.when(field == "payment_terms", F.col("payment_terms.text"))
            .when(field == "termination_clause", F.col("termination_clause.text"))
            .when(field == "effective_date", F.col("effective_date"))
            .when(field == "governing_law", F.col("governing_law")))


def findings(xr: DataFrame, policy: P.Policy = P.current()) -> DataFrame:
    """one row per issue with details JSON and a clamped quote."""
    ex = xr.select("doc_id", "governing_law", "effective_date", "payment_terms",
                   "termination_clause", "payment_net_days", "payment_amount_normalized",
                   F.posexplode_outer("_issues").alias("issue_pos", "i"))
    # outer: with posexplode an inferred filter would compute the issues twice
    return ex.where(F.col("issue_pos").isNotNull()).select(
        "doc_id",
        F.col("issue_pos").cast("bigint").alias("issue_pos"),
        F.col("i.type").alias("issue_type"),
        F.col("i.field").alias("field"),
        "governing_law",
        F.col("payment_net_days").cast("bigint").alias("payment_net_days"),
        F.col("payment_amount_normalized").alias("payment_amount"),
        details_json(F.col("i")).alias("details"),
        clamp_quote(field_text(F.col("i.field")), policy.max_quote_chars).alias("quote"),
    )


def findings_of_passes(first: DataFrame, marked: DataFrame, policy: P.Policy = P.current()) -> DataFrame:
    """F1 in two parts, none of which shuffles a clause: issues of the first pass with the quotes
    of their own row, and those that the cross-reference appended in ``marked``
    (rows without clauses, ``first_issues`` of the first pass). The latter name no field, so
    they have no quote."""
    no_clause = [F.lit(None).cast("struct<text:string>").alias(c) for c in ("payment_terms", "termination_clause")]
    later = marked.withColumn("effective_date", F.lit(None).cast("string")).select("*", *no_clause)
    appended = findings(later.withColumn("_issues", F.transform("_issues", lambda i, k: F.when(k >= F.col("first_issues"), i))), policy)
    return findings(first, policy).unionByName(appended.where(F.col("issue_type").isNotNull()))


def top_risky_docs(per_doc: DataFrame, n: int = P.TOP_RISKY_DOCS) -> DataFrame:
    """highest risk first, ties by ``doc_id`` (TakeOrderedAndProject)."""
    return (per_doc.orderBy(F.desc("risk_score"), F.asc("doc_id")).limit(n)
            .select("doc_id", "risk_score", "risk_bucket", "issues_count", "payment_net_days",
                    "governing_law"))


def section_of(issue_type: Column) -> Column:
    out = None
    for title, types in SECTIONS:
        cond = issue_type.isin(*types)
        out = F.when(cond, F.lit(title)) if out is None else out.when(cond, F.lit(title))
    return out


def report_sections(fnd: DataFrame, rows: int = P.REPORT_SECTION_ROWS) -> DataFrame:
    """first ``rows`` findings of each section in document order.

    ``row_number() <= rows`` over the section lets Spark insert a group limit
    before the shuffle (each map task forwards at most ``rows`` rows per
    section), so a section holding most findings never lands whole in one task.
    """
    tagged = fnd.select("*", section_of(F.col("issue_type")).alias("section")).where(
        F.col("section").isNotNull())
    w = Window.partitionBy("section").orderBy("doc_id", "issue_pos")
    ranked = tagged.select("*", F.row_number().over(w).cast("bigint").alias("row"))
    return ranked.where(F.col("row") <= rows).select(
        "section", "row", "doc_id", "issue_pos", "issue_type", "field", "payment_net_days",
        "payment_amount", "quote")


def report_quotes(sections: DataFrame) -> DataFrame:
    """the non-empty quotes among each section's rows."""
    return sections.where(F.length(F.btrim(F.col("quote"))) > 0).select(
        "section", "row", "doc_id", F.btrim(F.regexp_replace("quote", "\n", " ")).alias("quote"))


def markdown_rows(df: DataFrame, cols) -> DataFrame:
    """each row rendered as a markdown table line; blank cells become ``-``."""
    cells = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")) for c in cols]
    return df.select(F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|")).alias("line"))


def markdown_table(df: DataFrame, cols, order, max_rows: int) -> list:
    """Render a bounded table: header, rule, at most ``max_rows`` lines (collected)."""
    lines = ["|" + "|".join(cols) + "|", "|" + "|".join(["---"] * len(cols)) + "|"]
    body = markdown_rows(df.orderBy(*order).limit(max_rows), cols).collect()
    if not body:
        return ["_none_"]
    return lines + [r["line"] for r in body]
