"""Exploration queries over the per-document and findings tables.

A selection is plain data (lists and a range), turned into one Column
predicate; an empty list means "no filter" for that dimension, and the
net-days range keeps documents without net days.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.text import truthy_str

DEFAULT_ND_RANGE = (0, 200)
MIN_ND_WIDTH = 10
# Termination notice, e.g. "30 days" or "sixty (60) days".
NOTICE_DAYS_RX = r"(\d+)\)?\s+days"


@dataclass(frozen=True)
class Selection:
    risk_buckets: tuple = ()
    governing_laws: tuple = ()
    parties: tuple = ()
    net_days: tuple | None = None  # (low, high) inclusive; None = no range


def filter_options(per_doc: DataFrame) -> DataFrame:
    """Distinct non-NULL values of the three filter dimensions, sorted; one pass."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
                                 for c in ("risk_bucket", "governing_law", "party_key")]))
    return (per_doc.select(values.alias("v")).select("v.*").where(truthy_str(F.col("value")))
            .distinct().orderBy("dimension", "value"))


def selection_predicate(sel: Selection) -> Column:
    cond = F.lit(True)
    if sel.risk_buckets:
        cond = cond & F.col("risk_bucket").isin(*sel.risk_buckets)
    if sel.governing_laws:
        cond = cond & F.col("governing_law").isin(*sel.governing_laws)
    if sel.parties:
        cond = cond & F.col("party_key").isin(*sel.parties)
    if sel.net_days is not None:
        lo, hi = sel.net_days
        nd = F.col("payment_net_days")
        cond = cond & (nd.between(lo, hi) | nd.isNull())
    return cond


def apply_filters(per_doc: DataFrame, sel: Selection) -> DataFrame:
    """E2."""
    return per_doc.where(selection_predicate(sel))


def net_days_bounds(per_doc: DataFrame) -> DataFrame:
    """Slider bounds - min and max net days, at least 10 apart; 0-200 without data."""
    agg = per_doc.agg(F.min("payment_net_days").alias("lo"), F.max("payment_net_days").alias("hi"))
    lo = F.coalesce(F.col("lo"), F.lit(DEFAULT_ND_RANGE[0]))
    hi = F.when(F.col("lo").isNull(), F.lit(DEFAULT_ND_RANGE[1])).otherwise(
        F.greatest(F.col("hi"), F.col("lo") + MIN_ND_WIDTH))
    return agg.select(lo.cast("bigint").alias("nd_min"), hi.cast("bigint").alias("nd_max"))


def top_filtered(filtered: DataFrame, n: int = P.EXPLORE_TOP_ROWS) -> DataFrame:
    """Riskiest documents of a selection (ties by ``doc_id``)."""
    return (filtered.orderBy(F.desc("risk_score"), F.asc("doc_id")).limit(n)
            .select("doc_id", "risk_score", "risk_bucket", "issues_count", "payment_net_days",
                    "governing_law", "party_key"))


def findings_of(findings: DataFrame, filtered: DataFrame, per_doc: DataFrame) -> DataFrame:
    """E5: findings of the kept documents; all findings when nothing is kept.

    One semi-join on ``doc_id`` against the kept ids, or against all ids when
    the selection is empty (decided by a one-row existence check, not by
    collecting the selection); the findings are computed once.
    """
    kept = filtered.select("doc_id")
    any_kept = kept.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    keys = kept.unionByName(per_doc.select("doc_id").where(any_kept == 0))
    return findings.join(keys, "doc_id", "left_semi")


def findings_by_type(findings: DataFrame, types) -> DataFrame:
    """Findings of the chosen issue types (empty choice = all)."""
    return findings.where(F.col("issue_type").isin(*types)) if types else findings


def termination_notice_days(termination_text: Column) -> Column:
    """Notice period in days inside the termination clause (first number before ``days``)."""
    g = F.regexp_extract(termination_text, NOTICE_DAYS_RX, 1)
    return F.when(g != "", g.try_cast("int"))


def question_predicate(question: str, columns, places=P.US_STATES + P.COUNTRIES) -> Column | None:
    """The rule-based reading of a question, as a predicate (None = no rule).

    A question about governing law (``governed by`` or ``governing law``) that names known
    places, wherever they stand, asks for laws that contain one of them (the original knew
    California only). ``termination ... less than N`` asks for notice days below N. A rule
    whose column is absent does not apply.
    """
    q = question.lower()
    if ("governed by" in q or "governing law" in q) and "governing_law" in columns:
        named = [p.lower() for p in places if re.search(r"\b" + re.escape(p.lower()) + r"\b", q)]
        if named:
            law = F.lower(F.col("governing_law"))
            cond = law.contains(named[0])
            for p in named[1:]:
                cond = cond | law.contains(p)
            return cond
    if "termination" in q and "termination_notice_days" in columns:
        m = re.search(r"less than (\d+)", q)
        if m:
            return F.col("termination_notice_days") < int(m.group(1))
    return None


def question_filter(docs: DataFrame, question: str) -> DataFrame:
    """Documents matching the question (all documents when no rule applies)."""
    pred = question_predicate(question, docs.columns)
    return docs if pred is None else docs.where(pred)


def suggest_schema(df: DataFrame) -> DataFrame:
    """Per column, how many values are present and how many parse as a
    number / ISO date; the suggestion stays ``text`` as in the original."""
    probes = []
    for c in df.columns:
        s = F.col(c).cast("string")
        probes += [
            F.count(s).alias(f"{c}__n"),
            F.count_if(s.try_cast("double").isNotNull()).alias(f"{c}__num"),
            F.count_if(F.try_to_date(s, "yyyy-MM-dd").isNotNull()).alias(f"{c}__date"),
        ]
    row = df.agg(*probes)
    stacked = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"{c}__n").alias("values"),
        F.col(f"{c}__num").alias("numeric"), F.col(f"{c}__date").alias("dates")) for c in df.columns]))
    return row.select(stacked.alias("p")).select("p.*", F.lit("text").alias("suggested_type"))
