"""Risk scoring (R1-R5) and the strict profile's rules.

Scores are computed inside the row with ``aggregate`` over the issue array:
no explode, no join, no shuffle. Weights are a literal map built from the
policy (a handful of entries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import normalize as N
from ..functions.text import truthy_str
from .validate import issue, keep_issues

ND = "payment_net_days"
AMT = "payment_amount_normalized"


def weight_map(policy: P.Policy) -> Column:
    return F.create_map(*[x for t, w in policy.weights for x in (F.lit(t), F.lit(float(w)))])


def issue_weight_sum(policy: P.Policy, issues: Column | None = None) -> Column:
    """R1 total: sum of issue weights; unknown types weigh 0."""
    issues = F.col("_issues") if issues is None else issues
    wm = weight_map(policy)
    return F.aggregate(issues, F.lit(0.0),
                       lambda acc, x: acc + F.coalesce(F.try_element_at(wm, x["type"]), F.lit(0.0)))


def net_days_component(policy: P.Policy) -> Column:
    """R2: ``min(3, (nd - standard) / 30)`` above the standard."""
    nd = F.col(ND)
    std = policy.net_days_standard
    return F.when(nd > std, F.least(F.lit(3.0), F.greatest(F.lit(0.0), (nd - F.lit(std)) / F.lit(30.0))))


def amount_component(policy: P.Policy) -> Column:
    """``min(2, (amount - warn) / warn)`` above the warn level."""
    amt, warn = F.col(AMT), float(policy.amount_upper_warn)
    return F.when(amt > warn, F.least(F.lit(2.0), (amt - F.lit(warn)) / F.lit(warn or 1.0)))


def risk_score(policy: P.Policy = P.current()) -> Column:
    """R4 (unrounded). The strict profile caps the issue sum and has no numeric components."""
    wsum = issue_weight_sum(policy)
    if policy.score_cap is not None:
        return F.least(F.lit(float(policy.score_cap)), wsum)
    return (wsum + F.coalesce(net_days_component(policy), F.lit(0.0))
            + F.coalesce(amount_component(policy), F.lit(0.0)))


def risk_breakdown(v: DataFrame, policy: P.Policy = P.current()) -> DataFrame:
    """``(doc_id, component, value)`` - weight sum per issue type (first-seen
    order) plus the numeric components; zero-weight types are omitted."""
    wm = weight_map(policy)
    types = F.array_distinct(F.transform("_issues", lambda x: x["type"]))
    per_type = F.transform(types, lambda t: F.struct(
        t.alias("component"),
        F.aggregate(F.filter("_issues", lambda x: x["type"] == t), F.lit(0.0),
                    lambda acc, x: acc + F.coalesce(F.try_element_at(wm, x["type"]), F.lit(0.0))
                    ).alias("value")))
    comps = [per_type]
    if policy.score_cap is None:
        comps.append(F.array(
            F.struct(F.lit("NET_DAYS_DRIFT_NUMERIC").alias("component"),
                     net_days_component(policy).alias("value")),
            F.struct(F.lit("AMOUNT_OVER_WARN_NUMERIC").alias("component"),
                     amount_component(policy).alias("value"))))
    allc = F.filter(F.concat(*comps), lambda c: c["value"].isNotNull() & (c["value"] != 0))
    return (v.select("doc_id", F.posexplode(allc).alias("pos", "c"))
            .select("doc_id", "pos", F.col("c.component").alias("component"),
                    F.col("c.value").alias("value")))


def issue_types(issues: Column | None = None) -> Column:
    """Sorted distinct issue types joined by ``,``."""
    issues = F.col("_issues") if issues is None else issues
    return F.array_join(F.array_sort(F.array_distinct(F.filter(
        F.transform(issues, lambda x: x["type"]), lambda t: truthy_str(t)))), ",")


def per_doc_metrics(xr: DataFrame, policy: P.Policy = P.current()) -> DataFrame:
    """The 10-column per-document table (NULLs kept)."""
    score = risk_score(policy)
    return xr.select(
        "doc_id", "party_key", "governing_law",
        F.col("effective_date_normalized").alias("effective_date"),
        F.col(ND).alias("payment_net_days"),
        F.col(AMT).alias("payment_amount"),
        F.round(score, 3).alias("risk_score"),
        N.risk_bucket(score, policy.medium, policy.high).alias("risk_bucket"),
        F.size("_issues").alias("issues_count"),
        issue_types().alias("issue_types"),
    )


# ---------------------------------------------------------- strict profile

def strict_issues(v: DataFrame, policy: P.Policy = P.strict()) -> DataFrame:
    """The strict profile's issues, with a ``detail`` text each.

    Order per document: MISSING (schema order), NOTICE, AMBIGUOUS (clauses),
    AMBIGUOUS (redacted parties).
    """
    missing = [F.when(_strict_missing(f), issue(
        "MISSING", field=F.lit(f), detail=F.lit(f"Required field '{f}' is missing")))
        for f in policy.required_fields]
    law = F.col("governing_law")
    notice = F.when(truthy_str(law) & ~law.isin(*policy.approved_laws), issue(
        "NOTICE", field=F.lit("governing_law"), value=law,
        detail=F.concat(F.lit("Non-standard governing law: "), law)))
    amb = []
    for f in ("payment_terms", "termination_clause"):
        terms = N.matched_terms(F.col(f"{f}.text"), policy.strict_ambiguity_terms)
        amb.append(F.when(F.col(f).isNotNull() & (F.size(terms) > 0), issue(
            "AMBIGUOUS", field=F.lit(f), value=F.array_join(terms, ", "),
            detail=F.concat(F.lit("Ambiguous language found: "), F.array_join(terms, ", ")))))
    redacted = F.when(redacted_parties(F.col("parties")), issue(
        "AMBIGUOUS", field=F.lit("parties"), detail=F.lit("Party names appear redacted")))
    return v.select("*", keep_issues(*missing, notice, *amb, redacted).alias("_strict_issues"))


def _strict_missing(f: str) -> Column:
    c = F.col(f)
    if f == "parties":
        return c.isNull() | (F.size(c) == 0)
    if f in ("payment_terms", "termination_clause"):
        return c.isNull()
    return ~truthy_str(c)


def redacted_parties(parties: Column) -> Column:
    """A party name containing ``[*`` or no letter at all."""
    return F.coalesce(F.exists(parties, lambda x: F.contains(x, F.lit("[*")) | ~x.rlike("[A-Za-z]")),
                      F.lit(False))


def payment_amounts(text: Column) -> Column:
    """Every currency amount in the text as ``{currency, amount}``."""
    rx = r"(?i)(USD|US\$|\$)\s?([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?|\d+(?:\.\d{2})?)"
    cur = F.regexp_extract_all(text, F.lit(rx), 1)
    amt = F.regexp_extract_all(text, F.lit(rx), 2)
    return F.when(text.isNull(), F.array().cast("array<struct<currency:string,amount:double>>")).otherwise(
        F.zip_with(cur, amt, lambda c, a: F.struct(
            F.upper(c).alias("currency"),
            F.replace(a, F.lit(","), F.lit("")).try_cast("double").alias("amount"))))


def doc_tags(policy: P.Policy = P.strict(), issues: Column | None = None) -> Column:
    """L4: ``law:<raw>``, ``net:fast`` (net days at or under the standard), ``incomplete``."""
    issues = F.col("_strict_issues") if issues is None else issues
    law, nd = F.col("governing_law"), F.col(ND)
    return keep_issues(
        F.when(truthy_str(law), F.concat(F.lit("law:"), law)),
        F.when(nd.isNotNull() & (nd <= policy.net_days_standard), F.lit("net:fast")),
        F.when(F.exists(issues, lambda x: x["type"] == "MISSING"), F.lit("incomplete")),
    )


def strict_per_doc(v: DataFrame, policy: P.Policy = P.strict()) -> DataFrame:
    """L1-L7 per document."""
    s = strict_issues(v, policy)
    score = issue_weight_sum(policy, F.col("_strict_issues"))
    if policy.score_cap is not None:
        score = F.least(F.lit(float(policy.score_cap)), score)
    return s.select(
        "doc_id", "_char_count", "governing_law", F.col(ND).alias("payment_net_days"),
        "effective_date", "_strict_issues",
        score.cast("int").alias("risk_score"),
        N.risk_bucket(score, policy.medium, policy.high).alias("risk_bucket"),
        doc_tags(policy).alias("tags"),
        payment_amounts(F.col("payment_terms.text")).alias("payment_amounts"),
    )
