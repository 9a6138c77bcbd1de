"""Corpus statistics and the cross-reference pass.

Plan shape at scale:

* corpus scalars (median net days, top law) are global aggregations consumed
  as scalar subqueries - one value each, computed once and broadcast by Spark;
* per-party statistics come from counts per (party, value), which hash aggregates
  combine map-side, so a party holding a third of all contracts is small before the
  shuffle; medians and modes are read off the counts (``quantiles``);
* statistics return to documents with an equi-join on ``party_key``. Rows
  without a party key carry a hash of their document beside it (else they would all
  hash to one partition); the join strategy (broadcast vs sort-merge) and skew splitting
  of hot keys are left to AQE, which sees the real size of the party table.

"First seen" ties follow document order, i.e. the smallest ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.text import truthy_str
from .quantiles import medians, modes
from .validate import issue, keep_issues

ND = "payment_net_days"
AMT = "payment_amount_normalized"


def amount_text(c: Column) -> Column:
    """Canonical text of an amount (two decimals, no exponent)."""
    return c.cast("decimal(38,2)").cast("string")


def corpus_rows(v: DataFrame) -> DataFrame:
    """A1."""
    return v.select("doc_id", "party_key", "governing_law", F.col(ND).alias("payment_net_days"),
                    F.col(AMT).alias("amount"))


def net_days_median(v: DataFrame) -> DataFrame:
    """A2: exact median of net days (net days has at most 1000 distinct values)."""
    return v.agg(F.median(ND).alias("net_days_median"))


def governing_law_counts(v: DataFrame) -> DataFrame:
    """A3: ``(governing_law, contracts)``."""
    return (v.where(truthy_str(F.col("governing_law")))
            .groupBy("governing_law").agg(F.count(F.lit(1)).alias("contracts")))


def governing_laws_listed(v: DataFrame) -> DataFrame:
    """A3 for the report, which lists equally frequent laws as they were first seen:
    ``(governing_law, contracts, first_doc)``."""
    return (v.where(truthy_str(F.col("governing_law"))).groupBy("governing_law")
            .agg(F.count(F.lit(1)).alias("contracts"), F.min("doc_id").alias("first_doc")))


def governing_law_top(v: DataFrame) -> DataFrame:
    """A4: most frequent law; ties go to the law seen first (the first document that has one
    of the most frequent laws says which). No row if there is no law."""
    c = governing_law_counts(v)
    most = c.agg(F.max("contracts").alias("m")).scalar()
    leaders = c.where(F.col("contracts") == most).select("governing_law")
    first = v.select("doc_id", "governing_law").join(leaders, "governing_law").orderBy("doc_id").limit(1)
    return first.select(F.col("governing_law").alias("governing_law_top"))


def party_net_days_median(v: DataFrame) -> DataFrame:
    """A5 (+A7): per party the contract count and the median net days (NULL if none)."""
    return medians(v.where(F.col("party_key").isNotNull()), ["party_key"], ND, "contracts", "party_median")


def party_law_mode(v: DataFrame) -> DataFrame:
    """Per party the most frequent law; ties go to the law seen first."""
    with_law = v.where(F.col("party_key").isNotNull() & truthy_str(F.col("governing_law")))
    return modes(with_law, "party_key", "governing_law", "doc_id", "party_mode")


def party_contract_counts(v: DataFrame) -> DataFrame:
    """Contracts per party key (NULL keys dropped)."""
    return (v.where(F.col("party_key").isNotNull()).groupBy("party_key")
            .agg(F.count(F.lit(1)).alias("contracts")))


def party_stats(v: DataFrame) -> DataFrame:
    """A5 + A6 + A7 keyed by party."""
    return party_net_days_median(v).join(party_law_mode(v), "party_key", "left")


def attach_party_stats(v: DataFrame, stats: DataFrame) -> DataFrame:
    """Party statistics on every keyed row. ``v`` is read once, rows without a key are dealt
    by their document."""
    s = stats.select("party_key", F.xxhash64("party_key").alias("_deal"), "party_median", "party_mode")
    dealt = v.withColumn("_deal", F.xxhash64(F.coalesce("party_key", "doc_id")))
    return dealt.join(s, ["party_key", "_deal"], "left").select(*v.columns, "party_median", "party_mode")


def cross_reference_issues(policy: P.Policy, med: Column) -> Column:
    """V6-V10 in order for one row (needs ``party_median``/``party_mode``)."""
    nd, amt = F.col(ND), F.col(AMT)
    pk, law = F.col("party_key"), F.col("governing_law")
    pmed, pmode = F.col("party_median"), F.col("party_mode")
    pct = F.when(med > 0, F.abs(nd - med) / med)
    over_max = F.when(nd > policy.max_net_days, issue(
        "NET_DAYS_OVER_MAX", value=nd.cast("string"), max=F.lit(policy.max_net_days)))
    outlier = F.when(nd.isNotNull() & med.isNotNull() & (med > 0)
                     & (pct >= F.lit(policy.net_days_pct_from_median)),
                     issue("NET_DAYS_OUTLIER", value=nd.cast("string"), median=med,
                           pct_dev=F.round(pct, 2)))
    inconsistent = F.when(
        F.lit(policy.check_party_law_consistency) & pk.isNotNull() & truthy_str(law)
        & pmode.isNotNull() & (law != pmode),
        issue("GOVERNING_LAW_INCONSISTENT", party_key=pk, value=law, party_mode=pmode))
    drift = F.when(pk.isNotNull() & nd.isNotNull() & pmed.isNotNull()
                   & (F.abs(nd - pmed) > F.lit(policy.per_party_net_days_tolerance)),
                   issue("NET_DAYS_DRIFT_VS_PARTY", party_key=pk, value=nd.cast("string"),
                         party_median=pmed, tolerance=F.lit(policy.per_party_net_days_tolerance)))
    high = F.when(amt > F.lit(policy.amount_upper_warn), issue(
        "PAYMENT_AMOUNT_HIGH", value=amount_text(amt), warn_above=F.lit(policy.amount_upper_warn)))
    return keep_issues(over_max, outlier, inconsistent, drift, high)


def cross_reference(v: DataFrame, policy: P.Policy = P.current(),
                    keep_stats: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Append the cross-reference issues to each document's issues.

    Median and party statistics are taken from ``facts``, the same documents without their
    clauses, which is read four times and should be materialised; ``v`` is read
    once. Without ``facts`` they come from ``v``.
    """
    facts = v if facts is None else facts
    joined = attach_party_stats(v, party_stats(facts)).select(
        "*", net_days_median(facts).scalar().alias("corpus_median"))
    base = [c for c in v.columns if c != "_issues"]
    extra = ["party_median", "party_mode", "corpus_median"] if keep_stats else []
    new = cross_reference_issues(policy, F.col("corpus_median"))
    return joined.select(*base, *extra, F.concat(F.col("_issues"), new).alias("_issues"))


def first_evidence(evidence: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every evidence list in document order, from one pass."""
    by = Window.partitionBy("section").orderBy("doc_id", "issue_pos")
    return evidence.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")


# ------------------------------------------------------------------ report

def crossref_evidence(xr: DataFrame) -> DataFrame:
    """The report's evidence lists as one table.

    ``section`` is one of ``inconsistent_governing_law``, ``net_days_outliers``
    (reason ``over_max`` or ``far_from_median``), ``net_days_party_drifts``,
    ``amount_high_warnings``.
    """
    ex = xr.select("doc_id", F.posexplode("_issues").alias("issue_pos", "i"))
    t = F.col("i.type")
    section = (F.when(t == "GOVERNING_LAW_INCONSISTENT", "inconsistent_governing_law")
               .when(t.isin("NET_DAYS_OVER_MAX", "NET_DAYS_OUTLIER"), "net_days_outliers")
               .when(t == "NET_DAYS_DRIFT_VS_PARTY", "net_days_party_drifts")
               .when(t == "PAYMENT_AMOUNT_HIGH", "amount_high_warnings"))
    reason = (F.when(t == "NET_DAYS_OVER_MAX", "over_max")
              .when(t == "NET_DAYS_OUTLIER", "far_from_median"))
    reference = (F.when(t == "GOVERNING_LAW_INCONSISTENT", F.col("i.party_mode"))
                 .when(t == "NET_DAYS_OUTLIER", F.col("i.median").cast("string"))
                 .when(t == "NET_DAYS_DRIFT_VS_PARTY", F.col("i.party_median").cast("string")))
    return (ex.where(section.isNotNull())
            .select(section.alias("section"), "doc_id", "issue_pos",
                    F.col("i.party_key").alias("party_key"),
                    F.col("i.value").alias("value"), reason.alias("reason"),
                    reference.alias("reference")))


def crossref_summary(xr: DataFrame) -> DataFrame:
    """V12 header: document count, median net days and top law in one row."""
    return xr.agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.median(ND).alias("net_days_median"),
    ).select("doc_count", "net_days_median",
             governing_law_top(xr).scalar().alias("governing_law_top"))


def crossref_report(xr: DataFrame) -> dict:
    """All report parts as DataFrames (bounded rendering lives in ``report``)."""
    return {
        "summary": crossref_summary(xr),
        "governing_law_counts": governing_laws_listed(xr),
        "per_party_contract_counts": party_contract_counts(xr),
        "evidence": crossref_evidence(xr),
    }
