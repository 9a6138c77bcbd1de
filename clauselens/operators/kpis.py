"""Portfolio KPIs and trends (K1-K9) and the strict summary.

All are aggregations over the per-document table with partial (map-side)
aggregation; exact median/percentile are used on net days only, whose domain
is bounded (at most 1000 values), so their aggregation state stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import date_to_month
from ..functions.text import truthy_str
from .quantiles import medians


def kpi_net_days(per_doc: DataFrame) -> DataFrame:
    """K1: median, P90 (linear interpolation), min, max of net days."""
    nd = F.col("payment_net_days")
    return per_doc.agg(
        F.median(nd).alias("net_days_median"),
        F.percentile(nd, 0.9).alias("net_days_p90"),
        F.min(nd).cast("bigint").alias("net_days_min"),
        F.max(nd).cast("bigint").alias("net_days_max"),
    )


def kpi_risk_buckets(per_doc: DataFrame) -> DataFrame:
    """K2."""
    return per_doc.groupBy("risk_bucket").agg(F.count(F.lit(1)).alias("documents"))


def kpi_avg_risk(per_doc: DataFrame) -> DataFrame:
    """K3: mean of the (displayed, rounded) risk scores."""
    return per_doc.agg(F.avg("risk_score").alias("avg_risk_score"))


def kpi_top_law(per_doc: DataFrame, n: int = 5) -> DataFrame:
    """K4: most frequent governing laws; ties by law name."""
    return (per_doc.where(truthy_str(F.col("governing_law"))).groupBy("governing_law")
            .agg(F.count(F.lit(1)).alias("documents"))
            .orderBy(F.desc("documents"), "governing_law").limit(n))


def kpi_party_avg_risk(per_doc: DataFrame, n: int = 10) -> DataFrame:
    """K5: parties with the highest mean risk; ties by party key. Means are rounded before
    the cut, so the order in which partial sums meet cannot change the list."""
    return (per_doc.where(F.col("party_key").isNotNull()).groupBy("party_key")
            .agg(F.round(F.avg("risk_score"), 6).alias("avg_risk_score"))
            .orderBy(F.desc("avg_risk_score"), "party_key").limit(n))


def kpi_monthly(per_doc: DataFrame) -> DataFrame:
    """K6: contracts and median net days per effective month."""
    dated = per_doc.where(F.col("effective_date").isNotNull()).select(
        date_to_month(F.col("effective_date")).alias("month"), "payment_net_days")
    return medians(dated, ["month"], "payment_net_days", "contracts", "median_net_days")


def dashboard_metrics(per_doc: DataFrame) -> DataFrame:
    """K7: total documents, mean risk, median net days, high-risk documents."""
    return per_doc.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.median("payment_net_days").alias("net_days_median"),
        F.count_if(F.col("risk_bucket") == "high").alias("high_risk_docs"),
    )


def risk_histogram(filtered: DataFrame) -> DataFrame:
    """K8: bucket counts of a filtered selection."""
    return filtered.groupBy("risk_bucket").agg(F.count(F.lit(1)).alias("documents"))


def kpi_document(per_doc: DataFrame) -> DataFrame:
    """K9: all KPIs as one JSON document (one row, bounded maps/lists)."""
    nd = kpi_net_days(per_doc)
    buckets = kpi_risk_buckets(per_doc).agg(
        F.map_from_entries(F.collect_list(F.struct("risk_bucket", "documents"))).alias("m"))
    laws = kpi_top_law(per_doc).agg(
        F.collect_list(F.struct("governing_law", "documents")).alias("l"))
    parties = kpi_party_avg_risk(per_doc).agg(
        F.collect_list(F.struct("party_key", "avg_risk_score")).alias("l"))
    monthly = kpi_monthly(per_doc).agg(
        F.array_sort(F.collect_list(F.struct("month", "contracts", "median_net_days"))).alias("l"))
    doc = F.struct(
        F.col("net_days_median"), F.col("net_days_p90"), F.col("net_days_min"), F.col("net_days_max"),
        buckets.scalar().alias("risk_bucket_counts"),
        kpi_avg_risk(per_doc).scalar().alias("avg_risk_score"),
        laws.scalar().alias("top_governing_law"),
        parties.scalar().alias("party_avg_risk_top10"),
        monthly.scalar().alias("monthly"),
    )
    return nd.select(F.to_json(doc).alias("kpis"))


# ------------------------------------------------------------ strict

def issue_type_counts(issues_df: DataFrame, issues_col: str = "_issues") -> DataFrame:
    """Issues per type across the portfolio."""
    # outer: with explode an inferred filter would compute the issues twice
    return (issues_df.select(F.posexplode_outer(issues_col).alias("pos", "i")).where(F.col("pos").isNotNull())
            .groupBy(F.col("i.type").alias("issue_type")).agg(F.count(F.lit(1)).alias("issues")))


def portfolio_summary(strict_docs: DataFrame) -> DataFrame:
    """Documents, mean and median risk, bucket distribution."""
    return strict_docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.median("risk_score").alias("median_risk_score"),
        F.count_if(F.col("risk_bucket") == "low").alias("low"),
        F.count_if(F.col("risk_bucket") == "medium").alias("medium"),
        F.count_if(F.col("risk_bucket") == "high").alias("high"),
    )


def strict_documents(strict_docs: DataFrame) -> DataFrame:
    """All documents, riskiest first."""
    return strict_docs.select("doc_id", "risk_score", "risk_bucket").orderBy(F.desc("risk_score"), "doc_id")


def strict_high_risk(strict_docs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` riskiest documents of the high bucket with their issues. The bucket is the first
    key of the order and is filtered after the cut: a filter before it would be pushed below the
    extraction and compute the score a second time, from the text on."""
    high = F.col("risk_bucket") == "high"
    return (strict_docs.select("doc_id", "risk_score", "_strict_issues", "risk_bucket")
            .orderBy(F.desc(F.coalesce(high, F.lit(False))), F.desc("risk_score"), "doc_id").limit(n)
            .where(high).drop("risk_bucket"))
