"""Spark types of the data model (spans, issues, records, result tables)."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

PROVENANCE = T.MapType(T.StringType(), T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
]))

ISSUE_SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

# One wide struct for every issue type; fields a type does not use are NULL.
ISSUE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("span", ISSUE_SPAN),
    T.StructField("max", T.IntegerType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("pct_dev", T.DoubleType()),
    T.StructField("party_key", T.StringType()),
    T.StructField("party_mode", T.StringType()),
    T.StructField("party_median", T.DoubleType()),
    T.StructField("tolerance", T.IntegerType()),
    T.StructField("warn_above", T.DoubleType()),
    T.StructField("detail", T.StringType()),
])

EXTRACT = T.StructType([
    T.StructField("parties", T.ArrayType(T.StringType())),
    T.StructField("effective_date", T.StringType()),
    T.StructField("governing_law", T.StringType()),
    T.StructField("payment_terms", SPAN),
    T.StructField("termination_clause", SPAN),
    T.StructField("_doc_id", T.StringType()),
    T.StructField("_char_count", T.IntegerType()),
    T.StructField("_provenance", PROVENANCE),
])

VALIDATED = T.StructType(EXTRACT.fields + [
    T.StructField("effective_date_normalized", T.DateType()),
    T.StructField("payment_amount_normalized", T.DoubleType()),
    T.StructField("payment_net_days", T.IntegerType()),
    T.StructField("_issues", T.ArrayType(ISSUE)),
])

PER_DOC = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("party_key", T.StringType()),
    T.StructField("governing_law", T.StringType()),
    T.StructField("effective_date", T.DateType()),
    T.StructField("payment_net_days", T.IntegerType()),
    T.StructField("payment_amount", T.DoubleType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_bucket", T.StringType()),
    T.StructField("issues_count", T.IntegerType()),
    T.StructField("issue_types", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("issue_pos", T.IntegerType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("governing_law", T.StringType()),
    T.StructField("payment_net_days", T.IntegerType()),
    T.StructField("payment_amount", T.DoubleType()),
    T.StructField("details", T.StringType()),
    T.StructField("quote", T.StringType()),
])
