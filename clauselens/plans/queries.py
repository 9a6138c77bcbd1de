"""Registered queries: key -> (Spark callable, DuckDB oracle SQL or None).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables. Integer outputs are BIGINT and floating results that
depend on summation order are rounded to 6 digits in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import policy as P
from ..functions import extract as X
from ..functions import normalize as N
from ..operators import crossref, findings as FN, kpis as K, risk as R
from ..operators.extraction import confidence_gate
from . import oracle as O
from .portfolio import Portfolio

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[key] = lambda spark, sf_dir: out(fn(spark, sf_dir))
        REGISTRY[key].__doc__ = fn.__doc__
        REGISTRY[key].__name__ = key
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def out(df: DataFrame) -> DataFrame:
    """Uniform result types: integers as BIGINT, floats as DOUBLE."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def pf(spark: SparkSession, sf_dir: str, policy: P.Policy = P.current()) -> Portfolio:
    return Portfolio.of(spark, sf_dir, policy)


def r6(c):
    return F.round(c, 6)


W = O.with_ctes

# ================================================================ extraction

@query("extract_parties", W(["extracted"],
       "SELECT doc_id, parties[1] AS party_a, parties[2] AS party_b, parties_source FROM extracted"))
def extract_parties(spark, sf):
    """X1 + X9 cascade: first two parties and where they came from."""
    e = pf(spark, sf).extracted
    return e.select("doc_id", F.try_element_at("parties", F.lit(1)).alias("party_a"),
                    F.try_element_at("parties", F.lit(2)).alias("party_b"),
                    F.col("_provenance")["parties"]["source"].alias("parties_source"))


@query("extract_effective_date", W(["extracted"], "SELECT doc_id, effective_date FROM extracted"))
def extract_effective_date(spark, sf):
    """Raw effective-date text."""
    return pf(spark, sf).extracted.select("doc_id", "effective_date")


@query("extract_governing_law", W(["extracted"],
       "SELECT doc_id, governing_law, law_source FROM extracted"))
def extract_governing_law(spark, sf):
    """X3 (+X7/X8 fallbacks): governing law and its source."""
    return pf(spark, sf).extracted.select(
        "doc_id", "governing_law", F.col("_provenance")["governing_law"]["source"].alias("law_source"))


@query("extract_payment_terms", W(["extracted"],
       "SELECT doc_id, pt_text AS text, pt_start AS span_start, pt_end AS span_end FROM extracted"))
def extract_payment_terms(spark, sf):
    """Payment-terms span."""
    return pf(spark, sf).extracted.select(
        "doc_id", F.col("payment_terms.text").alias("text"),
        F.col("payment_terms.start").alias("span_start"), F.col("payment_terms.end").alias("span_end"))


@query("extract_termination", W(["extracted"],
       "SELECT doc_id, tc_text AS text, tc_start AS span_start, tc_end AS span_end FROM extracted"))
def extract_termination(spark, sf):
    """Termination-clause span."""
    return pf(spark, sf).extracted.select(
        "doc_id", F.col("termination_clause.text").alias("text"),
        F.col("termination_clause.start").alias("span_start"),
        F.col("termination_clause.end").alias("span_end"))


_GOV_HEAD = r"\bgoverned\s+by\b"
_GOV_TAIL = 200


@query("find_span", W(["contracts"], f"SELECT doc_id, {O.span_cols('text', _GOV_HEAD, _GOV_TAIL, 'g')} FROM contracts"))
def find_span(spark, sf):
    """The generic span finder, here on ``governed by`` + 200 chars."""
    s = X.find_span(F.col("text"), _GOV_HEAD, _GOV_TAIL)
    return pf(spark, sf).docs.select("doc_id", s["text"].alias("g_text"),
                                     s["start"].alias("g_start"), s["end"].alias("g_end"))


@query("governing_law_canonical", W(["contracts"], f"""
SELECT doc_id, CASE WHEN regexp_matches(text, {O.rx('i', X.LAW_FALLBACK_RX)}) THEN
  coalesce({O.canonical_place(O.strip(f"regexp_extract(text, {O.rx('i', X.LAW_FALLBACK_RX)}, 1)", X.LAW_STRIP))},
           {O.strip(f"regexp_extract(text, {O.rx('i', X.LAW_FALLBACK_RX)}, 1)", X.LAW_STRIP)}) END AS law
FROM contracts"""))
def governing_law_canonical(spark, sf):
    """Looser clause pattern canonicalised to the longest known place, on every contract."""
    return pf(spark, sf).docs.select(
        "doc_id", X.fallback_governing_law(F.col("text"), P.US_STATES + P.COUNTRIES).alias("law"))


_GAZ = O.rx("", r"\b(" + "|".join(X.places_by_length(P.US_STATES + P.COUNTRIES)) + r")\b")


@query("governing_law_gazetteer", f"""
SELECT doc_id, nullif(regexp_extract(text, {_GAZ}, 1), '') AS place FROM documents""")
def governing_law_gazetteer(spark, sf):
    """First known place name of each document."""
    from ..sources.tables import documents
    return documents(spark, sf).select(
        "doc_id", X.gazetteer_place(F.col("text"), P.US_STATES + P.COUNTRIES).alias("place"))


_FBP = O.q(X.party_fallback_rx())


@query("party_fallback", f"""
SELECT doc_id, CASE WHEN len(d) > 0 THEN array_to_string(d[1:4], ' ; ') END AS parties,
  CAST(least(len(d), 4) AS BIGINT) AS n_parties
FROM (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS d FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {_FBP}),
    lambda x: {O.strip('x')}), lambda x: length(x) >= 3) AS a FROM documents))""")
def party_fallback(spark, sf):
    """Company names with a corporate suffix in each document."""
    from ..sources.tables import documents
    names = X.fallback_parties(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", F.array_join(names, " ; ").alias("parties"),
        F.coalesce(F.size(names), F.lit(0)).alias("n_parties"))


@query("extract_cascade", W(["extracted"], """
SELECT doc_id, parties[1] AS party_a, parties[2] AS party_b, effective_date, governing_law,
  pt_start AS payment_start, tc_start AS termination_start, char_count, parties_source, law_source
FROM extracted"""))
def extract_cascade(spark, sf):
    """The extract record after rule -> fallback."""
    e = pf(spark, sf).extracted
    return e.select("doc_id", F.try_element_at("parties", F.lit(1)).alias("party_a"),
                    F.try_element_at("parties", F.lit(2)).alias("party_b"),
                    "effective_date", "governing_law",
                    F.col("payment_terms.start").alias("payment_start"),
                    F.col("termination_clause.start").alias("termination_start"),
                    F.col("_char_count").alias("char_count"),
                    F.col("_provenance")["parties"]["source"].alias("parties_source"),
                    F.col("_provenance")["governing_law"]["source"].alias("law_source"))


@query("extract_record", W(["extracted"], """
SELECT doc_id AS _doc_id, array_to_string(parties, ' ; ') AS parties, effective_date, governing_law,
  pt_text AS payment_terms, tc_text AS termination_clause, char_count AS _char_count FROM extracted"""))
def extract_record(spark, sf):
    """The extract record (schema fields + ``_doc_id`` + ``_char_count``)."""
    from ..operators.extraction import extract_record as rec
    r = rec(pf(spark, sf).extracted)
    return r.select("_doc_id", F.array_join("parties", " ; ").alias("parties"), "effective_date", "governing_law",
                    F.col("payment_terms.text").alias("payment_terms"),
                    F.col("termination_clause.text").alias("termination_clause"), "_char_count")


_GATE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {cond} AS passes FROM extracted" for f, cond in (
        ("parties", "parties IS NOT NULL"),
        ("effective_date", "effective_date IS NOT NULL"),
        ("governing_law", "governing_law IS NOT NULL"),
        ("payment_terms", f"coalesce(pt_start IS NOT NULL AND 0.72 >= {P.REGEX_CONFIDENCE} AND length(pt_text) >= {P.MIN_SPAN_LEN}, false)"),
        ("termination_clause", f"coalesce(tc_start IS NOT NULL AND 0.72 >= {P.REGEX_CONFIDENCE} AND length(tc_text) >= {P.MIN_SPAN_LEN}, false)"),
    ))


@query("confidence_gate", W(["extracted"], _GATE_SQL))
def q_confidence_gate(spark, sf):
    """X11: which (document, field) values pass the gate (others would go to the model)."""
    return confidence_gate(pf(spark, sf).extracted)


# ============================================================= normalisation

@query("normalize_date", W(["first_pass"], "SELECT doc_id, effective_date, eff_norm AS effective_date_normalized FROM first_pass"))
def normalize_date(spark, sf):
    """N1."""
    return pf(spark, sf).first_pass.select("doc_id", "effective_date", "effective_date_normalized")


@query("normalize_amount", W(["first_pass"], "SELECT doc_id, amount AS payment_amount FROM first_pass"))
def normalize_amount(spark, sf):
    """N2."""
    return pf(spark, sf).first_pass.select("doc_id", F.col("payment_amount_normalized").alias("payment_amount"))


@query("net_days", W(["first_pass"], "SELECT doc_id, CAST(nd AS BIGINT) AS payment_net_days FROM first_pass"))
def net_days(spark, sf):
    """N3."""
    return pf(spark, sf).first_pass.select("doc_id", "payment_net_days")


@query("norm_party_name", W(["extracted"], f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, name, {O.norm_party('name')} AS normalized FROM (
  SELECT doc_id, unnest(generate_series(1, len(parties))) AS pos, unnest(parties) AS name
  FROM extracted WHERE parties IS NOT NULL)"""))
def norm_party_name(spark, sf):
    """Every extracted party name and its normal form."""
    e = pf(spark, sf).extracted
    x = e.select("doc_id", F.posexplode_outer("parties").alias("p0", "name"))
    return x.where(F.col("p0").isNotNull()).select("doc_id", (F.col("p0") + 1).alias("pos"), "name",
                    N.norm_party_name(F.col("name")).alias("normalized"))


@query("party_key", W(["first_pass"], "SELECT doc_id, party_key FROM first_pass"))
def party_key(spark, sf):
    """N5."""
    return pf(spark, sf).first_pass.select("doc_id", "party_key")


@query("ambiguity_flag", W(["extracted"], f"""
SELECT doc_id, 'payment_terms' AS field, {O.contains_any('lower(pt_text)', P.AMBIGUITY_TERMS)} AS ambiguous
FROM extracted WHERE pt_text IS NOT NULL
UNION ALL
SELECT doc_id, 'termination_clause', {O.contains_any('lower(tc_text)', P.AMBIGUITY_TERMS)}
FROM extracted WHERE tc_text IS NOT NULL"""))
def ambiguity_flag(spark, sf):
    """N6 on both clause spans."""
    e = pf(spark, sf).extracted
    parts = [e.where(F.col(f).isNotNull()).select(
        "doc_id", F.lit(f).alias("field"), N.ambiguity_flag(F.col(f"{f}.text"), P.AMBIGUITY_TERMS).alias("ambiguous"))
        for f in ("payment_terms", "termination_clause")]
    return parts[0].unionByName(parts[1])


@query("date_to_month", W(["first_pass"], "SELECT doc_id, strftime(eff_norm, '%Y-%m') AS month FROM first_pass"))
def date_to_month(spark, sf):
    """N7."""
    return pf(spark, sf).first_pass.select("doc_id", N.date_to_month(F.col("effective_date_normalized")).alias("month"))


@query("clamp_quote", f"SELECT doc_id, {O.clamp_quote('text', P.MAX_QUOTE_CHARS)} AS quote FROM documents")
def clamp_quote(spark, sf):
    """N8 on every document text (400 characters + ellipsis)."""
    from ..sources.tables import documents
    return documents(spark, sf).select("doc_id", N.clamp_quote(F.col("text"), P.MAX_QUOTE_CHARS).alias("quote"))


@query("risk_bucket", W(["scored"], f"SELECT doc_id, {O.bucket('score', 5.0, 10.0)} AS risk_bucket FROM scored"))
def risk_bucket(spark, sf):
    """N10."""
    return pf(spark, sf).marked.select("doc_id", N.risk_bucket(R.risk_score(), 5.0, 10.0).alias("risk_bucket"))


# ============================================================ per-doc rules

def _issue_rows(df, col, types):
    # outer: with posexplode a filter on the array's size is inferred, and it would compute the
    # issues a second time, from the text on, below the join and the dealing of the contracts
    return df.select("doc_id", F.posexplode_outer(col).alias("issue_pos", "i")).where(F.col("i.type").isin(*types))


def _issue_sql(cte, col, types, extra=""):
    tl = ", ".join(O.q(t) for t in types)
    return W([cte], f"""
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS issue_pos, i.type AS issue_type, i.field AS field, i.value AS value{extra}
FROM (SELECT doc_id, unnest(generate_series(1, len({col}))) AS pos, unnest({col}) AS i FROM {cte})
WHERE i.type IN ({tl})""")


def _issue_cols(x, extra=()):
    return x.select("doc_id", "issue_pos", F.col("i.type").alias("issue_type"),
                    F.col("i.field").alias("field"), F.col("i.value").alias("value"), *extra)


@query("issue_bad_date", _issue_sql("first_pass", "issues1", ["BAD_DATE"]))
def issue_bad_date(spark, sf):
    """V1."""
    return _issue_cols(_issue_rows(pf(spark, sf).first_pass, "_issues", ["BAD_DATE"]))


@query("issue_ambiguous", _issue_sql("first_pass", "issues1", ["AMBIGUOUS"],
                                     ", i.span_start AS span_start, i.span_end AS span_end"))
def issue_ambiguous(spark, sf):
    """V2/V3."""
    return _issue_cols(_issue_rows(pf(spark, sf).first_pass, "_issues", ["AMBIGUOUS"]),
                       (F.col("i.span.start").alias("span_start"), F.col("i.span.end").alias("span_end")))


@query("issue_missing", _issue_sql("first_pass", "issues1", ["MISSING"]))
def issue_missing(spark, sf):
    """V4."""
    return _issue_cols(_issue_rows(pf(spark, sf).first_pass, "_issues", ["MISSING"]))


@query("validate_first_pass", W(["first_pass"], """
SELECT doc_id, eff_norm AS effective_date_normalized, amount AS payment_amount_normalized,
  CAST(nd AS BIGINT) AS payment_net_days, party_key, CAST(len(issues1) AS BIGINT) AS issue_count,
  array_to_string(list_transform(issues1, lambda x: x.type || ':' || x.field), ',') AS issue_list
FROM first_pass"""))
def validate_first_pass(spark, sf):
    """V5: normalised values and first-pass issues per document."""
    v = pf(spark, sf).first_pass
    return v.select("doc_id", "effective_date_normalized", "payment_amount_normalized", "payment_net_days",
                    "party_key", F.size("_issues").alias("issue_count"),
                    F.array_join(F.transform("_issues", lambda x: F.concat_ws(":", x["type"], x["field"])), ",")
                    .alias("issue_list"))


# ========================================================== corpus / crossref

@query("corpus_rows", W(["first_pass"], """
SELECT doc_id, party_key, governing_law, CAST(nd AS BIGINT) AS payment_net_days, amount FROM first_pass"""))
def corpus_rows(spark, sf):
    """A1."""
    return crossref.corpus_rows(pf(spark, sf).first_pass)


@query("net_days_median", W(["first_pass"], "SELECT median(nd) AS net_days_median FROM first_pass"))
def net_days_median(spark, sf):
    """A2."""
    return crossref.net_days_median(pf(spark, sf).facts)


@query("governing_law_counts", W(["first_pass"], f"""
SELECT governing_law, count(*) AS contracts FROM first_pass WHERE {O.truthy('governing_law')} GROUP BY 1"""))
def governing_law_counts(spark, sf):
    """A3."""
    return crossref.governing_law_counts(pf(spark, sf).facts).select("governing_law", "contracts")


@query("governing_law_top", W(["first_pass"], f"""
SELECT governing_law AS governing_law_top FROM (SELECT governing_law, count(*) AS n, min(doc_id) AS f
FROM first_pass WHERE {O.truthy('governing_law')} GROUP BY 1) ORDER BY n DESC, f LIMIT 1"""))
def governing_law_top(spark, sf):
    """A4."""
    return crossref.governing_law_top(pf(spark, sf).facts)


@query("party_net_days_median", W(["party_nd"], "SELECT party_key, contracts, party_median FROM party_nd"))
def party_net_days_median(spark, sf):
    """A5."""
    return crossref.party_net_days_median(pf(spark, sf).facts)


@query("party_law_mode", W(["party_mode"], "SELECT party_key, party_mode FROM party_mode"))
def party_law_mode(spark, sf):
    """A6."""
    return crossref.party_law_mode(pf(spark, sf).facts)


@query("party_contract_counts", W(["party_nd"], "SELECT party_key, contracts FROM party_nd"))
def party_contract_counts(spark, sf):
    """A7."""
    return crossref.party_contract_counts(pf(spark, sf).facts)


_XR_TYPES = {
    "issue_net_days_over_max": ("NET_DAYS_OVER_MAX", ", i.max AS max", ("max",)),
    "issue_net_days_outlier": ("NET_DAYS_OUTLIER", ", i.median AS median, i.pct_dev AS pct_dev", ("median", "pct_dev")),
    "issue_law_inconsistent": ("GOVERNING_LAW_INCONSISTENT", ", i.party_key AS party_key, i.party_mode AS party_mode",
                               ("party_key", "party_mode")),
    "issue_party_drift": ("NET_DAYS_DRIFT_VS_PARTY", ", i.party_key AS party_key, i.party_median AS party_median",
                          ("party_key", "party_median")),
    "issue_amount_high": ("PAYMENT_AMOUNT_HIGH", ", i.warn_above AS warn_above", ("warn_above",)),
}


def _make_xr_query(key, typ, sql_extra, fields):
    def fn(spark, sf):
        x = _issue_rows(pf(spark, sf).marked, "_issues", [typ])
        return _issue_cols(x, tuple(F.col(f"i.{f}").alias(f) for f in fields))
    fn.__doc__ = f"V6-V10: {typ} issues."
    query(key, _issue_sql("validated", "issues", [typ], sql_extra))(fn)


for _k, (_t, _e, _f) in _XR_TYPES.items():
    _make_xr_query(_k, _t, _e, _f)


@query("cross_reference", _issue_sql(
    "validated", "issues", ["BAD_DATE", "AMBIGUOUS", "MISSING", "NET_DAYS_OVER_MAX", "NET_DAYS_OUTLIER",
                            "GOVERNING_LAW_INCONSISTENT", "NET_DAYS_DRIFT_VS_PARTY", "PAYMENT_AMOUNT_HIGH"],
    ", i.party_key AS party_key, i.party_mode AS party_mode, i.party_median AS party_median, "
    "i.median AS median, i.pct_dev AS pct_dev"))
def cross_reference(spark, sf):
    """All issues per document after the cross-reference pass."""
    x = pf(spark, sf).marked.select("doc_id", F.posexplode("_issues").alias("issue_pos", "i"))
    return _issue_cols(x, tuple(F.col(f"i.{f}").alias(f) for f in
                                ("party_key", "party_mode", "party_median", "median", "pct_dev")))


@query("crossref_report", W(["validated"], """
SELECT CASE WHEN i.type = 'GOVERNING_LAW_INCONSISTENT' THEN 'inconsistent_governing_law'
            WHEN i.type IN ('NET_DAYS_OVER_MAX', 'NET_DAYS_OUTLIER') THEN 'net_days_outliers'
            WHEN i.type = 'NET_DAYS_DRIFT_VS_PARTY' THEN 'net_days_party_drifts'
            ELSE 'amount_high_warnings' END AS section,
  doc_id, CAST(pos - 1 AS BIGINT) AS issue_pos, i.party_key AS party_key, i.value AS value,
  CASE WHEN i.type = 'NET_DAYS_OVER_MAX' THEN 'over_max' WHEN i.type = 'NET_DAYS_OUTLIER' THEN 'far_from_median' END AS reason,
  CASE WHEN i.type = 'GOVERNING_LAW_INCONSISTENT' THEN i.party_mode
       WHEN i.type = 'NET_DAYS_OUTLIER' THEN CAST(i.median AS VARCHAR)
       WHEN i.type = 'NET_DAYS_DRIFT_VS_PARTY' THEN CAST(i.party_median AS VARCHAR) END AS reference
FROM (SELECT doc_id, unnest(generate_series(1, len(issues))) AS pos, unnest(issues) AS i FROM validated)
WHERE i.type IN ('GOVERNING_LAW_INCONSISTENT', 'NET_DAYS_OVER_MAX', 'NET_DAYS_OUTLIER',
                 'NET_DAYS_DRIFT_VS_PARTY', 'PAYMENT_AMOUNT_HIGH')"""))
def crossref_report(spark, sf):
    """The cross-reference evidence lists (inconsistencies, outliers, drifts, high amounts)."""
    return crossref.crossref_evidence(pf(spark, sf).marked)


# ===================================================================== risk

@query("risk_breakdown", W(["validated"], f"""
SELECT doc_id, component, round(value, 6) AS value FROM (
  SELECT doc_id, t AS component, first_pos, list_sum(list_transform(list_filter(issues, lambda x: x.type = t),
    lambda x: {O.weight_case('x.type', P.CURRENT_WEIGHTS)})) AS value
  FROM (SELECT doc_id, issues, t, list_position(list_transform(issues, lambda x: x.type), t) AS first_pos
        FROM (SELECT doc_id, issues, unnest(list_distinct(list_transform(issues, lambda x: x.type))) AS t FROM validated))
  UNION ALL
  SELECT doc_id, 'NET_DAYS_DRIFT_NUMERIC', 1000, CASE WHEN nd > 30 THEN least(3.0, greatest(0.0, (nd - 30) / 30.0)) END FROM validated
  UNION ALL
  SELECT doc_id, 'AMOUNT_OVER_WARN_NUMERIC', 1001, CASE WHEN amount > 1000000.0 THEN least(2.0, (amount - 1000000.0) / 1000000.0) END FROM validated)
WHERE value IS NOT NULL AND value <> 0"""))
def risk_breakdown(spark, sf):
    """Score components per document."""
    b = R.risk_breakdown(pf(spark, sf).marked)
    return b.select("doc_id", "component", r6(F.col("value")).alias("value"))


@query("risk_net_days_component", W(["validated"], """
SELECT doc_id, round(least(3.0, greatest(0.0, (nd - 30) / 30.0)), 6) AS value FROM validated WHERE nd > 30"""))
def risk_net_days_component(spark, sf):
    """R2."""
    v = pf(spark, sf).marked
    return v.where(F.col("payment_net_days") > 30).select("doc_id", r6(R.net_days_component(P.current())).alias("value"))


@query("risk_amount_component", W(["validated"], """
SELECT doc_id, round(least(2.0, (amount - 1000000.0) / 1000000.0), 6) AS value FROM validated WHERE amount > 1000000.0"""))
def risk_amount_component(spark, sf):
    """R3."""
    v = pf(spark, sf).marked
    return v.where(F.col("payment_amount_normalized") > 1_000_000.0).select(
        "doc_id", r6(R.amount_component(P.current())).alias("value"))


@query("risk_score", W(["per_doc"], "SELECT doc_id, risk_score, risk_bucket FROM per_doc"))
def risk_score(spark, sf):
    """R4."""
    return pf(spark, sf).per_doc.select("doc_id", "risk_score", "risk_bucket")


@query("per_doc_metrics", W(["per_doc"], "SELECT * FROM per_doc"))
def per_doc_metrics(spark, sf):
    """R5."""
    return pf(spark, sf).per_doc


# ===================================================================== KPIs

@query("kpi_net_days", W(["per_doc"], """
SELECT median(payment_net_days) AS net_days_median, round(quantile_cont(payment_net_days, 0.9), 6) AS net_days_p90,
  min(payment_net_days) AS net_days_min, max(payment_net_days) AS net_days_max FROM per_doc"""))
def kpi_net_days(spark, sf):
    """K1."""
    k = K.kpi_net_days(pf(spark, sf).per_doc)
    return k.select("net_days_median", r6(F.col("net_days_p90")).alias("net_days_p90"), "net_days_min", "net_days_max")


@query("kpi_risk_buckets", W(["per_doc"], "SELECT risk_bucket, count(*) AS documents FROM per_doc GROUP BY 1"))
def kpi_risk_buckets(spark, sf):
    """K2."""
    return K.kpi_risk_buckets(pf(spark, sf).per_doc)


@query("kpi_avg_risk", W(["per_doc"], "SELECT round(avg(risk_score), 6) AS avg_risk_score FROM per_doc"))
def kpi_avg_risk(spark, sf):
    """K3."""
    return K.kpi_avg_risk(pf(spark, sf).per_doc).select(r6(F.col("avg_risk_score")).alias("avg_risk_score"))


@query("kpi_top_law", W(["per_doc"], f"""
SELECT governing_law, count(*) AS documents FROM per_doc WHERE {O.truthy('governing_law')}
GROUP BY 1 ORDER BY documents DESC, governing_law LIMIT 5"""))
def kpi_top_law(spark, sf):
    """K4."""
    return K.kpi_top_law(pf(spark, sf).per_doc)


@query("kpi_party_avg_risk", W(["per_doc"], """
SELECT party_key, round(a, 6) AS avg_risk_score FROM (SELECT party_key, round(avg(risk_score), 6) AS a FROM per_doc
WHERE party_key IS NOT NULL GROUP BY 1 ORDER BY a DESC, party_key LIMIT 10)"""))
def kpi_party_avg_risk(spark, sf):
    """K5."""
    k = K.kpi_party_avg_risk(pf(spark, sf).per_doc)
    return k.select("party_key", r6(F.col("avg_risk_score")).alias("avg_risk_score"))


@query("kpi_monthly", W(["per_doc"], """
SELECT strftime(effective_date, '%Y-%m') AS month, count(*) AS contracts, median(payment_net_days) AS median_net_days
FROM per_doc WHERE effective_date IS NOT NULL GROUP BY 1"""))
def kpi_monthly(spark, sf):
    """K6."""
    return K.kpi_monthly(pf(spark, sf).per_doc)


@query("dashboard_metrics", W(["per_doc"], """
SELECT count(*) AS total_docs, round(avg(risk_score), 6) AS avg_risk_score, median(payment_net_days) AS net_days_median,
  count(*) FILTER (WHERE risk_bucket = 'high') AS high_risk_docs FROM per_doc"""))
def dashboard_metrics(spark, sf):
    """K7."""
    k = K.dashboard_metrics(pf(spark, sf).per_doc)
    return k.select("total_docs", r6(F.col("avg_risk_score")).alias("avg_risk_score"), "net_days_median",
                    "high_risk_docs")


# ============================================================== findings

@query("findings", W(["findings"], "SELECT * FROM findings"))
def q_findings(spark, sf):
    """F1."""
    return pf(spark, sf).findings


@query("top_risky_docs", W(["per_doc"], """
SELECT doc_id, risk_score, risk_bucket, issues_count, payment_net_days, governing_law FROM per_doc
ORDER BY risk_score DESC, doc_id LIMIT 25"""))
def top_risky_docs(spark, sf):
    """F2."""
    return FN.top_risky_docs(pf(spark, sf).per_doc)


def _sections_body() -> str:
    arms = " ".join(f"WHEN issue_type IN ({', '.join(O.q(t) for t in types)}) THEN {O.q(title)}"
                    for title, types in FN.SECTIONS)
    return f"""
SELECT section, row, doc_id, issue_pos, issue_type, field, payment_net_days, payment_amount, quote FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY doc_id, issue_pos) AS BIGINT) AS row FROM (
    SELECT *, CASE {arms} END AS section FROM findings) WHERE section IS NOT NULL) WHERE row <= {P.REPORT_SECTION_ROWS}"""


@query("report_sections", W(["findings"], _sections_body()))
def report_sections(spark, sf):
    """first 10 findings per report section."""
    return FN.report_sections(pf(spark, sf).findings)


@query("report_quotes", W(["findings"], f"""
SELECT section, row, doc_id, trim(replace(quote, chr(10), ' ')) AS quote FROM ({_sections_body()})
WHERE length(trim(quote)) > 0"""))
def report_quotes(spark, sf):
    """non-empty representative quotes per section."""
    return FN.report_quotes(FN.report_sections(pf(spark, sf).findings))


@query("markdown_table", W(["per_doc"], """
SELECT '|' || concat_ws('|', doc_id, coalesce(nullif(CAST(risk_score AS VARCHAR), ''), '-'), risk_bucket,
  CAST(issues_count AS VARCHAR), coalesce(CAST(payment_net_days AS VARCHAR), '-'), coalesce(nullif(governing_law, ''), '-')) || '|' AS line
FROM per_doc"""))
def markdown_table(spark, sf):
    """every per-document row rendered as a markdown table line."""
    return FN.markdown_rows(pf(spark, sf).per_doc,
                            ["doc_id", "risk_score", "risk_bucket", "issues_count", "payment_net_days",
                             "governing_law"])


# ============================================================ text mining

from ..operators import textmine as TM  # noqa: E402
from ..sources.tables import documents as _documents  # noqa: E402


def _doc_sentences(spark, sf):
    """Sentences of every document: ``(doc_id, sentence_pos, sentence, sid)``."""
    s = TM.split_sentences(_documents(spark, sf), ["doc_id"], "text")
    return s.select("*", F.struct("doc_id", "sentence_pos").alias("sid"))


_DOC_SENTS = ("doc_sents", O.sentences_from("documents", ["doc_id"], "text"))
_DOC_SID = ("sents", "SELECT struct_pack(doc_id := doc_id, sentence_pos := sentence_pos) AS sid, sentence FROM doc_sents")
_SNIPS = ("snips", O.snippets_sql())
_CON_SENTS = ("con_sents", O.sentences_from("snips", ["doc_id", "snippet_pos"], "snippet"))
_CON_SID = ("sents", "SELECT struct_pack(doc_id := doc_id, snippet_pos := snippet_pos, sentence_pos := sentence_pos) "
                     "AS sid, sentence FROM con_sents")


@query("risky_snippets", O.with_extra(["validated"], [_SNIPS], "SELECT * FROM snips"))
def risky_snippets(spark, sf):
    """Clause texts of every contract plus the clause text of each issue naming a clause."""
    return TM.risky_snippets(pf(spark, sf).first_pass)


@query("split_sentences", O.with_extra([], [_DOC_SENTS], "SELECT * FROM doc_sents"))
def split_sentences(spark, sf):
    """Sentences of every document (30-400 chars, distinct within the document)."""
    return TM.split_sentences(_documents(spark, sf), ["doc_id"], "text")


@query("tfidf_sentence_score", O.with_extra([], [_DOC_SENTS, _DOC_SID] + O.tfidf_ctes("sents"), """
SELECT sentence, m AS occurrences, first_sid.doc_id AS first_doc, first_sid.sentence_pos AS first_pos,
  round(score, 6) AS score FROM t_scored"""))
def tfidf_sentence_score(spark, sf):
    """TF-IDF row-sum score of every distinct sentence of the documents table."""
    s = pf(spark, sf).document_corpus.scores()
    return s.select("sentence", F.col("m").alias("occurrences"), F.col("first_sid.doc_id").alias("first_doc"),
                    F.col("first_sid.sentence_pos").alias("first_pos"), r6(F.col("score")).alias("score"))


@query("keyword_boost", O.with_extra([], [_DOC_SENTS], f"""
SELECT doc_id, sentence_pos, {O.boost_sql('sentence')} AS boost FROM doc_sents"""))
def keyword_boost(spark, sf):
    """T4: risk-keyword boost of every document sentence."""
    s = _doc_sentences(spark, sf)
    return s.select("doc_id", "sentence_pos", TM.keyword_boost(F.col("sentence")).alias("boost"))


@query("corpus_summary", O.with_extra(["validated"], [_SNIPS, _CON_SENTS, _CON_SID] + O.tfidf_ctes("sents")
                                      + O.summary_ctes(), """
SELECT sentence, first_sid.doc_id AS first_doc, first_sid.snippet_pos AS first_snippet,
  first_sid.sentence_pos AS first_pos, round(rank_score, 6) AS score FROM t_top"""))
def corpus_summary(spark, sf):
    """T5: the 10-sentence extractive summary of the risky contract clauses."""
    top = pf(spark, sf).clause_corpus.summary()
    return top.select("sentence", F.col("first_sid.doc_id").alias("first_doc"),
                      F.col("first_sid.snippet_pos").alias("first_snippet"),
                      F.col("first_sid.sentence_pos").alias("first_pos"), r6(F.col("rank_score")).alias("score"))


@query("document_summary", O.with_extra([], [_DOC_SENTS, _DOC_SID] + O.tfidf_ctes("sents") + O.summary_ctes(), """
SELECT sentence, first_sid.doc_id AS first_doc, first_sid.sentence_pos AS first_pos,
  round(rank_score, 6) AS score FROM t_top"""))
def document_summary(spark, sf):
    """T5 over the whole documents table."""
    top = pf(spark, sf).document_corpus.summary()
    return top.select("sentence", F.col("first_sid.doc_id").alias("first_doc"),
                      F.col("first_sid.sentence_pos").alias("first_pos"), r6(F.col("rank_score")).alias("score"))


@query("clause_themes")
def clause_themes(spark, sf):
    """Six clause themes (TF-IDF + KMeans) with their ten heaviest terms."""
    return TM.clause_themes(pf(spark, sf).clause_corpus)


@query("theme_examples")
def theme_examples(spark, sf):
    """Six example sentences of each of the six themes, nearest to the centroid first."""
    c = pf(spark, sf).clause_corpus
    return c.examples(c.fit_themes())


#: Centroids given by words, so that SQL can tell their nearest sentences too.
_WORD_THEMES = (("terminate", "termination", "written notice"), ("payment", "payment terms", "invoice"), ("governed", "laws", "state"))
_CENTROIDS = [(t, w, 1 / len(ws) ** 0.5) for t, ws in enumerate(_WORD_THEMES) for w in ws]


@query("theme_nearest", O.with_extra(["validated"], [_SNIPS, _CON_SENTS, _CON_SID] + O.tfidf_ctes("sents") + [
    ("c", "SELECT * FROM (VALUES " + ", ".join(f"({t}, {O.q(w)}, {c!r})" for t, w, c in _CENTROIDS) + ") AS c(theme, term, c)"),
    ("dots", """SELECT first_sid, theme, sum(tf * idf * c) AS dot FROM t_ex JOIN t_vocab USING (term) JOIN c USING (term) GROUP BY first_sid, theme"""),
    ("away", """SELECT t_ds.first_sid, sentence, m, th.theme, round(sqrt(greatest(0.0, CASE WHEN sw2 > 0 THEN 1.0 - 2 * coalesce(dot, 0.0) / sqrt(sw2) ELSE 0.0 END
        + size)), 9) AS distance FROM t_ds CROSS JOIN (SELECT theme, sum(c * c) AS size FROM c GROUP BY theme) th
        LEFT JOIN t_per USING (first_sid) LEFT JOIN dots ON dots.first_sid = t_ds.first_sid AND dots.theme = th.theme"""),
    ("near", "SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY first_sid ORDER BY distance, theme) = 1"),
], """SELECT CAST(theme AS BIGINT) AS theme, CAST(row_number() OVER w AS BIGINT) AS rank, sentence, m, round(distance, 6) AS distance
FROM near WINDOW w AS (PARTITION BY theme ORDER BY distance, first_sid) QUALIFY row_number() OVER w <= 6"""))
def theme_nearest(spark, sf):
    """The six sentences nearest to each of three centroids that words define."""
    return pf(spark, sf).clause_corpus.examples(_CENTROIDS).withColumn("distance", r6(F.col("distance")))


# ================================================================== chunks

from ..functions import chunks as CH  # noqa: E402
from ..operators import explore as EX  # noqa: E402

_HINTS = P.FIELD_HINTS
_STRIDE = P.CHUNK_SIZE - P.CHUNK_OVERLAP


def _chunks(df, text="text", ids=("doc_id",)):
    c = df.select(*ids, F.explode(CH.make_chunks(F.col(text), P.CHUNK_SIZE, P.CHUNK_OVERLAP)).alias("c"))
    return c.select(*ids, F.col("c.idx").alias("idx"), F.col("c.start").alias("chunk_start"),
                    F.col("c.end").alias("chunk_end"), F.col("c.text").alias("chunk_text"))


def _chunks_sql(table: str) -> str:
    s, o, st = P.CHUNK_SIZE, P.CHUNK_OVERLAP, _STRIDE
    return f"""
SELECT doc_id, CAST(i AS BIGINT) AS idx, CAST(i * {st} AS BIGINT) AS chunk_start,
  CAST(least(n, i * {st} + {s}) AS BIGINT) AS chunk_end, substring(text, i * {st} + 1, least(n, i * {st} + {s}) - i * {st}) AS chunk_text
FROM (SELECT doc_id, text, n, unnest(range(0, kl + 1)) AS i FROM
  (SELECT doc_id, text, length(text) AS n, CAST(greatest(0, ceil((length(text) - {s}) / {st}.0)) AS BIGINT) AS kl FROM {table} WHERE length(text) > 0))
UNION ALL
SELECT doc_id, kl + 1, n - {o}, n, substring(text, n - {o} + 1, {o}) FROM
  (SELECT doc_id, text, length(text) AS n, CAST(greatest(0, ceil((length(text) - {s}) / {st}.0)) AS BIGINT) AS kl FROM {table} WHERE length(text) > 0)
WHERE {o} > 0 AND n - {o} > kl * {st}"""


@query("make_chunks", O.with_extra([], [("ch", _chunks_sql("documents"))], """
SELECT doc_id, idx, chunk_start, chunk_end, md5(chunk_text) AS chunk_md5 FROM ch"""))
def make_chunks(spark, sf):
    """2000-char chunks with 150-char overlap (global offsets) of every document."""
    c = _chunks(_documents(spark, sf))
    return c.select("doc_id", "idx", "chunk_start", "chunk_end", F.md5("chunk_text").alias("chunk_md5"))


def _score_sql(text: str, hints) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({text}), {O.q(h)}) AS BIGINT)" for h in dict.fromkeys(hints)) + ")"


_FIELD_SCORES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, idx, {O.q(f)} AS field, {_score_sql('chunk_text', h)} AS score FROM ch" for f, h in _HINTS)


def _field_scores(c):
    """Rows (doc_id, idx, field, score); every chunk is lower-cased once."""
    low = c.select("doc_id", "idx", F.lower("chunk_text").alias("low"))
    scores = [F.struct(F.lit(f).alias("field"), sum((F.contains("low", F.lit(x)).cast("bigint") for x in dict.fromkeys(h)), F.lit(0)).cast("bigint").alias("score"))
              for f, h in _HINTS]
    return low.select("doc_id", "idx", F.inline(F.array(*scores)))


@query("chunk_keyword_score", O.with_extra(["contracts"], [("ch", _chunks_sql("contracts"))], _FIELD_SCORES_SQL))
def chunk_keyword_score(spark, sf):
    """Distinct field hints contained in each contract chunk."""
    return _field_scores(_chunks(pf(spark, sf).docs))


@query("chunk_prefilter_top5", O.with_extra([], [("ch", _chunks_sql("documents")), ("sc", _FIELD_SCORES_SQL)], """
SELECT doc_id, field, rank, idx, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, idx) AS BIGINT) AS rank FROM sc)
WHERE rank <= 5"""))
def chunk_prefilter_top5(spark, sf):
    """C4: per document and field the five best chunks by hint score (stable on ties), in the
    row: one scan for all fields, no shuffle, no text beyond the scores."""
    scores = CH.hint_scores(CH.make_chunks(F.col("text"), P.CHUNK_SIZE, P.CHUNK_OVERLAP), _HINTS)
    d = _documents(spark, sf).select("doc_id", scores.alias("scores"))
    return d.select("doc_id", F.inline(CH.prefilter_top_all(F.col("scores"), _HINTS, 5)))


# ================================================================= explore

_SEL = EX.Selection(risk_buckets=("high", "medium"), net_days=(30, 60))
_SEL_SQL = "risk_bucket IN ('high', 'medium') AND (payment_net_days BETWEEN 30 AND 60 OR payment_net_days IS NULL)"


@query("filter_options", W(["per_doc"], """
SELECT DISTINCT 'risk_bucket' AS dimension, risk_bucket AS value FROM per_doc WHERE risk_bucket IS NOT NULL AND risk_bucket <> ''
UNION ALL SELECT DISTINCT 'governing_law', governing_law FROM per_doc WHERE governing_law IS NOT NULL AND governing_law <> ''
UNION ALL SELECT DISTINCT 'party_key', party_key FROM per_doc WHERE party_key IS NOT NULL AND party_key <> ''"""))
def filter_options(spark, sf):
    """E1."""
    return EX.filter_options(pf(spark, sf).per_doc)


@query("apply_filters", W(["per_doc"], f"SELECT * FROM per_doc WHERE {_SEL_SQL}"))
def apply_filters(spark, sf):
    """high/medium risk with 30-60 net days (documents without net days kept)."""
    return EX.apply_filters(pf(spark, sf).per_doc, _SEL)


@query("net_days_bounds", W(["per_doc"], """
SELECT CAST(coalesce(min(payment_net_days), 0) AS BIGINT) AS nd_min,
  CAST(CASE WHEN min(payment_net_days) IS NULL THEN 200 ELSE greatest(max(payment_net_days), min(payment_net_days) + 10) END AS BIGINT) AS nd_max
FROM per_doc"""))
def net_days_bounds(spark, sf):
    """E3."""
    return EX.net_days_bounds(pf(spark, sf).per_doc)


@query("top100_filtered", W(["per_doc"], f"""
SELECT doc_id, risk_score, risk_bucket, issues_count, payment_net_days, governing_law, party_key FROM per_doc
WHERE {_SEL_SQL} ORDER BY risk_score DESC, doc_id LIMIT 100"""))
def top100_filtered(spark, sf):
    """E4."""
    return EX.top_filtered(EX.apply_filters(pf(spark, sf).per_doc, _SEL))


@query("risk_histogram", W(["per_doc"], f"SELECT risk_bucket, count(*) AS documents FROM per_doc WHERE {_SEL_SQL} GROUP BY 1"))
def risk_histogram(spark, sf):
    """K8: bucket counts of the selection."""
    return K.risk_histogram(EX.apply_filters(pf(spark, sf).per_doc, _SEL))


@query("findings_semi_join", W(["per_doc", "findings"], f"""
SELECT * FROM findings WHERE doc_id IN (SELECT doc_id FROM per_doc WHERE {_SEL_SQL})
  OR NOT EXISTS (SELECT 1 FROM per_doc WHERE {_SEL_SQL})"""))
def findings_semi_join(spark, sf):
    """E5: findings of the selected documents."""
    p = pf(spark, sf)
    return EX.findings_of(p.findings, EX.apply_filters(p.per_doc, _SEL), p.per_doc)


_TYPES = ("NET_DAYS_OUTLIER", "PAYMENT_AMOUNT_HIGH")


@query("findings_by_type", W(["findings"], f"SELECT * FROM findings WHERE issue_type IN {tuple(_TYPES)}"))
def findings_by_type(spark, sf):
    """E6."""
    return EX.findings_by_type(pf(spark, sf).findings, _TYPES)


_Q_LAW = "Which contracts are governed by California law?"
_Q_TERM = "Which contracts allow termination with less than 45 days notice?"


@query("question_filter", W(["per_doc"], "SELECT * FROM per_doc WHERE contains(lower(governing_law), 'california')"))
def question_filter(spark, sf):
    """E7: 'Which contracts are governed by California law?'"""
    return EX.question_filter(pf(spark, sf).per_doc, _Q_LAW)


@query("question_filter_termination", W(["validated"], f"""
SELECT doc_id, CAST(TRY_CAST(nullif(regexp_extract(tc_text, {O.q(EX.NOTICE_DAYS_RX)}, 1), '') AS INTEGER) AS BIGINT) AS termination_notice_days
FROM validated WHERE TRY_CAST(nullif(regexp_extract(tc_text, {O.q(EX.NOTICE_DAYS_RX)}, 1), '') AS INTEGER) < 45"""))
def question_filter_termination(spark, sf):
    """E7: 'Which contracts allow termination with less than 45 days notice?'"""
    v = pf(spark, sf).first_pass.select(
        "doc_id", EX.termination_notice_days(F.col("termination_clause.text")).alias("termination_notice_days"))
    return EX.question_filter(v, _Q_TERM)


@query("suggest_schema")
def suggest_schema(spark, sf):
    """Type probes over every per-document column; suggestion ``text``."""
    return EX.suggest_schema(pf(spark, sf).per_doc)


# ============================================================ strict policy

_ST = P.strict()


def _strict(spark, sf):
    return R.strict_per_doc(pf(spark, sf).first_pass, _ST)


def _strict_terms_sql(text: str) -> str:
    arr = "[" + ", ".join(f"CASE WHEN contains(lower({text}), {O.q(t.lower())}) THEN {O.q(t)} END" for t in _ST.strict_ambiguity_terms) + "]"
    return f"list_sort(list_filter({arr}, lambda x: x IS NOT NULL))"


_STRICT_BASE = f"""
SELECT doc_id, governing_law, nd, effective_date, parties, pt_text, pt_start, tc_text, tc_start,
  (CASE WHEN parties IS NULL OR len(parties) = 0 THEN 1 ELSE 0 END
   + CASE WHEN NOT {O.truthy('effective_date')} THEN 1 ELSE 0 END
   + CASE WHEN NOT {O.truthy('governing_law')} THEN 1 ELSE 0 END
   + CASE WHEN pt_start IS NULL THEN 1 ELSE 0 END
   + CASE WHEN tc_start IS NULL THEN 1 ELSE 0 END) AS n_missing,
  CASE WHEN {O.truthy('governing_law')} AND governing_law NOT IN ({', '.join(O.q(x) for x in _ST.approved_laws)}) THEN 1 ELSE 0 END AS notice,
  CASE WHEN pt_start IS NOT NULL THEN {_strict_terms_sql('pt_text')} ELSE [] END AS pt_terms,
  CASE WHEN tc_start IS NOT NULL THEN {_strict_terms_sql('tc_text')} ELSE [] END AS tc_terms,
  coalesce(len(list_filter(parties, lambda x: contains(x, '[*') OR NOT regexp_matches(x, '[A-Za-z]'))) > 0, false) AS redacted
FROM first_pass"""
_STRICT_SCORED = f"""
SELECT *, least(20.0, 3.0 * n_missing + 1.0 * notice + CASE WHEN len(pt_terms) > 0 THEN 1.0 ELSE 0.0 END
  + CASE WHEN len(tc_terms) > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN redacted THEN 1.0 ELSE 0.0 END) AS score FROM s_base"""


def _strict_sql(body: str) -> str:
    return O.with_extra(["first_pass"], [("s_base", _STRICT_BASE), ("s_scored", _STRICT_SCORED)], body)


@query("strict_risk_score", _strict_sql(f"""
SELECT doc_id, CAST(score AS BIGINT) AS risk_score, {O.bucket('score', 4.0, 8.0)} AS risk_bucket FROM s_scored"""))
def strict_risk_score(spark, sf):
    """L1: capped integer-weight score and 4/8 buckets of the strict profile."""
    return _strict(spark, sf).select("doc_id", "risk_score", "risk_bucket")


@query("strict_missing", W(["first_pass"], " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field FROM first_pass WHERE {c}" for f, c in (
        ("parties", "parties IS NULL OR len(parties) = 0"),
        ("effective_date", f"NOT {O.truthy('effective_date')}"),
        ("governing_law", f"NOT {O.truthy('governing_law')}"),
        ("payment_terms", "pt_start IS NULL"),
        ("termination_clause", "tc_start IS NULL")))))
def strict_missing(spark, sf):
    """L2: MISSING on all five schema fields."""
    x = _strict(spark, sf).select("doc_id", F.explode_outer("_strict_issues").alias("i"))
    return x.where(F.col("i.type") == "MISSING").select("doc_id", F.col("i.field").alias("field"))


@query("nonstandard_law", _strict_sql("SELECT doc_id, governing_law FROM s_base WHERE notice = 1"))
def nonstandard_law(spark, sf):
    """L3: governing law outside the approved list (exact raw match)."""
    x = _strict(spark, sf).select("doc_id", "governing_law", F.explode_outer("_strict_issues").alias("i"))
    return x.where(F.col("i.type") == "NOTICE").select("doc_id", "governing_law")


@query("doc_tags", _strict_sql("""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN governing_law IS NOT NULL AND length(governing_law) > 0 THEN 'law:' || governing_law END,
  CASE WHEN nd IS NOT NULL AND nd <= 30 THEN 'net:fast' END,
  CASE WHEN n_missing > 0 THEN 'incomplete' END], lambda x: x IS NOT NULL), ',') AS tags FROM s_base"""))
def doc_tags(spark, sf):
    """L4: law / fast-payment / incomplete tags per document."""
    return _strict(spark, sf).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("ambiguous_terms", _strict_sql("""
SELECT term, count(*) AS mentions FROM (SELECT unnest(list_concat(pt_terms, tc_terms)) AS term FROM s_base)
GROUP BY term ORDER BY mentions DESC, term LIMIT 10"""))
def ambiguous_terms(spark, sf):
    """The corpus' most frequent matched ambiguity terms (top 10)."""
    x = _strict(spark, sf).select(F.explode_outer("_strict_issues").alias("i")).where(
        (F.col("i.type") == "AMBIGUOUS") & F.col("i.field").isin("payment_terms", "termination_clause"))
    t = x.select(F.explode(F.split(F.col("i.value"), ", ")).alias("term"))
    return (t.groupBy("term").agg(F.count(F.lit(1)).alias("mentions"))
            .orderBy(F.desc("mentions"), "term").limit(_ST.top_n_ambiguous_terms))


_AMT_RX = r"(?i)(USD|US\$|\$)\s?([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?|\d+(?:\.\d{2})?)"


@query("payment_amounts", W(["first_pass"], f"""
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, upper(cur) AS currency, TRY_CAST(replace(amt, ',', '') AS DOUBLE) AS amount FROM (
  SELECT doc_id, unnest(generate_series(1, len(c))) AS pos, unnest(c) AS cur, unnest(a) AS amt FROM (
    SELECT doc_id, regexp_extract_all(pt_text, {O.q(_AMT_RX)}, 1) AS c, regexp_extract_all(pt_text, {O.q(_AMT_RX)}, 2) AS a
    FROM first_pass WHERE pt_text IS NOT NULL))"""))
def payment_amounts(spark, sf):
    """Every currency amount of the payment terms."""
    s = _strict(spark, sf).select("doc_id", F.posexplode_outer("payment_amounts").alias("pos", "p"))
    return s.where(F.col("pos").isNotNull()).select("doc_id", "pos", F.col("p.currency").alias("currency"), F.col("p.amount").alias("amount"))


@query("redacted_parties", _strict_sql("SELECT doc_id FROM s_base WHERE redacted"))
def redacted_parties(spark, sf):
    """Documents whose party names look redacted."""
    return pf(spark, sf).first_pass.where(R.redacted_parties(F.col("parties"))).select("doc_id")


@query("portfolio_summary", _strict_sql("""
SELECT count(*) AS documents, round(avg(CAST(score AS BIGINT)), 6) AS avg_risk_score,
  median(CAST(score AS BIGINT)) AS median_risk_score,
  count(*) FILTER (WHERE score < 4) AS low, count(*) FILTER (WHERE score >= 4 AND score < 8) AS medium,
  count(*) FILTER (WHERE score >= 8) AS high FROM s_scored"""))
def portfolio_summary(spark, sf):
    """Strict-profile portfolio summary."""
    s = K.portfolio_summary(_strict(spark, sf))
    return s.select("documents", r6(F.col("avg_risk_score")).alias("avg_risk_score"), "median_risk_score",
                    "low", "medium", "high")


@query("issue_type_counts", _strict_sql("""
SELECT issue_type, sum(n) AS issues FROM (
  SELECT 'MISSING' AS issue_type, n_missing AS n FROM s_base
  UNION ALL SELECT 'NOTICE', notice FROM s_base
  UNION ALL SELECT 'AMBIGUOUS', (CASE WHEN len(pt_terms) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(tc_terms) > 0 THEN 1 ELSE 0 END)
     + (CASE WHEN redacted THEN 1 ELSE 0 END) FROM s_base)
GROUP BY issue_type HAVING sum(n) > 0"""))
def issue_type_counts(spark, sf):
    """Strict issues per type."""
    return K.issue_type_counts(_strict(spark, sf), "_strict_issues").select(
        "issue_type", F.col("issues").cast("bigint").alias("issues"))


_HIGH_SQL = """SELECT doc_id, CAST(score AS BIGINT) AS risk_score, CAST(n_missing + notice
  + (CASE WHEN len(pt_terms) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(tc_terms) > 0 THEN 1 ELSE 0 END)
  + (CASE WHEN redacted THEN 1 ELSE 0 END) AS BIGINT) AS n_issues
FROM s_scored WHERE score >= 8 ORDER BY score DESC, doc_id LIMIT 10"""


@query("strict_documents", _strict_sql(f"""
SELECT doc_id, CAST(score AS BIGINT) AS risk_score, {O.bucket('score', 4.0, 8.0)} AS risk_bucket
FROM s_scored ORDER BY risk_score DESC, doc_id"""))
def strict_documents(spark, sf):
    """All documents by strict risk."""
    return K.strict_documents(_strict(spark, sf))


@query("strict_high_risk", _strict_sql(_HIGH_SQL))
def strict_high_risk(spark, sf):
    """The ten riskiest documents of the high bucket, with how many issues they have."""
    h = K.strict_high_risk(_strict(spark, sf))
    return h.select("doc_id", "risk_score", F.size("_strict_issues").cast("bigint").alias("n_issues"))


# ========================================================== sources / sinks

from ..operators import model as MD  # noqa: E402
from ..operators import report as RP  # noqa: E402
from ..sources import files as FS  # noqa: E402
from ..sources.quarantine import Quarantine  # noqa: E402
from ..schema import PER_DOC  # noqa: E402


@query("scan_text_corpus", "SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count FROM documents")
def scan_text_corpus(spark, sf):
    """Document ids and character counts (code points)."""
    return _documents(spark, sf).select("doc_id", F.length("text").alias("char_count"))


@query("short_text_flag", f"SELECT doc_id, length({O.strip('text')}) < {P.SHORT_TEXT_CHARS} AS short_text FROM documents")
def short_text_flag(spark, sf):
    """Documents whose trimmed text is shorter than 50 characters."""
    return _documents(spark, sf).select("doc_id", FS.short_text_flag(F.col("text")).alias("short_text"))


def _flat_sql(url: str) -> str:
    path = f"regexp_extract({url}, {O.q(r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)')}, 1)"
    rel = f"regexp_replace({path}, '^/+', '')"
    folders = f"regexp_extract({rel}, '^(.*)/[^/]*$', 1)"
    name = f"regexp_extract({rel}, '([^/]*)$', 1)"
    stem = (f"CASE WHEN regexp_matches({name}, {O.q(r'^.+\.[^.]+$')}) THEN regexp_extract({name}, "
            f"{O.q(r'^(.+)\.[^.]+$')}, 1) ELSE {name} END")
    return f"(CASE WHEN {folders} <> '' THEN replace({folders}, '/', '__') || '__' || {stem} ELSE {stem} END) || '.txt'"


@query("flat_doc_name", f"SELECT page_id, {_flat_sql('url')} AS doc_name FROM pages")
def flat_doc_name(spark, sf):
    """Flat document name of every page's URL path."""
    from ..sources.tables import read_table
    p = read_table(spark, sf, "pages")
    return p.select("page_id", FS.flat_name(FS.url_path(F.col("url"))).alias("doc_name"))


_HTML_SQL = (f"trim(regexp_replace(regexp_replace(html, {O.q(FS.HTML_DROP_RX)}, ' ', 'g'), "
             f"{O.q(O.WS_CLASS + '+')}, ' ', 'g'), ' ')")


@query("ingest_pages", f"""
SELECT page_id, {_flat_sql('url')} AS doc_name, {_HTML_SQL} AS text,
  length({_HTML_SQL}) < {P.SHORT_TEXT_CHARS} AS short_text FROM pages""")
def ingest_pages(spark, sf):
    """S3 (converter = tag stripping): page text, flat name and short-text flag."""
    from ..sources.tables import read_table
    p = read_table(spark, sf, "pages").select("page_id", FS.flat_name(FS.url_path(F.col("url"))).alias("doc_name"),
                                              FS.html_to_text(F.col("html")).alias("text"))
    return p.select("*", FS.short_text_flag(F.col("text")).alias("short_text"))


def _page_files(spark, sf, damaged: int | None = None, every: int = 1):
    """Pages as files ``(doc_id, source_path, content)``, of ids divisible by ``every``; of those divisible by
    ``damaged`` the body tag is lost, so that the converter fails."""
    from ..sources.tables import read_table
    html = F.col("html")
    if damaged:
        html = F.when(F.col("page_id") % damaged == 0, F.regexp_replace(html, "(?i)<body", "<b0dy")).otherwise(html)
    p = read_table(spark, sf, "pages").where(F.col("page_id") % every == 0)
    return p.select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("source_path"), F.encode(html, "UTF-8").alias("content"))


@query("ingest_error_split", f"""
SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN ok THEN 'converted' ELSE 'failed' END AS status,
  CASE WHEN ok THEN length({_HTML_SQL}) END AS chars, CASE WHEN NOT ok THEN 'no body' END AS error
FROM (SELECT *, contains(lower(html), '<body') AND page_id % 5 <> 0 AS ok FROM pages)""")
def ingest_error_split(spark, sf):
    """Pages through the converter hook, split into texts and failures; every fifth file is damaged."""
    ok, bad = FS.split_errors(FS.convert(_page_files(spark, sf, damaged=5), FS.html_converter))
    return (ok.select("doc_id", F.lit("converted").alias("status"), F.length("text").cast("bigint").alias("chars"), F.lit(None).cast("string").alias("error"))
            .unionByName(bad.select("doc_id", F.lit("failed").alias("status"), F.lit(None).cast("bigint").alias("chars"), "error")))


def _delivered_twice(spark, sf) -> Quarantine:
    """Two deliveries of the pages: of the even ids, one in five damaged; of all ids, one in fifteen damaged."""
    q = Quarantine(spark, FS.work_dir(spark, "quarantine"))
    q.ingest(_page_files(spark, sf, damaged=5, every=2), FS.html_converter, run="first")
    q.ingest(_page_files(spark, sf, damaged=15), FS.html_converter, run="second")
    return q


_DELIVERED_SQL = """(SELECT *, page_id % 2 = 0 AS early, page_id % 2 = 0 AND page_id % 5 <> 0 AND body AS ok1, page_id % 15 <> 0 AND body AS ok2
  FROM (SELECT *, contains(lower(html), '<body') AS body FROM pages))"""


@query("ingest_skip_existing", f"""
SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN ok1 THEN 1 ELSE 2 END AS run, length({_HTML_SQL}) AS chars,
  length({_HTML_SQL}) < {P.SHORT_TEXT_CHARS} AS short_text FROM {_DELIVERED_SQL} WHERE ok1 OR ok2""")
def ingest_skip_existing(spark, sf):
    """Pages delivered twice; the second run skips what the first converted."""
    c = _delivered_twice(spark, sf).converted()
    return c.select("doc_id", ((F.col("batch") - 1) / 2).cast("bigint").alias("run"), F.length("text").alias("chars"), "short_text")


@query("ingest_quarantine", f"""
SELECT CAST(page_id AS VARCHAR) AS doc_id, url AS source_path, 'no body' AS error, CASE WHEN early THEN 2 ELSE 1 END AS attempts
FROM {_DELIVERED_SQL} WHERE NOT ok1 AND NOT ok2""")
def ingest_quarantine(spark, sf):
    """What stays in quarantine after two deliveries, with its attempts."""
    return _delivered_twice(spark, sf).failures()


def _pages_as_files(spark, sf) -> str:
    """Write every page as one HTML file under its url's first folder (derived input for
    S3); pages without one go to Spark's default partition folder."""
    from ..sources.tables import read_table
    root = FS.work_dir(spark, "pages")
    p = read_table(spark, sf, "pages").select(
        F.regexp_extract(FS.url_path(F.col("url")), "^/([^/]+)/", 1).alias("part"), "html")
    p.write.option("maxRecordsPerFile", 1).partitionBy("part").text(root)
    return root


@query("ingest_files")
def ingest_files(spark, sf):
    """Binary-file ingest of the pages written as files, with the
    HTML converter hook; ``(doc_id, source_path, chars, error)``."""
    root = _pages_as_files(spark, sf)
    parts = [p for p in FS.folders(spark, root) if p.startswith("part=")]
    conv = FS.ingest(spark, root, [*parts, "part-missing"], FS.html_converter, glob="*.txt")
    return conv.select("doc_id", "source_path", F.length("text").alias("chars"), "error")


@query("text_corpus_roundtrip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS char_count FROM documents""")
def text_corpus_roundtrip(spark, sf):
    """Documents written as a text corpus, one file each, and scanned back with their ids."""
    root = FS.work_dir(spark, "texts")
    FS.write_texts(_documents(spark, sf).select("doc_id", "text"), root)
    return FS.scan_texts(spark, root)


@query("sink_roundtrip")
def sink_roundtrip(spark, sf):
    """Per-document metrics written as CSV and JSON, read back with a schema."""
    pd_ = pf(spark, sf).per_doc
    root = FS.work_dir(spark, "sinks")
    FS.write_csv(pd_, root + "/per_doc_csv")
    FS.write_json(pd_, root + "/per_doc_json")
    a = FS.read_csv(spark, root + "/per_doc_csv", PER_DOC)
    b = FS.read_json(spark, root + "/per_doc_json", PER_DOC)
    return a.select(F.lit("csv").alias("sink"), "*").unionByName(b.select(F.lit("json").alias("sink"), "*"))


@query("scan_extract_json")
def scan_extract_json(spark, sf):
    """Extract records written as JSON and scanned with the record schema."""
    from ..operators.extraction import extract_record
    from ..schema import EXTRACT
    root = FS.work_dir(spark, "extract")
    FS.write_json(extract_record(pf(spark, sf).extracted), root)
    return FS.read_json(spark, root, EXTRACT)


@query("scan_validated_docs")
def scan_validated_docs(spark, sf):
    """Validated records scanned back; the ``_report`` file beside them is ignored."""
    from ..schema import VALIDATED
    v = pf(spark, sf).validated
    root = FS.work_dir(spark, "validated")
    rec = v.select(*[c for c in v.columns if c not in ("doc_id", "party_key")], F.col("doc_id").alias("_doc_id"))
    FS.write_json(rec, root)
    # A report file next to the records, as the validator writes one.
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.text(root + "/_crossref_report")
    return FS.read_json(spark, root, VALIDATED)


@query("scan_artifacts")
def scan_artifacts(spark, sf):
    """Artifact loads; a missing artifact is an empty table of its schema."""
    root = FS.work_dir(spark, "artifacts")
    FS.write_csv(pf(spark, sf).per_doc, root + "/per_doc")
    present = FS.read_csv(spark, root + "/per_doc", PER_DOC)
    missing = FS.read_csv(spark, root + "/findings_missing", PER_DOC)
    return present.unionByName(missing)


@query("report_lines")
def report_lines(spark, sf):
    """The cross-reference, analysis and summary reports as lines with their place."""
    p = pf(spark, sf)
    summary = p.clause_corpus.summary()
    lines = RP.crossref_lines(p.marked)
    more = RP.text_lines(spark, RP.analysis_markdown(p.per_doc, p.findings) + RP.summary_markdown(p.per_doc, summary), 100)
    return lines.unionByName(more)


@query("kpi_document")
def kpi_document(spark, sf):
    """K9: all KPIs as one JSON document."""
    return K.kpi_document(pf(spark, sf).per_doc)


# =================================================================== hooks

def _unresolved_contracts(spark, sf):
    from ..operators.extraction import extract_fields
    return extract_fields(pf(spark, sf).docs, keep_text=True)


#: Documents of one task of the fuzzy ranking: some 5 MB of text and a few seconds.
DOCUMENTS_PER_TASK = 2_000


@query("chunk_fuzzy_rank")
def chunk_fuzzy_rank(spark, sf):
    """Fuzzy re-rank (partial ratio) of each document's prefiltered chunks, top-k kept. Documents
    are dealt by their number: a scan's splits hold whole row groups, so one of them may hold all rows."""
    from ..sources.tables import deal_rows, read_table
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    dealt = deal_rows(docs, docs.count(), DOCUMENTS_PER_TASK, F.xxhash64("doc_id", "text"))
    return MD.rank_chunks(dealt, [f for f, _ in P.FIELD_HINTS]).select(
        "doc_id", "field", "rank", "pre_rank", "chunk_start", "fuzzy")


def _requests_ctes():
    """The request of every (contract, field) that fails the gate: its best chunk. A chunk with
    a hint scores 100, so without one the order matters only among several chunks, which
    contracts don't have."""
    failing = f"SELECT doc_id, field FROM ({_GATE_SQL}) WHERE NOT passes"
    req = """SELECT doc_id, field, chunk_start, chunk_text FROM (
  SELECT f.*, ch.chunk_start, ch.chunk_text, row_number() OVER (PARTITION BY f.doc_id, f.field ORDER BY score > 0 DESC, score DESC, idx) AS rn
  FROM failing f JOIN sc USING (doc_id, field) JOIN ch USING (doc_id, idx)) WHERE rn = 1"""
    return [("ch", _chunks_sql("contracts")), ("sc", _FIELD_SCORES_SQL), ("failing", failing), ("req", req)]


def _stub_ctes():
    """What the stub model answers: the sentence around the first hint."""
    first = "least(" + ", ".join(f"CASE WHEN field = {O.q(f)} AND contains(low, {O.q(x)}) THEN strpos(low, {O.q(x)}) - 1 END" for f, h in _HINTS for x in h) + ")"
    at = f"SELECT *, {first} AS s FROM (SELECT *, lower(chunk_text) AS low FROM req)"
    ends = "SELECT *, CASE WHEN strpos(substr(low, s + 1), '.') > 0 THEN s + strpos(substr(low, s + 1), '.') ELSE length(chunk_text) END AS e FROM stub_at"
    return _requests_ctes() + [("stub_at", at), ("stub_end", ends), ("stub", f"""
SELECT doc_id, field, CAST(1 AS BIGINT) AS rank, chunk_start, chunk_text, sha256(chunk_text) AS chunk_sha,
  CASE WHEN s IS NULL THEN '' ELSE {O.strip('substring(chunk_text, s + 1, e - s)')} END AS text,
  CAST(coalesce(s, 0) AS BIGINT) AS "start", CAST(CASE WHEN s IS NULL THEN 0 ELSE e END AS BIGINT) AS "end",
  CASE WHEN s IS NULL THEN 0.0 ELSE 0.5 END AS confidence FROM stub_end""")]


def _model_sql(body: str) -> str:
    return O.with_extra(["contracts", "extracted"], _stub_ctes(), body)


_ANSWER_COLS = 'doc_id, field, rank, chunk_start, chunk_sha, text, "start", "end", confidence'


@query("chunk_topk", O.with_extra(["contracts", "extracted"], _requests_ctes(), """
SELECT doc_id, field, CAST(1 AS BIGINT) AS rank, chunk_start, CAST(length(chunk_text) AS BIGINT) AS chunk_chars FROM req"""))
def chunk_topk(spark, sf):
    """The chunk sent to the model per (contract, field) whose rule value fails the gate."""
    return _ranked_requests(spark, sf).select(
        "doc_id", "field", "rank", "chunk_start", F.length("chunk_text").alias("chunk_chars"))


def _ranked_requests(spark, sf):
    """The chunks sent to the model: of each contract the fields that fail the gate."""
    return MD.rank_chunks(MD.failing_fields(_unresolved_contracts(spark, sf)), [f for f, _ in P.SCHEMA_FIELDS])


#: The stub answers at once, so its calls need no threads.
_AT_ONCE = MD.CallLimits(concurrency=1, attempts=2, backoff_seconds=0.0)


@query("model_extract", _model_sql(f"SELECT {_ANSWER_COLS} FROM stub"))
def model_extract(spark, sf):
    """Model candidates (deterministic stub model) for fields failing the gate."""
    r = _ranked_requests(spark, sf)
    return MD.call_extractor(r, MD.keyword_stub_extractor, limits=_AT_ONCE)


@query("model_answers", _model_sql(f"""
SELECT doc_id, field, chunk_sha, CASE WHEN refused THEN 'failed' WHEN text = '' THEN 'empty' ELSE 'answered' END AS status,
  CAST(CASE WHEN refused THEN 2 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN refused THEN 'RuntimeError: refused' END AS reason,
  CASE WHEN NOT refused THEN text END AS text
FROM (SELECT *, contains(chunk_text, {O.q(MD.REFUSED)}) AS refused FROM stub)"""))
def model_answers(spark, sf):
    """Every call as a row, failed ones with their attempts and reason (a stub that refuses some chunks)."""
    got = MD.calls.ask(_ranked_requests(spark, sf), MD.refusing_stub_extractor, _AT_ONCE)
    return got.select("doc_id", "field", "chunk_sha", "status", "attempts", "reason", "text")


@query("globalize_offsets", _model_sql(f"SELECT {_ANSWER_COLS} FROM stub"))
def globalize_offsets(spark, sf):
    """Model offsets made global (contracts are one chunk, so here they stay; tests cover others)."""
    return MD.globalize_offsets(REGISTRY["model_extract"](spark, sf))


@query("best_candidate", _model_sql("""SELECT doc_id, field, text, "start", "end", confidence FROM stub WHERE text <> ''"""))
def best_candidate(spark, sf):
    """Best non-empty candidate per (document, field)."""
    b = MD.best_candidate(MD.globalize_offsets(REGISTRY["model_extract"](spark, sf)))
    return b.select("doc_id", "field", "best.*")


_FILLED_SQL = """
SELECT e.doc_id, coalesce(pt.text, e.pt_text) AS payment_terms, coalesce(tc.text, e.tc_text) AS termination_clause,
  coalesce(gl.text, e.governing_law) AS governing_law, '{' || array_to_string(list_filter([
    CASE WHEN pa.text IS NULL AND parties_source IS NOT NULL THEN '"parties":{"source":"' || parties_source || '"}' END,
    CASE WHEN gl.text IS NULL AND law_source IS NOT NULL THEN '"governing_law":{"source":"' || law_source || '"}' END,
    CASE WHEN pa.text IS NOT NULL THEN '"parties":' || model END, CASE WHEN ed.text IS NOT NULL THEN '"effective_date":' || model END,
    CASE WHEN gl.text IS NOT NULL THEN '"governing_law":' || model END, CASE WHEN pt.text IS NOT NULL THEN '"payment_terms":' || model END,
    CASE WHEN tc.text IS NOT NULL THEN '"termination_clause":' || model END], lambda x: x IS NOT NULL), ',') || '}' AS provenance
FROM (SELECT *, '{"source":"model","confidence":0.5}' AS model FROM extracted) e
""" + "\n".join(f"LEFT JOIN (SELECT doc_id, text FROM stub WHERE field = '{f}' AND text <> '') {a} ON {a}.doc_id = e.doc_id" for f, a in (
    ("parties", "pa"), ("effective_date", "ed"), ("governing_law", "gl"), ("payment_terms", "pt"), ("termination_clause", "tc")))


def _with_model(m):
    return m.select("doc_id", F.col("payment_terms.text").alias("payment_terms"),
                    F.col("termination_clause.text").alias("termination_clause"), "governing_law",
                    F.to_json("_provenance").alias("provenance"))


@query("extract_with_model", _model_sql(_FILLED_SQL))
def extract_with_model(spark, sf):
    """X10 complete: rule -> fallback -> model cascade with provenance (stub model), in one pass."""
    return _with_model(MD.apply_model(_unresolved_contracts(spark, sf), MD.keyword_stub_extractor, limits=_AT_ONCE))


@query("extract_with_memo", _model_sql(_FILLED_SQL))
def extract_with_memo(spark, sf):
    """The same cascade with an answer log: equal chunks are asked once."""
    memo = MD.AnswerLog(spark, FS.work_dir(spark, "memo"), "stub")
    return _with_model(MD.apply_model(_unresolved_contracts(spark, sf), MD.keyword_stub_extractor, memo=memo, limits=_AT_ONCE))


@query("model_memo", _model_sql(f"SELECT {_ANSWER_COLS} FROM stub WHERE text <> ''"))
def model_memo(spark, sf):
    """A first run against a model that refuses some chunks, a second one that asks only those
    again; the candidates that the compacted log then serves."""
    r = MD.materialize(_ranked_requests(spark, sf), "checkpoint")
    memo = MD.AnswerLog(spark, FS.work_dir(spark, "memo"), "stub")
    memo.ask_missing(r, MD.refusing_stub_extractor, _AT_ONCE)
    memo.ask_missing(r, MD.keyword_stub_extractor, _AT_ONCE)
    memo.compact()
    return memo.lookup(r)


@query("model_log", _model_sql(f"""
SELECT field, chunk_sha, CASE WHEN text = '' THEN 'empty' ELSE 'answered' END AS status,
  CAST(CASE WHEN contains(chunk_text, {O.q(MD.REFUSED)}) THEN 3 ELSE 1 END AS BIGINT) AS attempts
FROM (SELECT DISTINCT field, chunk_sha, chunk_text, text FROM stub)"""))
def model_log(spark, sf):
    """The log itself after a run with refused chunks (two attempts each) and a second one."""
    r = MD.materialize(_ranked_requests(spark, sf), "checkpoint")
    memo = MD.AnswerLog(spark, FS.work_dir(spark, "memo"), "stub")
    for factory in (MD.refusing_stub_extractor, MD.keyword_stub_extractor, MD.refusing_stub_extractor):
        memo.ask_missing(r, factory, _AT_ONCE)
    return memo.state().select("field", "chunk_sha", "status", "attempts")


@query("entity_hook")
def entity_hook(spark, sf):
    """Entity-recogniser fallback for contracts the rules left without parties or law."""
    from ..operators.extraction import extract_fields
    from ..policy import current
    e = extract_fields(pf(spark, sf).docs, current().with_(use_fallback=False), keep_text=True)
    out = MD.apply_recognizer(e, MD.regex_recognizer)
    return out.select("doc_id", F.array_join("parties", " ; ").alias("parties"), "governing_law")


# =============================================================== streaming

@query("incremental_ingest")
def incremental_ingest(spark, sf):
    """Conversation turns arriving in two file batches, extracted by a
    stream with availableNow triggers; each turn is processed exactly once."""
    from ..sources.tables import read_table
    from ..streaming.incremental import incremental_ingest as run
    conv = read_table(spark, sf, "conversations")
    root = FS.work_dir(spark, "stream")
    src, sink, ck = root + "/in", root + "/out", root + "/ck"
    cut = conv.agg(F.percentile_approx("conv_id", 0.5).alias("c")).collect()[0]["c"]
    conv.where(F.col("conv_id") <= cut).write.parquet(src + "/batch=1")
    run(spark, src, conv.schema, sink, ck, "concat(conv_id, '-', turn)")
    conv.where(F.col("conv_id") > cut).write.parquet(src + "/batch=2")
    run(spark, src, conv.schema, sink, ck, "concat(conv_id, '-', turn)")
    return spark.read.parquet(sink)
