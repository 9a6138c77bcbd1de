"""Field extraction over a document DataFrame (rule -> fallback cascade).

``extract_fields(docs)`` is one narrow projection: rules run on the whole
text, fallbacks only on rows the rules left empty (``CASE WHEN`` evaluates
the fallback branch lazily). The text column is dropped afterwards, so later
shuffles never carry whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import extract as X
from ..functions.text import blank_to_null, py_strip

SCHEMA_KEYS = tuple(f for f, _ in P.SCHEMA_FIELDS)


def _prov(source: str, confidence: Column | None = None) -> Column:
    return F.struct(F.lit(source).alias("source"),
                    (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"))


def rule_fields(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rule patterns only."""
    t = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        X.rule_parties(t).alias("parties"),
        X.rule_effective_date(t).alias("effective_date"),
        X.rule_governing_law(t).alias("governing_law"),
        X.rule_payment_terms(t).alias("payment_terms"),
        X.rule_termination(t).alias("termination_clause"),
        F.length(t).cast("int").alias("_char_count"),
    )


def extract_fields(docs: DataFrame, policy: P.Policy = P.current(),
                   text_col: str = "text", id_col: str = "doc_id",
                   keep_text: bool = False) -> DataFrame:
    """Extract record per document.

    Output columns: ``doc_id, parties, effective_date, governing_law,
    payment_terms, termination_clause, _char_count, _provenance`` (+ ``text``
    when ``keep_text``; needed only by the model stage).
    """
    t = F.col(text_col)
    cols = [
        F.col(id_col).alias("doc_id"),
        X.rule_parties(t).alias("_r_parties"),
        X.rule_effective_date(t).alias("effective_date"),
        X.rule_governing_law(t).alias("_r_law"),
        X.rule_payment_terms(t).alias("payment_terms"),
        X.rule_termination(t).alias("termination_clause"),
        F.length(t).cast("int").alias("_char_count"),
    ]
    if keep_text:
        cols.append(t.alias("text"))
    staged = docs.select(*cols)
    if not policy.use_fallback:
        return staged.select(
            "doc_id", F.col("_r_parties").alias("parties"), "effective_date",
            F.col("_r_law").alias("governing_law"), "payment_terms", "termination_clause",
            "_char_count", F.create_map().cast(
                "map<string,struct<source:string,confidence:double>>").alias("_provenance"),
            *(["text"] if keep_text else []))

    return _with_fallbacks(docs, policy, text_col, id_col, keep_text)


def _with_fallbacks(docs: DataFrame, policy: P.Policy, text_col: str, id_col: str,
                    keep_text: bool) -> DataFrame:
    """Staged projections; every expensive regex result is its own column so
    it runs once per row (Catalyst keeps non-trivial expressions that are
    read more than once in their own projection)."""
    t = F.col(text_col)
    pt_s, pt_h = X.span_probe(t, X.PAYMENT_HEAD_RX)
    tc_s, tc_h = X.span_probe(t, X.TERMINATION_HEAD_RX)
    party_rx = "(?is)" + X.PARTY_RX
    stage1 = docs.select(
        F.col(id_col).alias("doc_id"),
        t.alias("_t"),
        # The whole party match (never empty when found); its groups are read
        # from this short string in the next projection, not from the text.
        F.regexp_extract(t, party_rx, 0).alias("_party_m"),
        X.rule_effective_date(t).alias("effective_date"),
        X.rule_governing_law(t).alias("_r_law"),
        pt_s.alias("_pt_s"), pt_h.alias("_pt_h"),
        tc_s.alias("_tc_s"), tc_h.alias("_tc_h"),
        F.length(t).cast("int").alias("_char_count"),
    )
    tt, pm = F.col("_t"), F.col("_party_m")
    stage2 = stage1.select(
        "*",
        F.when(pm != "", F.array(py_strip(F.regexp_extract(pm, party_rx, 1), X.PARTY_STRIP),
                                 py_strip(F.regexp_extract(pm, party_rx, 2), X.PARTY_STRIP))).alias("_r_parties"),
        X.span_from_probe(tt, F.col("_pt_s"), F.col("_pt_h"), X.PAYMENT_TAIL).alias("payment_terms"),
        X.span_from_probe(tt, F.col("_tc_s"), F.col("_tc_h"), X.TERMINATION_TAIL).alias("termination_clause"),
        F.when(pm == "", X.fallback_party_names(tt, policy.party_prefix_chars, limit=policy.max_fallback_parties)).alias("_fp_names"),
        # Looser law clause, only where the rule found none (group never empty when found).
        F.when(F.col("_r_law").isNull(), F.regexp_extract(tt, "(?i)" + X.LAW_FALLBACK_RX, 1)).alias("_fb_g"),
    )
    fb = F.col("_fb_g")
    stage3 = stage2.select(
        "*",
        F.when(fb != "", py_strip(fb, X.LAW_STRIP)).alias("_fb_cand"),
        F.when(fb == "", X.gazetteer_place(tt, policy.places, policy.place_prefix_chars)).alias("_g_law"),
    )
    stage3 = stage3.select(
        "*",
        F.when(F.size("_fp_names") > 0, F.col("_fp_names")).alias("_f_parties"),
        blank_to_null(F.coalesce(X.canonical_place(F.col("_fb_cand"), policy.places, policy.whole_word_places),
                                 F.col("_fb_cand"))).alias("_f_law"),
    )
    r_law = F.col("_r_law")
    if policy.canonical_law:
        r_law = F.coalesce(X.canonical_place(r_law, policy.places, policy.whole_word_places), r_law)
    prov = F.map_from_entries(F.array_compact(F.array(
        F.when(F.col("_f_parties").isNotNull(), F.struct(F.lit("parties"), _prov("entity"))),
        F.when(F.col("_f_law").isNotNull(), F.struct(F.lit("governing_law"), _prov("fallback"))),
        F.when(F.col("_g_law").isNotNull(), F.struct(F.lit("governing_law"), _prov("entity"))),
    )))
    out = [
        "doc_id",
        F.coalesce(F.col("_r_parties"), F.col("_f_parties")).alias("parties"),
        "effective_date",
        F.coalesce(r_law, F.col("_f_law"), F.col("_g_law")).alias("governing_law"),
        "payment_terms",
        "termination_clause",
        "_char_count",
        prov.alias("_provenance"),
    ]
    if keep_text:
        out.append(F.col("_t").alias("text"))
    return stage3.select(*out)


def extract_record(extracted: DataFrame) -> DataFrame:
    """The extract record in schema order plus ``_doc_id``/``_char_count``/``_provenance``."""
    return extracted.select(*SCHEMA_KEYS, F.col("doc_id").alias("_doc_id"),
                            "_char_count", "_provenance")


def _gate_checks(policy: P.Policy) -> list:
    """(field, passes) per schema field."""
    out = []
    for f, kind in P.SCHEMA_FIELDS:
        c = F.col(f)
        ok = X.confident(c, policy.regex_confidence, policy.min_span_len) if kind == "span" else X.present(c)
        out.append((f, F.coalesce(ok, F.lit(False))))
    return out


def gate_fields(policy: P.Policy = P.current()):
    """X11 as a column: names of the fields that fail the gate."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(f)) for f, ok in _gate_checks(policy)]))


def confidence_gate(extracted: DataFrame, policy: P.Policy = P.current()) -> DataFrame:
    """X11 per (doc, field): does the current value pass the gate?"""
    checks = [F.struct(F.lit(f).alias("field"), ok.alias("passes")) for f, ok in _gate_checks(policy)]
    return extracted.select("doc_id", F.inline(F.array(*checks)))
