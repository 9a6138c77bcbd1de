"""Field extraction as Column expressions (rule patterns, span finder, fallbacks).

Everything here is a pure function ``Column -> Column``; Catalyst keeps it in
one narrow projection next to the scan. Offsets are code-point offsets
(``length`` of the text before the match), never ``regexp_instr``, which
counts UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy as P
from .text import blank_to_null, py_strip

# Rule patterns (Java syntax; DuckDB uses the same text with
# the flags passed as options).
DATE_RX = (r"(?:effective|commencement)\s*date[:\s]*"
           r"([A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4})")
LAW_RX = r"governed\s+by\s+the\s+laws?\s+of\s+([A-Za-z\s,]+?)(?:[,.\n]|$)"
PARTY_RX = r"\bbetween\s+(.*?)\s+and\s+(.*?)(?:[,.\n]|$)"
LAW_FALLBACK_RX = r"governed\s+by\s+the\s+laws?\s+of\s+([A-Za-z ,]+)"
PAYMENT_HEAD_RX = r"\bpayment\s+terms?\b"
PAYMENT_TAIL = 500
TERMINATION_HEAD_RX = r"\btermination\b"
TERMINATION_TAIL = 800
PARTY_STRIP = " .,\n"
LAW_STRIP = " .,\n"


def party_fallback_rx(suffixes=P.CORPORATE_SUFFIXES) -> str:
    """Capitalised name of up to five words followed by a corporate suffix."""
    word = r"[A-Z][A-Za-z0-9&'-]*"
    return (r"\b" + word + r"(?:\s+" + word + r"){0,4},?\s+(?:"
            + "|".join(suffixes) + r")\b\.?")


# --------------------------------------------------------------------- rules

def rule_parties(text: Column) -> Column:
    """``between X and Y`` -> [X, Y] (each stripped of `` .,\\n``)."""
    rx = "(?is)" + PARTY_RX
    return F.when(
        text.rlike(rx),
        F.array(py_strip(F.regexp_extract(text, rx, 1), PARTY_STRIP),
                py_strip(F.regexp_extract(text, rx, 2), PARTY_STRIP)),
    )


def rule_effective_date(text: Column) -> Column:
    """Raw effective/commencement date text (the group is never empty, so
    an empty extract means no match)."""
    rx = "(?i)" + DATE_RX
    g = F.regexp_extract(text, rx, 1)
    return F.when(g != "", py_strip(g))


def rule_governing_law(text: Column) -> Column:
    """Governing-law clause text, up to the first `` , . \\n`` or end
    (the group is never empty; an all-punctuation clause counts as absent)."""
    rx = "(?i)" + LAW_RX
    return blank_to_null(py_strip(F.regexp_extract(text, rx, 1), LAW_STRIP))


def span_probe(text: Column, head_rx: str) -> tuple:
    """Prefix and head lengths of the first match (one scan + one anchored match).

    Both are plain columns; stage them in one ``select`` and build the span
    from them in the next, so each regex runs once per row. The head is never
    empty, so a zero head length means no match.
    """
    # The search is faster than the lazy prefix, but it counts UTF-16 units: only where those
    # are characters.
    at = F.greatest(F.regexp_instr(text, F.lit("(?is)" + head_rx)) - 1, F.lit(0))
    s = (F.when(F.octet_length(text) == F.length(text), at)
         .otherwise(F.length(F.regexp_extract(text, "(?is)^(.*?)" + head_rx, 1))))
    # The head re-matched at ``s`` only (anchored): cheap, and zero when absent.
    h = F.length(F.regexp_extract(F.substring(text, s + 1, 1 << 30), "(?is)^(?:" + head_rx + ")", 0))
    return s, h


def span_from_probe(text: Column, s: Column, h: Column, tail: int,
                    window: int = P.SPAN_WINDOW, confidence: float = P.RULE_SPAN_CONFIDENCE,
                    source: str = "regex") -> Column:
    """X4 from staged probe columns: ``[s, e)`` with
    ``e = min(n, max(s + h + tail, s + window))``; text stripped, offsets kept."""
    n = F.length(text)
    e = F.least(n, F.greatest(s + h + F.lit(tail), s + F.lit(window)))
    return F.when(h > 0, F.struct(
        py_strip(F.substring(text, s + 1, e - s)).alias("text"),
        s.cast("int").alias("start"),
        e.cast("int").alias("end"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(source).alias("source"),
    ))


def find_span(text: Column, head_rx: str, tail: int,
              window: int = P.SPAN_WINDOW,
              confidence: float = P.RULE_SPAN_CONFIDENCE,
              source: str = "regex") -> Column:
    """X4 in one expression: first match of ``head_rx`` + up to ``tail`` chars,
    widened to ``window``. For hot paths stage ``span_probe`` first."""
    s, h = span_probe(text, head_rx)
    return span_from_probe(text, s, h, tail, window, confidence, source)


def rule_payment_terms(text: Column) -> Column:
    """X5."""
    return find_span(text, PAYMENT_HEAD_RX, PAYMENT_TAIL)


def rule_termination(text: Column) -> Column:
    """X6."""
    return find_span(text, TERMINATION_HEAD_RX, TERMINATION_TAIL)


# ----------------------------------------------------------------- fallbacks

def places_by_length(places) -> list:
    """Known places, longest first, ties by name (deterministic)."""
    return sorted(places, key=lambda s: (-len(s), s))


def canonical_place(cand: Column, places, whole_word: bool = False) -> Column:
    """X7 step 2: the longest known place contained in ``cand`` (case-insensitive)."""
    low = F.lower(cand)
    out = None
    for name in reversed(places_by_length(places)):
        if whole_word:
            hit = low.rlike(r"\b" + name.lower() + r"\b")
        else:
            hit = F.contains(low, F.lit(name.lower()))
        out = F.when(hit, F.lit(name)) if out is None else F.when(hit, F.lit(name)).otherwise(out)
    return out if out is not None else F.lit(None).cast("string")


def fallback_governing_law(text: Column, places, whole_word: bool = False) -> Column:
    """Looser clause pattern; canonicalised to a known place, else raw.

    Returns NULL when the clause is absent; an empty candidate stays empty and
    counts as absent downstream.
    """
    rx = "(?i)" + LAW_FALLBACK_RX
    cand = py_strip(F.regexp_extract(text, rx, 1), LAW_STRIP)
    return F.when(text.rlike(rx),
                  F.coalesce(canonical_place(cand, places, whole_word), cand))


def fallback_law_candidate(text: Column) -> Column:
    """X7 step 1: the looser clause text, stripped (may be empty)."""
    return py_strip(F.regexp_extract(text, "(?i)" + LAW_FALLBACK_RX, 1), LAW_STRIP)


def _head(text: Column, prefix: int | None) -> Column:
    return text if prefix is None else F.left(text, F.lit(prefix))


def gazetteer_place(text: Column, places, prefix: int | None = P.PLACE_PREFIX_CHARS) -> Column:
    """First known place name (whole word, exact case); ``prefix`` limits the characters read."""
    head = _head(text, prefix)
    alts = "|".join(places_by_length(places))
    rx = r"\b(" + alts + r")\b"
    return blank_to_null(F.regexp_extract(head, rx, 1))


def fallback_party_names(text: Column, prefix: int | None = P.PARTY_PREFIX_CHARS,
                         suffixes=P.CORPORATE_SUFFIXES, limit: int = P.MAX_FALLBACK_PARTIES) -> Column:
    """X9 without the empty-to-NULL step (stage it, then test ``size``)."""
    head = _head(text, prefix)
    names = F.transform(F.regexp_extract_all(head, F.lit(party_fallback_rx(suffixes)), 0),
                        lambda x: py_strip(x))
    return F.slice(F.array_distinct(F.filter(names, lambda x: F.length(x) >= 3)), 1, limit)


def fallback_parties(text: Column, prefix: int | None = P.PARTY_PREFIX_CHARS,
                     suffixes=P.CORPORATE_SUFFIXES, limit: int = P.MAX_FALLBACK_PARTIES) -> Column:
    """The first ``limit`` distinct company names (length >= 3)."""
    names = fallback_party_names(text, prefix, suffixes, limit)
    return F.when(F.size(names) > 0, names)


# -------------------------------------------------------------------- gate

def confident(span: Column, min_conf: float, min_len: int) -> Column:
    """X11 for span fields: present, confidence >= min and text length >= min."""
    return (span.isNotNull()
            & (F.coalesce(span["confidence"], F.lit(0.0)) >= F.lit(min_conf))
            & (F.length(F.coalesce(span["text"], F.lit(""))) >= F.lit(min_len)))


def present(value: Column) -> Column:
    """X11 for scalar fields: any non-NULL value passes."""
    return value.isNotNull()
