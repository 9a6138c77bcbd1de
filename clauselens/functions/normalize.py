"""Normalisation of extracted values as Column expressions.

Dates are parsed by matching the shape with a regex and then building an ISO
string for ``try_to_date`` - strict per calendar (``2/30/2020`` is NULL) and
independent of locale-specific pattern letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, collapse_ws_at_hand, py_strip, truthy_str

# English month names and their abbreviations, January first.
MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")
MONTH_ABBR = tuple(m[:3] for m in MONTHS)

# Amount and net-days patterns.
CURRENCY_RX = (r"(?:USD|US\$|\$)\s?"
               r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?|\d+(?:\.\d{2})?)")
# Optional variant: whole undelimited numbers first (``$5000`` -> 5000).
CURRENCY_FULL_RX = (r"(?:USD|US\$|\$)\s?"
                    r"(\d+(?:\.\d{2})?(?![0-9,])|[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)")
NET_DAYS_RX = r"net\s*(\d{1,3})"
# Edge characters removed from party names.
PARTY_EDGE_CHARS = " \t\n\r,.;:-()[]{}\"'"
TWO_DIGIT_YEAR_PIVOT = 69  # %y: 69-99 -> 19xx, 00-68 -> 20xx

_S = r"\s+"

# The four accepted formats, in the order they are tried:
#   (name, whole-string shape, month group kind)
DATE_FORMATS = (
    ("%b %d, %Y", r"^(" + "|".join(MONTH_ABBR) + r")" + _S + r"(\d{1,2})," + _S + r"(\d{4})$", "abbr"),
    ("%B %d, %Y", r"^(" + "|".join(MONTHS) + r")" + _S + r"(\d{1,2})," + _S + r"(\d{4})$", "full"),
    ("%m/%d/%Y", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "num"),
    ("%m/%d/%y", r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "num2"),
)
# Search patterns tried when no format matches the whole string (case-sensitive).
DATE_SEARCH = (
    r"[A-Za-z]{3}\s+\d{1,2},\s+\d{4}",
    r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}",
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}/\d{1,2}/\d{2}",
)


def _month_number(name: Column, kind: str) -> Column:
    names = MONTH_ABBR if kind == "abbr" else MONTHS
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))])
    return F.element_at(m, F.lower(name))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    iso = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.try_to_date(iso, "yyyy-MM-dd")


def _parse_format(s: Column, shape: str, kind: str) -> Column:
    """Parse ``s`` as a whole with one format; NULL if the shape or the date is invalid."""
    rx = "(?i)" + shape
    g = lambda i: F.regexp_extract(s, rx, i)
    if kind in ("abbr", "full"):
        y, m, d = g(3), _month_number(g(1), kind), g(2)
    else:
        m, d, y = g(1), g(2), g(3)
        if kind == "num2":
            yy = y.cast("int")
            y = F.when(yy >= TWO_DIGIT_YEAR_PIVOT, yy + 1900).otherwise(yy + 2000)
    return F.when(s.rlike(rx), _ymd(y, m, d))


def normalize_date(raw: Column) -> Column:
    """The first format matching the whole stripped string, else the first
    match of each search pattern parsed with its format; NULL otherwise."""
    s = py_strip(raw)
    whole = [_parse_format(s, shape, kind) for _, shape, kind in DATE_FORMATS]
    searched = []
    for rx, (_, shape, kind) in zip(DATE_SEARCH, DATE_FORMATS):
        found = F.regexp_extract(s, rx, 0)
        searched.append(F.when(s.rlike(rx), _parse_format(found, shape, kind)))
    return F.when(truthy_str(s), F.coalesce(*whole, *searched))


def normalize_amount(text: Column, full_amounts: bool = False) -> Column:
    """First currency amount as a double (``$5000`` -> 500.0 by default)."""
    rx = "(?i)" + (CURRENCY_FULL_RX if full_amounts else CURRENCY_RX)
    num = F.replace(F.regexp_extract(text, rx, 1), F.lit(","), F.lit(""))
    return F.when(truthy_str(text) & text.rlike(rx), num.try_cast("double"))


def net_days(text: Column) -> Column:
    """``net\\s*(\\d{1,3})`` anywhere (no word boundary on purpose)."""
    rx = "(?i)" + NET_DAYS_RX
    return F.when(truthy_str(text) & text.rlike(rx),
                  F.regexp_extract(text, rx, 1).try_cast("int"))


def norm_party_name(name: Column) -> Column:
    """Collapse whitespace, strip edge punctuation, upper-case."""
    return F.upper(py_strip(collapse_ws_at_hand(F.coalesce(name, F.lit(""))), PARTY_EDGE_CHARS))


UNROLLED_PARTIES = 4


def party_key_names(parties: Column) -> Column:
    """First two non-blank names, normalised (unsorted).

    Arrays of up to four names (rule and fallback output) use an unrolled,
    code-generated expression; longer arrays fall back to higher-order
    functions, which Spark interprets row by row.
    """
    def nonblank(x):
        return x.isNotNull() & (F.length(py_strip(x)) > 0)

    elems = [F.try_element_at(parties, F.lit(i)) for i in range(1, UNROLLED_PARTIES + 1)]
    short = F.slice(F.array_compact(F.array(
        *[F.when(nonblank(x), norm_party_name(x)) for x in elems])), 1, 2)
    long_ = F.slice(F.transform(F.filter(parties, nonblank), norm_party_name), 1, 2)
    return F.when(F.size(parties) <= UNROLLED_PARTIES, short).otherwise(long_)


def party_key_from_names(names: Column) -> Column:
    """N5 from staged ``party_key_names``; an empty key counts as no key."""
    key = F.array_join(F.array_sort(names), " | ")
    return F.when(names.isNotNull() & (F.size(names) > 0) & (key != ""), key)


def party_key(parties: Column) -> Column:
    """First two non-blank names, normalised, sorted, joined by `` | ``.
    (In wide projections stage ``party_key_names`` first.)"""
    return party_key_from_names(F.when(parties.isNotNull(), party_key_names(parties)))


def ambiguity_flag(text: Column, terms) -> Column:
    """Any policy term contained, case-insensitively."""
    low = F.lower(text)
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t.lower()))
    return out


def matched_terms(text: Column, terms) -> Column:
    """Policy terms contained in the text, sorted (strict profile detail)."""
    low = F.lower(text)
    arr = F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms])
    return F.array_sort(F.filter(arr, lambda x: x.isNotNull()))


def date_to_month(d: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(d, "yyyy-MM")


def clamp_quote(text: Column, max_chars: int) -> Column:
    """Whitespace squashed, cut at ``max_chars``, ellipsis when cut; ``""`` for no text."""
    t = F.btrim(F.regexp_replace(text, WS_CLASS + "+", " "), F.lit(" "))
    out = F.concat(F.left(t, F.lit(max_chars)),
                   F.when(F.length(t) > max_chars, F.lit("…")).otherwise(F.lit("")))
    return F.when(truthy_str(text), out).otherwise(F.lit(""))


def risk_bucket(score: Column, medium: float, high: float) -> Column:
    """>= high, >= medium, else low."""
    return (F.when(score >= F.lit(high), F.lit("high"))
            .when(score >= F.lit(medium), F.lit("medium"))
            .otherwise(F.lit("low")))
