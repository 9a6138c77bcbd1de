"""String helpers shared by all Column functions.

Python's ``str.split()``/``str.strip()`` and ``\\s`` in ``re`` treat every
Unicode whitespace character as space, Java's ``\\s`` only ASCII. The class
below lists Python's whitespace explicitly so the same regex text means the
same thing in Spark (Java) and in DuckDB (RE2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, in code-point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a regex character class accepted by Java and RE2.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def lit_str(s: str) -> Column:
    return F.lit(s)


def py_strip(c: Column, chars: str | None = None) -> Column:
    """``str.strip(chars)``; without ``chars`` strips Python whitespace."""
    return F.btrim(c, F.lit(PY_WHITESPACE if chars is None else chars))


def collapse_ws(c: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s)`` with Python's Unicode whitespace."""
    return F.regexp_replace(c, WS_CLASS + "+", " ")


def collapse_ws_at_hand(c: Column) -> Column:
    """``collapse_ws`` of a column that costs nothing to read more than once: the class above is
    slow, and a text of printable ASCII has no white space but spaces."""
    return (F.when(c.rlike("[^ -~]"), collapse_ws(c))
            .when(F.contains(c, F.lit("  ")), F.regexp_replace(c, "  +", " ")).otherwise(c))


def squash(c: Column) -> Column:
    """``' '.join(s.split())``: collapse whitespace runs and strip the ends."""
    return F.btrim(collapse_ws(c), F.lit(" "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def truthy_str(c: Column) -> Column:
    """Python truthiness of an optional string."""
    return c.isNotNull() & (F.length(c) > 0)


def has_text(c: Column) -> Column:
    """``s.strip()`` is non-empty."""
    return c.isNotNull() & (F.length(py_strip(c)) > 0)


def count_occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``)."""
    if not needle:
        return F.lit(0)
    return F.floor(
        (F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit(""))))
        / F.lit(len(needle))
    ).cast("int")


def contains_any(text_lower: Column, terms) -> Column:
    """Any literal term contained in an already lower-cased text."""
    terms = [t.lower() for t in terms]
    if not terms:
        return F.lit(False)
    out = None
    for t in terms:
        c = F.contains(text_lower, F.lit(t))
        out = c if out is None else (out | c)
    return out
