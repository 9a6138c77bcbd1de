"""Per-document rules: normalisation columns and first-pass issues (V1-V5).

One projection, no shuffle. Issues are an ``ARRAY<issue>`` in rule order:
BAD_DATE, AMBIGUOUS (payment terms), AMBIGUOUS (termination), MISSING...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import normalize as N
from ..functions.text import truthy_str
from ..schema import ISSUE

AMBIGUOUS_REASON = "Ambiguous language detected"
_FIELD_KIND = dict(P.SCHEMA_FIELDS)


def issue(type_: str, **fields) -> Column:
    """A NULL-padded issue struct of the common issue type."""
    parts = []
    for f in ISSUE.fields:
        v = F.lit(type_) if f.name == "type" else fields.get(f.name)
        if v is None:
            v = F.lit(None)
        elif not isinstance(v, Column):
            v = F.lit(v)
        parts.append(v.cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def keep_issues(*candidates: Column) -> Column:
    """Array of the non-NULL candidates, in order."""
    return F.array_compact(F.array(*candidates))


def is_missing(field: str) -> Column:
    """``not doc.get(field)`` for a typed field."""
    c = F.col(field)
    kind = _FIELD_KIND.get(field, "text")
    if kind == "span":
        return c.isNull()
    if kind == "list[text]":
        return c.isNull() | (F.size(c) == 0)
    return ~truthy_str(c)


def issue_bad_date() -> Column:
    """V1."""
    raw = F.col("effective_date")
    return F.when(truthy_str(raw) & F.col("effective_date_normalized").isNull(),
                  issue("BAD_DATE", field=F.lit("effective_date"), value=raw))


def issue_ambiguous(field: str, terms) -> Column:
    """V2/V3: ambiguous wording in a clause span, with its offsets."""
    span = F.col(field)
    txt = span["text"]
    return F.when(truthy_str(txt) & N.ambiguity_flag(txt, terms),
                  issue("AMBIGUOUS", field=F.lit(field), reason=F.lit(AMBIGUOUS_REASON),
                        span=F.struct(span["start"].alias("start"), span["end"].alias("end"))))


def issue_missing(fields) -> list:
    """V4: one MISSING issue per required field that is NULL or empty."""
    return [F.when(is_missing(f), issue("MISSING", field=F.lit(f))) for f in fields]


def normalized_columns(policy: P.Policy = P.current()) -> list:
    pt = F.col("payment_terms.text")
    has_pt = truthy_str(pt)
    return [
        N.normalize_date(F.col("effective_date")).alias("effective_date_normalized"),
        F.when(has_pt, N.normalize_amount(pt, policy.full_amounts)).alias("payment_amount_normalized"),
        F.when(has_pt, N.net_days(pt)).cast("int").alias("payment_net_days"),
    ]


def validate_first_pass(extracted: DataFrame, policy: P.Policy = P.current()) -> DataFrame:
    """V5: normalised values, party key and first-pass issues.

    Two projections: values read more than once (normalised date, party
    names, ambiguity flags) are columns of the first, so Catalyst keeps them
    there and the second reads them instead of recomputing them in every
    branch that needs them.
    """
    pt, tc = F.col("payment_terms.text"), F.col("termination_clause.text")
    staged = extracted.select(
        "*", *normalized_columns(policy),
        F.when(F.col("parties").isNotNull(), N.party_key_names(F.col("parties"))).alias("_pk_names"),
        (truthy_str(pt) & N.ambiguity_flag(pt, policy.ambiguity_terms)).alias("_pt_amb"),
        (truthy_str(tc) & N.ambiguity_flag(tc, policy.ambiguity_terms)).alias("_tc_amb"),
    )
    issues = keep_issues(
        issue_bad_date(),
        _ambiguous_from_flag("payment_terms", F.col("_pt_amb")),
        _ambiguous_from_flag("termination_clause", F.col("_tc_amb")),
        *issue_missing(policy.required_fields),
    )
    return staged.select(*extracted.columns, "effective_date_normalized", "payment_amount_normalized",
                         "payment_net_days", N.party_key_from_names(F.col("_pk_names")).alias("party_key"),
                         issues.alias("_issues"))


def _ambiguous_from_flag(field: str, flag: Column) -> Column:
    span = F.col(field)
    return F.when(flag, issue("AMBIGUOUS", field=F.lit(field), reason=F.lit(AMBIGUOUS_REASON),
                              span=F.struct(span["start"].alias("start"), span["end"].alias("end"))))
