"""DuckDB SQL for the correctness oracle.

The oracle restates every stage independently in SQL over the driver's views
(``orders``, ``customer``, ``nation``, ``documents``, ``pages`` ...). Stages
are CTEs; a query asks for the CTEs it needs and dependencies are pulled in
automatically. Regex texts are shared with the Spark side (inline flags work
in both Java and RE2); everything else is plain SQL.
"""

from __future__ import annotations

from .. import policy as P
from ..functions import extract as X
from ..functions import normalize as N
from ..functions.text import PY_WHITESPACE, WS_CLASS
from ..sources.contracts import contracts_sql_duckdb
from . import stopwords


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    """SQL expression for a set of characters (safe for control characters)."""
    parts, plain = [], ""
    for ch in s:
        if ch.isprintable() and ch not in "'":
            plain += ch
        else:
            if plain:
                parts.append(q(plain))
                plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain:
        parts.append(q(plain))
    return "(" + " || ".join(parts) + ")"


WS = chars(PY_WHITESPACE)


def strip(e: str, cs: str | None = None) -> str:
    return f"trim({e}, {WS if cs is None else chars(cs)})"


def squash(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS_CLASS + '+')}, ' ', 'g'), ' ')"


def truthy(e: str) -> str:
    return f"({e} IS NOT NULL AND length({e}) > 0)"


def rx(flags: str, pattern: str) -> str:
    return q(f"(?{flags})" + pattern if flags else pattern)


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


# ------------------------------------------------------------ expressions

def span_cols(text: str, head: str, tail: int, prefix: str) -> str:
    find = rx("is", "^(.*?)(" + head + ")")
    s = f"length(regexp_extract({text}, {find}, 1))"
    h = f"length(regexp_extract({text}, {find}, 2))"
    e = f"least(length({text}), greatest({s} + {h} + {tail}, {s} + {P.SPAN_WINDOW}))"
    hit = f"regexp_matches({text}, {rx('is', head)})"
    return (f"CASE WHEN {hit} THEN {strip(f'substring({text}, {s} + 1, {e} - {s})')} END AS {prefix}_text, "
            f"CASE WHEN {hit} THEN CAST({s} AS BIGINT) END AS {prefix}_start, "
            f"CASE WHEN {hit} THEN CAST({e} AS BIGINT) END AS {prefix}_end")


def canonical_place(cand: str, places=P.US_STATES + P.COUNTRIES) -> str:
    arms = " ".join(f"WHEN contains(lower({cand}), {q(p.lower())}) THEN {q(p)}"
                    for p in X.places_by_length(places))
    return f"CASE {arms} END"


def _month_num(e: str, kind: str) -> str:
    names = N.MONTH_ABBR if kind == "abbr" else N.MONTHS
    return f"list_position({lst(names)}, lower({e}))"


def parse_format(s: str, shape: str, kind: str) -> str:
    r = rx("i", shape)
    g = lambda i: f"regexp_extract({s}, {r}, {i})"
    if kind in ("abbr", "full"):
        y, m, d = f"CAST({g(3)} AS INT)", _month_num(g(1), kind), f"CAST({g(2)} AS INT)"
    else:
        m, d = f"CAST({g(1)} AS INT)", f"CAST({g(2)} AS INT)"
        y = f"CAST({g(3)} AS INT)"
        if kind == "num2":
            y = f"(CASE WHEN {y} >= {N.TWO_DIGIT_YEAR_PIVOT} THEN 1900 + {y} ELSE 2000 + {y} END)"
    iso = f"printf('%04d-%02d-%02d', {y}, {m}, {d})"
    return f"CASE WHEN regexp_matches({s}, {r}) THEN CAST(try_strptime({iso}, '%Y-%m-%d') AS DATE) END"


def normalize_date(raw: str) -> str:
    s = strip(raw)
    whole = [parse_format(s, shape, kind) for _, shape, kind in N.DATE_FORMATS]
    searched = [f"CASE WHEN regexp_matches({s}, {q(r)}) THEN "
                f"{parse_format(f'regexp_extract({s}, {q(r)}, 0)', shape, kind)} END"
                for r, (_, shape, kind) in zip(N.DATE_SEARCH, N.DATE_FORMATS)]
    return f"CASE WHEN {truthy(s)} THEN coalesce({', '.join(whole + searched)}) END"


def normalize_amount(text: str) -> str:
    r = rx("i", N.CURRENCY_RX)
    return (f"CASE WHEN {truthy(text)} AND regexp_matches({text}, {r}) THEN "
            f"TRY_CAST(replace(regexp_extract({text}, {r}, 1), ',', '') AS DOUBLE) END")


def net_days(text: str) -> str:
    r = rx("i", N.NET_DAYS_RX)
    return (f"CASE WHEN {truthy(text)} AND regexp_matches({text}, {r}) THEN "
            f"TRY_CAST(regexp_extract({text}, {r}, 1) AS INTEGER) END")


def norm_party(e: str) -> str:
    collapsed = f"regexp_replace(coalesce({e}, ''), {q(WS_CLASS + '+')}, ' ', 'g')"
    return f"upper({strip(collapsed, N.PARTY_EDGE_CHARS)})"


def party_key(parties: str) -> str:
    names = (f"list_transform(list_filter({parties}, lambda x: x IS NOT NULL AND length({strip('x')}) > 0), "
             f"lambda x: {norm_party('x')})")
    key = f"array_to_string(list_sort(({names})[1:2]), ' | ')"
    return f"CASE WHEN {parties} IS NOT NULL AND len({names}) > 0 AND {key} <> '' THEN {key} END"


def contains_any(low: str, terms) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(t.lower())})" for t in terms) + ")"


def count_occ(hay: str, needle: str) -> str:
    return f"((length({hay}) - length(replace({hay}, {q(needle)}, ''))) // {len(needle)})"


ISSUE_FIELDS = (("type", "VARCHAR"), ("field", "VARCHAR"), ("value", "VARCHAR"),
                ("reason", "VARCHAR"), ("span_start", "BIGINT"), ("span_end", "BIGINT"),
                ("max", "BIGINT"), ("median", "DOUBLE"), ("pct_dev", "DOUBLE"),
                ("party_key", "VARCHAR"), ("party_mode", "VARCHAR"), ("party_median", "DOUBLE"),
                ("tolerance", "BIGINT"), ("warn_above", "DOUBLE"), ("amount", "DOUBLE"))


def issue(type_: str, **f) -> str:
    parts = []
    for name, typ in ISSUE_FIELDS:
        v = q(type_) if name == "type" else f.get(name, "NULL")
        parts.append(f"{name} := CAST({v} AS {typ})")
    return "struct_pack(" + ", ".join(parts) + ")"


def keep(*cands: str) -> str:
    return f"list_filter([{', '.join(cands)}], lambda x: x IS NOT NULL)"


def weight_case(e: str, weights) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {float(w)}" for t, w in weights)
    return f"(CASE {e} {arms} ELSE 0.0 END)"


def bucket(score: str, medium: float, high: float) -> str:
    return f"CASE WHEN {score} >= {high} THEN 'high' WHEN {score} >= {medium} THEN 'medium' ELSE 'low' END"


def clamp_quote(e: str, n: int = P.MAX_QUOTE_CHARS) -> str:
    t = squash(e)
    return (f"CASE WHEN {truthy(e)} THEN left({t}, {n}) || "
            f"CASE WHEN length({t}) > {n} THEN '…' ELSE '' END ELSE '' END")


def risk_score(p: P.Policy = P.current()) -> str:
    wsum = f"coalesce(list_sum(list_transform(issues, lambda x: {weight_case('x.type', p.weights)})), 0.0)"
    ndc = (f"coalesce(CASE WHEN nd > {p.net_days_standard} THEN least(3.0, greatest(0.0, "
           f"(nd - {p.net_days_standard}) / 30.0)) END, 0.0)")
    warn = float(p.amount_upper_warn)
    amc = f"coalesce(CASE WHEN amount > {warn} THEN least(2.0, (amount - {warn}) / {warn}) END, 0.0)"
    return f"(({wsum} + {ndc}) + {amc})"


# --------------------------------------------------------------- the CTEs

def _ctes(p: P.Policy = P.current()) -> dict:
    c = {}
    deps = {}
    c["contracts"] = contracts_sql_duckdb()
    deps["contracts"] = []

    party_rx = rx("is", X.PARTY_RX)
    date_rx = rx("i", X.DATE_RX)
    law_rx = rx("i", X.LAW_RX)
    fb_rx = rx("i", X.LAW_FALLBACK_RX)
    c["rules"] = f"""
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS char_count,
  CASE WHEN regexp_matches(text, {party_rx}) THEN
    [{strip(f'regexp_extract(text, {party_rx}, 1)', X.PARTY_STRIP)},
     {strip(f'regexp_extract(text, {party_rx}, 2)', X.PARTY_STRIP)}] END AS r_parties,
  CASE WHEN regexp_matches(text, {date_rx}) THEN {strip(f'regexp_extract(text, {date_rx}, 1)')} END AS effective_date,
  CASE WHEN regexp_matches(text, {law_rx}) THEN
    nullif({strip(f'regexp_extract(text, {law_rx}, 1)', X.LAW_STRIP)}, '') END AS r_law,
  regexp_matches(text, {fb_rx}) AS fb_hit,
  {span_cols('text', X.PAYMENT_HEAD_RX, X.PAYMENT_TAIL, 'pt')},
  {span_cols('text', X.TERMINATION_HEAD_RX, X.TERMINATION_TAIL, 'tc')}
FROM contracts"""
    deps["rules"] = ["contracts"]

    cand = strip(f"regexp_extract(text, {fb_rx}, 1)", X.LAW_STRIP)
    gaz = rx("", r"\b(" + "|".join(X.places_by_length(p.places)) + r")\b")
    fbp = q(X.party_fallback_rx())
    c["fb_raw"] = f"""
SELECT *,
  CASE WHEN r_parties IS NULL THEN list_filter(list_transform(
      regexp_extract_all(text, {fbp}), lambda x: {strip('x')}),
      lambda x: length(x) >= 3) END AS fp_all,
  CASE WHEN r_law IS NULL AND fb_hit THEN nullif(coalesce({canonical_place(cand, p.places)}, {cand}), '') END AS f_law,
  CASE WHEN r_law IS NULL AND NOT fb_hit THEN nullif(regexp_extract(text, {gaz}, 1), '') END AS g_law
FROM rules"""
    deps["fb_raw"] = ["rules"]

    c["extracted"] = """
SELECT doc_id, text, char_count, effective_date, pt_text, pt_start, pt_end, tc_text, tc_start, tc_end,
  coalesce(r_parties, f_parties) AS parties,
  coalesce(r_law, f_law, g_law) AS governing_law,
  CASE WHEN f_parties IS NOT NULL THEN 'entity' END AS parties_source,
  CASE WHEN f_law IS NOT NULL THEN 'fallback' WHEN g_law IS NOT NULL THEN 'entity' END AS law_source
FROM (SELECT *, CASE WHEN len(fp_dist) > 0 THEN fp_dist[1:4] END AS f_parties
      FROM (SELECT *, list_filter(fp_all, lambda x, i: list_position(fp_all, x) = i) AS fp_dist FROM fb_raw))"""
    deps["extracted"] = ["fb_raw"]

    amb = p.ambiguity_terms
    missing = []
    for f in p.required_fields:
        if f in ("payment_terms", "termination_clause"):
            cond = "pt_start IS NULL" if f == "payment_terms" else "tc_start IS NULL"
        elif f == "parties":
            cond = "(parties IS NULL OR len(parties) = 0)"
        else:
            cond = f"NOT {truthy(f)}"
        missing.append(f"CASE WHEN {cond} THEN {issue('MISSING', field=q(f))} END")
    c["first_pass"] = f"""
SELECT *, {keep(
        f"CASE WHEN {truthy('effective_date')} AND eff_norm IS NULL THEN {issue('BAD_DATE', field=q('effective_date'), value='effective_date')} END",
        f"CASE WHEN {truthy('pt_text')} AND {contains_any('lower(pt_text)', amb)} THEN {issue('AMBIGUOUS', field=q('payment_terms'), reason=q('Ambiguous language detected'), span_start='pt_start', span_end='pt_end')} END",
        f"CASE WHEN {truthy('tc_text')} AND {contains_any('lower(tc_text)', amb)} THEN {issue('AMBIGUOUS', field=q('termination_clause'), reason=q('Ambiguous language detected'), span_start='tc_start', span_end='tc_end')} END",
        *missing)} AS issues1
FROM (SELECT *, {normalize_date('effective_date')} AS eff_norm,
        CASE WHEN {truthy('pt_text')} THEN {normalize_amount('pt_text')} END AS amount,
        CASE WHEN {truthy('pt_text')} THEN {net_days('pt_text')} END AS nd,
        {party_key('parties')} AS party_key
      FROM extracted)"""
    deps["first_pass"] = ["extracted"]

    c["corpus_median"] = "SELECT median(nd) AS med FROM first_pass"
    deps["corpus_median"] = ["first_pass"]
    c["party_nd"] = """
SELECT party_key, CAST(count(*) AS BIGINT) AS contracts, median(nd) AS party_median
FROM first_pass WHERE party_key IS NOT NULL GROUP BY party_key"""
    deps["party_nd"] = ["first_pass"]
    c["party_mode"] = f"""
SELECT party_key, governing_law AS party_mode FROM (
  SELECT *, row_number() OVER (PARTITION BY party_key ORDER BY n DESC, first_doc) AS rn FROM (
    SELECT party_key, governing_law, count(*) AS n, min(doc_id) AS first_doc FROM first_pass
    WHERE party_key IS NOT NULL AND {truthy('governing_law')} GROUP BY 1, 2)) WHERE rn = 1"""
    deps["party_mode"] = ["first_pass"]

    tol = p.per_party_net_days_tolerance
    warn = float(p.amount_upper_warn)
    xr_new = keep(
        f"CASE WHEN nd > {p.max_net_days} THEN {issue('NET_DAYS_OVER_MAX', value='CAST(nd AS VARCHAR)', max=str(p.max_net_days))} END",
        f"CASE WHEN nd IS NOT NULL AND med IS NOT NULL AND med > 0 AND abs(nd - med) / med >= {p.net_days_pct_from_median} "
        f"THEN {issue('NET_DAYS_OUTLIER', value='CAST(nd AS VARCHAR)', median='med', pct_dev='round(abs(nd - med) / med, 2)')} END",
        f"CASE WHEN {str(p.check_party_law_consistency).upper()} AND party_key IS NOT NULL AND {truthy('governing_law')} "
        f"AND party_mode IS NOT NULL AND governing_law <> party_mode THEN "
        f"{issue('GOVERNING_LAW_INCONSISTENT', party_key='party_key', value='governing_law', party_mode='party_mode')} END",
        f"CASE WHEN party_key IS NOT NULL AND nd IS NOT NULL AND party_median IS NOT NULL AND abs(nd - party_median) > {tol} "
        f"THEN {issue('NET_DAYS_DRIFT_VS_PARTY', party_key='party_key', value='CAST(nd AS VARCHAR)', party_median='party_median', tolerance=str(tol))} END",
        f"CASE WHEN amount > {warn} THEN {issue('PAYMENT_AMOUNT_HIGH', value='CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR)', warn_above=str(warn), amount='amount')} END",
    )
    c["validated"] = f"""
SELECT *, list_concat(issues1, {xr_new}) AS issues FROM (
  SELECT fp.*, s.party_median, m.party_mode, cm.med
  FROM first_pass fp
  LEFT JOIN party_nd s ON fp.party_key = s.party_key
  LEFT JOIN party_mode m ON fp.party_key = m.party_key
  CROSS JOIN corpus_median cm)"""
    deps["validated"] = ["first_pass", "party_nd", "party_mode", "corpus_median"]

    score = risk_score(p)
    c["scored"] = f"SELECT *, {score} AS score FROM validated"
    deps["scored"] = ["validated"]
    c["per_doc"] = f"""
SELECT doc_id, party_key, governing_law, eff_norm AS effective_date,
  CAST(nd AS BIGINT) AS payment_net_days, amount AS payment_amount,
  round(score, 3) AS risk_score, {bucket('score', p.medium, p.high)} AS risk_bucket,
  CAST(len(issues) AS BIGINT) AS issues_count,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(issues, lambda x: x.type), lambda t: t IS NOT NULL AND t <> ''))), ',') AS issue_types
FROM scored"""
    deps["per_doc"] = ["scored"]

    c["issues_x"] = """
SELECT v.doc_id, v.governing_law, v.nd, v.amount, v.effective_date, v.pt_text, v.tc_text,
  CAST(u.pos - 1 AS BIGINT) AS issue_pos, u.i
FROM validated v, (SELECT unnest(generate_series(1, len(v.issues))) AS pos, unnest(v.issues) AS i) u"""
    deps["issues_x"] = ["validated"]

    details = f"""CASE i.type
  WHEN 'BAD_DATE' THEN json_object('value', i.value)
  WHEN 'AMBIGUOUS' THEN json_object('reason', i.reason, 'span', json_object('start', i.span_start, 'end', i.span_end))
  WHEN 'MISSING' THEN json_object()
  WHEN 'NET_DAYS_OVER_MAX' THEN json_object('value', TRY_CAST(i.value AS INTEGER), 'max', i.max)
  WHEN 'NET_DAYS_OUTLIER' THEN json_object('value', TRY_CAST(i.value AS INTEGER), 'median', i.median, 'pct_dev', i.pct_dev)
  WHEN 'GOVERNING_LAW_INCONSISTENT' THEN json_object('party_key', i.party_key, 'value', i.value, 'party_mode', i.party_mode)
  WHEN 'NET_DAYS_DRIFT_VS_PARTY' THEN json_object('party_key', i.party_key, 'value', TRY_CAST(i.value AS INTEGER), 'party_median', i.party_median, 'tolerance', i.tolerance)
  WHEN 'PAYMENT_AMOUNT_HIGH' THEN json_object('value', TRY_CAST(i.value AS DECIMAL(38,2)), 'warn_above', CAST(i.warn_above AS DECIMAL(38,2)))
  END"""
    field_text = ("CASE i.field WHEN 'payment_terms' THEN pt_text WHEN 'termination_clause' THEN tc_text "
                  "WHEN 'effective_date' THEN effective_date WHEN 'governing_law' THEN governing_law END")
    c["findings"] = f"""
SELECT doc_id, issue_pos, i.type AS issue_type, i.field AS field, governing_law,
  CAST(nd AS BIGINT) AS payment_net_days, amount AS payment_amount,
  CAST({details} AS VARCHAR) AS details, {clamp_quote(field_text, p.max_quote_chars)} AS quote
FROM issues_x"""
    deps["findings"] = ["issues_x"]
    return c, deps


def with_ctes(names, body: str, policy: P.Policy = P.current()) -> str:
    c, deps = _ctes(policy)
    order: list = []

    def visit(n):
        if n in order:
            return
        for d in deps[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({c[n]})" for n in order) + "\n" + body


__all__ = ["with_ctes", "q", "strip", "squash", "truthy", "rx", "lst", "chars", "WS",
           "normalize_date", "normalize_amount", "net_days", "norm_party", "party_key",
           "contains_any", "count_occ", "clamp_quote", "bucket", "weight_case", "stopwords"]


# ------------------------------------------------------------ text mining

SPLIT_MARK = 57344  # a private-use code point marks sentence boundaries


def split_sentences_list(text: str) -> str:
    """List of kept sentences (before de-duplication)."""
    from ..operators.textmine import SENTENCE_SPLIT_RX  # noqa: F401  (same rule, RE2 form below)
    t = f"trim(regexp_replace(coalesce({text}, ''), {q(WS_CLASS + '+')}, ' ', 'g'), ' ')"
    marked = f"regexp_replace({t}, '([.?!])\\s+([A-Z0-9(])', '\\1' || chr({SPLIT_MARK}) || '\\2', 'g')"
    parts = f"list_transform(string_split({marked}, chr({SPLIT_MARK})), lambda x: {strip('x')})"
    return (f"list_filter({parts}, lambda x: length(x) >= {P.SENTENCE_MIN_CHARS} "
            f"AND length(x) <= {P.SENTENCE_MAX_CHARS})")


def sentences_from(table: str, id_cols, text: str) -> str:
    """One row per distinct-in-text sentence with ``sentence_pos`` (0-based)."""
    ids = ", ".join(id_cols)
    return f"""
SELECT {ids}, CAST(unnest(generate_series(0, len(d) - 1)) AS BIGINT) AS sentence_pos, unnest(d) AS sentence FROM (
  SELECT {ids}, list_filter(k, lambda x, i: list_position(k, x) = i) AS d FROM (
    SELECT {ids}, {split_sentences_list(text)} AS k FROM {table}))"""


def terms_sql(sentence: str) -> str:
    stop = lst(stopwords.english())
    return f"list_filter(regexp_extract_all(lower({sentence}), {q('[\\p{L}\\p{N}_]{2,}')}), lambda t: NOT list_contains({stop}, t))"


def tfidf_ctes(sents: str, max_features: int = P.TFIDF_MAX_FEATURES) -> list:
    """CTE list (name, sql) scoring distinct sentences of the CTE ``sents(sid, sentence)``."""
    return [
        ("t_ds", f"SELECT sentence, count(*) AS m, min(sid) AS first_sid FROM {sents} GROUP BY sentence"),
        ("t_dt", f"""SELECT sentence, m, first_sid, list_concat(tok, CASE WHEN len(tok) >= 2 THEN
            list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]) ELSE [] END) AS terms
            FROM (SELECT *, {terms_sql('sentence')} AS tok FROM t_ds)"""),
        ("t_ex", """SELECT first_sid, m, term, count(*) AS tf FROM (SELECT first_sid, m, unnest(terms) AS term FROM t_dt)
            GROUP BY first_sid, m, term"""),
        ("t_st", "SELECT term, sum(m * tf) AS ctf, sum(m) AS df FROM t_ex GROUP BY term"),
        ("t_n", "SELECT sum(m) AS n FROM t_ds"),
        ("t_vocab", f"""SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM
            (SELECT * FROM t_st ORDER BY ctf DESC, term LIMIT {max_features}) CROSS JOIN t_n"""),
        ("t_per", """SELECT first_sid, sum(tf * idf) AS sw, sum((tf * idf) * (tf * idf)) AS sw2
            FROM t_ex JOIN t_vocab USING (term) GROUP BY first_sid"""),
        ("t_scored", """SELECT t_ds.sentence, t_ds.m, t_ds.first_sid,
            coalesce(CASE WHEN sw2 > 0 THEN sw / sqrt(sw2) END, 0.0) AS score
            FROM t_ds LEFT JOIN t_per USING (first_sid)"""),
    ]


def boost_sql(sentence: str, keywords=P.RISK_KEYWORDS, weight: float = P.KEYWORD_BOOST) -> str:
    low = f"lower({sentence})"
    return "(" + " + ".join(count_occ(low, k.lower()) for k in keywords) + f") * {weight}"


def summary_ctes(top_k: int = P.TOP_K_SUMMARY_SENTENCES) -> list:
    return [
        ("t_fin", f"SELECT sentence, first_sid, round(score + {boost_sql('sentence')}, 9) AS rank_score FROM t_scored"),
        ("t_best", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(left(sentence, {P.SUMMARY_KEY_CHARS}))
            ORDER BY rank_score DESC, first_sid) AS rn FROM t_fin) WHERE rn = 1"""),
        ("t_top", f"SELECT sentence, first_sid, rank_score FROM t_best ORDER BY rank_score DESC, first_sid LIMIT {top_k}"),
    ]


def with_extra(base_names, extra_ctes, body: str, policy: P.Policy = P.current()) -> str:
    """``with_ctes`` plus ad-hoc CTEs appended after the named ones."""
    sql = with_ctes(base_names, "", policy) if base_names else "WITH "
    tail = ",\n".join(f"{n} AS ({s})" for n, s in extra_ctes)
    if base_names:
        return sql.rstrip("\n") + ",\n" + tail + "\n" + body
    return "WITH " + tail + "\n" + body


def snippets_sql() -> str:
    per_issue = ("list_transform(issues, lambda i: CASE i.field WHEN 'payment_terms' THEN pt_text "
                 "WHEN 'termination_clause' THEN tc_text END)")
    return f"""
SELECT doc_id, CAST(unnest(generate_series(0, len(sn) - 1)) AS BIGINT) AS snippet_pos, unnest(sn) AS snippet FROM (
  SELECT doc_id, list_filter(list_concat([pt_text, tc_text], {per_issue}), lambda s: {truthy('s')}) AS sn FROM validated)"""
