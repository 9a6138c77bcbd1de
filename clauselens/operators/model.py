"""Model-assisted extraction and other Python hooks.

Everything happens in the row: the fields that fail the confidence gate, their ranked
chunks, the model's answers and the best candidate are columns of the document's row, so
one pass over the table does it and no text is shuffled. Only what needs Python goes
there: chunks whose order depends on the fuzzy score, the requests, and the texts of rows
that need a recogniser. With an answer log (``memo``) equal chunks are asked once over all
rows and runs; the extracted rows are then written once and joined to their answers.

Hook signatures (user supplied):

* extractor: see ``calls``;
* recogniser ``text -> list[(entity_text, label)]``;
* converter ``bytes -> (text, error)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import policy as P
from ..functions import chunks as CH
from ..functions import extract as X
from ..session import materialize
from . import calls
from .calls import ANSWERED, CallLimits
from .memo import AnswerLog

ModelMemo = AnswerLog

CANDIDATE = ("chunk_sha", "text", "start", "end", "confidence")


# ------------------------------------------------------------------ U4 / C5

def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lcs_wide(a: str, b: str) -> int:
    """LCS length, bit-parallel over the first string, of any length (Hyyro 2004)."""
    masks: dict = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Lanes:
    """Texts laid out for the bit-parallel LCS: the characters of all texts, each followed by
    ``GAP`` blanks that match nothing, as numbers of the characters that needles have (0: none)."""

    GAP = 63

    def __init__(self, needles, texts: list):
        self.kinds = {ch: k for k, ch in enumerate(sorted(set("".join(needles))), 1)}
        code = _codes(("\0" * self.GAP).join([*texts, ""]))
        top = max(map(ord, self.kinds))
        table = np.zeros(top + 2, np.intp)
        table[[ord(ch) for ch in self.kinds]] = [*self.kinds.values()]
        self.at = table[np.minimum(code, top + 1)]
        self.sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(self.sizes + self.GAP) - self.GAP
        self.starts = self.ends - self.sizes
        self.inside = np.ones(len(code), bool)
        gaps = (self.ends[:, None] + np.arange(self.GAP)).ravel()
        self.at[gaps] = 0
        self.inside[gaps] = False
        self.kind = self.at.astype(np.min_scalar_type(len(self.kinds)))  # the same, quick to compare

    def scores(self, needle: str) -> np.ndarray:
        """Best score of ``needle`` over the windows of each text. The LCS runs at every place of
        the texts at once, a lane per place and no wider than the needle needs; of them only
        windows that start at the needle's first character or end at its last one count."""
        m = len(needle)
        lane = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if m <= np.iinfo(t).bits)
        bits = np.zeros(len(self.kinds) + 1, lane)
        for i, ch in enumerate(needle):
            bits[self.kinds[ch]] |= lane(1 << i)
        masks = np.take(bits, self.at)
        n = len(masks) - m + 1                             # windows after that lie in the last gap
        full = lane((1 << m) - 1)
        v = np.full(n, full)
        u, t = np.empty_like(v), np.empty_like(v)
        for j in range(m):                                 # v = (v + u) | (v - u); bits above the needle's never come down
            np.bitwise_and(v, masks[j:j + n], out=u)
            np.add(v, u, out=t)
            np.bitwise_xor(v, u, out=v)
            np.bitwise_or(v, t, out=v)
        lcs = np.bitwise_count(np.bitwise_and(np.invert(v, out=v), full, out=v))
        tail = self.kind == self.kinds[needle[-1]]
        counts = (self.kind[:n] == self.kinds[needle[0]]) | tail[m - 1:]
        counts[self.starts] |= tail[self.starts[:, None] + np.arange(m)].any(axis=1)
        lcs *= (counts & self.inside[:n]).view(np.uint8)
        # Windows cut by the end of their text are shorter, so they are scored one by one.
        short = np.arange(1, m)
        cut = self.ends[:, None] - short
        held = cut >= self.starts[:, None]
        cut = np.where(held, cut, 0)
        best = (np.where(held, lcs[cut], 0) * 200.0 / (m + short)).max(axis=1, initial=0.0)
        lcs[cut[held]] = 0
        return np.maximum(best, 200.0 * np.maximum.reduceat(lcs, self.starts) / (m + m))


def partial_ratios(needle: str, texts: list) -> np.ndarray:
    """U4: best similarity (0-100) of ``needle`` with windows of each text.

    100 when contained. Otherwise windows of the needle's length anchored at occurrences of
    its first or last character are compared with the normalised indel similarity
    ``2 * LCS / (len(a) + len(b))``. An empty needle or text scores 0.
    """
    out = np.array([100.0 if needle and needle in t else 0.0 for t in texts])
    rest = [i for i, t in enumerate(texts) if needle and t and out[i] == 0.0]
    if not rest:
        return out
    if len(needle) > 63:                                   # no lane is wide enough
        m = len(needle)
        for i in rest:
            t = texts[i]
            starts = {k for k, ch in enumerate(t) if ch == needle[0]} | {max(0, k - m + 1) for k, ch in enumerate(t) if ch == needle[-1]}
            out[i] = max((200.0 * _lcs_wide(needle, t[s:s + m]) / (m + len(t[s:s + m])) for s in starts), default=0.0)
        return out
    out[rest] = _Lanes([needle], [texts[i] for i in rest]).scores(needle)
    return out


def partial_ratio(needle: str, hay: str) -> float:
    """``partial_ratios`` of one text."""
    return float(partial_ratios(needle, [hay])[0])


#: Texts laid out at once: their lanes stay in the processor's cache.
TEXTS_AT_ONCE = 32


def best_ratios(hints, texts: list) -> np.ndarray:
    """U4: the best ``partial_ratios`` over several hints, per text. Texts are laid out once for all hints."""
    best = np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t]
    narrow = [h for h in dict.fromkeys(hints) if h and len(h) <= _Lanes.GAP]
    for h in dict.fromkeys(hints):
        if len(h) > _Lanes.GAP:
            np.maximum(best, partial_ratios(h, texts), out=best)
    for at in range(0, len(some) if narrow else 0, TEXTS_AT_ONCE):
        part = some[at:at + TEXTS_AT_ONCE]
        lanes = _Lanes(narrow, [texts[i] for i in part])
        best[part] = np.max([best[part], *map(lanes.scores, narrow)], axis=0)
    return best


def fuzzy_scores(hints: list):
    """U4 as a function of three columns: the texts of a row, their numbers, and per list in
    ``hints`` that is wanted a struct (no, misses), the number of the list and those of the
    texts to compare with it. Gives per text the best partial ratio for each list (null where
    it is not wanted). A text wanted for several lists comes once."""
    @pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def scores(texts: pd.Series, numbers: pd.Series, wanted: pd.Series) -> pd.Series:
        out = [None if r is None else [[None] * len(hints) for _ in r] for r in texts]
        groups: dict = {}                                  # lists a text is compared with -> rows of scores, texts
        for row, r, ids, entries in zip(out, texts, numbers, wanted):
            of: dict = {}
            for e in entries if r is not None else ():
                for i in e["misses"]:
                    of.setdefault(i, set()).add(e["no"])
            for scored, text, i in zip(row or (), r if r is not None else (), ids if r is not None else ()):
                groups.setdefault(tuple(sorted(of[i])), []).append((scored, text))
        for ks, places in groups.items():
            for at in range(0, len(places), 256):          # about half a million characters at once
                part = places[at:at + 256]
                low = [t.lower() for _, t in part]
                for k in ks:
                    for (scored, _), best in zip(part, best_ratios(hints[k], low).tolist()):
                        scored[k] = best
        return pd.Series(out)

    return scores


# ------------------------------------------------------------------ C4-C6

def with_requests(docs: DataFrame, fields, policy: P.Policy = P.current(), text_col: str = "text",
                  keep: int | None = None) -> DataFrame:
    """C4-C6 in the row: ``docs`` with the array ``requests`` (field, rank, chunk_start, chunk_text,
    pre_rank, fuzzy), per field the top ``model_top_k_chunks`` chunks.

    Prefilter by keyword score (top ``keep``, stable), then fuzzy re-rank. A chunk with a
    contained hint scores 100. The fuzzy UDF (U4) is handed texts only for fields with
    several chunks, and of them the chunks without a hint; elsewhere the order cannot depend
    on it and the score of such a chunk is 0. With a column ``failing`` (names of fields) only
    these fields of a row are ranked.

    Every chunk is lower-cased once for all fields, and what is sorted and filtered per field
    are numbers of chunks: texts are looked up for the UDF, once per chunk, and for the result.
    """
    words = dict(policy.field_hints)
    hinted = [(f, words[f]) for f in dict.fromkeys(fields) if words.get(f)]
    number = {f: k for k, (f, _) in enumerate(hinted)}
    keep = policy.prefilter_chunks if keep is None else keep
    wanted = "failing" in docs.columns
    chunks = CH.make_chunks(F.col(text_col), policy.chunk_size, policy.chunk_overlap)
    if wanted:
        chunks = F.when(F.size("failing") > 0, chunks)
    none = F.array().cast("array<int>")
    entries = []
    for f in fields:
        if f in number:
            order = F.array_sort(F.transform("_held", lambda x: F.struct((-x[f]).alias("neg"), x["idx"].alias("idx"))))  # noqa: B023
            top = F.transform(F.slice(order, 1, keep), lambda x: F.struct(x["idx"].alias("idx"), (x["neg"] < 0).alias("contained")))
        else:
            top = F.transform("_chunks", lambda c: F.struct(c["idx"].alias("idx"), F.lit(False).alias("contained")))
        entry = F.struct(F.lit(f).alias("field"), F.lit(number.get(f, -1)).alias("no"), top.alias("top"))
        entries.append(F.when(F.array_contains("failing", f), entry) if wanted else entry)

    def with_misses(e):
        rest = F.transform(F.filter(e["top"], lambda c: ~c["contained"]), lambda c: c["idx"])
        return F.struct(e["field"].alias("field"), e["no"].alias("no"), e["top"].alias("top"),
                        F.when((e["no"] >= 0) & (F.size(e["top"]) > 1), rest).otherwise(none).alias("misses"))

    x = docs.withColumn("_chunks", chunks)
    x = x.withColumn("_held", F.when(F.size("_chunks") > 0, CH.hint_scores(F.col("_chunks"), hinted)))
    ranked = F.transform(F.array_compact(F.array(*entries)), with_misses)
    x = x.withColumn("_fields", F.when(F.size("_chunks") > 0, ranked)).drop("_held")
    x = x.withColumn("_asked", F.array_distinct(F.flatten(F.transform("_fields", lambda e: e["misses"]))))
    texts = F.when(F.size("_asked") > 0, F.transform("_asked", lambda i: F.get("_chunks", i)["text"]))
    wanted = F.transform("_fields", lambda e: F.struct(e["no"].alias("no"), e["misses"].alias("misses")))
    x = x.withColumn("_scores", fuzzy_scores([h for _, h in hinted])(texts, F.col("_asked"), wanted))

    def best(e):
        def score(c):
            fuzzy = F.get(F.get("_scores", F.array_position("_asked", c["idx"]).cast("int") - 1), e["no"])
            return F.coalesce(fuzzy, F.when(c["contained"], 100.0).otherwise(0.0))

        order = F.array_sort(F.transform(e["top"], lambda c, k: F.struct(
            (-score(c)).alias("minus"), k.alias("pre_rank"), c["idx"].alias("idx"))))
        return F.transform(F.slice(order, 1, policy.model_top_k_chunks), lambda c, k: F.struct(
            e["field"].alias("field"), (k + 1).alias("rank"), F.get("_chunks", c["idx"])["start"].alias("chunk_start"),
            F.get("_chunks", c["idx"])["text"].alias("chunk_text"), c["pre_rank"].alias("pre_rank"), (-c["minus"]).alias("fuzzy")))

    x = x.withColumn("requests", F.flatten(F.transform("_fields", best)))
    return x.drop("_chunks", "_fields", "_asked", "_scores")


def rank_chunks(docs: DataFrame, fields, policy: P.Policy = P.current(),
                text_col: str = "text", keep: int | None = None) -> DataFrame:
    """The requests of ``with_requests`` as rows. Nothing is shuffled."""
    r = with_requests(docs, fields, policy, text_col, keep).select("doc_id", F.explode_outer("requests").alias("r"))
    # explode_outer: with explode an inferred filter would compute all of this twice
    return r.where("r IS NOT NULL").select("doc_id", "r.field", "r.pre_rank", "r.chunk_start", "r.chunk_text", "r.fuzzy", "r.rank")


def failing_fields(extracted: DataFrame, policy: P.Policy = P.current(), text_col: str = "text") -> DataFrame:
    """``(doc_id, text, failing)``: the fields of every row that fail the confidence gate,
    from the row alone (no join back to the texts). Rows without any are not filtered here:
    the filter would be pushed below the extraction and run all its patterns again."""
    from .extraction import gate_fields

    return extracted.select("doc_id", F.col(text_col).alias("text"), gate_fields(policy).alias("failing"))


# ------------------------------------------------------------------ C7-C9

def call_extractor(requests: DataFrame, extractor_factory: Callable[[], Callable],
                   partitions: int | None = None, limits: CallLimits = CallLimits()) -> DataFrame:
    """What the model returned per request, candidates without text included; a failed call
    gives no row. ``calls.ask`` gives all answers with their status."""
    got = calls.ask(requests, extractor_factory, limits, partitions)
    return got.where((F.col("status") == ANSWERED) | F.col("text").isNotNull()).select(
        "doc_id", "field", "rank", "chunk_start", *CANDIDATE)


def globalize_offsets(cands: DataFrame) -> DataFrame:
    """Offsets below the chunk start are taken as chunk-local."""
    cs = F.col("chunk_start")
    local = (F.col("start") < cs) | (F.col("end") < cs)
    return cands.select(
        *[c for c in cands.columns if c not in ("start", "end")],
        F.when(local, cs + F.greatest(F.lit(0), F.col("start"))).otherwise(F.col("start")).alias("start"),
        F.when(local, cs + F.greatest(F.lit(0), F.col("end"))).otherwise(F.col("end")).alias("end"))


def best_candidate(cands: DataFrame) -> DataFrame:
    """Non-empty text, highest confidence, first ranked chunk on ties."""
    ok = cands.where(F.col("text").isNotNull() & (F.length("text") > 0))
    return ok.groupBy("doc_id", "field").agg(F.max_by(
        F.struct("text", "start", "end", "confidence"),
        F.struct(F.col("confidence"), -F.col("rank"))).alias("best"))


def _global(a, at: str):
    """C8 for one answer: an offset below the chunk start is local."""
    cs = a["chunk_start"]
    local = (a["start"] < cs) | (a["end"] < cs)
    return F.when(local, cs + F.greatest(F.lit(0), a[at])).otherwise(a[at])


def _best_in_row(field: str):
    """C9 in the row: of the field's answers the most confident, the first ranked on ties."""
    mine = F.filter("answers", lambda a: (a["field"] == field) & (a["status"] == ANSWERED))
    best = F.array_max(F.transform(mine, lambda a: F.struct(
        a["confidence"].alias("confidence"), (-a["rank"]).alias("minus"), a["text"].alias("text"),
        _global(a, "start").alias("start"), _global(a, "end").alias("end"))))
    return F.when(F.size("answers") > 0, best)


def _filled(df: DataFrame, best: dict) -> DataFrame:
    """Fields replaced by their best candidate (struct columns), provenance included."""
    cols, added = [], []
    for f, kind in P.SCHEMA_FIELDS:
        b = F.col(best[f])
        if kind == "span":
            val = F.struct(b["text"].alias("text"), b["start"].alias("start"), b["end"].alias("end"),
                           b["confidence"].alias("confidence"), F.lit("llm").alias("source"))
        else:
            val = F.split(b["text"], r"\s*;\s*|\s+and\s+") if kind == "list[text]" else b["text"]
        cols.append(F.when(b.isNotNull(), val).otherwise(F.col(f)).alias(f))
        added.append(F.when(b.isNotNull(), F.struct(F.lit(f), F.struct(F.lit("model").alias("source"), b["confidence"].alias("confidence")))))
    added = F.map_from_entries(F.array_compact(F.array(*added)))
    prov = F.map_concat(F.map_filter("_provenance", lambda k, v: ~F.array_contains(F.map_keys(added), k)), added)
    names = [f for f, _ in P.SCHEMA_FIELDS]
    rest = [c for c in df.columns if c not in (*names, "_provenance", "answers", *best.values())]
    return df.select(*rest, *cols, prov.alias("_provenance"))


def apply_model(extracted: DataFrame, extractor_factory, policy: P.Policy = P.current(),
                partitions: int | None = None, memo: AnswerLog | None = None,
                limits: CallLimits | None = None) -> DataFrame:
    """X10 last step: fields failing the gate take the best model candidate.

    ``extracted`` must carry ``text`` (``extract_fields(..., keep_text=True)``); the result
    does not. Calls run in place, ``policy.model_concurrency`` at a time per task, unless
    ``limits`` says otherwise; ``partitions`` deals the rows to that many tasks first.
    """
    from .extraction import SCHEMA_KEYS, gate_fields

    limits = limits or CallLimits(concurrency=policy.model_concurrency)
    rows = extracted.withColumn("failing", gate_fields(policy))
    rows = with_requests(rows, SCHEMA_KEYS, policy).drop("failing", "text")
    best = {f: f"_best_{f}" for f in SCHEMA_KEYS}
    if memo is None:
        if partitions:
            rows = rows.repartition(partitions)
        rows = calls.ask_in_rows(rows, extractor_factory, limits)
        return _filled(rows.select("*", *[_best_in_row(f).alias(c) for f, c in best.items()]), best)
    rows = materialize(rows, "checkpoint")
    asked = rows.select("doc_id", F.inline("requests"))
    found = best_candidate(globalize_offsets(memo.lookup_or_call(asked, extractor_factory, partitions, limits)))
    found = found.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("best"))).alias(c) for f, c in best.items()])
    return _filled(rows.drop("requests").join(found, "doc_id", "left"), best)


# ------------------------------------------------------------------ stubs

def keyword_stub_extractor():
    """A deterministic stand-in model: the sentence around the first field hint."""
    hints = dict(P.FIELD_HINTS)

    def extract(doc_id, field, chunk_start, chunk_text):
        low = chunk_text.lower()
        hits = [low.find(h) for h in hints.get(field, ()) if h in low]
        if not hits:
            return {"field": field, "text": "", "start": 0, "end": 0, "confidence": 0.0}
        s = min(hits)
        e = low.find(".", s)
        e = len(chunk_text) if e < 0 else e + 1
        return {"field": field, "text": chunk_text[s:e].strip(), "start": s, "end": e, "confidence": 0.5}

    return extract


#: Chunks with these words are refused by the stub below.
REFUSED = "commercially reasonable"


def refusing_stub_extractor():
    """The stub above, as a model that fails on some chunks."""
    inner = keyword_stub_extractor()

    def extract(doc_id, field, chunk_start, chunk_text):
        if REFUSED in chunk_text:
            raise RuntimeError("refused")
        return inner(doc_id, field, chunk_start, chunk_text)

    return extract


# ------------------------------------------------------------------ U2

def apply_recognizer(extracted: DataFrame, recognizer_factory: Callable[[], Callable],
                     policy: P.Policy = P.current()) -> DataFrame:
    """Entity-based fallback for rows whose rules found no parties or law.

    One pass, in place: nothing is shuffled, rows that need no recogniser pass through as
    they are; the recogniser is created once per task.
    Fields it fills have the provenance source ``entity``.
    """
    places, limit, prefix = set(policy.places), policy.max_fallback_parties, policy.place_prefix_chars
    keep = [c for c in extracted.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec = recognizer_factory()
        for b in batches:
            parties, laws = [], []
            for t in b.column("_unread").to_pylist():
                ents = (rec(t[:prefix]) or []) if t is not None else []
                names, seen = [], set()
                for text, label in ents:
                    text = text.strip()
                    if label in ("ORG", "PERSON") and len(text) >= 3 and text not in seen:
                        names.append(text)
                        seen.add(text)
                parties.append(names[:limit] or None)
                laws.append(next((x for x, lab in ents if lab in ("GPE", "LOC") and x in places), None))
            yield pa.record_batch([b.column(c) for c in keep] + [pa.array(parties, pa.list_(pa.string())), pa.array(laws, pa.string())],
                                  names=[*keep, "ent_parties", "ent_law"])

    # All rows pass through once, as Arrow batches; texts only of those that lack a field.
    lacking = F.col("parties").isNull() | F.col("governing_law").isNull()
    rows = extracted.select(*keep, F.when(lacking, F.col("text")).alias("_unread"))
    both = rows.mapInArrow(run, T.StructType(rows.select(*keep).schema.fields).add("ent_parties", T.ArrayType(T.StringType())).add("ent_law", "string"))
    filled = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(c).isNull() & F.col(e).isNotNull(), F.struct(F.lit(c), F.struct(
            F.lit("entity").alias("source"), F.lit(None).cast("double").alias("confidence"))))
        for c, e in (("parties", "ent_parties"), ("governing_law", "ent_law"))])))
    cols = [c for c in keep if c not in ("parties", "governing_law", "_provenance")]
    out = [F.coalesce("parties", "ent_parties").alias("parties"), F.coalesce("governing_law", "ent_law").alias("governing_law")]
    if "_provenance" in keep:
        out.append(F.map_concat(F.map_filter("_provenance", lambda k, v: ~F.array_contains(F.map_keys(filled), k)),
                                filled).alias("_provenance"))
    return both.select(*cols, *out)


def regex_recognizer():
    """Default recogniser: company names with a corporate suffix (ORG) and known places (GPE)."""
    import re

    org = re.compile(X.party_fallback_rx())
    gpe = re.compile(r"\b(" + "|".join(X.places_by_length(P.US_STATES + P.COUNTRIES)) + r")\b")

    def rec(text: str):
        ents = [(m.group(0), "ORG") for m in org.finditer(text)]
        ents += [(m.group(1), "GPE") for m in gpe.finditer(text)]
        return ents

    return rec
