"""Overlapping chunks and keyword ranking as in-row array expressions.

The chunk loop ``i -> j - overlap`` has a closed form, so chunks are built
with ``sequence`` + ``transform`` inside the row - no Python, no shuffle:

    stride = size - overlap if size > overlap else size
    K      = max(0, ceil((n - size) / stride))
    chunk k in 0..K = [k*stride, min(n, k*stride + size))
    plus a tail [n - overlap, n) when overlap > 0 and n - overlap > K*stride.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chunk(text: Column, idx: Column, start: Column, end: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), start.cast("int").alias("start"),
                    end.cast("int").alias("end"),
                    F.substring(text, start + 1, end - start).alias("text"))


def make_chunks(text: Column, size: int = 2000, overlap: int = 150) -> Column:
    """``ARRAY<STRUCT<idx, start, end, text>>`` with global code-point offsets."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    stride = size - overlap if size > overlap else size

    def of(n):                                             # bound once: a length is counted over the whole text
        k_last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(stride))).cast("int")
        body = F.transform(
            F.sequence(F.lit(0), k_last),
            lambda k: _chunk(text, k, k * stride, F.least(n, k * stride + size)),
        )
        tail_start = n - F.lit(overlap)
        has_tail = (F.lit(overlap > 0)) & (tail_start > k_last * stride)
        tail = F.array(_chunk(text, k_last + 1, tail_start, n))
        chunks = F.when(has_tail, F.concat(body, tail)).otherwise(body)
        return F.when(n > 0, chunks).otherwise(
            F.array().cast("array<struct<idx:int,start:int,end:int,text:string>>"))

    return F.get(F.transform(F.array(F.length(text)), of), 0)


def keyword_score(chunk_text: Column, hints) -> Column:
    """Number of distinct hints contained in the lower-cased text."""
    low = F.lower(chunk_text)
    out = F.lit(0)
    for h in dict.fromkeys(hints):
        out = out + F.contains(low, F.lit(h)).cast("int")
    return out


def prefilter_top(chunks: Column, hints, keep: int = 5) -> Column:
    """C4: best ``keep`` chunks by keyword score, stable on ties; all chunks without hints."""
    if not hints:
        return chunks
    scored = F.transform(chunks, lambda c: F.struct(
        (-keyword_score(c["text"], hints)).alias("neg"), c["idx"].alias("idx"), c.alias("c")))
    ranked = F.transform(F.array_sort(scored), lambda x: x["c"].withField(
        "keyword_score", -x["neg"]))
    return F.slice(ranked, 1, keep)


def hint_scores(chunks: Column, hints) -> Column:
    """C2 of all fields at once: per chunk a struct of its index and every field's keyword score.
    Each text is lower-cased once and the result carries no text. Stage it as a column: it
    is read once per field."""
    scores = lambda low: [
        sum((F.contains(low, F.lit(h)).cast("int") for h in dict.fromkeys(words)), F.lit(0)).alias(f) for f, words in hints]
    return F.transform(F.transform(chunks, lambda c: F.lower(c["text"])),
                       lambda low, i: F.struct(i.cast("int").alias("idx"), *scores(low)))


def prefilter_top_all(scores: Column, hints, keep: int = 5) -> Column:
    """C4 of all fields from ``hint_scores``: ``ARRAY<STRUCT<field, rank, idx, score>>``, per field
    the best ``keep`` chunks, stable on ties."""
    tops = []
    for f, _ in hints:
        order = F.array_sort(F.transform(scores, lambda x: F.struct((-x[f]).alias("neg"), x["idx"].alias("idx"))))
        tops.append(F.transform(F.slice(order, 1, keep), lambda x, r: F.struct(
            F.lit(f).alias("field"), (r + 1).alias("rank"), x["idx"].alias("idx"), (-x["neg"]).alias("score"))))
    return F.flatten(F.array(*tops))


def hint_contained(chunk_text: Column, hints) -> Column:
    """True when any hint is a substring (partial ratio is then 100)."""
    low = F.lower(chunk_text)
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(low, F.lit(h))
    return out
