"""Operator 12: fill-in-middle transformation over a wavelet matrix of character classes.

A text is a sequence of units: runs of ``[A-Za-z]`` and single other characters. Every
byte of its UTF-8 form gets one of four classes: continuation byte, letter inside a run,
first letter of a run, other character. A wavelet matrix over the classes answers
``rank(class, i)`` in constant time, so

* units up to byte ``i``      = rank(first letter, i) + rank(other, i),
* code points up to byte ``i`` = i - rank(continuation, i),
* the byte where unit ``u`` starts is found by bisection on the first sum.

The two cuts of a document come from the SHA-256 of its id, so a rerun cuts alike.
Texts go through Arrow batches one by one; the matrix takes about half of a text's size.

Edge cases: a null text counts as empty, an empty text is ``plain`` with 0 units; texts
that contain a marker stay plain; a null doc_id is hashed as an empty one; repeated rows
give repeated rows; bytes that are no letters are single units per code point, NUL too.
Only ``doc_id`` and ``text`` are read, further columns have no effect.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: texts that are transformed at all, and of them those in suffix-prefix-middle order.
TRANSFORMED, SUFFIX_FIRST = 90, 20
CONTINUATION, INNER, FIRST, OTHER = range(4)

_BYTES = np.arange(256)
_IS_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_PLAIN_CLASS = np.where(_IS_LETTER, FIRST, np.where((_BYTES & 0xC0) == 0x80, CONTINUATION, OTHER)).astype(np.uint8)


class BitVector:
    """Packed bits with running counts per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        inside = int(self.words[w]) & ((1 << (i & 63)) - 1)
        return int(self.before[w]) + inside.bit_count()


class WaveletMatrix:
    """Rank over a sequence of symbols below ``2 ** bits``.

    Level by level (highest bit first) the symbols are dealt stably by that bit, zeros in
    front; a rank query follows its symbol's bits down the levels.
    """

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.n, self.bits, self.levels, self.zeros, self.from_ = len(symbols), bits, [], [], {}
        for b in reversed(range(bits)):
            bit = (symbols >> b & 1).astype(bool)
            level = BitVector(bit)
            self.levels.append(level)
            self.zeros.append(self.n - level.rank1(self.n))
            if b:
                symbols = np.concatenate([symbols[~bit], symbols[bit]])
        for s in range(1 << bits):                     # where each symbol's run starts on the last level
            self.from_[s] = self._down(s, 0)

    def _down(self, symbol: int, i: int) -> int:
        for k, level in enumerate(self.levels):
            ones = level.rank1(i)
            i = self.zeros[k] + ones if symbol >> (self.bits - 1 - k) & 1 else i - ones
        return i

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` among the first ``i`` symbols."""
        return self._down(symbol, i) - self.from_[symbol]


class Units:
    """Unit boundaries and code points of one text."""

    def __init__(self, text: bytes):
        classes = _PLAIN_CLASS[np.frombuffer(text, np.uint8)]
        letter = classes == FIRST
        classes[1:][letter[1:] & letter[:-1]] = INNER
        self.matrix = WaveletMatrix(classes)
        self.size = len(text)
        self.n = self.boundaries(self.size)

    def boundaries(self, i: int) -> int:
        """Units that start before byte ``i``."""
        return self.matrix.rank(FIRST, i) + self.matrix.rank(OTHER, i)

    def points(self, i: int) -> int:
        """Code points that start before byte ``i``."""
        return i - self.matrix.rank(CONTINUATION, i)

    def cut_after(self, units: int) -> int:
        """The byte where the first ``units`` units end: the largest i with at most that many
        boundaries before it."""
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.boundaries(mid) <= units else (lo, mid - 1)
        return lo


def draws(doc_id: int | None, seed: str = "1") -> list:
    """The first four 32-bit numbers of SHA-256 of ``seed:doc_id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i:i + 4], "big") for i in range(0, 16, 4)]


def split(text: bytes, doc_id: int | None, seed: str = "1") -> tuple:
    """(units, form, prefix code points, middle code points, output) of one text."""
    if not text:
        return 0, "plain", None, None, b""
    units = Units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if p in text or s in text or m in text or h3 % 100 >= TRANSFORMED:
        return units.n, "plain", None, None, text
    one, two = (units.cut_after(x) for x in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    chars = units.points(one)
    if h4 % 100 < SUFFIX_FIRST:
        return units.n, "spm", chars, units.points(two) - chars, s + suffix + p + prefix + m + middle
    return units.n, "psm", chars, units.points(two) - chars, p + prefix + s + suffix + m + middle


def transform(docs: DataFrame, seed: str = "1") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` per document row."""

    def run(batches):
        for b in batches:
            rows = [split(t or b"", i, seed) for t, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist())]
            n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                                   pa.array(middle, pa.int64()), pa.array(out, pa.binary())],
                                  names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    # Texts travel as bytes, so that none is decoded on the way.
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    done = map_batches(src, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``output`` was made of, from output and form alone. A marker cannot
    begin inside another, and texts with a marker stay plain, so each occurs once."""
    o = F.col(output)
    first = F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    k, at, mid = len(PREFIX), F.instr(o, first), F.instr(o, F.lit(MIDDLE))
    a = F.substr(o, F.lit(k + 1), at - (k + 1))                 # before the second marker
    b = F.substr(o, at + k, mid - at - k)                        # between second and third
    middle = F.substr(o, mid + k)
    return (F.when(F.col(form) == "psm", F.concat(a, middle, b))
            .when(F.col(form) == "spm", F.concat(b, middle, a)).otherwise(o))


def digests(transformed: DataFrame) -> DataFrame:
    """The operator's rows with SHA-256 digests of output and restored text in place of the output."""
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                              F.sha2(F.col("output"), 256).alias("output_sha256"),
                              F.sha2(restored(), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of ``digests(transform(documents))``."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
      regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
g AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT doc_id, n, form, text, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid,
      array_to_string(list_slice(u, b + 1, n), '') AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN output ELSE pre || mid || suf END) AS restored_sha256 FROM o"""
