"""Helpers shared by the operators: Arrow batches in tasks, hashed words, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import apply_defaults, ensure_checkpoint_dir


ROWS_AT_ONCE = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, shipped package and checkpoint folder."""
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    return spark


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a plain function over record batches (one call a task), handed on in
    slices of ``ROWS_AT_ONCE``, so that a worker holds few texts as Python objects at a time."""

    def run(batches):
        return fn(b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, max(1, b.num_rows), ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    """A string column as UTF-8 bytes; null stays ``None``."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ``[^\x20\x09-\x0D]``: the bytes that words of the contracts are made of.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LONG = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_BASE_INVERSE, 1 << 12)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        return cls.up, cls.down


def _hash_part(a: np.ndarray, in_word: np.ndarray):
    n = len(a)
    edge = np.diff(in_word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[a] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h ^ (end - start).astype(np.uint64)), start, end


def hash_words(text: bytes, word_bytes: np.ndarray = NOT_SPACE):
    """(64-bit hash, start, end) of every run of ``word_bytes`` in the text.

    A hash is the word's polynomial over the bytes, taken for all words at once from
    running sums, so it does not depend on the place. Texts over 1 MB are hashed in
    pieces that end between words, which bounds the memory.
    """
    a = np.frombuffer(text, np.uint8)
    in_word = word_bytes[a]
    if len(a) <= _LONG:
        return _hash_part(a, in_word)
    gaps = np.flatnonzero(~in_word)
    parts, at = [], 0
    while at < len(a):
        k = np.searchsorted(gaps, at + _LONG)
        to = int(gaps[k]) + 1 if k < len(gaps) else len(a)
        h, s, e = _hash_part(a[at:to], in_word[at:to])
        parts.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` word hashes; fewer words give one hash of all
    of them, none give an empty array. The order of the words matters."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    out = words[:n - k + 1] + np.uint64(k)
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:n - k + 1 + i]
    return mix64(out)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/clauselens-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage
    and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
