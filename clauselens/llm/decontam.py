"""Operator 7: benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ten consecutive words (an item of fewer
words is one window). A window is a set of word shingles; all of them must occur
(containment 1), so its prefix is one shingle, the rarest. Rarity is counted over
all documents. Documents probe that prefix index, the position of the shingle
fixes where the window would start, windows that would leave the document are
dropped by the length bound, and the words of the rest are compared one by one.

The benchmark side is shipped to the tasks in blocks of at most ``block_pairs``
(window, item) pairs, dealt by hash; every block is held against every document,
so the size of the benchmark bounds neither memory nor the result.

Edge cases: a null or empty text has no words (n_words 0, not contaminated); a
benchmark item without words has no window; an item with a null id marks words as
hit but is not counted or listed; repeated rows give repeated results; an empty
benchmark hits nothing. Only the id and text columns are read, so further
columns, whatever their names, have no effect.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, texts, written

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: (window, item) pairs in one block: about 200 bytes each, so 100 MB a task.
BLOCK_PAIRS = 500_000

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256))


def words_of(text: bytes | None) -> list:
    return text.translate(TO_WORDS).split() if text else []


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW_WORDS) -> DataFrame:
    """``(item, win)``: the distinct windows of every item, words joined by a space."""
    src = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def cut(batches):
        for b in batches:
            items, wins = [], []
            for item, t in zip(b.column("item").to_pylist(), texts(b)):
                w = words_of(t)
                if w:
                    own = {b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))}
                    items += [item] * len(own)
                    wins += own
            yield pa.record_batch({"item": pa.array(items, pa.string()),
                                   "win": pa.array(wins, pa.binary()).cast(pa.string())})

    return map_batches(src, cut, "item string, win string").distinct()


class Block:
    """The words, shingles and windows of one block, as arrays for the tasks."""

    def __init__(self, rows, shingle: int = SHINGLE_WORDS):
        by_win: dict = {}
        for r in rows:
            by_win.setdefault(r["win"], []).append(r["item"])
        wins = sorted(by_win)
        split = [w.encode().split(b" ") for w in wins]
        self.vocab = {w: i for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.items = [[i for i in by_win[w] if i is not None] for w in wins]
        self.lens = np.array([len(s) for s in split], np.int64)
        self.words = np.full((len(wins), max(self.lens, default=1)), -1, np.int32)
        for i, s in enumerate(split):
            self.words[i, :len(s)] = [self.vocab[w] for w in s]
        self.k = np.minimum(self.lens, shingle)
        # (code, window, offset) of every shingle of every window
        cw, co, cc = [], [], []
        for k in sorted(set(self.k.tolist())):
            own = np.flatnonzero(self.k == k)
            for off in range(self.words.shape[1] - k + 1):
                has = own[self.lens[own] >= off + k]
                cw.append(has), co.append(np.full(len(has), off)), cc.append(self._codes(self.words[has], off, k))
        self.win, self.off = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (cw, co))
        code = np.concatenate(cc) if cc else np.zeros(0, np.uint64)
        self.codes, self.code_of = np.unique(code, return_inverse=True)

    @staticmethod
    def _codes(words: np.ndarray, off: int, k: int) -> np.ndarray:
        """Words ``off .. off+k-1`` of each row as one number; a collision only costs a comparison."""
        c = np.full(len(words), k, np.uint64)
        for j in range(off, off + k):
            c = c * np.uint64(0x9E3779B97F4A7C15) + words[:, j].astype(np.int64).astype(np.uint64) + np.uint64(1)
            c ^= c >> np.uint64(29)
        return c

    def doc_words(self, words: list) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def doc_shingles(self, ids: np.ndarray):
        """(position, index of code) of the document's shingles that the block knows."""
        pos, idx = [], []
        known = ids >= 0
        for k in sorted(set(self.k.tolist())):
            if len(ids) < k:
                continue
            at = known[:len(ids) - k + 1].copy()
            for j in range(1, k):
                at &= known[j:len(ids) - k + 1 + j]
            p = np.flatnonzero(at)
            if len(p):
                rows = ids[p[:, None] + np.arange(k)]
                c = self._codes(rows, 0, k)
                i = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
                ok = self.codes[i] == c
                pos.append(p[ok]), idx.append(i[ok])
        if not pos:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(pos), np.concatenate(idx)

    def choose_prefix(self, counts: np.ndarray) -> None:
        """Keep of each window the rarest shingle (then the smallest code, then the first)."""
        order = np.lexsort((self.off, self.code_of, counts[self.code_of], self.win))
        first = np.ones(len(order), bool)
        first[1:] = self.win[order][1:] != self.win[order][:-1]
        keep = order[first]
        keep = keep[np.argsort(self.code_of[keep], kind="stable")]
        self.p_code, self.p_win, self.p_off = self.code_of[keep], self.win[keep], self.off[keep]
        self.codes, self.p_code = self.codes[np.unique(self.p_code)], np.unique(self.p_code, return_inverse=True)[1]
        self.p_from = np.searchsorted(self.p_code, np.arange(len(self.codes) + 1))
        del self.win, self.off, self.code_of

    def matches(self, ids: np.ndarray, at_once: int = 200_000):
        """(start, window) of every window that occurs in the document."""
        pos, code = self.doc_shingles(ids)
        starts, wins = [], []
        many = self.p_from[code + 1] - self.p_from[code] if len(code) else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(many) // at_once, prepend=0))
        for part in np.split(np.arange(len(pos)), cut):
            n = many[part]
            if not n.sum():
                continue
            which = np.repeat(part, n)
            probe = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.p_from[code[part]], n)
            w = self.p_win[probe]
            s = pos[which] - self.p_off[probe]
            ok = (s >= 0) & (s + self.lens[w] <= len(ids))       # length and positional bounds
            s, w = s[ok], w[ok]
            for j in range(self.words.shape[1]):                  # exact containment, word by word
                want = self.words[w, j]
                ok = (want < 0) | (ids[np.minimum(s + j, len(ids) - 1)] == want)
                s, w = s[ok], w[ok]
            starts.append(s), wins.append(w)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(wins)


def merged_spans(start: np.ndarray, end: np.ndarray):
    """Union of half-open intervals as disjoint ones, in order."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:] - 1, len(e) - 1)]


def _rarity(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of the block occurs in all documents."""
    if not len(block.codes):
        return np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        bl = shared.value
        total = np.zeros(len(bl.codes), np.int64)
        for b in batches:
            for t in texts(b):
                _, i = bl.doc_shingles(bl.doc_words(words_of(t)))
                np.add.at(total, i, 1)
        has = np.flatnonzero(total)
        yield pa.record_batch({"shingle": pa.array(has, pa.int64()), "n": pa.array(total[has], pa.int64())})

    rows = (map_batches(docs.select("text"), count, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).toPandas())   # at most one row a shingle of the block
    out = np.zeros(len(block.codes), np.int64)
    out[rows["shingle"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


class PrefixBlocks:
    """The blocks of a benchmark, one at a time, with their prefixes chosen."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, block_pairs: int):
        self.docs = docs
        self.wins = written(item_windows(benchmark, window=window), "windows")
        self.n = max(1, -(-self.wins.count() // block_pairs))

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        for i in range(self.n):
            block = Block(self.wins.where(F.pmod(F.xxhash64("win", "item"), F.lit(self.n)) == i).toLocalIterator())
            block.choose_prefix(_rarity(self.docs, block))
            yield block


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
          block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per document row ``(doc_id, n_words, starts, ends, items)``: disjoint hit word
    spans and the ids of the items with an occurring window."""
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    blocks = PrefixBlocks(docs, benchmark, window, block_pairs)
    n_blocks = len(blocks)
    schema = "doc_id long, digest binary, n_words long, starts array<long>, ends array<long>, items array<string>"
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            bl = shared.value
            for b in batches:
                cols: list = [[], [], [], [], []]
                for t in texts(b):
                    words = words_of(t)
                    s, w = bl.matches(bl.doc_words(words)) if len(bl.codes) else (np.zeros(0, np.int64),) * 2
                    first, last = merged_spans(s, s + bl.lens[w])
                    items = sorted({x for k in np.unique(w) for x in bl.items[k]})
                    digest = hashlib.blake2b(t or b"", digest_size=16).digest() if n_blocks > 1 else None
                    for c, v in zip(cols, (digest, len(words), first.tolist(), last.tolist(), items)):
                        c.append(v)
                yield pa.record_batch([b.column("doc_id"), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64())),
                                       pa.array(cols[4], pa.list_(pa.string()))],
                                      names=["doc_id", "digest", "n_words", "starts", "ends", "items"])

        parts.append(map_batches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), find, schema))
    if n_blocks == 1:
        return parts[0].drop("digest")
    # Equal (doc_id, text) rows have equal results, so what the blocks found is merged per such row.
    found = None
    for p in parts:
        p = p.where(F.size("starts") > 0).select("doc_id", "digest", "starts", "ends", "items").distinct()
        found = p if found is None else found.unionByName(p)
    found = found.groupBy("doc_id", "digest").agg(
        F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches):
        for b in batches:
            s, e = zip(*(merged_spans(np.array(x), np.array(y)) for x, y in
                         zip(b.column("s").to_pylist(), b.column("e").to_pylist()))) if b.num_rows else ((), ())
            yield pa.record_batch([b.column("doc_id"), b.column("digest"), pa.array([x.tolist() for x in s], pa.list_(pa.int64())),
                                   pa.array([x.tolist() for x in e], pa.list_(pa.int64())), b.column("items")],
                                  names=["doc_id", "digest", "starts", "ends", "items"])

    found = map_batches(found, merge, "doc_id long, digest binary, starts array<long>, ends array<long>, items array<string>")
    base = parts[0].select("doc_id", "digest", "n_words").alias("b")
    found = found.alias("f")
    none = F.array()
    return base.join(found, F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.digest") == F.col("f.digest")),
                     "left").select("b.doc_id", "n_words",
                                    F.coalesce("starts", none.cast("array<long>")).alias("starts"),
                                    F.coalesce("ends", none.cast("array<long>")).alias("ends"),
                                    F.coalesce("items", none.cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
                  block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = spans(docs, benchmark, window, block_pairs)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return s.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                    (F.size("starts") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
                      block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The rows of ``docs`` without any window of a benchmark item, all columns. One
    narrow pass per block of the benchmark; texts are not shuffled."""
    prepare(docs.sparkSession)
    for block in PrefixBlocks(docs.select("text"), benchmark, window, block_pairs):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            bl = shared.value
            for b in batches:
                yield b.filter(pa.array([not len(bl.matches(bl.doc_words(words_of(t)))[0]) for t in texts(b)], pa.bool_()))

        if len(block.codes):
            docs = map_batches(docs, clean, docs.schema)
    return docs
