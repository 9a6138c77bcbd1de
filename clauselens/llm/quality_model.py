"""Operator 9: quality classifier from weak labels.

Heuristic labellers vote on every document or abstain, from its counts and shares
(symbols, upper case, exclamation marks, repeated passages, variety, function words,
sentence ends). The votes overlap; a generative model with one table of vote
probabilities per labeller and class is fitted by expectation-maximisation on the
vote patterns of all documents, counted by pattern (at most 3 ** labellers groups).
Its posterior labels train a linear scorer on hashed features (whole words, word-edge
shapes and repetition levels, ``DIMENSIONS`` buckets) by logistic regression on a
bounded sample of distinct texts (the ``SAMPLE_ROWS`` smallest text hashes, each text
once, however many copies it has); every document is then scored on its whole text.

No label of the ``labels`` table is used; tests hold the result against them.

Edge cases: null and empty texts have score 0 and posterior 0 and are not kept;
repeated rows give repeated results; without documents nothing is fitted and the
result is empty; if all documents share one vote pattern the scorer keeps the
posterior's side. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_batches, mix64, prepare, shingle_hashes, texts

DIMENSIONS = 1 << 16
SAMPLE_ROWS = 6000
EPOCHS = 150
RATE = 0.5
PENALTY = 1e-5
WINDOW_WORDS = 200
EM_ROUNDS = 200
ABSTAIN, BAD, GOOD = 0, 1, 2

_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_IS_SYMBOL = np.isin(np.arange(256), _SYMBOLS)
#: Shape of a byte: upper case, lower case or beyond ASCII, digit, or itself.
_SHAPE = bytes(0x58 if 0x41 <= c <= 0x5A else 0x78 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x39 if 0x30 <= c <= 0x39
               else c for c in range(256))


def variety(words: np.ndarray) -> float:
    """Mean share of distinct words over all consecutive windows of ``WINDOW_WORDS``
    words; what is left at the end counts with the words before it as a full window.
    Variety falls with length, so it is taken of as many words everywhere."""
    n = len(words)
    if n <= WINDOW_WORDS:
        return len(np.unique(words)) / n
    parts = words[:n // WINDOW_WORDS * WINDOW_WORDS].reshape(-1, WINDOW_WORDS)
    if n % WINDOW_WORDS:
        parts = np.concatenate([parts, words[None, -WINDOW_WORDS:]])
    parts = np.sort(parts, 1)
    return float((1 + (parts[:, 1:] != parts[:, :-1]).sum(1)).mean() / WINDOW_WORDS)


class Text:
    """What the labellers and the features need of one text."""

    __slots__ = ("words", "start", "end", "raw", "n", "symbols", "upper", "marks", "decorated", "capitals", "stops",
                 "function", "repeated", "variety")

    def __init__(self, text: bytes):
        self.raw = text
        self.words, self.start, self.end = hash_words(text)
        n = self.n = len(self.words)
        self.symbols = self.upper = self.marks = self.decorated = self.capitals = self.stops = 0.0
        self.function = self.repeated = self.variety = 0.0
        if not n:
            return
        byte = np.frombuffer(text, np.uint8)
        count = np.bincount(byte, minlength=256)
        size = self.end - self.start
        letters = int(size.sum())
        self.symbols = count[_SYMBOLS].sum() / letters
        self.upper = count[0x41:0x5B].sum() / letters
        self.marks = count[0x21] / letters
        last, second = byte[self.end - 1], byte[np.minimum(self.start + 1, self.end - 1)]
        self.decorated = float(_IS_SYMBOL[last].mean())
        self.capitals = float(((second >= 0x41) & (second <= 0x5A) & (size > 1)).mean())
        self.stops = float((last == 0x2E).mean())
        self.function = float((size < 4).mean())
        if n >= 3:
            _, inverse, count = np.unique(shingle_hashes(self.words, 3), return_inverse=True, return_counts=True)
            self.repeated = float((count[inverse] > 1).mean())
        self.variety = variety(self.words)


#: Labellers: name -> (vote, condition). Each votes one way or abstains.
LABELLERS = {
    "many symbols": (BAD, lambda t: t.symbols > 0.05),
    "decorated words": (BAD, lambda t: t.decorated > 0.15),
    "upper case": (BAD, lambda t: t.upper > 0.3),
    "capital words": (BAD, lambda t: t.capitals > 0.3),
    "exclamations": (BAD, lambda t: t.marks > 0.05),
    "repeated passages": (BAD, lambda t: t.repeated > 0.5),
    "little variety": (BAD, lambda t: t.n >= 20 and t.variety < 0.2),
    "short words": (BAD, lambda t: t.n >= 20 and t.function > 0.42),
    "prose": (GOOD, lambda t: 0.15 <= t.function <= 0.42 and t.symbols < 0.02 and t.upper < 0.1),
    "sentences": (GOOD, lambda t: 0.02 <= t.stops and (t.stops <= 0.3 or t.n < 10) and t.repeated < 0.4 and t.decorated < 0.1),
}


def votes(t: Text) -> int:
    """The votes of all labellers as one base-3 number."""
    code = 0
    for vote, holds in LABELLERS.values():
        code = code * 3 + (vote if holds(t) else ABSTAIN)
    return code


def unpack(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


class LabelModel:
    """Class prior and vote probabilities of the labellers, fitted by EM."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS):
        v, k = unpack(patterns), len(LABELLERS)
        self.table = np.full((k, 2, 3), 1.0)                 # [labeller, class, vote]
        # Start: the majority of the votes cast.
        p = 0.5 + 0.4 * np.sign((v == GOOD).sum(1) - (v == BAD).sum(1))
        self.prior = before = 0.5
        for _ in range(rounds):
            self.prior = float(np.clip((counts * p).sum() / counts.sum(), 1e-4, 1 - 1e-4))
            for c, w in ((0, counts * (1 - p)), (1, counts * p)):
                for vote in range(3):
                    self.table[:, c, vote] = ((v == vote) * w[:, None]).sum(0) + 0.1
            self.table /= self.table.sum(2, keepdims=True)
            p = self._posterior(v)
            if abs(before - self.prior) < 1e-9:
                break
            before = self.prior

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.table)[np.arange(v.shape[1])[None, :], :, v].sum(1)
        d = log[:, 1] - log[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(d, -50, 50)))

    def posterior(self, codes) -> np.ndarray:
        """Probability of good for vote patterns."""
        return self._posterior(unpack(np.asarray(codes)))

    def accuracy(self) -> dict:
        """Per labeller the probability that a vote it casts is right."""
        out = {}
        for i, name in enumerate(LABELLERS):
            right = self.prior * self.table[i, 1, GOOD] + (1 - self.prior) * self.table[i, 0, BAD]
            wrong = self.prior * self.table[i, 1, BAD] + (1 - self.prior) * self.table[i, 0, GOOD]
            out[name] = float(right / (right + wrong))
        return out


def features(t: Text):
    """(bucket, value) of the hashed features: relative frequencies of words and of
    word-edge shapes (first two and last two characters' shapes), and the level of
    repetition."""
    if not t.n:
        return np.zeros(0, np.int64), np.zeros(0)
    shape = np.frombuffer(t.raw.translate(_SHAPE), np.uint8).astype(np.uint64)
    last = t.end - 1
    edge = (shape[t.start] | shape[np.minimum(t.start + 1, last)] << np.uint64(8)
            | shape[np.maximum(last - 1, t.start)] << np.uint64(16) | shape[last] << np.uint64(24))
    level = np.array([int(t.repeated * 10), 16 + int(t.variety * 10)], np.uint64) + np.uint64(1 << 40)
    h = np.concatenate([t.words, mix64(edge + np.uint64(1 << 48)), mix64(level)])
    weight = np.concatenate([np.full(2 * t.n, 1 / t.n), np.ones(2)])
    bucket, inverse = np.unique((h & np.uint64(DIMENSIONS - 1)).astype(np.int64), return_inverse=True)
    return bucket, np.sqrt(np.bincount(inverse, weight))


class Scorer:
    """Logistic regression on hashed features against soft labels."""

    def __init__(self, rows: list, target: np.ndarray):
        size = np.array([len(b) for b, _ in rows])
        row = np.repeat(np.arange(len(rows)), size)
        col = np.concatenate([b for b, _ in rows]) if rows else np.zeros(0, np.int64)
        val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        # Both classes weigh the same.
        good = max(float(target.sum()), 1e-9)
        weight = target / good + (1 - target) / max(len(target) - good, 1e-9)
        self.w, self.b = np.zeros(DIMENSIONS), 0.0
        g2, b2 = np.full(DIMENSIONS, 1e-8), 1e-8
        for _ in range(EPOCHS if len(rows) else 0):
            z = np.bincount(row, val * self.w[col], minlength=len(rows)) + self.b
            err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weight
            g = np.bincount(col, val * err[row], minlength=DIMENSIONS) + PENALTY * self.w
            g2 += g * g
            b2 += err.sum() ** 2
            self.w -= RATE * g / np.sqrt(g2)
            self.b -= RATE * err.sum() / np.sqrt(b2)

    def score(self, t: Text) -> float:
        bucket, value = features(t)
        return float(1 / (1 + np.exp(-np.clip((self.w[bucket] * value).sum() + self.b, -50, 50))))


def sampled(docs: DataFrame, sample_rows: int) -> DataFrame:
    """``(h, text)``: the rows whose text is among the ``sample_rows`` distinct non-empty
    texts with the smallest hashes, the same ones on every run. Copies do not move the
    bound, and with a non-empty text the sample is not empty."""
    hashed = docs.where("length(text) > 0").select(F.xxhash64("text").alias("h"), "text")
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample_rows)
    return hashed.join(F.broadcast(chosen), "h", "left_semi")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(LabelModel, Scorer); (None, None) without a document."""

    def vote(batches):
        for b in batches:
            codes = [votes(Text(t)) for t in texts(b) if t]
            c, n = np.unique(np.array(codes, np.int64), return_counts=True)
            yield pa.record_batch({"pattern": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64())})

    seen = (map_batches(docs.select("text"), vote, "pattern long, n long").groupBy("pattern")
            .agg(F.sum("n").alias("n")).orderBy("pattern").collect())          # at most 3 ** labellers rows
    total = sum(r["n"] for r in seen)
    if not total:
        return None, None
    model = LabelModel(np.array([r["pattern"] for r in seen]), np.array([r["n"] for r in seen], np.float64))

    some = sampled(docs, sample_rows)

    def sample(batches):
        seen = set()                            # at most sample_rows hashes: a task passes each text on once
        for b in batches:
            out = []
            for h, t in zip(b.column("h").to_pylist(), texts(b)):
                if h in seen:
                    continue
                seen.add(h)
                x = Text(t)
                bucket, value = features(x)
                out.append((h, votes(x), bucket.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            cols = zip(*out) if out else ((),) * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                  names=["h", "pattern", "bucket", "value"])

    rows = (map_batches(some, sample, "h long, pattern long, bucket binary, value binary")
            .dropDuplicates(["h"]).drop("h").toPandas())                       # at most sample_rows rows
    rows = rows.sort_values(["pattern", "bucket", "value"])
    data = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64))
            for b, v in zip(rows["bucket"], rows["value"])]
    return model, Scorer(data, model.posterior(rows["pattern"].to_numpy(np.int64)) if len(rows) else np.zeros(0))


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document row: doc_id, posterior (of its votes), score (of the scorer), kept
    (score of at least one half)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, sample_rows))

    def run(batches):
        model, scorer = shared.value
        for b in batches:
            text = [Text(t) if t else None for t in texts(b)]
            codes = [0 if t is None else votes(t) for t in text]
            p = model.posterior(codes) if model and codes else np.zeros(len(codes))
            p = np.where([t is None for t in text], 0.0, p)
            s = np.array([scorer.score(t) if t and scorer else 0.0 for t in text])
            yield pa.record_batch([b.column("doc_id"), pa.array(np.round(p, 6), pa.float64()),
                                   pa.array(np.round(s, 6), pa.float64()), pa.array(s >= 0.5)],
                                  names=["doc_id", "posterior", "score", "kept"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                       "doc_id long, posterior double, score double, kept boolean")
