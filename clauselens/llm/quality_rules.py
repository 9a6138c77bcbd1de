"""Operator 2: quality rules with an isolation forest on rule statistics.

Every document yields counts (words, symbols, repeated lines, repeated three-word
windows, upper case, exclamation marks, short words, lines). Two fixed rules reject a
document outright (``base_failed``). For the others shares of these counts go down
the trees of an isolation forest: random splits isolate unusual documents early, so
a short mean path means an anomaly. Repeated lines and windows enter with what their
share exceeds ``USUAL_REPEATS`` by: good documents repeat a few lines too, and raw
shares would make anomalies of them. The forest is fitted on a bounded sample of the
labelled rows (``SAMPLE_ROWS``); the score limit is calibrated on all labelled rows,
aggregated by score, as the limit with the best balanced accuracy.

Edge cases: null or empty texts have no words and fail the base rules; without
labelled rows of both kinds no score limit is set and only the base rules reject;
rows with a null doc_id or label are scored but never used for fitting; repeated
rows give repeated results; other columns are not read (the filter returns them as
they are). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_batches, prepare, shingle_hashes, texts, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled rows that the forest may be fitted on, and the shape of the forest.
SAMPLE_ROWS = 4096
TREES = 100
TREE_ROWS = 256
SEED = 20240229
#: Share of repeated lines or words up to which repetition is nothing unusual: half the base rule's limit.
USUAL_REPEATS = MAX_REPEAT_PERCENT / 200
#: Scores are compared in steps of 1/SCORE_STEPS, so calibration groups are few.
SCORE_STEPS = 2000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_upper", "n_marks", "n_short", "n_lines")
COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
SHARES = ("mean_word", "symbols", "upper", "marks", "short", "excess_lines", "excess_repeats")

_SPACE = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def doc_counts(text: bytes | None) -> tuple:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    words, start, end = hash_words(text)
    n = len(words)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(byte[0x80:0xC0].sum()) - int(byte[_SPACE].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        _, inverse, count = np.unique(shingle_hashes(words, 3), return_inverse=True, return_counts=True)
        at = count[inverse] > 1
        if at.any():
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j:n - 2 + j] |= at
            repeated = int(covered.sum())
    return (n, chars, int(byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated,
            int(byte[0x41:0x5B].sum()), int(byte[0x21]), int(np.count_nonzero(end - start < 4)), len(lines))


def shares(counts: np.ndarray) -> np.ndarray:
    """Counts (rows of ``COUNTS``) as the forest's inputs (columns of ``SHARES``)."""
    c = np.asarray(counts, np.float64).reshape(-1, len(COUNTS))
    words, chars, symbols, dup_lines, repeated, upper, marks, short, lines = c.T
    w, ch = np.maximum(words, 1), np.maximum(chars, 1)
    excess = (np.maximum(x - USUAL_REPEATS, 0) for x in (dup_lines / np.maximum(lines, 1), repeated / w))
    return np.stack([chars / w, symbols / ch, upper / ch, marks / ch, short / w, *excess], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    c = np.asarray(counts, np.int64).reshape(-1, len(COUNTS))
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows (c(n) of the paper)."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits over at most ``TREE_ROWS`` sampled rows each."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.norm = float(max(_mean_path(np.array(size)), 1e-9))
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng):
        """Arrays of a tree: column (-1 at a leaf), split, left child, path length at a leaf."""
        column, split, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, r, depth = todo.pop()
            low, high = r.min(0), r.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(r) <= 1 or not len(wide):
                path[node] = depth + float(_mean_path(np.array(len(r))))
                continue
            c = int(rng.choice(wide))
            s = float(rng.uniform(low[c], high[c]))
            column[node], split[node], left[node] = c, s, len(column)
            for part in (r[r[:, c] <= s], r[r[:, c] > s]):
                todo.append((len(column), part, depth + 1))
                column.append(-1), split.append(0.0), left.append(0), path.append(0.0)
        return np.array(column), np.array(split), np.array(left), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / c(n)): near 1 for anomalies, in steps of 1/SCORE_STEPS."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for column, split, left, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                c = column[node]
                inner = c >= 0
                right = rows[at_row, np.maximum(c, 0)] > split[node]
                node = np.where(inner, left[node] + right, node)
            total += path[node]
        return np.round(2.0 ** (-total / len(self.trees) / self.norm) * SCORE_STEPS) / SCORE_STEPS


def counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, *COUNTS)`` per document row."""

    def run(batches):
        for b in batches:
            rows = [doc_counts(t) for t in texts(b)]
            cols = zip(*rows) if rows else [()] * len(COUNTS)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)],
                                  names=["doc_id", *COUNTS])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(src, run, f"doc_id long, {COUNT_SCHEMA}")


class Model:
    """A fitted forest and its limit; ``forest`` is None without labelled rows."""

    def __init__(self, forest: IsolationForest | None, limit: float):
        self.forest, self.limit = forest, limit

    def judge(self, counts: np.ndarray):
        """(base_failed, score, kept) of rows of ``COUNTS``."""
        bad = base_failed(counts)
        score = self.forest.score(shares(counts)) if self.forest and len(counts) else np.zeros(len(bad))
        return bad, score, ~bad & (score <= self.limit)


def best_limit(groups: list, default: float = 1.0) -> float:
    """The limit with the best balanced accuracy; of equal ones the highest.
    ``groups``: (score, good rows, bad rows), one per distinct score."""
    groups = sorted(groups)
    good, bad = sum(g for _, g, _ in groups), sum(b for _, _, b in groups)
    if not good or not bad:
        return default
    best, at, g, b = -1.0, default, 0, 0
    for i, (s, gg, bb) in enumerate(groups):
        g, b = g + gg, b + bb
        value = g / good + (bad - b) / bad
        if value >= best - 1e-12:
            # half way to the next score: unseen documents fall on the nearer side
            best, at = value, (s + groups[i + 1][0]) / 2 if i + 1 < len(groups) else default
    return at


def fit(counts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows that pass the base rules: forest on a sample, limit on all."""
    spark = counts.sparkSession
    lab = (labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
           .where("l_id IS NOT NULL AND quality IS NOT NULL").distinct())
    rows = counts.where(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    rows = written(rows.join(lab, rows["doc_id"] == lab["l_id"]).select("doc_id", "quality", *COUNTS), "labelled")
    some = (rows.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS)
            .limit(sample_rows).select(*COUNTS).toPandas().to_numpy(np.float64))
    if not len(some):
        return Model(None, 1.0)
    forest = IsolationForest(shares(some))
    shared = spark.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            c = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in COUNTS], 1)
            yield pa.record_batch({"score": pa.array(shared.value.score(shares(c)), pa.float64()),
                                   "quality": b.column("quality")})

    groups = (map_batches(rows.select("quality", *COUNTS), run, "score double, quality int").groupBy("score")
              .agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"),
                   F.sum((F.col("quality") == 0).cast("long")).alias("bad")).collect())   # at most SCORE_STEPS + 1 rows
    return Model(forest, best_limit([(r["score"], r["good"], r["bad"]) for r in groups]))


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, anomaly (the forest's score)."""
    prepare(docs.sparkSession)
    counts = written(counted(docs), "counts")
    shared = docs.sparkSession.sparkContext.broadcast(fit(counts, labels, sample_rows))
    own = COUNTS[:5]

    def run(batches):
        for b in batches:
            c = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in COUNTS], 1)
            bad, score, kept = shared.value.judge(c)
            yield pa.record_batch([b.column("doc_id"), *(b.column(x) for x in own), pa.array(bad), pa.array(kept),
                                   pa.array(score)], names=["doc_id", *own, "base_failed", "kept", "anomaly"])

    return map_batches(counts, run, "doc_id long, " + ", ".join(f"{x} long" for x in own)
                       + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns; the
    counts are taken again on the way instead of shuffling texts to a verdict."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(written(counted(docs), "counts"), labels, sample_rows))

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, _, kept = shared.value.judge(np.array([doc_counts(t) for t in texts(b)], np.int64))
                yield b.filter(pa.array(kept))

    return map_batches(docs, run, docs.schema)
