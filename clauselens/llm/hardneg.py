"""Operator 13: hard-negative mining with an inverted multi-index.

Vectors are scaled to integers, ``floor(scale * x)``, and cut in two halves. A codebook
per half (k-means) gives every vector a cell (code of the first half, code of the
second). Rows are stored in cell order; a task reads them in chunks of bounded size, and
every chunk is an inverted multi-index of its own: a list per cell and, per half and
code, the largest distance of its rows from the centre (the radius).

For a query, half-score bounds ``a.centre + |a| * radius`` of both halves are sorted, and a
heap visits the cells by falling sum of the two (multi-sequence). The sum bounds every
score in the cell, so a search ends, exactly, as soon as the next sum cannot change the
result:

* positives: below the score of the worst of the first ``positives`` rows of the same label;
* negatives: for every window (share of a positive's score), below its lower end, or
  below the worst of its first ``negatives`` rows. Cells whose rows all score above every
  open window are passed over unscored.

Queries go to the tasks in blocks of about ``BLOCK_QUERIES`` (a stated query set against
all rows); a task returns the first few per query, and windows over these few merge
them. The result is exact, recall 1; the codebooks only decide how much is scored. They
are fitted on a bounded sample (``SAMPLE_ROWS`` rows, ``SAMPLE_VALUES`` numbers), the
rows with the smallest id hashes; every row is indexed.

Edge cases: rows with a null id, label or vector, or a null or non-finite component
(also after scaling) take no part; rows that share an id are one row, the least by
(label, vector); shorter vectors count as filled up with zeros; ties go to the smaller
id; an anchor without positives, or a window without rows, gives no rows; scores are exact
integers, and those beyond the range of a long are returned as its ends. Further columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, prepare, scratch_path, written

SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 1 << 21
CODES = 16
CHUNK_ROWS = 32_768
BLOCK_QUERIES = 4_096
#: Rows scored at once before the search looks again whether it may stop.
STEP_ROWS = 1_024
_LONG = (1 << 63) - 1


# ------------------------------------------------------------------ codebooks

def codebook(x: np.ndarray, codes: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means centres of the rows of ``x``; fewer if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= codes:
        return distinct if len(distinct) else np.zeros((1, x.shape[1]))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), codes, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=codes)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a float64 matrix; short rows are filled up with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    n = np.asarray(column.value_lengths(), np.int64)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def scores(x: np.ndarray, a: np.ndarray, small: bool) -> np.ndarray:
    """Exact integer inner products of the rows with ``a``."""
    if small:                                            # every sum stays below 2**53
        return (x @ a).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape) @ np.array([int(v) for v in a], object)
    return np.array([max(-_LONG - 1, min(_LONG, int(v))) for v in np.atleast_1d(exact)], np.int64)


# ------------------------------------------------------------------ one chunk

class MultiIndex:
    """Cells of one chunk of rows."""

    def __init__(self, ids, labels, x, codes1, codes2, centres1, centres2):
        order = np.lexsort((ids, codes2, codes1))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        c1, c2 = codes1[order], codes2[order]
        self.half = x.shape[1] // 2
        self.lists = []                                   # per half: codes in use, their centres, their radii
        for c, centres, cols in ((c1, centres1, slice(None, self.half)), (c2, centres2, slice(self.half, None))):
            far = np.sqrt(((self.x[:, cols] - centres[c]) ** 2).sum(1))
            radius = np.full(len(centres), -1.0)
            np.maximum.at(radius, c, far)
            used = np.flatnonzero(radius >= 0)
            self.lists.append((used, centres[used], radius[used] * (1 + 1e-9) + 1e-6))
        cell = c1.astype(np.int64) * len(centres2) + c2
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        ends = np.append(first[1:], len(cell))
        self.cells = {(int(c1[s]), int(c2[s])): (int(s), int(e)) for s, e in zip(first, ends)}
        self.norm = float(np.sqrt((self.x ** 2).sum(1)).max(initial=0.0))

    def visit(self, a: np.ndarray) -> Iterator[tuple]:
        """(upper bound, lower bound, start, end) of the cells by falling upper bound."""
        halves = []
        for (used, centres, radius), part in zip(self.lists, (a[:self.half], a[self.half:])):
            mid, wide = centres @ part, np.sqrt(part @ part) * radius
            order = np.argsort(-(mid + wide), kind="stable")
            halves.append((used[order].tolist(), (mid + wide)[order].tolist(), (mid - wide)[order].tolist()))
        (u1, hi1, lo1), (u2, hi2, lo2) = halves
        slack = 1e-9 * self.norm * float(np.sqrt(a @ a)) + 1e-3
        heap = [(-(hi1[0] + hi2[0]), 0, 0)]
        while heap:
            top, i, j = heapq.heappop(heap)
            if j + 1 < len(u2):
                heapq.heappush(heap, (-(hi1[i] + hi2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u1):
                heapq.heappush(heap, (-(hi1[i + 1] + hi2[0]), i + 1, 0))
            at = self.cells.get((u1[i], u2[j]))
            if at:
                yield -top + slack, lo1[i] + lo2[j] - slack, *at

    def search(self, a: np.ndarray, goal: "Goal", small: bool) -> int:
        """Offers the rows to ``goal`` until no cell left can change it; returns rows scored."""
        ids, got, n, scored = [], [], 0, 0

        def offer():
            nonlocal ids, got, n, scored
            if n:
                where = np.concatenate(ids)
                goal.offer(self.ids[where], self.labels[where], np.concatenate(got))
                ids, got, scored, n = [], [], scored + n, 0

        for upper, lower, s, e in self.visit(a):
            if upper < goal.least:
                offer()
                break
            if lower > goal.most:
                continue
            for k in range(s, e, CHUNK_ROWS):
                to = min(e, k + CHUNK_ROWS)
                ids.append(np.arange(k, to))
                got.append(scores(self.x[k:to], a, small))
                n += to - k
            if n >= STEP_ROWS:
                offer()
                if upper < goal.least:
                    break
        offer()
        return scored


class First:
    """The first ``k`` rows by (score falling, id)."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids, scores_):
        if len(ids) and len(self.ids) == self.k:
            ok = scores_ >= self.scores[-1]
            ids, scores_ = ids[ok], scores_[ok]
        if len(ids):
            ids, scores_ = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores_])
            order = np.lexsort((ids, -scores_.astype(np.float64) if abs(scores_).max() < 1 << 53 else [-int(v) for v in scores_]))[:self.k]
            self.ids, self.scores = ids[order], scores_[order]

    @property
    def worst(self) -> float:
        return float(self.scores[-1]) if len(self.ids) == self.k else -np.inf


class Goal:
    """What a search still looks for: scores from ``least`` to ``most``."""

    least, most = -np.inf, np.inf


class Positives(Goal):
    def __init__(self, own_id: int, label: int, k: int):
        self.own_id, self.label, self.first = own_id, label, First(k)

    def offer(self, ids, labels, got):
        ok = (labels == self.label) & (ids != self.own_id)
        self.first.add(ids[ok], got[ok])
        self.least = self.first.worst


class Windows(Goal):
    """First ``k`` rows of other labels in each window of scores."""

    def __init__(self, label: int, windows: list, k: int):
        """``windows``: (positive id, positive score, low, high)."""
        self.label, self.windows, self.k = label, windows, k
        self.first = [First(k) for _ in windows]
        self._bounds()

    def _bounds(self):
        self.least = min((max(low, f.worst) for (_, _, low, _), f in zip(self.windows, self.first)), default=np.inf)
        self.most = max((high for _, _, _, high in self.windows), default=-np.inf)

    def offer(self, ids, labels, got):
        other = labels != self.label
        ids, got = ids[other], got[other]
        for (_, _, low, high), f in zip(self.windows, self.first):
            ok = (got >= low) & (got <= high)
            f.add(ids[ok], got[ok])
        self._bounds()


# ------------------------------------------------------------------ frames

class Index:
    """All rows with scaled vectors and cells, written in cell order."""

    def __init__(self, vectors: DataFrame, scale: int, codes: int = CODES):
        spark = vectors.sparkSession
        x = F.transform(F.col("vec").cast("array<double>"), lambda v: F.lit(float(scale)) * v)
        # Kept as floating point: floor() of Spark would end at the range of a long.
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                          & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
        rows = written(rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.*"), "vectors")
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"),
                         F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most")).first()
        self.n, self.width = facts["n"], max(facts["width"] or 0, 0)
        most = (facts["most"] or 0.0) + 1
        self.small = self.width * most * most < 1 << 53
        take = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, self.width)))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).select("x").toArrow().column("x").combine_chunks()
        x, half = np.floor(matrix(sample, self.width)), self.width // 2
        centres = [codebook(x[:, :half], codes), codebook(x[:, half:], codes)]
        self.centres = centres
        width = self.width

        def code(batches):
            for b in batches:
                v = np.floor(matrix(b.column("x"), width))
                yield pa.record_batch([b.column("vec_id"), b.column("label"),
                                       pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(v.ravel())),
                                       pa.array(nearest(v[:, :half], centres[0]).astype(np.int32)), pa.array(nearest(v[:, half:], centres[1]).astype(np.int32))],
                                      names=["vec_id", "label", "x", "c1", "c2"])

        coded = map_batches(rows, code, "vec_id long, label long, x array<double>, c1 int, c2 int")
        parts = max(1, -(-self.n // CHUNK_ROWS), min(self.n // STEP_ROWS, spark.sparkContext.defaultParallelism))
        # The id splits a cell that holds many rows.
        self.rows = written(coded.repartitionByRange(parts, "c1", "c2", "vec_id").sortWithinPartitions("c1", "c2"), "cells")

    def queries(self, divisor: int) -> Iterator[DataFrame]:
        """Rows whose id is divisible by ``divisor``, in blocks of about ``BLOCK_QUERIES``."""
        anchors = self.rows.where(F.col("vec_id") % divisor == 0).select("vec_id", "label", "x")
        blocks = -(-anchors.count() // BLOCK_QUERIES)
        for k in range(blocks):
            yield anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)

    def searched(self, goals, out, schema: str) -> DataFrame:
        """Searches all rows in the tasks. ``goals()`` makes [(vector, goal)] anew in each
        task; ``out(goals)`` gives its rows as columns. Both must be picklable."""
        width, small, centres = self.width, self.small, self.centres

        def run(batches):
            todo = goals()
            for chunk in _chunks(batches, CHUNK_ROWS):
                ids, labels, x, c1, c2 = chunk
                index = MultiIndex(ids, labels, x, c1, c2, *centres)
                for a, goal in todo:
                    index.search(a, goal, small)
            yield out(todo)

        def _chunks(batches, most):
            held, n = [], 0
            for b in batches:
                for k in range(0, b.num_rows, most):
                    part = b.slice(k, most)
                    if n + part.num_rows > most and held:
                        yield _joined(held)
                        held, n = [], 0
                    held.append(part)
                    n += part.num_rows
            if held:
                yield _joined(held)

        def _joined(held):
            cols = {c: np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("vec_id", "label", "c1", "c2")}
            return cols["vec_id"], cols["label"], np.concatenate([matrix(b.column("x"), width) for b in held]), cols["c1"], cols["c2"]

        return map_batches(self.rows, run, schema)


def _bounds(score: int, low: int, high: int) -> tuple:
    """Least and largest integer s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(vectors: DataFrame, divisor: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` has ``vec_id, label, vec``. Anchors are the rows whose id is divisible by
    ``divisor``; their positives are the first ``positives`` other rows of the same label;
    per positive, the first ``negatives`` rows of other labels with a score of ``low`` to
    ``high`` percent of the positive's.
    """
    spark = prepare(vectors.sparkSession)
    index = Index(vectors, scale)
    path = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    done = []
    for k, block in enumerate(index.queries(divisor)):
        a = block.toArrow()
        if not a.num_rows:
            continue
        ids, labels = (np.asarray(a.column(c).combine_chunks()).tolist() for c in ("vec_id", "label"))
        x = matrix(a.column("x").combine_chunks(), index.width)
        shared = spark.sparkContext.broadcast((ids, labels, x))

        def looking():
            i, lab, v = shared.value
            return [(v[j], Positives(i[j], lab[j], positives)) for j in range(len(i))]

        def found(todo):
            n = [len(g.first.ids) for _, g in todo]
            return pa.record_batch([pa.array(np.repeat([g.own_id for _, g in todo], n).astype(np.int64)),
                                    pa.array(np.concatenate([g.first.ids for _, g in todo])),
                                    pa.array(np.concatenate([g.first.scores for _, g in todo]))],
                                   names=["anchor_id", "positive_id", "positive_score"])

        near = index.searched(looking, found, "anchor_id long, positive_id long, positive_score long")
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
        windows: dict = {}
        for r in near.collect():                          # at most ``positives`` per query of the block
            windows.setdefault(r["anchor_id"], []).append(
                (r["positive_id"], r["positive_score"], *_bounds(r["positive_score"], low, high)))
        given = spark.sparkContext.broadcast({i: [w for w in ws if w[2] <= w[3]] for i, ws in windows.items()})

        def asking():
            i, lab, v = shared.value
            w = given.value
            return [(v[j], Windows(lab[j], w[i[j]], negatives)) for j in range(len(i)) if w.get(i[j])]

        def answered(todo):
            i = [i for i in shared.value[0] if given.value.get(i)]
            rows = [(anchor, p, ps, f) for anchor, (_, g) in zip(i, todo) for (p, ps, _, _), f in zip(g.windows, g.first)]
            n = [len(f.ids) for *_, f in rows]
            a, p, s = (np.repeat(np.array([r[c] for r in rows], np.int64), n) for c in range(3))
            nid, ns = (np.concatenate([np.zeros(0, np.int64), *(getattr(r[3], c) for r in rows)]) for c in ("ids", "scores"))
            return pa.record_batch([pa.array(c) for c in (a, p, nid, s, ns)],
                                   names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        hard = index.searched(asking, answered, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{path}/block={k}")
        done.append(k)
        shared.unpersist()
        given.unpersist()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop("block")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The contract's input: where the id is divisible by 7, the label moves on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), F.col("embedding").alias("vec"))


def oracle_sql() -> str:
    """DuckDB SQL of ``mine(relabelled(embeddings))`` (one row per vec_id)."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3"""
