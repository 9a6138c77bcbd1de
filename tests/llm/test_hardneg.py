import math
import random

import numpy as np
import pytest

from clauselens.llm import hardneg as H

SCHEMA = "vec_id long, label int, embedding array<float>, x string, c1 string, score string"


def brute(rows, scale=256, divisor=50, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, label, vector); returns the result rows by comparing every pair."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        q = [math.floor(scale * float(np.float32(c))) for c in v]
        if i not in best or (label, q) < best[i]:
            best[i] = (label, q)
    out = []
    for a, (label, q) in best.items():
        if a % divisor:
            continue
        s = sorted(((-sum(x * y for x, y in zip(q, w)), i, lab) for i, (lab, w) in best.items() if i != a))
        for minus, p, _ in [r for r in s if r[2] == label][:positives]:
            ps = -minus
            hard = [(i, -m) for m, i, lab in s if lab != label and low * ps <= -100 * m <= high * ps][:negatives]
            out += [(a, p, k + 1, i, ps, ns) for k, (i, ns) in enumerate(hard)]
    return sorted(out)


def vectors(seed, n, dim=8, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.5) for x in c]
        k = math.sqrt(sum(x * x for x in v))
        rows.append((i, rng.randrange(labels), [x / k for x in v]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def mined(spark, rows):
    return sorted(map(tuple, H.mine(frame(spark, rows).withColumnRenamed("embedding", "vec")).collect()))


def test_equals_brute_force_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_ROWS", 64)
    monkeypatch.setattr(H, "STEP_ROWS", 16)
    monkeypatch.setattr(H, "BLOCK_QUERIES", 5)
    rows = vectors(1, 900)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_awkward_rows(spark):
    rows = vectors(2, 260)
    same = rows[50][2]
    rows += [(1000 + i, i % 3, same) for i in range(150)]                      # ties: one very common vector
    rows += [(None, 1, same), (2000, None, same), (2050, 1, None), (2100, 1, [None] * 8), (2150, 1, [float("nan")] * 8),
             (2200, 1, [float("inf")] + [0.0] * 7), (2250, 2, [0.0] * 8), (2300, 1, [0.5, 0.5]), (2350, 1, []), rows[50], rows[51],
             (2400, 1, [-0.9] * 8), (2450, 77, same)]                           # 2450 has no positive
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float(2 ** 20 + i), float(-(2 ** 19)), 3.0e4 * i]) for i in range(120)]
    index = H.Index(frame(spark, rows).withColumnRenamed("embedding", "vec"), 256)
    assert not index.small
    assert mined(spark, rows) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.1, 0.2]), (2, 2, [0.1, 0.3])]) == []


def test_relabelled(spark):
    got = H.relabelled(frame(spark, [(7, 9, [1.0]), (14, 3, [1.0]), (8, 3, [1.0]), (21, None, None)])).collect()
    assert [r["label"] for r in got] == [0, 4, 3, None]


@pytest.mark.parametrize("rows,dim", [(400, 6), (50, 1), (30, 0)])
def test_visits_cells_by_falling_sound_bounds(rows, dim):
    rng = np.random.default_rng(rows)
    x = np.floor(rng.normal(0, 100, (rows, dim)))
    half = dim // 2
    c = [H.codebook(x[:, :half], 8), H.codebook(x[:, half:], 8)]
    codes = [H.nearest(p, q).astype(np.int32) for p, q in zip((x[:, :half], x[:, half:]), c)]
    index = H.MultiIndex(np.arange(rows), np.zeros(rows, np.int64), x, *codes, *c)
    a = np.floor(rng.normal(0, 100, dim))
    seen, last = 0, np.inf
    for upper, lower, s, e in index.visit(a):
        got = index.x[s:e] @ a
        assert lower <= got.min() and got.max() <= upper <= last + 1e-9
        last, seen = upper, seen + e - s
    assert seen == rows


def test_search_stops_early_on_clustered_rows():
    rng = np.random.default_rng(5)
    centres = np.eye(16) * 2000
    x = np.floor(centres[rng.integers(0, 16, 20_000)] + rng.normal(0, 20, (20_000, 16)))
    books = [H.codebook(x[:, :8], 16), H.codebook(x[:, 8:], 16)]
    codes = [H.nearest(x[:, :8], books[0]).astype(np.int32), H.nearest(x[:, 8:], books[1]).astype(np.int32)]
    index = H.MultiIndex(np.arange(20_000), np.zeros(20_000, np.int64), x, *codes, *books)
    goal = H.Positives(0, 0, 5)
    scored = index.search(x[0], goal, True)
    want = sorted(((-int(v), i) for i, v in enumerate(x @ x[0]) if i), key=lambda r: r)[:5]
    assert list(zip(goal.first.scores.tolist(), goal.first.ids.tolist())) == [(-s, i) for s, i in want]
    assert scored < 4_000
