import random

import llm_fixtures as X
import numpy as np
import pytest
from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import neardup as N


def shingles(t, k):
    w = [x.decode() for x in (t or "").encode().lower().split()]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """{doc_id: component} by all pairs; rows that share an id are one document."""
    rows = [(d, shingles(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, u in rows[i + 1:]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in rows}


def hot_group(seed=3, n=220):
    """Near copies of one text with few edits each, copies of them, and others."""
    rng = random.Random(seed)
    base = X.prose(rng, "en", 120).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(["edit%d" % rng.randrange(40), base[0], "x%d" % rng.randrange(10 ** 6)])
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    rows += [(2000 + i, X.prose(rng, "de", 80)) for i in range(20)]
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, k, percent):
    rows = hot_group()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_wide_buckets_take_the_bound_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "WIDE_BUCKET", 4)
    rows = hot_group(11, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(df).collect()}
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("wide", [4, 64])
def test_repeated_rows_in_wide_open_buckets(spark, monkeypatch, wide):
    """Rows that stand in the table many times over count once for rarity and in the joins."""
    monkeypatch.setattr(N, "WIDE_BUCKET", wide)
    rng = random.Random(13)
    rows = hot_group(13, 110)
    rows += [r for r in rows for _ in range(rng.choice([0, 0, 1, 6]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = N.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == brute(sorted(set(rows)), 3, 85)


def test_repeated_rows_do_not_change_what_is_frequent(spark):
    sets = {i: list(range(100)) + [1000 + i] for i in range(80)}
    rows = spark.createDataFrame([(7, i, [7]) for i in sets], "key long, rep long, bands array<long>")
    df = spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>")
    N.prepare(spark)
    facts = {r["rep"]: r["frequent"] for r in N.OpenBuckets(rows, df, 85).facts.collect()}
    assert set(facts.values()) == {100}


def test_pair_of_a_wide_and_a_narrow_member_is_made(spark):
    # Document 0 is in a wide bucket and shares a small one with 500, which is in no wide one.
    common = list(range(10 ** 6, 10 ** 6 + 100))
    sets = {0: common, 500: common[:95] + [1], **{i: list(range(1000 * i, 1000 * i + 100)) for i in range(1, 80)}}
    sets |= {i: list(range(1000 * i, 1000 * i + 100)) for i in (600, 601)}
    rows = [(7, i, [7, 8] if i == 0 else [7]) for i in range(80)]
    rows += [(8, 0, [7, 8]), (8, 500, [8]), (8, 600, [8]), (8, 601, [8])]
    assert len([r for r in rows if r[0] == 7]) > N.WIDE_BUCKET >= 4
    N.prepare(spark)
    buckets = N.OpenBuckets(spark.createDataFrame(rows, "key long, rep long, bands array<long>"),
                            spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>"), 85)
    got = {(r["a"], r["b"]) for r in buckets.pairs(lambda df, col, to: df.withColumn(to, N.F.col(col))).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b
              and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert linked == {(0, 500)} and linked <= got


def test_smallest_sets_that_can_be_linked(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i")]          # 4 and 5 shingles of five words: 4 of 5 shared
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(df, 5, 80).collect()}
    assert got == brute(rows, 5, 80) == {1: 1, 2: 1}


def test_edge_rows(spark, docs):
    rows = [(d, t) for d, t, _ in X.documents()]
    out = N.near_duplicates(docs).collect()
    want = brute(rows, 3, 85)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in out}
    assert sizes[1000] == sizes[1001] == sizes[1002] == 0 and sizes[1003] == 1
    assert want[1005] == want[1006] == 0 and want[1009] == 1008


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = X.prose(random.Random(1), "en", 60), X.prose(random.Random(2), "en", 60)
    rows = [(5, a), (5, b), (6, a), (7, b), (8, "other words here")]
    got = {r["doc_id"]: r["component_id"] for r in
           N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}


def test_drop_copies_keeps_one_of_each_group_and_all_columns(spark, docs, empty):
    left = N.drop_copies(docs, 3, 85)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    want = brute([(d, t) for d, t, _ in X.documents()], 3, 85)
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert sum(i is None for i in ids) == 2
    assert N.near_duplicates(empty).count() == 0 and N.drop_copies(empty).count() == 0


def test_drop_copies_keeps_one_of_repeated_rows(spark):
    t = X.prose(random.Random(4), "en", 60)
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (3, "z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.drop_copies(df).collect()) == [1, 3]


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2 ** 63, int(2000 * j)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            rest = rng.integers(0, 2 ** 63, 2000 - int(2000 * j)).astype(np.uint64) * np.uint64(2)
            a, b = (N.sketch_of(np.unique(np.concatenate([both, rest[i::2]]))) for i in (0, 1))
            errors.append(N.estimate(a[None], b[None])[0][0] - j)
        assert abs(np.mean(errors)) < 0.02


def test_band_miss_probability():
    for t in (0.8, 0.85, 0.9):
        r = N.band_rows(t)
        assert (1 - t ** r) ** (N.REGISTERS // r) <= N.MISS
    assert len(N.band_keys(N.sketch_of(np.array([5, 2 ** 60], np.uint64)), 8)) == 32


def test_components_of_a_long_chain(spark):
    rng = random.Random(9)
    nodes = list(range(300))
    rng.shuffle(nodes)
    e = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in N.components(e).collect()}
    assert got == {**{n: 0 for n in nodes}, 1000: 1000, 1001: 1000}
