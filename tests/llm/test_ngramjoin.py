import random

import llm_fixtures as X
import numpy as np
import pytest
from llm_fixtures import docs, empty  # noqa: F401
from test_neardup import brute, hot_group

from clauselens.llm import ngramjoin as J


def joined(spark, rows, ngram=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in J.ngram_join(df, ngram, percent).collect()}


@pytest.mark.parametrize("ngram,percent", [(4, 85), (5, 80), (1, 60)])
def test_components_equal_all_pairs(spark, ngram, percent):
    rows = hot_group(seed=ngram, n=160)
    assert joined(spark, rows, ngram, percent) == brute(rows, ngram, percent)


def test_families_near_the_threshold(spark):
    """Sub-families of one text: edits that several members share, links only through others."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for fam in range(12):
        head = list(base)
        for _ in range(rng.randint(2, 5)):
            head[rng.randrange(150)] = f"fam{fam}"
        for m in range(15):
            w = list(head)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(150)] = rng.choice([f"fam{fam}x", f"only{fam}-{m}"])
            if rng.random() < 0.3:
                w += [f"tail{fam}"] * rng.randint(1, 12) + [f"t{m}"]
            rows.append((fam * 100 + m, " ".join(w)))
    rng.shuffle(rows)
    want = brute(rows, 4, 85)
    assert 1 < len(set(want.values())) < len(rows)
    assert joined(spark, rows) == want


def test_shared_passages_link_nothing(spark):
    """A passage in every document: long in short ones, short in long ones."""
    rng = random.Random(8)
    passage = X.prose(rng, "en", 60)
    rows = [(i, X.prose(rng, "de", rng.choice([5, 8, 11, 100, 400])) + " " + passage + " " + X.prose(rng, "fr", rng.randint(0, 9)))
            for i in range(120)]
    rows += [(500 + i, rows[i][1]) for i in range(0, 120, 3)]
    assert joined(spark, rows) == brute(rows, 4, 85)


def test_edge_rows(spark, docs):  # noqa: F811
    rows = [(d, t) for d, t, _ in X.documents()]
    out = J.ngram_join(docs, 4, 85).collect()
    want = brute(rows, 4, 85)
    named = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert {d: r["component_id"] for d, r in named.items()} == want
    assert len(out) == len(want) + 2 and all(r["component_id"] is None for r in out if r["doc_id"] is None)
    assert [named[i]["n_shingles"] for i in (1000, 1001, 1002, 1003)] == [0, 0, 0, 1]


def test_repeated_rows_and_ids(spark):
    t = [X.prose(random.Random(i), "en", 80) for i in range(3)]
    near = t[0] + " more"
    rows = [(1, t[0])] * 7 + [(2, near)] * 3 + [(3, t[1]), (3, ""), (3, None), (4, t[1]), (5, "one two"), (6, "one two"), (6, "one two")]
    assert joined(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    # Of different texts under one id, the one with the smallest digest stands for the document.
    two = joined(spark, [(9, t[0]), (9, t[2]), (10, t[0]), (11, t[2])])
    assert sorted(two) == [9, 10, 11] and sorted(two.values()) in ([9, 9, 10], [9, 9, 11])


def test_empty_table(empty):  # noqa: F811
    assert J.ngram_join(empty).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_filters_keep_linked_pairs(spark, percent):
    """Prefixes, positions and suffix classes of random sets, by the definitions."""
    rng = np.random.default_rng(percent)
    universe = rng.integers(0, 2 ** 63, 4000).astype(np.uint64) * np.uint64(2)
    for _ in range(200):
        n = int(rng.integers(8, 300))
        base = rng.choice(universe, n, replace=False)
        other = base[rng.random(n) < percent / 100 + 0.05]
        a, b = np.unique(base), np.unique(np.concatenate([other, rng.choice(universe, int(rng.integers(0, max(1, n // 12))))]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        pa_, pb = J.probes_of(a, percent), J.probes_of(b, percent)
        if pa_ is None or pb is None:
            assert np.array_equal(a, b)
            continue
        small = min(len(a), len(b))
        assert len(np.intersect1d(pa_, pb)) >= min(J.longer(small), J.need(small, percent))
        least = J.longer(J.need(max(len(a), len(b)), percent))
        assert len(np.intersect1d(pa_, pb)) >= min(least, J.need(small, percent))


@pytest.mark.parametrize("head", [64, 2])
def test_no_pair_is_made_twice(spark, monkeypatch, head):
    monkeypatch.setattr(J, "HEAD", head)
    rows = hot_group(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = df.rdd.map(lambda r: (r[0], J.token_set(r[1].encode(), 4).view(np.int64).tolist())).map(
        lambda r: (r[0], len(r[1]), r[1])).toDF("rep long, n long, tokens array<long>")
    entries = J.prefix_entries(sets, 85).cache()
    same = lambda d, c, to: d.withColumn(to, J.F.col(c))
    J.prepare(spark)
    heads = entries.where("head IS NOT NULL").select("rep", "head")
    pairs = [tuple(r) for r in J.open_pairs(entries.drop("head"), heads, same, 85).collect()]
    assert len(pairs) == len(set(pairs))
    texts = dict(rows)
    small = {i: {tuple(t.split()[k:k + 4]) for k in range(len(t.split()) - 3)} for i, t in texts.items()}
    linked = {(a, b) for a in small for b in small if a < b and small[a] != small[b]
              and 100 * len(small[a] & small[b]) >= 85 * len(small[a] | small[b])}
    got = set(pairs)
    assert linked <= got | {p for p in linked if small[p[0]] == small[p[1]]}
