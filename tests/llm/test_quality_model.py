import functools
import math
import random

import numpy as np
from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import quality_model as M


def test_em_finds_the_accuracies_of_overlapping_labellers():
    rng = np.random.default_rng(3)
    k, n = len(M.LABELLERS), 40_000
    truth = rng.random(n) < 0.8
    right = np.linspace(0.7, 0.95, k)
    codes = np.zeros(n, np.int64)
    for j in range(k):
        ok = rng.random(n) < right[j]
        vote = np.where(rng.random(n) < 0.5, M.ABSTAIN, np.where(truth == ok, M.GOOD, M.BAD))
        codes = codes * 3 + vote
    p, c = np.unique(codes, return_counts=True)
    model = M.LabelModel(p, c.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    got = np.array(list(model.accuracy().values()))
    assert np.abs(got - right).max() < 0.06
    assert ((model.posterior(codes) >= 0.5) == truth).mean() > 0.9


def test_votes_round_trip():
    t = M.Text(b"SHOUTED WORDS!! " * 40)
    v = M.unpack(np.array([M.votes(t)]))[0]
    assert len(v) == len(M.LABELLERS) and set(v.tolist()) <= {0, 1, 2} and (v == M.BAD).any()


def test_variety_is_of_the_whole_text():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(5000)]
    normal, few = " ".join(words), " ".join(rng.choice(words[:6], 4000))
    alone = M.Text(" ".join(words[:150] + words[:50]).encode())
    assert alone.variety == 0.75
    holds = M.LABELLERS["little variety"][1]
    tail = M.Text(f"{' '.join(words[:250])} {few}".encode())
    assert tail.variety < 0.2 and holds(tail)
    opening = M.Text(f"{' '.join(rng.choice(words[:6], 220))} {normal}".encode())
    assert opening.variety > 0.9 and not holds(opening)
    # The last window is a full one: 201 words are two windows.
    assert M.Text(" ".join(["a"] * 200 + ["b"]).encode()).variety == (1 / 200 + 2 / 200) / 2


def test_rows(spark, docs, empty):
    out = M.classify(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5)
    assert len(out) == docs.count()
    assert by[1000]["score"] == by[1001]["score"] == 0 and not by[1000]["kept"]
    assert sum(by[i]["kept"] for i in range(60)) >= 57
    assert not by[1011]["kept"] and not by[1012]["kept"]
    assert M.classify(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["kept"] for r in M.classify(blank).collect()] == [False, False]


def test_sample_is_of_distinct_texts_bounded_and_never_empty(spark):
    rows = [(i, "the one text of nearly all rows. " * 9) for i in range(3000)] + [(9000 + i, f"text {i} of its own.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert M.sampled(df, 10).select("text").distinct().count() == 10
    assert M.sampled(df, 100).select("text").distinct().count() == 41
    fitted = []
    for n in (1, 10, 100):
        with_rows = M.Scorer
        M.Scorer = lambda data, target: fitted.append(len(data)) or with_rows(data, target)
        try:
            assert M.fit(df, n)[1] is not None
        finally:
            M.Scorer = with_rows
    assert fitted == [1, 10, 41]
    # Far more rows than the sample, two texts: the hash range of a share by rows would often hold none.
    two = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'SPAM!! NOW!!', 'a plain text of some words.') AS text")
    assert M.classify(two, 2).where("score IS NULL").count() == 0


def test_agrees_with_labels_that_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    r = M.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert r[r.quality == 1].kept.mean() > 0.97 and (~r[r.quality == 0].kept).mean() > 0.95


def brute_em(votes_of_docs):
    """The same EM, one document at a time in plain Python."""
    k = len(M.LABELLERS)
    sign = lambda x: (x > 0) - (x < 0)
    p = [0.5 + 0.4 * sign(v.count(M.GOOD) - v.count(M.BAD)) for v in votes_of_docs]
    before = 0.5
    for _ in range(M.EM_ROUNDS):
        prior = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
        table = [[[0.1] * 3, [0.1] * 3] for _ in range(k)]
        for v, good in zip(votes_of_docs, p):
            for j in range(k):
                table[j][0][v[j]] += 1 - good
                table[j][1][v[j]] += good
        table = [[[x / sum(c) for x in c] for c in both] for both in table]
        p = []
        for v in votes_of_docs:
            d = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v[j]]) - math.log(table[j][0][v[j]]) for j in range(k))
            p.append(1 / (1 + math.exp(-max(-50, min(50, d)))))
        if abs(before - prior) < 1e-9:
            break
        before = prior
    return prior, p


def test_em_equals_brute_force():
    rng = random.Random(5)
    k = len(M.LABELLERS)
    docs_votes = []
    for _ in range(300):
        good = rng.random() < 0.7
        docs_votes.append([M.ABSTAIN if rng.random() < 0.6 else (M.GOOD if good == (rng.random() < 0.85) else M.BAD) for _ in range(k)])
    prior, want = brute_em(docs_votes)
    codes = np.array([functools.reduce(lambda c, v: c * 3 + v, row, 0) for row in docs_votes])
    patterns, counts = np.unique(codes, return_counts=True)
    model = M.LabelModel(patterns, counts.astype(float))
    assert abs(model.prior - prior) < 1e-6
    np.testing.assert_allclose(model.posterior(codes), want, atol=1e-6)


def test_scorer_equals_brute_force():
    made = [M.Text(t.encode()) for t in ("the old house stood by the river", "BUY NOW!! BUY NOW!!", "a word", "The house. The river. The end.",
                                         "win win win $$$ win", "it was as it is, and so it will be")]
    target = [0.9, 0.05, 0.5, 0.8, 0.1, 0.95]
    rows = [dict(zip(b.tolist(), v.tolist())) for b, v in map(M.features, made)]
    good = sum(target)
    weight = [t / good + (1 - t) / (len(target) - good) for t in target]
    w, g2, bias, b2 = {}, {}, 0.0, 1e-8
    for _ in range(M.EPOCHS):
        err = [(1 / (1 + math.exp(-(sum(v * w.get(c, 0.0) for c, v in r.items()) + bias))) - t) * x for r, t, x in zip(rows, target, weight)]
        grad = {}
        for r, e in zip(rows, err):
            for c, v in r.items():
                grad[c] = grad.get(c, 0.0) + v * e
        for c, g in grad.items():
            g += M.PENALTY * w.get(c, 0.0)
            g2[c] = g2.get(c, 1e-8) + g * g
            w[c] = w.get(c, 0.0) - M.RATE * g / math.sqrt(g2[c])
        b2 += sum(err) ** 2
        bias -= M.RATE * sum(err) / math.sqrt(b2)
    scorer = M.Scorer([M.features(t) for t in made], np.array(target))
    unseen = M.Text(b"the house by the river, NOW!!")
    for t in [*made, unseen]:
        b, v = M.features(t)
        z = bias + sum(x * w.get(c, 0.0) for c, x in zip(b.tolist(), v.tolist()))
        assert abs(scorer.score(t) - 1 / (1 + math.exp(-z))) < 1e-6
