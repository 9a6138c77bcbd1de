import collections

import numpy as np
import pytest

from clauselens.llm import quality_rules as Q
import llm_fixtures as X
from llm_fixtures import docs, empty  # noqa: F401


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    tri = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    rep = {i + j for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(rep)


def test_base_columns_equal_brute_force_and_verdicts(spark, docs):
    rows = {}
    for r in Q.quality_rules(docs, X.labels_df(spark)).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    want = collections.defaultdict(list)
    for d, t, _ in X.documents():
        want[d].append(brute(t))
    assert {d: sorted(tuple(r[c] for c in Q.COUNTS[:5]) for r in v) for d, v in rows.items()} == {d: sorted(v) for d, v in want.items()}
    for v in rows.values():
        for r in v:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert not rows[1011][0]["kept"] and not rows[1012][0]["kept"]
    assert sum(rows[i][0]["kept"] for i in range(60)) >= 55


def test_dup_lines():
    assert Q.doc_counts(b"a b\nc\na b\n\n\n \nc\nc")[3] == 3


def test_forest_scores_outliers_higher_and_is_deterministic():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 3))
    forest, again = Q.IsolationForest(rows), Q.IsolationForest(rows)
    probe = np.array([[0, 0, 0], [8, 8, 8], [0, -9, 0]], float)
    s = forest.score(probe)
    assert s[0] < 0.5 < min(s[1:]) and (again.score(probe) == s).all()
    same = Q.IsolationForest(np.ones((10, 2)))
    assert np.isfinite(same.score(np.ones((2, 2)))).all()


def test_repetition_goes_down_the_trees():
    c = dict.fromkeys(Q.COUNTS, 0) | {"n_words": 100, "word_chars": 500, "n_lines": 10}
    row = lambda **k: list((c | k).values())
    usual, lines, words = Q.shares([row(n_dup_lines=2, n_repeat_words=20), row(n_dup_lines=5), row(n_repeat_words=45)])
    assert (usual == Q.shares([row()])[0]).all()
    assert lines[Q.SHARES.index("excess_lines")] == 0.25 and words[Q.SHARES.index("excess_repeats")] == pytest.approx(0.2)
    rng = np.random.default_rng(2)
    rows = np.array([row(word_chars=w, n_dup_lines=d) for w, d in zip(rng.integers(450, 550, 400), [8, 0, 0, 0, 0, 0, 0, 0] * 50)])
    rows[8:, Q.COUNTS.index("n_dup_lines")] = 0                     # one document of many repeated lines among 400
    forest = Q.IsolationForest(Q.shares(rows), tree_rows=400)
    score = forest.score(Q.shares(rows))
    assert score[0] > np.quantile(score[1:], 0.95)


def test_limit_calibration():
    assert Q.best_limit([(0.4, 10, 0), (0.5, 5, 1), (0.7, 0, 8)]) == pytest.approx(0.6)
    assert Q.best_limit([(0.4, 10, 0)]) == 1.0 and Q.best_limit([]) == 1.0


def test_filter_agrees_and_empty_tables(spark, docs, empty):
    labels = X.labels_df(spark)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == Q.quality_rules(docs, labels).where("kept").count()
    assert Q.quality_rules(empty, labels).count() == 0 and Q.keep_good(empty, labels).count() == 0
    bare = Q.quality_rules(docs, labels.limit(0))
    assert bare.where("kept").count() == bare.where("NOT base_failed").count()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_labelled_rows_are_told_apart(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    r = Q.quality_rules(docs, labels).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert r[r.quality == 1].kept.mean() > 0.97 and (~r[r.quality == 0].kept).mean() > 0.95
