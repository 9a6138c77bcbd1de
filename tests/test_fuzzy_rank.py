"""The fuzzy ranking: dealt by rows, each chunk lower-cased and compared once, same scores as the definition."""

import random

import numpy as np

from clauselens import policy as P
from clauselens.operators import model as MD
from clauselens.plans import queries as Q

from test_calls import slow_ratio

FIELDS = [f for f, _ in P.FIELD_HINTS]


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["Net", "governed", "laws", "paymnt", "terminat", "betwen", "effectiv", "date", "due", "ärger", "İstanbul", "ΟΔΟΣ", "xyz"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_documents_of_one_row_group_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    rows = [*enumerate(texts(40)), (None, "a" * 3000), (7, "twice"), (7, "twice"), (8, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q, "DOCUMENTS_PER_TASK", 1)
    got = Q.REGISTRY["chunk_fuzzy_rank"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == len(rows)
    assert got.count() == 5 * 43                           # no row for a text that is null or empty


def test_a_text_is_lower_cased_once_and_sent_once(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    plan = MD.rank_chunks(docs, FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("ArrowEvalPython") == 1


def test_scores_and_order_are_those_of_the_definition(spark):
    p = P.current().with_(chunk_size=60, chunk_overlap=7, prefilter_chunks=4, model_top_k_chunks=3)
    docs = dict(enumerate(texts(25)))
    got = {}
    for r in MD.rank_chunks(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), [*FIELDS, "other"], p).collect():
        got.setdefault((r["doc_id"], r["field"]), []).append((r["rank"], r["pre_rank"], r["chunk_start"], r["chunk_text"], r["fuzzy"]))
    hints = dict(P.FIELD_HINTS)
    for d, text in docs.items():
        starts, i = [], 0
        while i < len(text):
            j = min(len(text), i + 60)
            starts.append(i)
            i = j - 7 if j - 7 > i else j
        chunks = [(s, text[s:s + 60]) for s in starts]
        for f in [*FIELDS, "other"]:
            h = hints.get(f, ())
            top = sorted(chunks, key=lambda c: -sum(x in c[1].lower() for x in h))[:4] if h else chunks
            score = lambda c: 100.0 if any(x in c[1].lower() for x in h) else max((slow_ratio(x, c[1].lower()) for x in h), default=0.0) if len(top) > 1 else 0.0  # noqa: E731, B023
            order = sorted(((-score(c), k, c) for k, c in enumerate(top)), key=lambda x: x[:2])[:3]
            assert got[d, f] == [(n, k, *c, -m) for n, (m, k, c) in enumerate(order, 1)], (d, f)


def test_only_failing_fields_are_ranked(spark):
    p = P.current().with_(chunk_size=20, chunk_overlap=0)
    text = "the invoce is duu now, that is all, and nothing else"
    docs = spark.createDataFrame([("a", text, ["parties"]), ("b", text, []), ("c", text, None), ("d", None, ["parties"])],
                                 "doc_id string, text string, failing array<string>")
    got = {r["doc_id"]: r["requests"] for r in MD.with_requests(docs, FIELDS, p).collect()}
    assert [r["field"] for r in got["a"]] == ["parties"] and not any(got[k] for k in "bcd") and len(got) == 4


def test_best_ratios_of_several_hints():
    hints = ["net", "", "due", "n" * 70, "ärger", "net"]
    some = [*texts(70, 5), "", "ne", "n" * 69, "\0net", "\0" * 80, "e\0t"]
    want = np.max([[slow_ratio(h, t) for t in some] for h in hints], axis=0)
    assert np.array_equal(MD.best_ratios(hints, some), want)
    assert MD.best_ratios([], some).tolist() == [0.0] * len(some)
