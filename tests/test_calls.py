"""Model calls: limits, retries, errors as rows; the answer log; one pass over the table."""

import asyncio
import random
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from clauselens.operators import calls as C
from clauselens.operators import model as MD
from clauselens.operators.extraction import extract_fields

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers can't import tests

REQ = "doc_id string, field string, rank int, chunk_start int, chunk_text string"
FAST = C.CallLimits(concurrency=1, attempts=2, backoff_seconds=0.0)


def found(*_):
    return {"text": "x", "start": 0, "end": 1, "confidence": 0.5}


# ------------------------------------------------------------------ one task

@pytest.mark.parametrize("kind", ["plain", "coroutine"])
def test_no_more_calls_at_a_time_than_the_limit(kind):
    lock, now, most = threading.Lock(), [0], [0]

    def enter(d):
        with lock:
            now[0] += d
            most[0] = max(most[0], now[0])

    def plain(*_):
        enter(1)
        time.sleep(0.02)
        enter(-1)
        return found()

    async def coroutine(*_):
        enter(1)
        await asyncio.sleep(0.02)
        enter(-1)
        return found()

    with C.Caller(plain if kind == "plain" else coroutine, C.CallLimits(concurrency=3)) as caller:
        t = time.monotonic()
        got = caller.ask_all([("d", "f", 0, str(i)) for i in range(12)])
        took = time.monotonic() - t
    assert [a.status for a in got] == ["answered"] * 12 and most[0] == 3
    assert took < 12 * 0.02                                  # they do run at the same time


def test_rate_limit_holds_over_batches():
    at = []
    with C.Caller(lambda *_: at.append(time.monotonic()), C.CallLimits(concurrency=4, per_second=50)) as caller:
        for _ in range(2):
            caller.ask_all([("d", "f", 0, "t")] * 5)
    gaps = np.diff(sorted(at))
    assert len(at) == 10 and at[-1] - at[0] >= 9 / 50 - 0.01 and gaps.min() > 0.005


def test_retries_until_an_answer_and_keeps_the_last_reason():
    tries = {}

    def flaky(doc_id, field, start, text):
        tries[text] = tries.get(text, 0) + 1
        if text == "never" or tries[text] < int(text):
            raise OSError(f"try {tries[text]}")
        return found()

    with C.Caller(flaky, C.CallLimits(concurrency=2, attempts=3, backoff_seconds=0.001)) as caller:
        got = caller.ask_all([("d", "f", 0, t) for t in ("1", "2", "3", "never")])
    assert [(a.status, a.attempts, a.reason) for a in got] == [
        ("answered", 1, None), ("answered", 2, None), ("answered", 3, None), ("failed", 3, "OSError: try 3")]


def test_time_limit():
    async def slow(doc_id, field, start, text):
        await asyncio.sleep(0.5 if text == "slow" else 0)
        return found()

    with C.Caller(slow, C.CallLimits(attempts=1, timeout_seconds=0.05)) as caller:
        got = caller.ask_all([("d", "f", 0, "slow"), ("d", "f", 0, "quick")])
    assert [a.status for a in got] == ["failed", "answered"] and got[0].reason.startswith("TimeoutError")


@pytest.mark.parametrize("answer,status", [
    (None, "empty"), ({}, "empty"), ({"text": "", "confidence": 0.0}, "empty"), ({"text": "a", "confidence": 1}, "answered"),
    ({"text": "a", "confidence": 1.5}, "failed"), ({"text": "a", "confidence": "high"}, "failed"),
    ({"text": 7, "confidence": 0.5}, "failed"), ({"text": "a", "start": "x", "confidence": 0.5}, "failed"),
    ({"text": "a", "confidence": float("nan")}, "failed")])
def test_invalid_answers_fail(answer, status):
    with C.Caller(lambda *_: answer, FAST) as caller:
        assert caller.ask_all([("d", "f", 0, "t")])[0].status == status


def test_limits_must_be_positive():
    for bad in ({"concurrency": 0}, {"attempts": 0}, {"per_second": 0}):
        with pytest.raises(ValueError):
            C.CallLimits(**bad)


def test_errors_are_rows_with_a_reason(spark):
    req = spark.createDataFrame([("a", "f", 1, 0, "fine"), ("b", "f", 1, 5, "bad"), ("c", "f", 1, 0, "")], REQ)

    def factory():
        def ask(doc_id, field, start, text):
            if text == "bad":
                raise KeyError("k")
            return found() if text else None
        return ask

    got = C.ask(req, factory, FAST).cache()
    assert [tuple(r) for r in got.select("doc_id", "status", "attempts").orderBy("doc_id").collect()] == [
        ("a", "answered", 1), ("b", "failed", 2), ("c", "empty", 1)]
    assert [tuple(r) for r in C.failures(got).select("doc_id", "chunk_start", "attempts", "reason").collect()] == [("b", 5, 2, "KeyError: 'k'")]
    assert [r["doc_id"] for r in C.answered(got).collect()] == ["a"]
    assert C.ask(req.where("false"), factory, FAST).count() == 0


# ------------------------------------------------------------------ the log

class Counted:
    """A factory of extractors that count their calls; fails on the chunks in ``bad``."""

    def __init__(self, spark, bad=()):
        self.calls, self.bad = spark.sparkContext.accumulator(0), set(bad)

    def __call__(self):
        def ask(doc_id, field, start, text):
            self.calls.add(1)
            if text in self.bad:
                raise RuntimeError("down")
            return None if text == "nothing" else {"text": text, "start": 1, "end": 2, "confidence": 0.5}
        return ask


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([("a", "f", 1, 10, "one"), ("b", "f", 1, 0, "one"), ("c", "f", 1, 0, "two"), ("d", "f", 1, 0, "nothing"),
                                  ("e", "g", 1, 0, "one")], REQ)


def served(df):
    return sorted((r["doc_id"], r["text"], r["start"]) for r in df.collect())


ALL = [("a", "one", 11), ("b", "one", 1), ("c", "two", 1), ("e", "one", 1)]


def test_failed_calls_are_asked_again_and_settled_ones_are_not(spark, tmp_path, requests):
    log = MD.AnswerLog(spark, str(tmp_path / "log"), "m")
    first, second, third = Counted(spark, bad=["two"]), Counted(spark), Counted(spark)
    assert served(log.lookup_or_call(requests, first, limits=FAST)) == [r for r in ALL if r[0] != "c"]
    assert first.calls.value == 3 + 2                        # one/f, one/g, nothing; two twice
    assert [(r["field"], r["attempts"], r["reason"]) for r in log.failures().collect()] == [("f", 2, "RuntimeError: down")]
    assert served(log.lookup_or_call(requests, second, limits=FAST)) == ALL and second.calls.value == 1
    assert served(log.lookup_or_call(requests, third, limits=FAST)) == ALL and third.calls.value == 0
    assert log.failures().count() == 0
    state = {(r["field"], r["text"]): (r["status"], r["attempts"]) for r in log.state().collect()}
    assert state == {("f", "one"): ("answered", 1), ("g", "one"): ("answered", 1), ("f", "two"): ("answered", 3), ("f", None): ("empty", 1)}


def test_a_repeated_run_adds_no_rows(spark, tmp_path, requests):
    log = MD.AnswerLog(spark, str(tmp_path / "log"), "m")
    once, again = Counted(spark, bad=["two"]), Counted(spark, bad=["two"])
    log.ask_missing(requests, once, FAST, run="monday")
    before = sorted(map(tuple, log.state().collect()), key=repr)
    log.ask_missing(requests, again, FAST, run="monday")
    assert again.calls.value == 0 and sorted(map(tuple, log.state().collect()), key=repr) == before


def test_a_run_that_died_does_not_count_and_is_replaced(spark, tmp_path, requests):
    log = MD.AnswerLog(spark, str(tmp_path / "log"), "m")
    log.ask_missing(requests.where("doc_id = 'a'"), Counted(spark), FAST, run="one")
    log.ask_missing(requests, Counted(spark), FAST, run="two")
    (tmp_path / "log" / "log-000002-two" / "_DONE").unlink()
    assert log.state().count() == 1
    again = Counted(spark)
    log.ask_missing(requests, again, FAST, run="two")
    assert again.calls.value == 3 and log.state().count() == 4
    assert len(list((tmp_path / "log").iterdir())) == 2


def test_rows_written_twice_count_once(spark, tmp_path, requests):
    log = MD.AnswerLog(spark, str(tmp_path / "log"), "m")
    log.ask_missing(requests, Counted(spark, bad=["two"]), FAST)
    batch = next((tmp_path / "log").iterdir())
    spark.read.parquet(str(batch)).coalesce(1).write.mode("append").parquet(str(batch))     # as tasks without a committer would
    assert log.state().count() == 4 and log.failures().first()["attempts"] == 2


def test_compaction_keeps_the_state_and_survives_its_own_end(spark, tmp_path, requests):
    log = MD.AnswerLog(spark, str(tmp_path / "log"), "m")
    for bad in (["one", "two"], ["two"], []):
        log.ask_missing(requests, Counted(spark, bad), FAST)
    want = sorted(map(tuple, log.state().collect()), key=repr)
    import shutil
    shutil.copytree(tmp_path / "log", tmp_path / "kept")
    log.compact()
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["base-000003"]
    assert sorted(map(tuple, log.state().collect()), key=repr) == want
    # Had it died before it removed the batches it covers:
    shutil.copytree(tmp_path / "kept", tmp_path / "log", dirs_exist_ok=True)
    assert sorted(map(tuple, log.state().collect()), key=repr) == want
    log.ask_missing(requests.withColumn("chunk_text", F.concat("chunk_text", F.lit("!"))), Counted(spark), FAST)
    log.compact()
    assert log.state().count() == 8 and [p.name for p in (tmp_path / "log").iterdir()] == ["base-000004"]


def test_attempts_have_an_end_and_models_are_apart(spark, tmp_path, requests):
    log = MD.AnswerLog(spark, str(tmp_path / "log"), "m", max_attempts=4)
    counts = []
    for _ in range(3):
        c = Counted(spark, bad=["two"])
        log.ask_missing(requests, c, FAST)
        counts.append(c.calls.value)
    assert counts == [5, 2, 0]
    other = Counted(spark)
    assert served(MD.AnswerLog(spark, str(tmp_path / "log"), "n").lookup_or_call(requests, other, limits=FAST)) == ALL and other.calls.value == 4


# ------------------------------------------------------------------ the cascade

DOCS = [("a", "Agreement between X Corp and Y Ltd. Payment Terms: net 30, to the account named. Termination. Either party may end it."),
        ("b", "Agreement between X Corp and Y Ltd. Invoice is payable on receipt. The governing law is Ohio."),
        ("c", "Nothing of that kind."), ("d", ""), ("e", None), ("f", "Invoice is payable on receipt. The governing law is Ohio.")]


def test_in_place_and_logged_cascades_agree(spark, tmp_path):
    e = extract_fields(spark.createDataFrame(DOCS, "doc_id string, text string"), keep_text=True)
    memo = MD.AnswerLog(spark, str(tmp_path / "log"), "m")
    a = MD.apply_model(e, MD.keyword_stub_extractor, limits=FAST)
    b = MD.apply_model(e, MD.keyword_stub_extractor, limits=FAST, memo=memo)
    key = lambda r: r["doc_id"]
    assert sorted(a.collect(), key=key) == sorted(b.select(*a.columns).collect(), key=key)
    rows = {r["doc_id"]: r for r in a.collect()}
    assert rows["b"]["payment_terms"]["source"] == "llm" and rows["a"]["payment_terms"]["source"] == "regex"
    assert rows["d"]["payment_terms"] is None and len(rows) == 6


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Scan parquet"), plan


def test_one_scan_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id string, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    e = extract_fields(d, keep_text=True)
    for df in (MD.apply_model(e, MD.keyword_stub_extractor), MD.apply_recognizer(e, MD.regex_recognizer), MD.rank_chunks(MD.failing_fields(e), ["payment_terms"])):
        n, plan = scans(df)
        assert n == 1 and "Exchange" not in plan


def test_best_candidate_over_chunks_with_local_offsets(spark):
    """Two chunks per field; the model answers with offsets of the chunk."""
    from clauselens.policy import current
    p = current().with_(chunk_size=30, chunk_overlap=0, model_top_k_chunks=2)
    text = "x" * 30 + "the fees are due on receipt..." + "y" * 30 + "an invoice is sent every month"
    e = extract_fields(spark.createDataFrame([("a", text)], "doc_id string, text string"), p, keep_text=True)

    def factory():
        def ask(doc_id, field, start, chunk):
            if field != "payment_terms":
                return None
            at = chunk.find("due") if "due" in chunk else chunk.find("invoice")
            return {"text": chunk[at:at + 3], "start": at, "end": at + 3, "confidence": 0.9 if "invoice" in chunk else 0.4}
        return ask

    r = MD.apply_model(e, factory, p, limits=FAST).first()
    assert r["payment_terms"]["text"] == "inv" and (r["payment_terms"]["start"], r["payment_terms"]["end"]) == (93, 96)
    assert text[93:96] == "inv" and r["_provenance"]["payment_terms"]["confidence"] == 0.9


# ------------------------------------------------------------------ U4

def slow_ratio(needle, hay):
    """The definition, one window at a time."""
    if not needle or not hay:
        return 0.0
    if needle in hay:
        return 100.0
    m, best = len(needle), 0.0
    starts = {i for i, ch in enumerate(hay) if ch == needle[0]} | {max(0, i - m + 1) for i, ch in enumerate(hay) if ch == needle[-1]}
    for s in starts:
        w = hay[s:s + m]
        row = [0] * (len(w) + 1)
        for a in needle:
            new = [0]
            for j, b in enumerate(w):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
            row = new
        best = max(best, 200.0 * row[-1] / (m + len(w)))
    return best


def test_lanes_equal_the_definition():
    rng = random.Random(4)
    for alphabet, lens in (("ab", (1, 9)), ("abc é\U0001F642", (1, 20)), ("abcdefgh ", (60, 70))):
        for _ in range(40):
            needle = "".join(rng.choice(alphabet) for _ in range(rng.randint(*lens)))
            texts = ["".join(rng.choice(alphabet + "z") for _ in range(rng.randint(0, 60))) for _ in range(8)] + ["", needle]
            assert MD.partial_ratios(needle, texts) == pytest.approx([slow_ratio(needle, t) for t in texts])
    assert MD.partial_ratio("", "a") == 0.0


def test_lanes_are_much_faster_than_a_loop_per_character():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("etaoinsr") for _ in range(6)) for _ in range(250)) for _ in range(40)]

    def loop(needle, t):
        m = len(needle)
        starts = {i for i, ch in enumerate(t) if ch == needle[0]} | {max(0, i - m + 1) for i, ch in enumerate(t) if ch == needle[-1]}
        return max((200.0 * MD._lcs_wide(needle, t[s:s + m]) / (m + len(t[s:s + m])) for s in starts), default=0.0)

    t0 = time.perf_counter()
    slow = [loop("termination rights", t) for t in texts]
    t1 = time.perf_counter()
    fast = MD.partial_ratios("termination rights", texts)
    t2 = time.perf_counter()
    assert fast == pytest.approx(slow) and (t2 - t1) * 5 < t1 - t0
