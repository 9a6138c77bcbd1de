"""Ingest runs: converted texts are skipped, failures stay in quarantine until they are converted."""

import sys

from pyspark import cloudpickle

from clauselens.plans.queries import text_corpus_roundtrip
from clauselens.sources import files as FS
from clauselens.sources.quarantine import Quarantine

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers can't import tests

SCHEMA = "doc_id string, source_path string, content binary"
GOOD, BAD = b"<body>" + b"long enough " * 9 + b"</body>", b"no tags"


def files(spark, **content):
    return spark.createDataFrame([(k, f"p/{k}", bytearray(v)) for k, v in content.items()], SCHEMA)


def state(q):
    return (sorted(r["doc_id"] for r in q.converted().collect()),
            sorted((r["doc_id"], r["attempts"], r["error"]) for r in q.failures().collect()))


class Counted:
    def __init__(self, spark):
        self.calls = spark.sparkContext.accumulator(0)

    def __call__(self):
        inner = FS.html_converter()

        def conv(content):
            self.calls.add(1)
            return inner(content)
        return conv


def test_second_run_skips_converted_and_retries_failures(spark, tmp_path):
    q, c = Quarantine(spark, str(tmp_path / "q")), Counted(spark)
    q.ingest(files(spark, a=GOOD, b=BAD, c=BAD), c)
    assert state(q) == (["a"], [("b", 1, "no body"), ("c", 1, "no body")]) and c.calls.value == 3
    q.ingest(files(spark, a=GOOD, b=GOOD, c=BAD, d=GOOD), c)
    assert state(q) == (["a", "b", "d"], [("c", 2, "no body")]) and c.calls.value == 6
    q.ingest(files(spark, c=GOOD), c, retry=False)
    assert state(q) == (["a", "b", "d"], [("c", 2, "no body")]) and c.calls.value == 6


def test_attempts_have_an_end(spark, tmp_path):
    q, c = Quarantine(spark, str(tmp_path / "q"), max_attempts=2), Counted(spark)
    for _ in range(4):
        q.ingest(files(spark, b=BAD), c)
    assert c.calls.value == 2 and state(q) == ([], [("b", 2, "no body")])


def test_repeated_and_dead_runs(spark, tmp_path):
    q, c = Quarantine(spark, str(tmp_path / "q")), Counted(spark)
    q.ingest(files(spark, a=GOOD, b=BAD), c, run="one")
    q.ingest(files(spark, a=GOOD, b=BAD), c, run="one")
    assert c.calls.value == 2
    (tmp_path / "q" / "log-000001-one" / "_DONE").unlink()
    assert state(q) == ([], [])
    q.ingest(files(spark, a=GOOD, b=BAD), c, run="one")
    assert state(q) == (["a"], [("b", 1, "no body")]) and c.calls.value == 4


def test_a_converter_that_raises_is_a_failure_and_nothing_is_nothing(spark, tmp_path):
    q = Quarantine(spark, str(tmp_path / "q"))

    def factory():
        def conv(content):
            raise ValueError("broken file")
        return conv

    q.ingest(files(spark, a=GOOD).where("false"), factory)
    assert state(q) == ([], [])
    q.ingest(files(spark, a=GOOD, e=b""), factory)
    assert state(q) == ([], [("a", 1, "ValueError: broken file"), ("e", 1, "ValueError: broken file")])


def test_text_corpus_keeps_ids_and_texts(spark, tmp_path):
    rows = [(1, "one\ntwo"), (2, ""), (3, None), (4, "ends with newlines\n\n"), (5, "é \U0001F642\r\n\x0b x"), (6, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["char_count"]) for r in text_corpus_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {str(i): (t or "", len(t or "")) for i, t in rows}
