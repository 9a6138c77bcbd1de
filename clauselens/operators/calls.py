"""Calls of a caller-supplied model from Spark tasks.

A task takes its requests from Arrow batches and asks the extractor for all of a batch
at once, ``concurrency`` calls at a time, at most ``per_second`` a second, each tried up to
``attempts`` times. Every request gives one answer row:

* ``answered``: a candidate with text;
* ``empty``: the model was asked and found nothing;
* ``failed``: every attempt raised, ran out of time or gave an invalid answer; ``reason`` says
  what the last one was.

The extractor is ``(doc_id, field, chunk_start, chunk_text) -> dict | None``, a plain function
(run in threads) or a coroutine function, made once per task by its factory. A dict
has ``text, start, end, confidence``; a confidence outside 0 to 1 or an offset that is
no integer is an invalid answer.
"""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from .. import policy as P

ANSWERED, EMPTY, FAILED = "answered", "empty", "failed"

#: What an answer row says beside the request's own columns.
ANSWER = "chunk_sha string, status string, attempts int, reason string, text string, start int, end int, confidence double"
ANSWERS = f"doc_id string, field string, rank int, chunk_start int, {ANSWER}"
_REQUEST = ("field", "rank", "chunk_start", "chunk_text")


@dataclass(frozen=True)
class CallLimits:
    """Limits of one task; a job has as many tasks at a time as it has cores or partitions."""

    concurrency: int = P.MODEL_CONCURRENCY
    per_second: float | None = None
    attempts: int = 3
    backoff_seconds: float = 0.5
    timeout_seconds: float | None = None

    def __post_init__(self):
        if self.concurrency < 1 or self.attempts < 1 or (self.per_second is not None and self.per_second <= 0):
            raise ValueError(f"call limits must be positive: {self}")


@dataclass(frozen=True)
class Answer:
    status: str
    attempts: int
    reason: str | None = None
    text: str | None = None
    start: int | None = None
    end: int | None = None
    confidence: float | None = None


def checked(got: dict | None, attempts: int) -> Answer:
    """The answer that a returned value stands for; raises ValueError if it is invalid."""
    if not got:
        return Answer(EMPTY, attempts)
    text, confidence = got.get("text"), float(got.get("confidence", 0.0))
    if not 0.0 <= confidence <= 1.0:
        raise ValueError(f"confidence {confidence} is not between 0 and 1")
    if text is not None and not isinstance(text, str):
        raise ValueError(f"text is of type {type(text).__name__}")
    start, end = (None if got.get(k) is None else int(got[k]) for k in ("start", "end"))
    return Answer(ANSWERED if text else EMPTY, attempts, None, text, start, end, confidence)


class Caller:
    """One extractor with its limits; used by one task."""

    def __init__(self, extractor: Callable, limits: CallLimits):
        self.extractor, self.limits = extractor, limits
        self.is_async = inspect.iscoroutinefunction(extractor) or inspect.iscoroutinefunction(getattr(extractor, "__call__", None))
        self.in_line = not self.is_async and limits.concurrency == 1 and limits.timeout_seconds is None
        self.runner = asyncio.Runner()
        self.threads = None if self.is_async or self.in_line else ThreadPoolExecutor(limits.concurrency)
        self.free_at = 0.0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.threads:
            self.threads.shutdown(wait=False, cancel_futures=True)
        self.runner.close()

    def ask_all(self, requests: list) -> list:
        """Answers to ``(doc_id, field, chunk_start, chunk_text)`` in their order."""
        return self.runner.run(self._all(requests)) if requests else []

    async def _all(self, requests):
        if self.limits.concurrency == 1:
            return [await self._answer(r) for r in requests]
        slots = asyncio.Semaphore(self.limits.concurrency)

        async def one(r):
            async with slots:
                return await self._answer(r)

        return await asyncio.gather(*map(one, requests))

    async def _turn(self):
        """Waits for the next call that the rate allows."""
        if self.limits.per_second is not None:
            now = time.monotonic()
            at = max(now, self.free_at)
            self.free_at = at + 1.0 / self.limits.per_second
            if at > now:
                await asyncio.sleep(at - now)

    async def _call(self, request):
        if self.in_line:
            return self.extractor(*request)
        call = self.extractor(*request) if self.is_async else \
            asyncio.get_running_loop().run_in_executor(self.threads, self.extractor, *request)
        return await asyncio.wait_for(call, self.limits.timeout_seconds)

    async def _answer(self, request) -> Answer:
        reason = None
        for attempt in range(1, self.limits.attempts + 1):
            await self._turn()
            try:
                return checked(await self._call(request), attempt)
            except Exception as e:  # noqa: BLE001 - reported in the answer
                reason = f"{type(e).__name__}: {e}"
            if attempt < self.limits.attempts:
                await asyncio.sleep(self.limits.backoff_seconds * 2 ** (attempt - 1))
        return Answer(FAILED, self.limits.attempts, reason)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def ask(requests: DataFrame, extractor_factory: Callable[[], Callable], limits: CallLimits = CallLimits(),
        partitions: int | None = None) -> DataFrame:
    """One answer row (``ANSWERS``) per request row ``(doc_id, field, rank, chunk_start,
    chunk_text)``. ``partitions`` deals the requests to that many tasks, which bounds the
    calls at a time of the whole job; else tasks follow the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Caller(extractor_factory(), limits) as caller:
            for b in batches:
                doc, field, at, text = (b.column(c).to_pylist() for c in ("doc_id", "field", "chunk_start", "chunk_text"))
                got = caller.ask_all(list(zip(doc, field, at, text)))
                cols = {"chunk_sha": [_sha(t) for t in text], **{k: [getattr(a, k) for a in got] for k in Answer.__dataclass_fields__}}
                own = [b.column(c) for c in ("doc_id", "field", "rank", "chunk_start")]
                yield pa.record_batch(own + [pa.array(v, schema.field(k).type) for k, v in cols.items()], schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(ANSWERS))
    req = requests.select(F.col("doc_id").cast("string").alias("doc_id"), "field", F.col("rank").cast("int").alias("rank"),
                          F.col("chunk_start").cast("int").alias("chunk_start"), "chunk_text")
    return (req.repartition(partitions) if partitions else req).mapInArrow(run, ANSWERS)


def ask_in_rows(df: DataFrame, extractor_factory: Callable[[], Callable], limits: CallLimits = CallLimits(),
                requests: str = "requests") -> DataFrame:
    """``df`` with the array column ``requests`` (field, rank, chunk_start, chunk_text) replaced by
    ``answers``, in place: the other columns pass through as Arrow batches, rows
    without requests as they are, nothing is shuffled."""
    kept = [c for c in df.columns if c != requests]
    item = StructType.fromDDL(f"field string, rank int, chunk_start int, {ANSWER}")
    out = StructType(df.select(*kept).schema.fields).add("answers", ArrayType(item))
    arrow_item = to_arrow_schema(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Caller(extractor_factory(), limits) as caller:
            for b in batches:
                asked = [r or [] for r in b.column(requests).to_pylist()]
                ids = b.column("doc_id").to_pylist()
                flat = [(i, *(r[k] for k in _REQUEST)) for i, rs in zip(ids, asked) for r in rs]
                got = caller.ask_all([(i, field, at, text) for i, field, _, at, text in flat])
                cols = {"field": [r[1] for r in flat], "rank": [r[2] for r in flat], "chunk_start": [r[3] for r in flat],
                        "chunk_sha": [_sha(r[4]) for r in flat], **{k: [getattr(a, k) for a in got] for k in Answer.__dataclass_fields__}}
                items = pa.StructArray.from_arrays([pa.array(v, arrow_item.field(k).type) for k, v in cols.items()],
                                                   fields=[arrow_item.field(k) for k in cols])
                ends = [0]
                for rs in asked:
                    ends.append(ends[-1] + len(rs))
                answers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                yield pa.record_batch([b.column(c) for c in kept] + [answers], names=[*kept, "answers"])

    return df.select(*kept, requests).mapInArrow(run, out)


def answered(answers: DataFrame) -> DataFrame:
    """The candidates of answer rows."""
    return answers.where(F.col("status") == ANSWERED)


def failures(answers: DataFrame) -> DataFrame:
    """The failed requests of answer rows, with attempts and reason."""
    return answers.where(F.col("status") == FAILED).select("doc_id", "field", "rank", "chunk_start", "chunk_sha", "attempts", "reason")
