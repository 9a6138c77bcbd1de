"""A log of model answers that outlives a run.

One key is (model, field, sha256 of the chunk), its state one of

* ``answered`` or ``empty``: settled, never asked again;
* ``failed`` with the number of attempts: asked again by the next run, until ``max_attempts``.

A run writes each key that it asked once, as a batch (``sources.batches``): a run that died
leaves nothing that counts, a run repeated under its name asks nothing, tasks that Spark
runs again are the writer's matter, and of several rows of one key in a batch one
counts. ``compact`` folds all batches into one row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.batches import Batches
from . import calls
from .calls import ANSWERED, EMPTY, CallLimits

KEY = ["model", "field", "chunk_sha"]
SCHEMA = ("model string, field string, chunk_sha string, status string, attempts int, reason string, "
          "text string, start int, end int, confidence double")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class AnswerLog:
    def __init__(self, spark: SparkSession, path: str, model: str, max_attempts: int | None = None):
        self.batches, self.model, self.max_attempts = Batches(spark, path), model, max_attempts

    # ------------------------------------------------------------ state

    def state(self) -> DataFrame:
        """One row per key: the settled answer if there is one (the first), else the last failure;
        ``attempts`` over all runs."""
        settled = F.col("status").isin(ANSWERED, EMPTY)
        # At most one row per key and batch counts.
        first = Window.partitionBy(*KEY, "batch").orderBy(F.desc(settled), "status", "text", "reason")
        once = self.batches.read(SCHEMA).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        order = F.when(settled, F.lit(1 << 30) - F.col("batch")).otherwise(F.col("batch"))
        best = F.max_by(F.struct("status", "reason", "text", "start", "end", "confidence"), order).alias("a")
        return once.groupBy(*KEY).agg(best, F.sum("attempts").cast("int").alias("attempts")).select(*KEY, "a.*", "attempts").select(*COLUMNS)

    def settled(self) -> DataFrame:
        """Keys that are not asked (again)."""
        done = F.col("status").isin(ANSWERED, EMPTY)
        if self.max_attempts is not None:
            done = done | (F.col("attempts") >= self.max_attempts)
        return self.state().where(done & (F.col("model") == self.model)).select(*KEY)

    def failures(self) -> DataFrame:
        """Keys whose every attempt failed so far, with the number of attempts and the last reason."""
        return self.state().where(F.col("status") == calls.FAILED).select(*KEY, "attempts", "reason")

    # ------------------------------------------------------------ runs

    def keyed(self, ranked: DataFrame) -> DataFrame:
        return ranked.select("*", F.sha2(F.col("chunk_text"), 256).alias("chunk_sha"), F.lit(self.model).alias("model"))

    def ask_missing(self, ranked: DataFrame, extractor_factory: Callable[[], Callable], limits: CallLimits = CallLimits(),
                    partitions: int | None = None, run: str | None = None) -> None:
        """Asks what is not settled, equal chunks once, and appends the answers as the batch of ``run``."""
        if self.batches.is_done(run):
            return
        todo = self.keyed(ranked).join(self.settled(), KEY, "left_anti").dropDuplicates(KEY)
        # Asked at offset 0, so answers are relative to the chunk.
        got = calls.ask(todo.withColumn("chunk_start", F.lit(0)), extractor_factory, limits, partitions)
        self.batches.append(got.withColumn("model", F.lit(self.model)).select(*COLUMNS), run)

    def lookup(self, ranked: DataFrame) -> DataFrame:
        """Candidates of the requests that the log answers."""
        known = self.state().where((F.col("status") == ANSWERED) & (F.col("model") == self.model))
        hits = self.keyed(ranked).drop("chunk_text").join(known.drop("attempts", "reason", "status"), KEY)
        shift = F.col("chunk_start")
        return hits.select("doc_id", "field", F.col("rank").cast("int").alias("rank"), F.col("chunk_start").cast("int").alias("chunk_start"),
                           "chunk_sha", "text", (F.col("start") + shift).cast("int").alias("start"),
                           (F.col("end") + shift).cast("int").alias("end"), "confidence")

    def lookup_or_call(self, ranked: DataFrame, extractor_factory, partitions: int | None = None,
                       limits: CallLimits = CallLimits(), run: str | None = None) -> DataFrame:
        """Candidates of all requests; what the log does not settle is asked first."""
        self.ask_missing(ranked, extractor_factory, limits, partitions, run)
        return self.lookup(ranked)

    def compact(self) -> None:
        """Folds the batches into one base of one row per key."""
        if len(self.batches.counting()) > 1:
            self.batches.fold(self.state())
