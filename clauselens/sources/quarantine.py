"""Ingest with a quarantine (S3, S5, S7): converted texts and failures as two tables.

A run converts the files that are not converted yet and writes texts and failures in one
pass, as the two partitions of its batch (``batches``). The next run skips what is
converted and tries failed files again, up to ``max_attempts``; a file that is converted then
leaves the quarantine. A run that died leaves nothing behind that counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files as FS
from .batches import Batches

CONVERTED, FAILED = "converted", "failed"
_ROW = "doc_id string, source_path string, text string, short_text boolean, error string"


class Quarantine:
    def __init__(self, spark: SparkSession, path: str, max_attempts: int | None = None):
        self.batches, self.max_attempts = Batches(spark, path), max_attempts

    def converted(self) -> DataFrame:
        """``(doc_id, source_path, text, short_text, batch)``, one row per converted document."""
        return self.batches.read(_ROW, f"/status={CONVERTED}").drop("error").dropDuplicates(["doc_id"])

    def failures(self) -> DataFrame:
        """``(doc_id, source_path, error, attempts)`` of the documents that no run converted, with the last error."""
        f = self.batches.read(_ROW, f"/status={FAILED}").dropDuplicates(["doc_id", "batch"])
        f = f.groupBy("doc_id").agg(F.max_by("source_path", "batch").alias("source_path"), F.max_by("error", "batch").alias("error"),
                                    F.count(F.lit(1)).alias("attempts"))
        return FS.skip_existing(f, self.batches.read(_ROW, f"/status={CONVERTED}")).select("doc_id", "source_path", "error", "attempts")

    def ingest(self, files: DataFrame, converter_factory: Callable[[], Callable], run: str | None = None, retry: bool = True) -> None:
        """One run over ``files (doc_id, source_path, content)``; without ``retry`` failed files are skipped too."""
        if self.batches.is_done(run):
            return
        todo = FS.skip_existing(files, self.batches.read(_ROW, f"/status={CONVERTED}"))
        if not retry:
            todo = FS.skip_existing(todo, self.failures())
        elif self.max_attempts is not None:
            todo = FS.skip_existing(todo, self.failures().where(F.col("attempts") >= self.max_attempts))
        got = FS.convert(todo, converter_factory)
        status = F.when(F.col("error").isNull(), CONVERTED).otherwise(FAILED)
        rows = got.select("doc_id", "source_path", "text", FS.short_text_flag(F.col("text")).alias("short_text"), "error", status.alias("status"))
        self.batches.append(rows, run, "status")
