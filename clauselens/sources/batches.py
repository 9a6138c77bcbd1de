"""A folder of finished batches: how runs append to a table without counting anything twice.

``log-<n>-<run>`` is what one run wrote, ``base-<n>`` what a compaction made of all batches up
to n. A batch counts once its ``_DONE`` file stands beside its data, which is made
after Spark has committed the write. A run that died is not read, and overwritten when it
is repeated under its name. Batches that a base covers are not read either, so a
compaction that dies before it removes them changes nothing. One writer at a time; the
driver lists as many folders as there were runs since the last compaction.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_DONE = "_DONE"
_NAME = re.compile(r"(log|base)-(\d+)(?:-(.+))?$")


@dataclass(frozen=True, order=True)
class Batch:
    number: int
    kind: str
    run: str | None
    path: str
    done: bool


class Batches:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def all(self) -> list[Batch]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        out = []
        for f in fs.listStatus(p):
            m = _NAME.match(f.getPath().getName())
            if m:
                done = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), _DONE))
                out.append(Batch(int(m[2]), m[1], m[3], f.getPath().toString(), done))
        return sorted(out)

    def counting(self) -> list[Batch]:
        """Done batches that count: the last base and the runs after it."""
        done = [b for b in self.all() if b.done]
        base = max((b for b in done if b.kind == "base"), default=None)
        return ([base] if base else []) + [b for b in done if b.kind == "log" and (base is None or b.number > base.number)]

    def read(self, schema: str, below: str = "") -> DataFrame:
        """The rows of the batches that count, with ``batch``, a number that grows from run to
        run; ``below`` reads a folder of each batch."""
        out = self.spark.createDataFrame([], f"{schema}, batch int")
        for b in self.counting():
            fs, p = self._fs(b.path + below)
            if fs.exists(p):
                part = self.spark.read.schema(schema).parquet(b.path + below)
                out = out.unionByName(part.withColumn("batch", F.lit(2 * b.number + (b.kind == "log"))))
        return out

    def is_done(self, run: str | None) -> bool:
        return run is not None and any(b.run == run and b.done for b in self.all())

    def _write(self, writer: DataFrameWriter, name: str) -> None:
        writer.mode("overwrite").parquet(f"{self.path}/{name}")
        fs, p = self._fs(f"{self.path}/{name}/{_DONE}")
        fs.create(p, True).close()

    def append(self, df: DataFrame, run: str | None = None, *partition_by: str) -> None:
        """``df`` as the batch of ``run``."""
        batches = self.all()
        again = next((b for b in batches if run is not None and b.run == run), None)
        n = again.number if again else max((b.number for b in batches), default=0) + 1
        w = df.write.partitionBy(*partition_by) if partition_by else df.write
        self._write(w, f"log-{n:06d}-{run or uuid.uuid4().hex[:12]}")

    def fold(self, df: DataFrame) -> None:
        """``df``, made of all batches that count, as one base; what it covers is removed."""
        n = max(b.number for b in self.counting())
        self._write(df.write, f"base-{n:06d}")
        for b in self.all():
            if b.number <= n and not (b.kind == "base" and b.number == n):
                fs, p = self._fs(b.path)
                fs.delete(p, True)
