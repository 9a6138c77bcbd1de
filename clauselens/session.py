"""Session defaults and lineage cutting.

Cluster settings win: nothing here overrides a value the session already has.
``spark.checkpoint.dir`` is read from the session; a scratch folder is set only
when it is missing (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "clauselens", extra: dict | None = None) -> SparkSession:
    """A session for local runs: UI off, AQE on, UTC."""
    b = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set engine defaults that the session does not define yet and make the
    package importable on executors."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to executors (``addPyFile``) once per context,
    so Python hooks (pandas UDFs, ``mapInPandas``) can import it."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="clauselens-pkg-"), "clauselens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local master may do without one (tests, trials)
    and gets a scratch folder; on a cluster a folder that all executors share must be set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="clauselens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize_dealt(df: DataFrame, mode: str = "checkpoint") -> DataFrame:
    """``materialize`` that keeps how ``df`` is dealt, so that joins and groupings by its keys need
    no exchange afterwards. A checkpoint keeps the partitioning of its physical plan, and an
    adaptive plan has none to tell, so this one step is planned without."""
    if mode != "checkpoint":
        return materialize(df, mode)
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key, None)
    conf.set(key, "false")
    try:
        return materialize(df, mode)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def materialize(df: DataFrame, mode: str = "persist") -> DataFrame:
    """Reuse an expensive intermediate.

    ``persist``: cache (memory, spill to disk); lost blocks are recomputed from
    lineage. ``checkpoint``: write to the session's shared checkpoint folder and
    cut lineage (reliable, survives executor loss without recomputation).
    """
    if mode == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
