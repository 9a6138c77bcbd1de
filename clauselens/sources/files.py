"""File sources and sinks.

* text corpora: one document per file (``wholetext``), id = file name;
* binary ingest: ``binaryFile`` with recursive lookup and a glob, a
  converter hook over Arrow batches, flat document names, skip-existing by
  left-anti join, short-text flags and a per-file error split;
* record sinks/scans: JSON and CSV datasets written by Spark (one dataset,
  not one file per document); Spark's file index already hides ``_``-files.

Scratch output goes under the session's checkpoint folder (shared storage on
a cluster), never a machine-local folder.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import policy as P
from ..functions.text import py_strip, squash
from ..session import ensure_checkpoint_dir

CONVERTED = "doc_id string, source_path string, text string, error string"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------- S1/S2

def scan_text(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``(doc_id, text, char_count)``, one row per file.

    Invalid UTF-8 is replaced by U+FFFD when decoding and then dropped, the
    nearest Spark form of decoding with ``errors='ignore'``.
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(path))
    text = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "\ufffd", "")
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.length("text").alias("char_count"))


def write_texts(docs: DataFrame, path: str) -> str:
    """``(doc_id, text)`` as a text corpus: one file per document, in a folder that names its
    id. A null text becomes an empty file. Spark's writer ends the file with a newline."""
    # Each task commits its own files (version 2): the driver would rename them one after another.
    # The path is fresh, read after the job only, and a task that runs again writes the same names.
    (docs.repartition("doc_id").select("doc_id", "text").write
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc_id").text(path))
    return path


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text, char_count)`` of a corpus of ``write_texts``, whatever the id's type."""
    t = spark.read.schema("value string, doc_id string").text(path, wholetext=True)
    return t.select("doc_id", F.regexp_replace("value", r"\n\z", "").alias("text")).select("*", F.length("text").alias("char_count"))


def short_text_flag(text: Column, min_chars: int = P.SHORT_TEXT_CHARS) -> Column:
    """Trimmed length below ``min_chars``."""
    return F.length(py_strip(F.coalesce(text, F.lit("")))) < min_chars


# ---------------------------------------------------------------- S3-S5, S7

def flat_name(rel_path: Column) -> Column:
    """``a/b/f.pdf`` -> ``a__b__f.txt`` (folders joined by ``__``, file stem)."""
    rel = F.regexp_replace(rel_path, "^/+", "")
    folders = F.regexp_extract(rel, "^(.*)/[^/]*$", 1)
    name = F.regexp_extract(rel, "([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    joined = F.when(folders != "", F.concat(F.replace(folders, F.lit("/"), F.lit("__")), F.lit("__"), stem)
                    ).otherwise(stem)
    return F.concat(joined, F.lit(".txt"))


def url_path(url: Column) -> Column:
    """Path part of a URL (no query, no fragment)."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list:
    """Names of the folders directly under a path, sorted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def ingest(spark: SparkSession, root: str, parts, converter_factory: Callable[[], Callable],
           glob: str = "*.pdf") -> DataFrame:
    """S3: convert every matching file under the chosen parts; missing parts
    are skipped; fails when nothing is found. Output ``CONVERTED`` rows."""
    found = [d for d in (os.path.join(root, part) for part in parts) if path_exists(spark, d)]
    if not found:
        raise FileNotFoundError(f"no input parts found under {root}")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(found).select("path", "content"))
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no {glob} files found under {root}")
    # Path relative to the root, starting with the part folder.
    rel = F.regexp_extract("path", "/((?:" + "|".join(re.escape(part) for part in parts) + ")/.*)$", 1)
    named = files.select(flat_name(rel).alias("doc_id"), F.col("path").alias("source_path"), "content")
    return convert(named, converter_factory)


def convert(files: DataFrame, converter_factory: Callable[[], Callable]) -> DataFrame:
    """``(doc_id, source_path, content)`` -> text or error per file; a
    failing file is reported, the run continues."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv = converter_factory()
        for b in batches:
            texts, errors = [], []
            for content in b["content"]:
                try:
                    t, err = conv(content)
                except Exception as e:  # noqa: BLE001 - reported per file
                    t, err = None, f"{type(e).__name__}: {e}"
                texts.append(t)
                errors.append(err)
            yield pd.DataFrame({"doc_id": b["doc_id"], "source_path": b["source_path"],
                                "text": texts, "error": errors})

    return files.mapInPandas(run, CONVERTED)


def skip_existing(incoming: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop documents already present in the target (left-anti join)."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def split_errors(converted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(converted documents, failures)."""
    return (converted.where(F.col("error").isNull()).drop("error"),
            converted.where(F.col("error").isNotNull()).select("doc_id", "source_path", "error"))


# Tags whose content is not text.
HTML_DROP_RX = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>"


def html_to_text(html: Column) -> Column:
    """Tag-stripping converter expression (the built-in converter for HTML)."""
    return squash(F.regexp_replace(html, HTML_DROP_RX, " "))


def html_converter():
    """Converter hook for HTML bytes (used when pages arrive as files)."""
    drop = re.compile(r"<script\b.*?</script>|<style\b.*?</style>|<[^>]+>", re.I | re.S)

    def conv(content: bytes):
        html = bytes(content).decode("utf-8", errors="ignore")
        if "<body" not in html.lower():
            return None, "no body"
        return " ".join(drop.sub(" ", html).split()), None

    return conv


# ---------------------------------------------------------------- S8-S16

def write_json(df: DataFrame, path: str) -> str:
    """One JSON-lines dataset."""
    df.write.mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; nested columns are written as JSON text."""
    flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name)
                       for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON dataset with an explicit schema; ``_``-prefixed files are
    ignored by Spark's file index; empty DataFrame if the path is absent (S16)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV artifact with header; empty with the schema if absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
