"""Training-data pipeline over the ``documents`` table: five stages, each one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet to the session's shared checkpoint folder and read again as the next stage's
``docs``, so a lost executor never goes back past the last stage. All stages but the
last return the columns of ``documents``.

1. ``language_id``: drops documents whose language the compression classifier rejects
   (no letters, or too narrow a margin).
2. ``quality_rules``: drops documents that the base rules or the isolation forest reject.
3. ``near_dedup``: keeps one document of each near-duplicate group (five-word shingles,
   similarity of 0.8 or more).
4. ``decontamination``: drops documents with a benchmark window.
5. ``sentencepiece``: encodes what is left: ids, N-best scores and round trip.

An empty table passes through as an empty result; null texts end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselens.llm import decontam, langid, neardup, pieces, quality_rules
from clauselens.llm.common import prepare, written
from clauselens.llm.queries import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language."""
    return langid.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the limit comes from the ``labels`` table."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the ``benchmark`` table."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and N-best scores of every document."""
    return pieces.encode(docs, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Compression, isolation forest and piece lattice are beyond SQL; tests/llm checks the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
