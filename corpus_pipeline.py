"""The corpus pipeline: quality rules, near-dedup, substring dedup, PII, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  Between stages
the rows are written as Parquet and read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import near_dedup, packing, pii, quality, substring_dedup
from sluice.llm._runtime import Scratch, prepare
from sluice.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The scope of the stage that ``run`` runs; a stage that is called alone has a scope that lasts until the application ends.
_SCOPE: ContextVar[Scratch | None] = ContextVar("scope", default=None)


def _begin(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    spark = prepare(docs.sparkSession)
    return docs.select(*COLUMNS), _SCOPE.get() or Scratch(spark)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.clean(_begin(docs)[0]))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(*_begin(docs))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.remove_repeats(*_begin(docs)))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(*_begin(docs)))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_begin(docs)[0], tokenizer_path()).drop("class_size")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("minhash dedup", minhash_dedup),
    ("substring dedup", substring_removal),
    ("pii", pii_redaction),
    ("packing", sequence_packing),
]

#: Probability MinHash, redaction by learned patterns and packing aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's output and scratch tables go once the next one's output is there, the last input with the application."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        output = Scratch(spark)
        with Scratch(spark) as scope:
            token = _SCOPE.set(scope)
            try:
                docs = output.table(stage(spark, docs, sf_dir))
            finally:
                _SCOPE.reset(token)
        if before is not None:
            before.close()
        before = output
    return STAGES[-1][1](spark, docs, sf_dir)
