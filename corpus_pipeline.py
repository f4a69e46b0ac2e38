"""From raw documents to packed training sequences, stage by stage.

Each stage gets the Parquet table that the stage before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.llm.line_dedup import drop_shared_lines
from dqspark.llm.packing import pack
from dqspark.llm.shared import keep, table
from dqspark.llm.simhash import first_of_near_copies
from dqspark.llm.toxicity import train, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5; null texts are scored as empty."""
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; every document stays, an emptied one with an empty text."""
    left = drop_shared_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    return first_of_near_copies(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in windows of 2048: one row per piece of a document."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("packing", packing),
]
# Models and tokenizers have no SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
