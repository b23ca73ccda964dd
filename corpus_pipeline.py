"""The corpus pipeline: quality selection, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import scratch, table
from docloom.llm.decontaminate import decontaminated
from docloom.llm.mixing import mixture
from docloom.llm.quality import kept
from docloom.llm.queries import quality_weights, vocabulary
from docloom.llm.simhash import near_duplicates_removed
from docloom.llm.tokenfiles import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go, those without words among them.

    Training sees the rated documents still in ``docs``.  Null ids are judged like others and equal rows alike; columns named like the
    scores keep their values.  Without ratings of two grades, or without rows, nothing goes.
    """
    return kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class of near copies the document with the smallest id stays.

    Fingerprints within four bits give the first links, each checked on whole sets; a prefix filter adds the copies that they miss.
    Texts without words are one class.  Of rows with equal id and text one stays; rows with a null id all stay.
    """
    return near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go.

    Null texts hold nothing, and an empty benchmark takes nothing; null ids and equal rows are judged by their text.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row for each time that the mix takes a document.

    The null source is a source.  Equal rows share a key, so that each comes as often as the other; rows of one id with different texts are
    drawn apart.  Weights come from the ratings, 1 without one.
    """
    return mixture(docs, quality_weights(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token files of the mix, and their documents read back.

    A null text is empty and has its end id; null ids come first, equal ids by text.  No rows: no files and no rows.
    """
    return token_files(spark, docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Training and hashing decide here, so no SQL gives the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
