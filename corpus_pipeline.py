"""The corpus pipeline: filter, clean, deduplicate, mix and pack documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.llm import lines, minhash, mixing, packing, quality
from porespark.llm.queries import END_ID, WORD_VOCABULARY
from porespark.plans.lineage import checkpoint_dir

SHINGLE_WORDS, PERCENT = 5, 80
# A line goes at 0.5 % of its source's pages, in sources of under 1,000 pages at five of them.
LINE_RATIO, LINE_PAGES, LINE_MOST = 0.005, 5, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose posterior is good; null and empty texts are judged like any, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, labels, F.col("source"), F.col("lang"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are boilerplate of their source; pages that are mostly such lines are left to the next stage.

    Every row stays, null texts stay null, a null source is a source.
    """
    cleaned = lines.line_dedup(docs, F.col("source"), ratio=LINE_RATIO, min_pages=LINE_PAGES, most=LINE_MOST, by_text=True)
    return cleaned.select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; rows that repeat an id stay together.

    Documents without an id or without words are in no group and stay.
    """
    found = minhash.near_duplicates(docs, k=SHINGLE_WORDS, percent=PERCENT)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the target mix of sources, repeating and cutting documents as it asks.

    Texts without words take nothing of a budget; a source that has no other texts goes.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into training sequences; one row per piece, null and empty texts as the end id alone."""
    return packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the signatures and the tokenizer are beyond SQL: tests hold every stage of the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written to the shared folder and read again.  Empty tables give no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for nth, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{nth}")
        docs = spark.read.parquet(f"{folder}/{nth}")
    return docs
