"""From raw documents to packed training sequences: five stages, each a corpus operator, each on all that the one before kept.

Every stage takes null ids, null, empty and very long texts, repeated rows and ids, and an empty table (it gives an empty
one back); the first four return the columns of documents, so extra columns end here. Each says below what it does with
ties and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import containment, importance, jaccard, packing, personal
from trackloom.llm.common import read, small_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling selects; toxic documents and those below the quality cut go.

    A document is judged by its id and text: repeated rows stay or go together, rows without an id are judged like others,
    null and empty texts weigh 0. Equal keys at the cut stay together. Without labels every document stays.
    """
    return importance.keep_selected(docs, read(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the least id, a null id last, ties by a hash of the text.

    Repeated rows of the kept id and text stay once. Documents without words link with nothing and stay, all of them.
    """
    return jaccard.keep_representatives(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; equal texts stay or go together, null and empty ones stay."""
    return containment.drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; all rows stay, repeated ones with equal results, null texts as null. Spans that overlap become one."""
    return personal.redact(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; repeated rows are packed one by one, a null or empty text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("pack", pack)]

#: SQL expresses neither the resampling nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is written and read again as the next one's docs."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
