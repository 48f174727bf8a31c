"""A corpus pipeline: five stages, each by one of the training-data operators, over all that the stage before it kept.

Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars). The runner writes a
stage's rows as Parquet and reads them again for the next one, so a stage can be taken up anew by itself. Stages with
Python workers limit the bytes of the session's Arrow batches, if the user has not (``small_batches``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.llm import mixing, packing, secrets, simhash, toxicity
from lumispark.llm.common import shared_folder, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are likelier toxic than not; null and empty texts are scored like others."""
    small_batches(spark)
    scored = toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more; the one with the smallest id stays.

    Texts without words are equal to each other. Of rows that agree in id and words one stays."""
    small_batches(spark)
    return simhash.near_unique(docs.select(*COLUMNS)).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret that the scan reports replaced by a mark."""
    found = secrets.scan(docs.select(*COLUMNS))
    return _documents(found.withColumn("text", secrets.redact(F.col("text"), F.col("spans"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time that it reads them."""
    return _documents(mixing.take(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: a row for each, of all documents that the mix holds."""
    small_batches(spark)
    return packing.pack_harmonic(docs.select("doc_id", "text"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Toxicity is a fitted model, the fingerprints are bit sums of hashes, ids come from a tokenizer: SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
