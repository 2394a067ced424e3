"""The corpus pipeline: documents in, token digests out.

Each stage reads what its predecessor kept, from Parquet. All but the last
return the columns of their input.

Defined results: nulls in any column are carried; null and empty texts pass the
classifier unless its intercept rejects them, are copies of each other, have no near
copies, and have size 0, so that the mixture takes them by the rate 0 or not at all
in a source without words; null ids are never near copies and draw by their text;
repeated rows are exact copies; an empty table gives an empty result. A lost
executor costs the tasks it held: what a stage has written lies in the shared
checkpoint folder, and a stage's input is removed once its output is there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contactloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from contactloom.session import prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.clean(docs, table(prepare(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    prepare(spark)
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    prepare(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The learned and sketched stages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    # the checkpoint folder is the one that executors and driver share
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    former = None
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            path = f"{folder}/{place}-{name}"
            docs.write.parquet(path)
            if former:
                _remove(spark, former)
            docs, former = spark.read.parquet(path), path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
