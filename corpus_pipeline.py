"""A corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return
the columns of documents. Those with Python functions begin by having the executors give back the heap that they no
longer need. A null in any column, an empty or repeated row, and an empty table are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urkunde.llm import bpe_codec, exact_dedup, mixture, near_dedup, quality_mil
from urkunde.llm.common import read, remove, shrink, work_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labels, does not reject; with all their columns as they are."""
    shrink(spark)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "doc_id", "text")
    judged = quality_mil.classify(packed, read(spark, sf_dir, "labels"), F.lit(False), keep=["_all"])
    return judged.filter("predicted = 1").select("_all.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    shrink(spark)
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks for."""
    return mixture.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and ids."""
    shrink(spark)
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again. A stage's
    folder goes when the next one's is written; the last one stays for the result."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = work_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            remove(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
