"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe, cotraining, linedrop, mixing, setsketch, simhash
from veilspan.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotraining.keep_good(docs, cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go (the first of each stays); n_chars follows the text."""
    cut = linedrop.drop_recurring(docs)
    changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.select(*[changed if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: one document of each component of fingerprints within 4 bits stays. An exact check follows: of those that share
    five-word shingles at Jaccard 0.8 or more one stays, too, since 4 of 64 bits find a twelfth of such pairs.

    Both name the smallest row of each of their components in all of `docs`; a document stays if both name it, so no two that
    either links stay together. The names meet first, so the texts travel once."""
    stay = written(simhash.representatives(docs, width=4, bits=4), "simhash-stay")
    both = written(setsketch.representatives(docs, width=5, percent=80).join(stay, ["__id", "__th"], "left_semi"), "stay")
    return simhash.only(docs, both).dropDuplicates(["__id", "__th"]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at shares that follow the root of their size, by replication, in shuffled order."""
    return mixing.replicate(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, decoded once to see that they give the text again."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("mixing", mixture),
    ("byte-level bpe", encoding),
]
# the classifier and the fingerprints' hash have no SQL form; tests/llm hold the run against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
