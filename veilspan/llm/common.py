"""Small helpers of the training-data operators."""
from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with NULL texts as empty; whatever else the table carries is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one on this machine if the session runs on this machine
    alone (tests); on a cluster that is an error, since executors could not see it."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends there and survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A NULL id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) == 0


def spread_hash(*cols: Column) -> Column:
    """Uniform in [0, 1), fixed by the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
