"""Session defaults and small helpers shared by every job."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "veilspan", cores: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster pass your own session instead."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give regex-heavy work enough tasks when the input arrives in very few splits.

    Only the number of splits counts, which the planned scan knows without listing its files to Python. A
    large input has more splits than cores and nothing is shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def let(value: Column, body) -> Column:
    """Bind `value` once per row and use it many times inside `body`.

    Catalyst may inline an aliased expression into every use, also into a lambda that runs once per
    array element; a one-element transform evaluates it exactly once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on an expensive derived column without letting the predicate travel down.

    A plain `where` is pushed through the projections below it, which would evaluate the whole
    chain of higher-order functions a second time inside the filter. A generator stops it.
    """
    d = df.select("*", F.explode_outer(F.when(cond, F.array(F.lit(1)))).alias("__ok"))
    return d.where(F.col("__ok").isNotNull()).drop("__ok")


def inline_rows(df: DataFrame, keys: list[str], structs: Column, probe: str) -> DataFrame:
    """Array of structs → rows; the outer form keeps Spark from pushing "array not empty" down.

    `probe` is a field that is never NULL in a real element.
    """
    return df.select(*keys, F.inline_outer(structs)).where(F.col(probe).isNotNull())
