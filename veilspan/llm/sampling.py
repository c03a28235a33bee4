"""Bounded, repeatable samples of labelled rows for fitting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import spread_hash, written


def bounded(rows: DataFrame, by: Column, per_class: int, total: int | None = None) -> DataFrame:
    """About `per_class` rows of each value of `by`, chosen by a hash of doc_id; with `total`, fewer of each (one at
    least) where the values are so many that the rows would exceed it; never more than twice the sum. Adds `class`."""
    keyed = rows.withColumn("class", by).where(F.col("class").isNotNull())
    counts = written(keyed.groupBy("class").count(), "classes")
    classes = counts.count()
    if not classes:
        return keyed.limit(0)
    if total:
        per_class = max(1, min(per_class, total // classes))
    share = counts.select("class", F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("count")).alias("__share"))
    some = keyed.join(F.broadcast(share), "class").where(spread_hash(F.lit("sample"), F.col("doc_id")) < F.col("__share"))
    return some.select(*keyed.columns).limit(2 * per_class * classes)
