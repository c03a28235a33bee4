"""Exact duplicates: sorted runs of digests, merged as a tree.

Every input partition sorts the digests of its rows and folds equal ones: a run with one entry per digest, its best
identifier and a count. Runs are then merged in binomial rounds: in a round the runs of `fan_in` neighbouring nodes go to
one node, are merged there in key order (the exchange hands over sorted stretches, which Spark's external sort
merges and spills) and one streaming pass again keeps one entry per digest, so every level is a sorted run and a
text with a third of all rows travels as one entry per run and never as rows. Digests are dealt over shards first:
a node is (shard, position), and the last round leaves one sorted run per shard rather than one for everything.

An entry is identified by SHA-256, byte length and an independent 64-bit hash; entries only merge when
all three agree, at every level.

NULL texts count as empty, NULL identifiers lose against any other. Rows that repeat identifier and
text alike share their fate. An empty table gives no rows; other columns are never read.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import ids_and_texts

KEY = ["digest", "n_bytes", "check"]
RUN = "shard int, node int, digest binary, n_bytes int, check long, best long, n long"


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """Digest entries, their shard and the partition that made them; the texts stay behind."""
    return (
        ids_and_texts(docs)
        .select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"))
        .withColumn("shard", F.pmod(F.col("check"), F.lit(shards)).cast("int"))
    )


def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries → one per (shard, node, KEY): the first identifier and the sum of the counts. Holds one batch."""
    held = None  # the last entry of the batch before; the next batch may go on with it
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for name in ("shard", "node", *KEY):
            c = t[name].combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        total = np.add.reduceat(t["n"].to_numpy(), start)
        t = t.take(pa.array(start)).set_column(t.num_columns - 1, b.schema.field("n"), pa.array(total, pa.int64()))
        yield from t.slice(0, t.num_rows - 1).to_batches()
        held = t.take(pa.array([t.num_rows - 1]))
    if held is not None:
        yield from held.to_batches()


def merged(entries: DataFrame, keep: str) -> DataFrame:
    """The sorted runs of every node of this level, from entries that already lie in its partition."""
    best = F.col("best").desc_nulls_last() if keep == "largest" else F.col("best").asc_nulls_last()
    return entries.sortWithinPartitions("shard", "node", *KEY, best).mapInArrow(folded, RUN)


def levels(docs: DataFrame, keep: str = "largest", fan_in: int = 8) -> list[DataFrame]:
    """The runs of the input partitions and those after every round."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs(docs, shards)
    nodes = max(1, rows.rdd.getNumPartitions())
    first = rows.select("shard", F.spark_partition_id().alias("node"), *KEY, F.col("doc_id").alias("best"), F.lit(1).cast("long").alias("n"))
    out = [merged(first, keep)]
    for _ in range(max(1, math.ceil(math.log(nodes, fan_in)))):
        up = out[-1].withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        out.append(merged(up.repartition("shard", "node"), keep))
    return out


def tree_merge(docs: DataFrame, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One entry per distinct text: KEY, best identifier, number of rows."""
    return levels(docs, keep, fan_in)[-1].select(*KEY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """Every row: doc_id, keep_id, group_size, kept, text_sha256."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = tree_merge(docs, keep, fan_in)
    return (
        runs(docs, shards)
        .join(best, KEY)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )
