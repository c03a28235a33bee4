"""Mixing sources to target weights by Poisson replication.

A source of size s and target share w gets the mean repetition rate λ = w · T / s, with T the size of the
mixture. Every document draws its number of copies from Poisson(λ) by inverting the distribution at a
uniform number that seed and identifier fix, copies are exploded and the result is dealt over all
partitions and ordered there by a hash of (seed, identifier, copy): a global shuffle in one exchange.

Rates above `whole` are split: floor(λ / whole) · whole certain copies and a draw for the rest, so the
distribution's table stays short while the mean is kept.

NULL identifiers draw as the text '', NULL sources form a source of their own, NULL and empty texts have
size 0; a source whose texts are all empty gets rate 1. Repeated rows of one identifier draw alike.
An empty table gives an empty mixture.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import written

WHOLE = 8
SOURCES = 100_000
TERMS = 40  # P(X ≥ 40) for a rate of 8 is below 1e-15


def uniform(seed: int, *parts: Column) -> Column:
    """The first 48 bits of an MD5 digest, in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """(source, rate). Without `weights` a source's share follows its size to the power `alpha`; with
    them, sources not named get none."""
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    sizes = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        w = F.pow(F.col("size"), F.lit(alpha))
    else:
        w = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    shares = sizes.withColumn("w", w)
    total = shares.agg(F.sum("w").alias("w"), F.sum("size").alias("size")).first()  # two numbers
    whole_w, whole_size = F.lit(float(total["w"] or 1.0)), F.lit(float(total["size"] or 0))
    return shares.select("source", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.col("w") / whole_w * whole_size / F.col("size")).alias("rate"))


def poisson(rate: Column, u: Column) -> Column:
    """Smallest k whose distribution function exceeds u."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(s, i):
        p = s["p"] * rate / (s["k"] + 1)
        return F.when(u < s["cdf"], s).otherwise(F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["k"]


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 7) -> DataFrame:
    """Every column of `docs` once per copy, with `mix_copy` (from 0), `mix_copies` and `mix_order` (each
    unless `docs` has a column of that name)."""
    per_source = written(rates(docs, weights, alpha).select(F.col("source").alias("__of"), F.col("rate").alias("__rate")), "rates")
    if per_source.count() <= SOURCES:  # a size that is known; more sources meet their rows by a shuffle
        per_source = F.broadcast(per_source)
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"))
    certain = F.floor(F.col("__rate") / WHOLE) * WHOLE
    drawn = packed.join(per_source, F.col("__source").eqNullSafe(F.col("__of")))
    counted = drawn.withColumn("mix_copies", (certain + poisson(F.col("__rate") - certain, uniform(seed, F.col("__id")))).cast("int"))
    copies = counted.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    mixed = copies.withColumn("mix_order", uniform(seed + 1, F.col("__id"), F.col("mix_copy")))
    extra = [c for c in ("mix_copies", "mix_copy", "mix_order") if c not in docs.columns]
    dealt = mixed.select("__doc", "mix_copies", "mix_copy", "mix_order").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mix_order")
    return dealt.sortWithinPartitions("mix_order").select(*[F.col("__doc")[c].alias(c) for c in docs.columns], *extra)
