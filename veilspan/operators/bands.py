"""Bands, policies and messages as tables: every value meets the one band of its key that holds it.

A band table has `low`, `high` (NULL: open), `low_incl`, `high_incl`, optional key columns and whatever a match should
bring (a name, a message, a treatment). Bands of a key must not overlap; gaps are allowed and give NULL.
NULL values and values of unknown keys give NULL, a NULL key meets a NULL key, NaN lies above every number.
"""
from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import let

EDGES = ("low", "high", "low_incl", "high_incl")
FINE = 16


def band_faults(bands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows that can't be used, with `fault`: `empty` (nothing lies in it) or `overlap` (with the band before it).

    Bands are put in order per key; two of a key overlap exactly if two neighbours do."""
    order = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(F.col("low").asc_nulls_first(), F.col("low_incl").desc(), F.col("high").asc_nulls_last())
    before = F.lag(F.struct("high", "high_incl")).over(order)
    d = bands.withColumn("__before", before)
    last, low = F.col("__before.high"), F.col("low")
    empty = (low > F.col("high")) | ((low == F.col("high")) & ~(F.col("low_incl") & F.col("high_incl")))
    apart = (low > last) | ((low == last) & ~(F.col("low_incl") & F.col("__before.high_incl")))
    overlap = F.col("__before").isNotNull() & ~F.coalesce(apart, F.lit(False))
    fault = F.when(F.coalesce(empty, F.lit(False)), "empty").when(overlap, "overlap")
    return d.withColumn("fault", fault).drop("__before").where(F.col("fault").isNotNull())


def checked(bands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`bands`, or a ValueError that names some of its faults."""
    bad = band_faults(bands, keys).limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['fault']}: {r.asDict()}" for r in bad))
    return bands


def cell_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most `value`, in two steps of some FINE comparisons."""
    coarse, fine = F.array(*map(F.lit, cuts[::FINE])), F.array(*map(F.lit, cuts))
    count = lambda a: F.size(F.filter(a, lambda c: c <= value))
    return let(count(coarse), lambda i: F.when(i == 0, 0).otherwise((i - 1) * FINE + count(F.slice(fine, (i - 1) * FINE + 1, FINE))))


def with_band(rows: DataFrame, value: str, bands: DataFrame, keys: tuple[str, ...] = (), add: tuple[str, ...] = ("band",), few: int = 1000, most_cells: int = 256) -> DataFrame:
    """Every row, once, with the columns `add` of its band.

    Up to `few` bands (counted first) travel to the rows. A larger table is cut into cells at quantiles of its lower edges,
    so that a key has some eight bands in a cell; a band stands in every cell that it touches, a value in one, and the two
    meet by an equi-join on (keys, cell), whichever side Spark then finds small. A key with very many rows is thereby spread
    over its cells as well."""
    checked(bands, keys)
    v = F.col("__value")
    right = bands.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(e).alias(f"__{e}") for e in EDGES], F.struct(*add).alias("__add"))
    left = rows.withColumn("__value", F.col(value).cast("double"))
    above = F.col("__low").isNull() | (v > F.col("__low")) | ((v == F.col("__low")) & F.col("__low_incl"))
    below = F.col("__high").isNull() | (v < F.col("__high")) | ((v == F.col("__high")) & F.col("__high_incl"))
    on = reduce(and_, [left[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], v.isNotNull() & above & below)
    n = bands.count()
    if n <= few:
        right = F.broadcast(right)
    else:
        of_key = n / (bands.select(*keys).distinct().count() if keys else 1)
        cells = max(1, min(most_cells, math.ceil(of_key / 8)))
        cuts = sorted(set(bands.approxQuantile("low", [i / cells for i in range(1, cells)], 0.001))) if cells > 1 else []
        if cuts:
            first = F.when(F.col("__low").isNull(), 0).otherwise(cell_of(F.col("__low"), cuts))
            last = F.when(F.col("__high").isNull(), len(cuts)).otherwise(cell_of(F.col("__high"), cuts))
            right = right.withColumn("__cell", F.explode(F.sequence(first, last)))
            left = left.withColumn("__at", cell_of(v, cuts))
            on = on & (F.col("__at") == F.col("__cell"))
    return left.join(right, on, "left").select(*rows.columns, *[F.col("__add")[a].alias(a) for a in add])


def applied(rows: DataFrame, policy: list[tuple[str, str]], treatments: dict) -> DataFrame:
    """Columns by policy rows (column, treatment), read at plan time: `drop` leaves a column out, `keep` leaves it as it
    is, any other name is looked up in `treatments` (name → function of a column). Columns without a row are left out."""
    said = dict(policy)
    if len(said) < len(policy):
        raise ValueError("a column has two treatments")
    unknown = {t for t in said.values()} - {"keep", "drop", *treatments}
    missing = set(said) - set(rows.columns)
    if unknown or missing:
        raise ValueError(f"unknown treatments {sorted(unknown)}, columns {sorted(missing)}")
    how = {"keep": lambda c: c, **treatments}
    return rows.select(*[how[said[c]](F.col(c)).alias(c) for c in rows.columns if said.get(c, "drop") != "drop"])
