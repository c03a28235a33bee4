"""Market cache and market comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.functions.text import normalize, squeeze


def cache_key(title: Column, location: Column, bucket: Column) -> Column:
    """Accents, case and blanks do not matter."""
    return F.concat_ws("|", squeeze(normalize(title)), squeeze(normalize(location)), bucket)


def latest_entries(cache: DataFrame, key: str, saved_at: str) -> DataFrame:
    """Newest entry per key (partial max before the shuffle, no group is sorted)."""
    rest = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(saved_at, *[c for c in rest if c != saved_at])).alias("_e")).select(key, "_e.*")


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, now: str, saved_at: str) -> DataFrame:
    """Left join to the newest entry not older than the time to live; `hit` tells which found one."""
    e = latest_entries(cache, key, saved_at)
    age = F.col(now).cast("timestamp") - F.col(saved_at).cast("timestamp")
    fresh = age <= F.expr(f"INTERVAL {V.CACHE_TTL_DAYS} DAYS")
    j = requests.join(e, key, "left")
    kept = [F.when(fresh, F.col(c)).alias(c) for c in e.columns if c != key]
    return j.select(*requests.columns, *kept, F.coalesce(fresh, F.lit(False)).alias("hit"))


def cache_misses(requests: DataFrame, cache: DataFrame, key: str, now: str, saved_at: str) -> DataFrame:
    """Keys that must be asked for: no fresh entry; each key once."""
    e = cache.groupBy(F.col(key).alias("_k")).agg(F.max(saved_at).alias("_at"))
    fresh = F.col("_at") >= F.col(now).cast("timestamp") - F.expr(f"INTERVAL {V.CACHE_TTL_DAYS} DAYS")
    return requests.join(e, (F.col(key) == F.col("_k")) & fresh, "left_anti").select(key).distinct()


def cache_write_back(cache: DataFrame, responses: DataFrame, key: str, saved_at: str) -> DataFrame:
    """Cache after storing the responses: newest entry per key wins."""
    return latest_entries(cache.unionByName(responses), key, saved_at)


PERIODS = ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")


def valid_market_rows(rows: DataFrame) -> DataFrame:
    """Rows with three positive finite amounts; unknown periods count as yearly."""
    good = F.lit(True)
    for c in ("min_salary", "median_salary", "max_salary"):
        x = F.col(c)
        good = good & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)
    p = F.upper(F.coalesce(F.col("period"), F.lit("YEAR")))
    return rows.where(good).withColumn("period", F.when(p.isin(*PERIODS), p).otherwise("YEAR")).withColumn(
        "currency", F.upper(F.coalesce(F.col("currency"), F.lit("USD")))
    )


def best_market_row(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the valid row with the most reported salaries (first one on ties)."""
    v = valid_market_rows(rows)
    rest = [c for c in v.columns if c != key]
    rank = F.struct(F.coalesce(F.col("salary_count"), F.lit(0)), -F.col(order))
    return v.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_m")).select(key, "_m.*")


def market_monthly(amount: Column, period: Column, currency: Column) -> Column:
    return N.to_gtq(N.to_monthly(amount, period), currency, "A")


def market_position(desired: Column, lo: Column, mid: Column, hi: Column) -> Column:
    return F.when(
        lo.isNotNull() & mid.isNotNull() & hi.isNotNull(),
        F.when(desired < lo, "below_min").when(desired <= mid, "min_median").when(desired <= hi, "median_max").otherwise("above_max"),
    )


def small_sample(count: Column) -> Column:
    return F.coalesce(count < 10, F.lit(False))
