"""Aggregations over call logs, rule checks and judge verdicts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed as V

SKETCH = 10_000  # accuracy of the quantile sketch: ranks are off by at most 1 / SKETCH of the group


def finite(x: Column) -> Column:
    """Value or NULL when NaN / infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def with_group(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [left[k].eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left").drop(*[f"_r_{k}" for k in keys])


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], after: tuple[str, ...] = ()) -> DataFrame:
    """Exact nearest-rank percentiles (rank ⌈p n⌉; for names in `after`, ⌊p n⌋ + 1) per group; one way for
    groups of any size.

    A mergeable quantile sketch per group bounds every wanted rank from both sides. A second pass counts
    what lies below the bounds and ranks only the values between them, a few thousandths of a group, so no
    task holds a group. NULL keys are groups, groups without a value get NULL, non-NULL values only count.
    """
    if not keys:
        return percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, ps, after).drop("_all")
    v = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v"))
    edge = 3.0 / SKETCH
    cuts = [F.percentile_approx("_v", [max(0.0, p - edge), min(1.0, p + edge)], SKETCH).alias(f"_c{i}") for i, p in enumerate(ps.values())]
    stats = v.groupBy(*keys).agg(F.count("_v").alias("_n"), *cuts)
    bounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(n in after).alias("up"), F.col(f"_c{i}")[0].alias("lo"), F.col(f"_c{i}")[1].alias("hi")) for i, (n, p) in enumerate(ps.items())])
    wanted = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", bounds.alias("_w"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    values = v.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = values.join(wanted, same).select(*keys, "_v", "_c", "_n", F.explode("_w").alias("_w"))
    inside = F.col("_v") >= F.col("_w.lo")
    at = F.col("_w.p") * F.col("_n")
    rank = F.when(F.col("_w.up"), F.least(F.floor(at) + 1, "_n")).otherwise(F.greatest(F.lit(1), F.ceil(at)))
    near = placed.where(F.col("_v") <= F.col("_w.hi")).groupBy(*keys, F.col("_w.i").alias("_i"), F.when(inside, F.col("_v")).alias("_v")).agg(
        F.sum("_c").alias("_c"), F.first(rank).alias("_rank")
    )
    upto = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    found = near.withColumn("_cum", F.sum("_c").over(upto)).where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_c") < F.col("_rank")))
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(ps)])
    lost = F.raise_error(F.lit("a rank lies outside the bounds of its sketch")).cast("double")
    exact = [F.when(F.col("_n") > 0, F.coalesce(n, lost)).alias(n) for n in ps]
    return with_group(stats.select(*keys, "_n"), picked, keys).select(*keys, *exact)


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group: the mean of the two middle values."""
    two = percentiles(df, keys, value, {"_low": 0.5, "_high": 0.5}, after=("_high",))
    return two.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def latency_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls(ok, ttft_ms, total_ms, tps, tokens) → counts, medians, p95 and means per group."""
    ok = calls.where("ok")
    base = calls.groupBy(*keys).agg(
        F.count_if("ok").alias("n"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.avg(F.when(F.col("ok"), finite(F.col("tps")))).alias("tps"),
        F.avg(F.when(F.col("ok"), finite(F.col("tokens")))).alias("tokens"),
    )
    q = percentiles(
        ok.select(*keys, finite(F.col("total_ms")).alias("total_ms")), keys, "total_ms",
        {"total_p50": 0.5, "total_p95": 0.95},
    )
    t = percentiles(ok.select(*keys, finite(F.col("ttft_ms")).alias("ttft_ms")), keys, "ttft_ms", {"ttft_p50": 0.5})
    return with_group(with_group(base, q, keys), t, keys)


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Agreement and Cohen's κ of two yes/no ratings: four counts per group, then arithmetic."""
    x, y = F.col(a), F.col(b)
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(x == y).alias("agree"),
        F.count_if(x).alias("_a"),
        F.count_if(y).alias("_b"),
    )
    n = F.col("n").cast("double")
    po, pa, pb = F.col("agree") / n, F.col("_a") / n, F.col("_b") / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return s.select(
        *keys, "n", "agree", po.alias("pct"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa")
    )


def position_bias(scores: DataFrame) -> DataFrame:
    """scores(unit, pass, position, score): how often the first shown answer wins."""
    t = scores.groupBy("unit", "pass").agg(
        F.sum(F.when(F.col("position") == 0, F.col("score"))).alias("first"),
        F.sum(F.when(F.col("position") == 1, F.col("score"))).alias("second"),
    )
    t = t.where(F.col("first").isNotNull() & F.col("second").isNotNull())
    return t.agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if(F.col("first") > F.col("second")).alias("first_wins"),
        F.count_if(F.col("first") == F.col("second")).alias("ties"),
    )


def average_passes(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("score"))


def criterion_matrix(flags: DataFrame, source: str, criteria: list[str]) -> DataFrame:
    """Wide table of pass flags → pass rate per source and criterion, one column per criterion."""
    return flags.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), *[ratio(F.col(c)).alias(c) for c in criteria]
    )


def criterion_rates(flags: DataFrame, source: str, criteria: list[str]) -> DataFrame:
    """The matrix in long form: (source, criterion, passed, n, rate), the criterion `overall` pooling all of them.

    A NULL flag was not judged and counts nowhere; a criterion without a judged answer has n = 0 and a NULL rate.
    """
    counts = [F.struct(F.lit(c).alias("criterion"), F.count_if(F.col(c)).alias("passed"), F.count(F.col(c)).alias("n")) for c in criteria]
    per = flags.groupBy(source).agg(F.array(*counts).alias("rows"))

    def total(field: str) -> Column:
        return F.aggregate(F.col("rows")[field], F.lit(0).cast("long"), lambda a, n: a + n).alias(field)

    every = F.concat("rows", F.array(F.struct(F.lit("overall").alias("criterion"), total("passed"), total("n"))))
    d = per.select(source, F.inline(every))
    return d.withColumn("rate", F.when(F.col("n") > 0, F.col("passed") / F.col("n")))


def case_detail(cases: DataFrame, unit: list[str], source: str, sources: list[str], criteria: list[str], words: str, scores: list[str]) -> DataFrame:
    """One row per unit; for every source words, criteria passed and the mean of the judge's scores, NULL where it has none."""
    passed = sum((F.col(c).cast("int") for c in criteria[1:]), F.col(criteria[0]).cast("int"))
    mean = sum((F.col(c) for c in scores[1:]), F.col(scores[0])) / len(scores)
    d = cases.select(*unit, source, F.col(words).alias("words"), passed.alias("rules"), mean.alias("judge"))
    own = [F.max(F.when(F.col(source) == s, F.col(f))).alias(f"{f}_{s}") for s in sources for f in ("words", "rules", "judge")]
    return d.groupBy(*unit).agg(*own)


def token_cost(prompt: Column, output: Column, thoughts: Column) -> Column:
    """Price of summed tokens."""
    return prompt / 1e6 * V.PRICE_IN_PER_M + (output + thoughts) / 1e6 * V.PRICE_OUT_PER_M


def composite(det: Column, judge: Column) -> Column:
    """Mean of rule score and judge/5 (the rule score alone when there is no judge)."""
    d = F.coalesce(det, F.lit(0.0))
    return (d + F.coalesce(judge / 5, d)) / 2


def first_warm_run(calls: DataFrame, keys: list[str], run: str) -> DataFrame:
    """First warm successful run per key: a minimum per key, no sorting of the group."""
    rest = [c for c in calls.columns if c not in keys]
    return (
        calls.where((F.col("kind") == "warm") & F.col("ok"))
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), run).alias("_r"))
        .select(*keys, "_r.*")
    )


def missing_verdicts(calls: DataFrame, verdicts: DataFrame, unit: list[str], model: str) -> DataFrame:
    """Units (input × task) with outputs of at least two models that have no verdict yet."""
    good = calls.where((F.col("kind") == "warm") & F.col("ok"))
    units = good.groupBy(*unit).agg(F.count_distinct(F.col(model)).alias("outputs")).where("outputs >= 2")
    return units.join(verdicts.select(*unit).distinct(), unit, "left_anti")


def memory_mode(size: Column, vram: Column) -> Column:
    return F.when(F.coalesce(vram, F.lit(0)) == 0, "cpu").when(vram >= size, "gpu").otherwise("partial")


def rank_in_buckets(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """0-based rank within `group`, for groups of any size.

    `bucket` is a deterministic, order-preserving function of the order key: rows are ranked inside
    (group, bucket), and the counts of the earlier buckets of the group are added. A task sorts one bucket
    at a time, so the caller chooses buckets that follow the data.
    """
    keys = [*group, bucket]
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    before = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    rest = [c for c in df.columns if c != bucket]
    return local.join(offs, keys).select(*rest, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(out))


def ordinals(df: DataFrame, key: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """0-based rank of a numeric key over the whole table without one global sort task.

    The bucket edges are approximate quantiles, as many as the number of rows asks for, fetched once and
    put into the plan, so every evaluation of the plan cuts the rows alike.
    """
    buckets = max(16, -(-df.count() // rows_per_bucket))
    ps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.agg(F.percentile_approx(key, ps, F.lit(max(10_000, 20 * buckets)))).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in dict.fromkeys(edges)]), lambda e: F.col(key) > e)) if edges else F.lit(0)
    return rank_in_buckets(df.withColumn("_bucket", bucket), [], "_bucket", [key], "ordinal")


def seeded_order(df: DataFrame, group: str, item: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Reproducible shuffle of the items of a group: rank of a hash of (group, item).

    The first hash digits are the bucket: uniform, so even one huge group spreads over many tasks.
    """
    h = F.sha2(F.concat_ws(":", F.col(group).cast("string"), F.col(item).cast("string")), 256)
    digits = max(2, len(f"{df.count() // rows_per_bucket:x}"))  # hex digits of the bucket
    d = df.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, digits))
    return rank_in_buckets(d, [group], "_bucket", ["_h"], "position").drop("_h")


def both_orders(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair to be judged twice, each answer once in the first place: columns pass, first, second."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    turn = F.array(*[F.struct(F.lit(i).alias("pass"), F.col(x).alias("first"), F.col(y).alias("second")) for i, (x, y) in enumerate([(a, b), (b, a)])])
    return pairs.select(*rest, F.inline(turn))


def request_status(dest: Column, ok: Column, failure: Column, ms: Column) -> Column:
    """ok / slow by destination threshold; offline, timeout or failed otherwise."""
    limit = F.lit(None).cast("double")
    for name, cap in V.SLOW_MS.items():
        limit = F.when(dest == name, float(cap)).otherwise(limit)
    return (
        F.when(ok & (ms > limit), "slow")
        .when(ok, "ok")
        .when(failure.isin("offline", "network"), "offline")
        .when(failure == "timeout", "timeout")
        .otherwise("failed")
    )


def error_code(status: Column, body: Column) -> Column:
    """Upstream HTTP status → error code."""
    return (
        F.when(status == 429, "rate_limited")
        .when(status == 401, "upstream_auth")
        .when((status == 403) & F.lower(body).contains("not subscribed"), "not_subscribed")
        .when(status == 403, "upstream_auth")
        .otherwise("upstream_error")
    )


FAILURE_REASON = {  # fixed values
    "not_subscribed": "la cuenta no está suscrita a la API (403)",
    "upstream_auth": "credencial rechazada por el proveedor",
    "not_configured": "falta la API key en el servidor",
    "rate_limited": "límite de uso alcanzado (429)",
    "upstream_error": "el proveedor devolvió un error",
    "invalid_request": "petición rechazada por validación",
    "sensitive_data": "el servidor detectó datos sensibles y rechazó el envío",
}


def failure_reason(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in FAILURE_REASON.items():
        out = F.when(code == k, v).otherwise(out)
    return out
