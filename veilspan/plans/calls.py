"""Queries over call logs, verdicts and caches, bound to `events`, `labels`, `documents`, `conversations`."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.operators import benchstats as B
from veilspan.operators import lookup as L
from veilspan.plans.registry import query
from veilspan.session import table
from veilspan.streaming import events as ST

# events as a call log: model = event type, input = user, task by parity, run in time order
CALLS_SQL = """calls AS (SELECT event_id, event_type AS model, user_id AS input, CASE WHEN event_id % 2 = 0 THEN 'negotiation' ELSE 'requirements' END AS task,
  event_id AS run, CASE WHEN event_id % 7 = 0 THEN 'cold' ELSE 'warm' END AS kind, event_id % 11 <> 0 AS ok, value / 4 AS ttft_ms, value AS total_ms,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1000 / (value + 1) END AS tps, CAST(event_id % 300 AS DOUBLE) AS tokens FROM events)"""


def calls(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "event_type AS model", "user_id AS input",
        "CASE WHEN event_id % 2 = 0 THEN 'negotiation' ELSE 'requirements' END AS task", "event_id AS run",
        "CASE WHEN event_id % 7 = 0 THEN 'cold' ELSE 'warm' END AS kind", "event_id % 11 <> 0 AS ok", "value / 4 AS ttft_ms",
        "value AS total_ms", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1000 / (value + 1) END AS tps",
        "CAST(event_id % 300 AS DOUBLE) AS tokens",
    )


def r4(c):
    return F.round(c, 4)


LATENCY_SQL = f"""
WITH {CALLS_SQL}
SELECT model, task, CAST(count_if(ok) AS BIGINT) AS n, CAST(count_if(NOT ok) AS BIGINT) AS errors,
 round(avg(tps) FILTER (ok), 4) AS tps, round(avg(tokens) FILTER (ok), 4) AS tokens,
 quantile_disc(total_ms, 0.5) FILTER (ok) AS total_p50, quantile_disc(total_ms, 0.95) FILTER (ok) AS total_p95, quantile_disc(ttft_ms, 0.5) FILTER (ok) AS ttft_p50
FROM calls WHERE kind = 'warm' GROUP BY model, task
"""


@query("latency_summary", LATENCY_SQL)
def latency_summary(spark, sf):
    d = B.latency_summary(calls(spark, sf).where("kind = 'warm'"), ["model", "task"])
    return d.withColumn("tps", r4(F.col("tps"))).withColumn("tokens", r4(F.col("tokens")))


@query("percentiles_by_histogram", f"""
WITH {CALLS_SQL} SELECT model, quantile_disc(total_ms, 0.5) AS p50, quantile_disc(total_ms, 0.95) AS p95, quantile_disc(total_ms, 0.99) AS p99 FROM calls GROUP BY model
""")
def percentiles_by_histogram(spark, sf):
    """The form used beyond the buffer limit: no group is ever gathered."""
    return B.percentiles(calls(spark, sf), ["model"], "total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("median_summary", f"""
WITH {CALLS_SQL} SELECT model, round(avg(total_ms), 4) AS mean_ms, round(quantile_cont(total_ms, 0.5), 6) AS median_ms, max(total_ms) AS max_ms, min(total_ms) AS min_ms FROM calls GROUP BY model
""")
def median_summary(spark, sf):
    c = calls(spark, sf)
    s = c.groupBy("model").agg(r4(F.avg("total_ms")).alias("mean_ms"), F.max("total_ms").alias("max_ms"), F.min("total_ms").alias("min_ms"))
    return B.with_group(s, B.medians(c, ["model"], "total_ms", "m"), ["model"]).select("model", "mean_ms", F.round("m", 6).alias("median_ms"), "max_ms", "min_ms")


@query("both_orders", f"""
WITH {CALLS_SQL}, u AS (SELECT input, task, min(model) AS a, max(model) AS b FROM calls WHERE kind = 'warm' AND ok GROUP BY input, task HAVING count(DISTINCT model) > 1)
SELECT input, task, CAST(0 AS INT) AS pass, a AS first, b AS second FROM u UNION ALL SELECT input, task, CAST(1 AS INT), b, a FROM u
""")
def both_orders(spark, sf):
    """Blind comparisons of two models' answers, each pair in both orders."""
    good = calls(spark, sf).where((F.col("kind") == "warm") & F.col("ok"))
    pairs = good.groupBy("input", "task").agg(F.min("model").alias("a"), F.max("model").alias("b")).where("a <> b")
    return B.both_orders(pairs, "a", "b")


@query("percentiles_of_null_groups", """
WITH v AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS g, CASE WHEN event_id % 5 <> 3 THEN value END AS x FROM events)
SELECT g, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.95) AS p95 FROM v GROUP BY g
""")
def percentiles_of_null_groups(spark, sf):
    """A NULL key is a group, a group of NULL values a row."""
    v = table(spark, sf, "events").selectExpr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS g", "CASE WHEN event_id % 5 <> 3 THEN value END AS x")
    return B.percentiles(v, ["g"], "x", {"p50": 0.5, "p95": 0.95})


@query("first_warm_run", f"""
WITH {CALLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, input, task ORDER BY run) AS rn FROM calls WHERE kind = 'warm' AND ok)
SELECT model, input, task, run, total_ms FROM r WHERE rn = 1
""")
def first_warm_run(spark, sf):
    c = calls(spark, sf).select("model", "input", "task", "kind", "ok", "run", "total_ms")
    return B.first_warm_run(c, ["model", "input", "task"], "run").select("model", "input", "task", "run", "total_ms")


@query("missing_verdicts", f"""
WITH {CALLS_SQL}, u AS (SELECT input, task, count(DISTINCT model) AS outputs FROM calls WHERE kind = 'warm' AND ok GROUP BY input, task),
v AS (SELECT DISTINCT input, task FROM calls WHERE event_id % 50 = 0)
SELECT input, task, CAST(outputs AS BIGINT) AS outputs FROM u WHERE outputs >= 2 AND NOT EXISTS (SELECT 1 FROM v WHERE v.input = u.input AND v.task = u.task)
""")
def missing_verdicts(spark, sf):
    c = calls(spark, sf)
    return B.missing_verdicts(c, c.where("event_id % 50 = 0"), ["input", "task"], "model")


# judge scores: every event is a verdict of a model at a position in a pass
SCORES_SQL = """scores AS (SELECT user_id AS unit, event_id % 2 AS pass, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'purchase' END AS model,
  CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END AS position, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'utilidad' WHEN 1 THEN 'precision' WHEN 2 THEN 'tono' ELSE 'fidelidad' END AS criterion,
  CASE WHEN event_id % 3 = 0 THEN 'negotiation' ELSE 'requirements' END AS task, CAST(1 + event_id * 7 % 5 AS DOUBLE) AS score FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""


def scores(spark, sf):
    return table(spark, sf, "events").where("event_type IN ('click', 'view', 'purchase')").selectExpr(
        "user_id AS unit", "event_id % 2 AS pass", "event_type AS model",
        "CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END AS position",
        "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'utilidad' WHEN 1 THEN 'precision' WHEN 2 THEN 'tono' ELSE 'fidelidad' END AS criterion",
        "CASE WHEN event_id % 3 = 0 THEN 'negotiation' ELSE 'requirements' END AS task", "CAST(1 + event_id * 7 % 5 AS DOUBLE) AS score",
    )


@query("position_bias", f"""
WITH {SCORES_SQL}, t AS (SELECT unit, pass, sum(score) FILTER (position = 0) AS a, sum(score) FILTER (position = 1) AS b FROM scores GROUP BY unit, pass)
SELECT CAST(count(*) AS BIGINT) AS comparisons, CAST(count_if(a > b) AS BIGINT) AS first_wins, CAST(count_if(a = b) AS BIGINT) AS ties FROM t WHERE a IS NOT NULL AND b IS NOT NULL
""")
def position_bias(spark, sf):
    return B.position_bias(scores(spark, sf))


@query("pass_average", f"WITH {SCORES_SQL} SELECT unit, model, criterion, round(avg(score), 6) AS score FROM scores GROUP BY unit, model, criterion")
def pass_average(spark, sf):
    return B.average_passes(scores(spark, sf), ["unit", "model", "criterion"]).withColumn("score", F.round("score", 6))


@query("judge_rollup", f"""
WITH {SCORES_SQL} SELECT task, criterion, round(avg(score), 6) AS score, CAST(count(*) AS BIGINT) AS n FROM scores GROUP BY ROLLUP (task, criterion)
""")
def judge_rollup(spark, sf):
    return scores(spark, sf).rollup("task", "criterion").agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query("label_pivot", f"""
WITH {SCORES_SQL} SELECT model, CAST(count_if(criterion = 'utilidad') AS BIGINT) AS utilidad, CAST(count_if(criterion = 'precision') AS BIGINT) AS precision, CAST(count_if(criterion = 'tono') AS BIGINT) AS tono,
 CAST(count_if(criterion = 'fidelidad') AS BIGINT) AS fidelidad FROM scores GROUP BY model
""")
def label_pivot(spark, sf):
    return scores(spark, sf).groupBy("model").pivot("criterion", ["utilidad", "precision", "tono", "fidelidad"]).agg(F.count(F.lit(1)))


@query("judge_by_position", f"WITH {SCORES_SQL} SELECT CAST(position AS BIGINT) AS position, round(avg(score), 6) AS score FROM scores GROUP BY position")
def judge_by_position(spark, sf):
    return scores(spark, sf).groupBy(F.col("position").cast("bigint").alias("position")).agg(F.round(F.avg("score"), 6).alias("score"))


_COMPOSITE = f"""{CALLS_SQL}, {SCORES_SQL}, det AS (SELECT model, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS det, quantile_disc(total_ms, 0.5) AS p50 FROM calls GROUP BY model),
jud AS (SELECT model, avg(score) AS judge FROM scores GROUP BY model), c AS (SELECT det.model, det, p50, judge, (det + coalesce(judge / 5, det)) / 2 AS composite FROM det LEFT JOIN jud ON det.model = jud.model)"""


def _composite(spark, sf):
    c = calls(spark, sf)
    det = c.groupBy("model").agg(B.ratio(F.col("ok")).alias("det"))
    p50 = B.percentiles(c, ["model"], "total_ms", {"p50": 0.5})
    jud = scores(spark, sf).groupBy("model").agg(F.avg("score").alias("judge"))
    j = det.join(p50, "model").join(jud, "model", "left")
    return j.withColumn("composite", B.composite(F.col("det"), F.col("judge")))


@query("composite_ranking", f"""
WITH {_COMPOSITE}, r AS (SELECT *, row_number() OVER (ORDER BY round(composite, 9) DESC, p50, model) AS rank, max(composite) OVER () - composite AS behind FROM c)
SELECT model, round(det, 6) AS det, round(judge, 6) AS judge, p50, round(composite, 6) AS composite, CAST(rank AS BIGINT) AS rank, behind < 0.02 AS near_tie FROM r
""")
def composite_ranking(spark, sf):
    """One row per model at most, so the last ranking window is over a handful of rows."""
    c = _composite(spark, sf)
    w = Window.orderBy(F.round("composite", 9).desc(), "p50", "model")
    d = c.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("best", F.max("composite").over(Window.partitionBy()))
    return d.select("model", F.round("det", 6).alias("det"), F.round("judge", 6).alias("judge"), "p50", F.round("composite", 6).alias("composite"),
                    "rank", (F.col("best") - F.col("composite") < 0.02).alias("near_tie"))


@query("metric_win_loss", f"""
WITH {_COMPOSITE}, r AS (SELECT *, row_number() OVER (ORDER BY round(composite, 9) DESC, p50, model) AS rank FROM c),
m AS (SELECT rank, model, unnest(['det', 'judge', 'p50']) AS metric, unnest([det, judge, p50]) AS v, unnest([true, true, false]) AS higher FROM r WHERE rank <= 2)
SELECT a.metric, a.model AS first_model, b.model AS second_model, CASE WHEN (a.v > b.v) = a.higher THEN 'win' ELSE 'loss' END AS outcome
FROM m a JOIN m b ON a.metric = b.metric AND a.rank = 1 AND b.rank = 2 WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND round(a.v, 2) <> round(b.v, 2)
""")
def metric_win_loss(spark, sf):
    c = _composite(spark, sf)
    w = Window.orderBy(F.round("composite", 9).desc(), "p50", "model")
    top = c.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    m = top.select("rank", "model", F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("v"), F.lit(h).alias("higher")) for n, h in (("det", True), ("judge", True), ("p50", False))])))
    a = m.where("rank = 1").select("metric", F.col("model").alias("first_model"), F.col("v").alias("x"), "higher")
    b = m.where("rank = 2").select("metric", F.col("model").alias("second_model"), F.col("v").alias("y"))
    return a.join(b, "metric").where(F.round("x", 2) != F.round("y", 2)).select(
        "metric", "first_model", "second_model", F.when((F.col("x") > F.col("y")) == F.col("higher"), "win").otherwise("loss").alias("outcome"))


@query("winner_per_task", f"""
WITH {CALLS_SQL}, {SCORES_SQL}, d AS (SELECT model, task, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS det FROM calls GROUP BY ALL), j AS (SELECT model, task, avg(score) AS judge FROM scores GROUP BY ALL),
c AS (SELECT d.model, d.task, (det + coalesce(judge / 5, det)) / 2 AS s FROM d LEFT JOIN j ON d.model = j.model AND d.task = j.task), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(s, 9) DESC, model) AS rn FROM c)
SELECT task, model, round(s, 6) AS score FROM r WHERE rn = 1
""")
def winner_per_task(spark, sf):
    d = calls(spark, sf).groupBy("model", "task").agg(B.ratio(F.col("ok")).alias("det"))
    j = scores(spark, sf).groupBy("model", "task").agg(F.avg("score").alias("judge"))
    c = d.join(j, ["model", "task"], "left").select("model", "task", B.composite(F.col("det"), F.col("judge")).alias("s"))
    w = Window.partitionBy("task").orderBy(F.round("s", 9).desc(), "model")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("task", "model", F.round("s", 6).alias("score"))


@query("token_cost", f"""
WITH {CALLS_SQL} SELECT model, CAST(count(*) AS BIGINT) AS letters, round(sum(run) / 1e6 * 0.75 + sum(tokens + 10) / 1e6 * 3.75, 6) AS cost_usd,
 round((sum(run) / 1e6 * 0.75 + sum(tokens + 10) / 1e6 * 3.75) / count(*), 9) AS cost_per_letter FROM calls WHERE ok GROUP BY model
""")
def token_cost(spark, sf):
    g = calls(spark, sf).where("ok").groupBy("model").agg(
        F.count(F.lit(1)).alias("letters"), B.token_cost(F.sum("run"), F.sum("tokens"), F.count(F.lit(1)) * 10).alias("c"))
    return g.select("model", "letters", F.round("c", 6).alias("cost_usd"), F.round(F.col("c") / F.col("letters"), 9).alias("cost_per_letter"))


_REQ = "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'company' WHEN 1 THEN 'market' ELSE 'letter' END AS dest, value * 60 AS ms, event_type"


@query("request_status", f"""
WITH r AS (SELECT {_REQ} FROM events), s AS (SELECT dest, CASE WHEN event_type NOT IN ('error', 'signup') THEN CASE WHEN ms > CASE dest WHEN 'letter' THEN 10000 ELSE 3000 END THEN 'slow' ELSE 'ok' END
 WHEN event_type = 'signup' AND ms > 6000 THEN 'timeout' WHEN event_type = 'signup' THEN 'offline' ELSE 'failed' END AS status FROM r)
SELECT dest, status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY dest, status
""")
def request_status(spark, sf):
    r = table(spark, sf, "events").selectExpr(
        "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'company' WHEN 1 THEN 'market' ELSE 'letter' END AS dest", "value * 60 AS ms", "event_type")
    fail = F.when(F.col("event_type") == "signup", F.when(F.col("ms") > 6000, "timeout").otherwise("network")).otherwise("http")
    ok = ~F.col("event_type").isin("error", "signup")
    return r.select("dest", B.request_status(F.col("dest"), ok, fail, F.col("ms")).alias("status")).groupBy("dest", "status").agg(F.count(F.lit(1)).alias("n"))


@query("error_codes", """
WITH r AS (SELECT CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE 404 END AS status, CASE WHEN user_id % 2 = 0 THEN 'You are NOT subscribed' ELSE 'denied' END AS body FROM events WHERE event_type = 'error'),
c AS (SELECT CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 401 THEN 'upstream_auth' WHEN status = 403 AND lower(body) LIKE '%not subscribed%' THEN 'not_subscribed' WHEN status = 403 THEN 'upstream_auth' ELSE 'upstream_error' END AS code FROM r)
SELECT code, CASE code WHEN 'rate_limited' THEN 'límite de uso alcanzado (429)' WHEN 'upstream_auth' THEN 'credencial rechazada por el proveedor' WHEN 'not_subscribed' THEN 'la cuenta no está suscrita a la API (403)' ELSE 'el proveedor devolvió un error' END AS reason,
 CAST(count(*) AS BIGINT) AS n FROM c GROUP BY code
""")
def error_codes(spark, sf):
    r = table(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE 404 END AS status",
        "CASE WHEN user_id % 2 = 0 THEN 'You are NOT subscribed' ELSE 'denied' END AS body")
    g = r.select(B.error_code(F.col("status"), F.col("body")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return g.select("code", B.failure_reason(F.col("code")).alias("reason"), "n")


# ------------------------------------------------------------------ raters: quality and toxicity labels
_RATED = "rated AS (SELECT d.doc_id, d.source, d.lang, l.quality = 1 AS a, l.toxic = 0 AS b, length(d.text) < 2000 AS short FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def rated(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", (F.length("text") < 2000).alias("short"))
    l = table(spark, sf, "labels")
    return d.join(l, "doc_id").select("doc_id", "source", "lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"), "short")


@query("cohen_kappa", f"""
WITH {_RATED}, s AS (SELECT lang, count(*) AS n, count_if(a = b) AS agree, count_if(a) AS ca, count_if(b) AS cb FROM rated GROUP BY lang),
p AS (SELECT *, agree / n AS po, (ca / n) * (cb / n) + (1 - ca / n) * (1 - cb / n) AS pe FROM s)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, round(po, 6) AS pct, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM p
""")
def cohen_kappa(spark, sf):
    return B.kappa(rated(spark, sf), ["lang"], "a", "b").withColumn("pct", F.round("pct", 6)).withColumn("kappa", F.round("kappa", 6))


@query("criterion_matrix", f"""
WITH {_RATED} SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(a AS INT)), 6) AS quality, round(avg(CAST(b AS INT)), 6) AS clean, round(avg(CAST(short AS INT)), 6) AS short FROM rated GROUP BY source
""")
def criterion_matrix(spark, sf):
    m = B.criterion_matrix(rated(spark, sf).withColumnsRenamed({"a": "quality", "b": "clean"}), "source", ["quality", "clean", "short"])
    return m.select("source", "n", *[F.round(c, 6).alias(c) for c in ("quality", "clean", "short")])


@query("judge_minus_rules", f"""
WITH {_RATED} SELECT source, round(1 + 4 * avg(CAST(a AS INT)), 6) AS rules_scaled, round(1 + 4 * avg(CAST(b AS INT)), 6) AS judge, round(4 * (avg(CAST(b AS INT)) - avg(CAST(a AS INT))), 6) AS delta FROM rated GROUP BY source
""")
def judge_minus_rules(spark, sf):
    g = rated(spark, sf).groupBy("source").agg(B.ratio(F.col("a")).alias("a"), B.ratio(F.col("b")).alias("b"))
    return g.selectExpr("source", "round(1 + 4 * a, 6) AS rules_scaled", "round(1 + 4 * b, 6) AS judge", "round(4 * (b - a), 6) AS delta")


@query("case_detail_pivot", f"""
WITH {_RATED} SELECT source, CAST(count_if(lang = 'en') AS BIGINT) AS en, CAST(count_if(lang = 'es') AS BIGINT) AS es, CAST(count_if(lang = 'fr') AS BIGINT) AS fr, CAST(count_if(lang = 'de') AS BIGINT) AS de FROM rated WHERE a GROUP BY source
""")
def case_detail_pivot(spark, sf):
    p = rated(spark, sf).where("a").groupBy("source").pivot("lang", ["en", "es", "fr", "de"]).agg(F.count(F.lit(1)))
    return p.na.fill(0, ["en", "es", "fr", "de"])


_LONG = " UNION ALL ".join(f"SELECT source, '{n}' AS criterion, {c} AS flag FROM judged" for n, c in (("quality", "a"), ("clean", "b"), ("short", "short")))


@query("criterion_rates", f"""
WITH {_RATED}, judged AS (SELECT source, CASE WHEN doc_id % 10 <> 0 THEN a END AS a, b, short FROM rated), f AS ({_LONG}),
g AS (SELECT source, criterion, count(*) FILTER (WHERE flag) AS passed, count(flag) AS n FROM f GROUP BY source, criterion
 UNION ALL SELECT source, 'overall', count(*) FILTER (WHERE flag), count(flag) FROM f GROUP BY source)
SELECT source, criterion, CAST(passed AS BIGINT) AS passed, CAST(n AS BIGINT) AS n, round(CASE WHEN n > 0 THEN passed / n END, 6) AS rate FROM g
""")
def criterion_rates(spark, sf):
    """Pass rate of every source by criterion and over all of them; one answer in ten was not judged for quality."""
    r = rated(spark, sf).withColumnsRenamed({"a": "quality", "b": "clean"}).withColumn("quality", F.when(F.col("doc_id") % 10 != 0, F.col("quality")))
    return B.criterion_rates(r, "source", ["quality", "clean", "short"]).withColumn("rate", F.round("rate", 6))


_SOURCES = ("local", "nube", "plantilla")
_DETAIL = ", ".join(f"max(CASE WHEN source = '{s}' THEN {f} END) AS {f}_{s}" for s in _SOURCES for f in ("words", "rules", "judge"))


@query("case_detail", f"""
WITH t AS (SELECT conv_id, CAST(floor(turn / 3) AS BIGINT) AS answer, CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'local' WHEN 1 THEN 'nube' ELSE 'plantilla' END AS source, text, length(text) AS n, turn FROM conversations),
c AS (SELECT conv_id, answer, source, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS INT) AS words, CAST(n >= 40 AS INT) + CAST(n <= 400 AS INT) + CAST(ends_with(text, '.') AS INT) AS rules,
 (n % 5 + 1 + (n + turn) % 5 + 1) / 2 AS judge FROM t)
SELECT conv_id, answer, {_DETAIL} FROM c GROUP BY conv_id, answer
""")
def case_detail(spark, sf):
    """Every three turns of a conversation as the answers of three sources: words, rules passed and judge mean side by side."""
    n = F.length("text")
    source = F.get(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("turn") % 3).cast("int"))
    t = table(spark, sf, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 3).alias("answer"), source.alias("source"), F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))).alias("words"),
        (n >= 40).alias("long_enough"), (n <= 400).alias("short_enough"), F.endswith("text", F.lit(".")).alias("ended"),
        (n % 5 + 1).alias("tone"), ((n + F.col("turn")) % 5 + 1).alias("fit"))
    return B.case_detail(t, ["conv_id", "answer"], "source", list(_SOURCES), ["long_enough", "short_enough", "ended"], "words", ["tone", "fit"])


PERMS = ", ".join(f"({i}, {p}, '{s}')" for i, perm in enumerate(V.PERMUTATIONS) for p, s in enumerate(perm))


@query("balanced_order", f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels), p(perm, position, source) AS (VALUES {PERMS})
SELECT doc_id, CAST(position AS BIGINT) AS position, source FROM o JOIN p ON p.perm = o.i % 6
""")
def balanced_order(spark, sf):
    """Case i is shown in permutation i mod 6; ordinals without one global sort task."""
    o = B.ordinals(table(spark, sf, "labels").select("doc_id"), "doc_id")
    perms = F.array(*[F.array(*[F.lit(s) for s in perm]) for perm in V.PERMUTATIONS])
    return o.select("doc_id", F.posexplode(F.get(perms, (F.col("ordinal") % 6).cast("int"))).alias("position", "source")).select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "source")


@query("seeded_blind_order", """
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256(source || ':' || CAST(doc_id AS VARCHAR))) - 1 AS BIGINT) AS position FROM documents
""")
def seeded_blind_order(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return B.seeded_order(d, "source", "doc_id").withColumn("position", F.col("position").cast("bigint"))


@query("memory_mode", """
SELECT CASE WHEN vram = 0 THEN 'cpu' WHEN vram >= size THEN 'gpu' ELSE 'partial' END AS mode, CAST(count(*) AS BIGINT) AS n
FROM (SELECT p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_partkey % 60 AS INT) END AS vram FROM part) GROUP BY mode
""")
def memory_mode(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_size AS size", "CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_partkey % 60 AS INT) END AS vram")
    return d.select(B.memory_mode(F.col("size"), F.col("vram")).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ cache of market answers
_CACHE = """cache AS (SELECT event_type || '|' || CAST(user_id AS VARCHAR) AS key, ts AS saved_at, value AS median FROM events WHERE event_id % 2 = 0),
req AS (SELECT event_id, event_type || '|' || CAST(user_id AS VARCHAR) AS key, TIMESTAMP '2024-01-30 00:00:00' AS now FROM events WHERE event_id % 2 = 1),
last AS (SELECT key, max(saved_at) AS saved_at, arg_max(median, saved_at) AS median FROM cache GROUP BY key)"""


def _cache(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    cache = e.where("event_id % 2 = 0").select("key", F.col("ts").alias("saved_at"), F.col("value").alias("median"))
    req = e.where("event_id % 2 = 1").select("event_id", "key", F.to_timestamp(F.lit("2024-01-30 00:00:00")).alias("now"))
    return req, cache


@query("ttl_cache_lookup", f"""
WITH {_CACHE} SELECT r.event_id, r.key, CASE WHEN now - saved_at <= INTERVAL 7 DAY THEN median END AS median, coalesce(now - saved_at <= INTERVAL 7 DAY, false) AS hit
FROM req r LEFT JOIN last l ON r.key = l.key
""")
def ttl_cache_lookup(spark, sf):
    req, cache = _cache(spark, sf)
    return L.cache_lookup(req, cache, "key", "now", "saved_at").select("event_id", "key", "median", "hit")


@query("cache_miss_worklist", f"""
WITH {_CACHE} SELECT DISTINCT r.key FROM req r WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.key = r.key AND r.now - l.saved_at <= INTERVAL 7 DAY)
""")
def cache_miss_worklist(spark, sf):
    req, cache = _cache(spark, sf)
    return L.cache_misses(req, cache, "key", "now", "saved_at")


@query("cache_write_back", f"""
WITH {_CACHE}, n AS (SELECT * FROM cache UNION ALL SELECT key, now, CAST(event_id AS DOUBLE) FROM req WHERE event_id % 5 = 1)
SELECT key, max(saved_at) AS saved_at, arg_max(median, (saved_at, median)) AS median FROM n GROUP BY key
""")
def cache_write_back(spark, sf):
    req, cache = _cache(spark, sf)
    new = req.where("event_id % 5 = 1").select("key", F.col("now").alias("saved_at"), F.col("event_id").cast("double").alias("median"))
    return L.cache_write_back(cache, new, "key", "saved_at").select("key", "saved_at", "median")


# ------------------------------------------------------------------ streams, batch form
@query("call_event_fold", """
WITH e AS (SELECT conv_id, turn, text, role FROM conversations)
SELECT conv_id AS call, string_agg(text, '' ORDER BY turn) FILTER (role <> 'system') AS content, CAST(count_if(role <> 'system') AS BIGINT) AS deltas,
 CAST((max(turn) - min(turn)) * 250 AS DOUBLE) AS total_ms, CAST((min(turn) FILTER (role <> 'system' AND text <> '') - min(turn)) * 250 AS DOUBLE) AS ttft_ms FROM e GROUP BY conv_id
HAVING count_if(role <> 'system') > 0
""")
def call_event_fold(spark, sf):
    """Turns of a conversation as the deltas of one call, a quarter of a second apart."""
    c = table(spark, sf, "conversations")
    ev = c.select(
        F.col("conv_id").alias("call"), F.col("turn").alias("seq"), F.when(F.col("role") != "system", "delta").otherwise("status").alias("type"),
        "text", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("message"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("turn") * 250000).alias("ts"),
        F.lit(None).cast("struct<eval_count:double,eval_duration_ms:double>").alias("stats"))
    return ST.fold_calls(ev).where("deltas > 0").select("call", "content", "deltas", "total_ms", "ttft_ms")


@query("tumbling_latency", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, round(avg(value), 6) AS mean_value, max(value) AS max_value
FROM events GROUP BY ALL
""")
def tumbling_latency(spark, sf):
    d = ST.windowed_latency(table(spark, sf, "events"), "ts", ["event_type"], "value", F.col("event_type") == "error", "1 day", "1 hour")
    return d.withColumn("mean_value", F.round("mean_value", 6))
