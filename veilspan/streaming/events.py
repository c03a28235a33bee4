"""Call-event streams: fold per call, windowed metrics, continuous redaction."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "type string, phase string, text string, content string, message string, "
    "stats struct<eval_count:double, eval_duration_ms:double>"
)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Streaming source of NDJSON lines; blank and broken lines are dropped."""
    lines = spark.readStream.text(path)
    return parse_event_lines(lines)


def parse_event_lines(lines: DataFrame) -> DataFrame:
    ddl = f"call string, seq bigint, ts timestamp, {EVENT_SCHEMA}"
    e = lines.where(F.trim("value") != "").select(F.from_json("value", ddl).alias("e"))
    return e.select("e.*").where(F.col("type").isNotNull())


def fold_calls(events: DataFrame, key: str = "call", quiet: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Events of one call → content, time to first text, total time, tokens per second, error.

    Deltas are partially collected before the shuffle; a finished call carries its own final content,
    which wins. On a stream a call is a session on `ts`: it is given out (append mode) and its state
    released once the watermark, `late` behind, has passed `quiet` after its last event.
    """
    delta = F.col("type") == "delta"
    piece = F.when(delta & (F.coalesce("text", F.lit("")) != ""), F.struct("seq", "text"))
    if events.isStreaming:
        by = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", quiet))
    else:
        by = events.groupBy(key)
    g = by.agg(
        F.min("ts").alias("started"),
        F.min(F.when(piece.isNotNull(), F.col("ts"))).alias("_first"),
        F.max("ts").alias("_last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("_text"),
        F.max(F.when(F.col("type") == "done", F.col("content"))).alias("_done"),
        F.max("stats.eval_count").alias("_n"),
        F.max("stats.eval_duration_ms").alias("_ms"),
        F.max(F.when(F.col("type") == "error", F.col("message"))).alias("error"),
        F.count_if(delta).alias("deltas"),
    )
    content = F.when(F.coalesce("_done", F.lit("")) != "", F.col("_done")).otherwise(F.col("_text"))
    return g.select(
        key,
        content.alias("content"),
        millis(F.col("_first"), F.col("started")).alias("ttft_ms"),
        millis(F.col("_last"), F.col("started")).alias("total_ms"),
        F.when(F.col("_ms") > 0, F.col("_n") / (F.col("_ms") / 1000)).alias("tps"),
        "deltas",
        (F.col("error").isNull() & (F.trim(content) != "")).alias("ok"),
    )


CALL_ROW = (
    "content string, ttft_ms double, total_ms double, tps double, deltas bigint, ok boolean, kind string, after_end bigint"
)


def fold_calls_by_state(events: DataFrame, key: str = "call", late: str = "1 minute", idle: str = "1 day", keep: str = "1 hour") -> DataFrame:
    """The same fold on a stream, one row per call however long the call is silent in between.

    A call ends with its `done` or `error` event: the row is given out (kind `call`) once the watermark, `late` behind, has
    passed the end, so deltas that come out of order still count. A call that never ends is given out `idle` after its
    last event. An ended call is remembered for `keep`; events of it that arrive then, or lie behind its end, do not
    change the row: those known in time are its `after_end`, the others come as one row of kind `late` with their number.
    Events behind the watermark are dropped by Spark, which counts them in the query's progress. State is one call's events, and
    a mark of some bytes after its end. Events without a key or a time are left out.
    """
    micros = {n: _micros(events.sparkSession, text) for n, text in (("late", late), ("idle", idle), ("keep", keep))}
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late).select(
        F.col(key).cast("string").alias("call"), "ts", F.unix_micros("ts").alias("us"), "seq", "type",
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("content", F.lit("")).alias("content"), "message",
        F.col("stats.eval_count").alias("n"), F.col("stats.eval_duration_ms").alias("ms"),
    )

    def step(of, frames, state):
        s = json.loads(state.get[0]) if state.exists else {"events": [], "after": 0, "closed": False}
        if not state.hasTimedOut:
            for f in frames:
                f = f.drop(columns="ts").astype(object)
                new = f.where(f.notna(), None).to_dict("records")
                if s["closed"]:
                    s["after"] += len(new)
                else:
                    s["events"] += [{k: v for k, v in e.items() if k != "call"} for e in new]
        if s["closed"]:
            if state.hasTimedOut:
                if s["after"]:
                    yield pd.DataFrame([(of[0], None, None, None, None, 0, None, "late", s["after"])], columns=names)
                state.remove()
                return
            due = s["until"]
        else:
            ends = [e["us"] for e in s["events"] if e["type"] in ("done", "error")]
            due = min(ends) + 1000 if ends else max(e["us"] for e in s["events"]) + micros["idle"]
            if state.hasTimedOut or due <= state.getCurrentWatermarkMs() * 1000:
                yield pd.DataFrame([(of[0], *_call(s["events"], min(ends) if ends else None))], columns=names)
                due = max(due, state.getCurrentWatermarkMs() * 1000) + micros["keep"]
                s = {"closed": True, "after": 0, "until": due}
        state.update((json.dumps(s),))
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))

    names = ["call", *[c.split()[0] for c in CALL_ROW.split(", ")]]
    out = rows.groupBy("call").applyInPandasWithState(step, f"call string, {CALL_ROW}", "events string", "append", "EventTimeTimeout")
    return out.withColumnRenamed("call", key)


def _micros(spark: SparkSession, text: str) -> int:
    return spark.sql(f"SELECT CAST(unix_micros(TIMESTAMP_MICROS(0) + INTERVAL {text}) AS BIGINT) AS us").first()["us"]


def _call(events: list[dict], end: int | None) -> tuple:
    """One call's row from its events up to its end; events behind it are only counted."""
    own = [e for e in events if end is None or e["us"] <= end]
    delta = [e for e in own if e["type"] == "delta"]
    pieces = sorted((e for e in delta if e["text"]), key=lambda e: (e["seq"] is not None, e["seq"] or 0, e["text"]))
    done = [e["content"] for e in own if e["type"] == "done"]
    content = max(done, default="") or "".join(e["text"] for e in pieces)
    failed = any(e["type"] == "error" and e["message"] is not None for e in own)
    start, last = min(e["us"] for e in own), max(e["us"] for e in own)
    n, ms = (max((e[k] for e in own if e[k] is not None), default=None) for k in ("n", "ms"))
    first = min((e["us"] for e in pieces), default=None)
    return (
        content, None if first is None else (first - start) / 1000, (last - start) / 1000,
        n / (ms / 1000) if ms and ms > 0 and n is not None else None,
        len(delta), not failed and content.strip(" ") != "", "call", len(events) - len(own),
    )


def millis(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000


def windowed_latency(events: DataFrame, ts: str, keys: list[str], value: str, error: Column, width: str, late: str) -> DataFrame:
    """Counts, errors, mean and maximum per tumbling window; batch or stream (watermark `late`)."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, width).alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(error).alias("errors"),
        F.avg(value).alias("mean_value"),
        F.max(value).alias("max_value"),
    ).select(F.col("_w.start").alias("window_start"), *keys, "n", "errors", "mean_value", "max_value")


def split_sinks(stream: DataFrame, blocked: str, sent_path: str, held_path: str, checkpoint: str):
    """Continuous gate: each micro-batch goes to two folders, held-back rows apart.

    The batch id names the folder of each side and a batch replaces both, an empty side too: a batch that is run again after a
    lost executor or driver, or with other verdicts, leaves no row twice and none on the side it was on before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            for part, path in ((~F.col(blocked), sent_path), (F.coalesce(F.col(blocked), F.lit(True)), held_path)):
                b.where(part).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            b.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
