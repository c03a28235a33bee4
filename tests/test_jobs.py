"""Whole jobs on small tables: streams, cache, sinks, percentiles, leak audit."""
import json
import os

import pytest
from pyspark.sql import functions as F

from veilspan.operators import audit as A
from veilspan.operators import benchstats as B
from veilspan.operators import detect as D
from veilspan.operators import govern as G
from veilspan.operators import quality as Q
from veilspan.operators import render as T
from veilspan.sources import cases as K
from veilspan.streaming import events as ST

CASE = {
    "id": "demo-1", "descripcion": "invented",
    "profile": {
        "nombre": "Ana Ixcot", "puestoActual": "Analista", "empleadorActual": "Banco Industrial, S.A.", "salarioActual": 15000.0,
        "monedaActual": "GTQ", "puestoDeseado": "Gerente de datos", "empresaDestino": "Claro", "salarioDeseado": 19000.0, "monedaDeseada": "GTQ",
        "aniosExperiencia": 5, "logros": "Gano quince mil. Mi jefe, Carlos Pérez, del Banco Industrial. Correo: ana arroba correo.", "oferta": None,
    },
    "canaries": [
        {"type": "salary", "value": "quince mil", "dificultad": "media", "nota": ""}, {"type": "person_name", "value": "Carlos Pérez", "dificultad": "fácil", "nota": ""},
        {"type": "employer", "value": "Banco Industrial", "dificultad": "fácil", "nota": ""}, {"type": "email", "value": "ana arroba correo", "dificultad": "difícil", "nota": ""},
    ],
    "allowed": ["Analista", "Claro"],
}


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cases")
    (d / "a.json").write_text(json.dumps(CASE), encoding="utf8")
    return K.read_cases(spark, str(d / "*.json"))


def test_leak_audit(cases):
    assert A.fixture_errors(cases).count() == 0
    r = G.route_c(cases, "id")
    out = {x["type"]: x["redactor"] for x in A.audit(K.canary_table(cases), r, "id").collect()}
    assert out == {"salary": A.CAUGHT, "person_name": A.CAUGHT, "employer": A.CAUGHT, "email": A.LEAK}
    assert A.false_positives(K.allowed_table(cases), r, "id").collect()[0]["kept"] == 2


def test_payload_never_reads_other_columns(cases):
    p = cases.withColumn("location", F.lit("Guatemala")).withColumn("years_bucket", F.lit("ONE_TO_THREE"))
    out = G.project(p, "id", "market")
    assert G.never_sent_violations(out) == []
    with pytest.raises(ValueError):
        G.assert_exact_columns(out.withColumn("employer", F.lit("x")), out.columns)


@pytest.mark.skipif("LEAK_CASES" not in os.environ, reason="folder with the full set of case files not given")
def test_full_case_set(spark):
    c = K.read_cases(spark, os.environ["LEAK_CASES"])
    r = G.route_c(c, "id")
    t = A.audit(K.canary_table(c), r, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("redactor") == A.CAUGHT).alias("c")).collect()[0]
    assert (t["n"], t["c"]) == (78, 66)


def test_template_letter_c_has_the_asked_length(cases):
    letter = T.template_letters_c(cases, "id").select("letter", Q.length_ok(F.col("letter")).alias("ok")).collect()[0]
    assert letter["ok"] and "quince mil" not in letter["letter"] and letter["letter"].endswith("Ana Ixcot")


def test_percentiles_are_nearest_rank(spark):
    rows = [("a", float(i)) for i in range(1, 11)] + [("b", 7.0)] * 5 + [("c", float(i * i)) for i in range(1000)]
    rows += [(None, 3.0), (None, 1.0), ("d", None), ("e", 1e9), ("e", 1.0), ("e", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in B.percentiles(d, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (5.0, 10.0), "b": (7.0, 7.0), "c": (499.0**2, 949.0**2), None: (1.0, 3.0), "d": (None, None), "e": (1.0, 1e9)}
    assert {r["k"]: r["m"] for r in B.medians(d, ["k"], "v", "m").collect()} == {"a": 5.5, "b": 7.0, "c": (499.0**2 + 500.0**2) / 2, None: 2.0, "d": None, "e": (1e9 + 1) / 2}


def test_percentiles_of_a_large_skewed_group(spark):
    d = spark.range(0, 200_000).selectExpr("'k' AS k", "CASE WHEN id = 0 THEN 1e12 ELSE CAST(id * 7919 % 200000 AS DOUBLE) END AS v")
    want = sorted([1e12] + [float(i * 7919 % 200_000) for i in range(1, 200_000)])
    r = B.percentiles(d.repartition(7), ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()[0]
    assert (r["p50"], r["p99"]) == (want[99_999], want[197_999])


def test_ordinals_follow_the_key(spark):
    d = spark.range(0, 500).select((F.col("id") * 7 % 501).alias("k"))
    got = sorted((r["k"], r["ordinal"]) for r in B.ordinals(d, "k").collect())
    assert [o for _, o in got] == list(range(500))


def test_requirements_of_a_wrong_type_are_refused(spark):
    d = spark.createDataFrame([(1, '{"must":["a"],"nice":[1],"keywords":[]}'), (2, '{"must":["a"],"nice":["b"],"keywords":[]}'), (3, '{"must":"a","nice":[],"keywords":[]}')], "i int, c string")
    got = {r["i"]: r["p"]["schema_valid"] for r in d.select("i", Q.parse_requirements(F.col("c")).alias("p")).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_keep_strings_count_one_by_one(spark):
    d = spark.createDataFrame(
        [(1, "Trabajo en Banco Industrial hoy", "Banco Industrial", ["Banco", "Banco Industrial"]), (2, "Trabajo en Banco Industrial hoy", "Banco Industrial", ["Banco"])],
        "i int, t string, e string, k array<string>",
    )
    got = {r["i"]: [x["kind"] for x in r["f"]] for r in D.find_c(d, "t", "f", "e", None, "k").collect()}
    assert got == {1: [], 2: ["employer"]}


def test_own_name_with_dot_or_hyphen_is_masked(spark):
    d = spark.createDataFrame([("Soy José A. Pérez.", "José A. Pérez"), ("Soy Ana-María López", "Ana-María López"), ("Soy Ana María López", "Ana-María López")], "t string, n string")
    assert [[x["rule"] for x in r["f"]] for r in D.find_c(d, "t", "f", None, "n", None).collect()][:2] == [["own_name"], ["own_name"]]


def test_names_after_any_number_of_blanks(spark):
    d = spark.createDataFrame([("lo hice en Microsoft ayer",), ("lo hice en" + " " * 12 + "Microsoft ayer",)], "t string")
    assert [r[0] for r in d.select(Q.unknown_names(F.col("t"), F.lit("nada"))).collect()] == [["Microsoft"], ["Microsoft"]]


def test_leaves_at_any_depth(spark):
    body = '{"a":{"b":{"c":{"d":{"e":{"f":"x@y.com"}}}}}}'
    d = spark.createDataFrame([(1, body), (2, '[1,{"k":null,"q":"]}{"}]'), (3, "no json x@y.com"), (4, None)], "id int, body string")
    got = {(r["id"], r["path"], r["text"]) for r in G.walk_leaves(d, "id", "body").collect()}
    keys = {(1, f"$.{'.'.join('abcdef'[:i])}.<key>".replace("$..", "$."), "abcdef"[i]) for i in range(6)}
    assert got == keys | {(1, "$.a.b.c.d.e.f", "x@y.com"), (2, "$[0]", "1"), (2, "$[1].<key>", "k"), (2, "$[1].<key>", "q"), (2, "$[1].q", "]}{"), (3, "$", "no json x@y.com")}
    gate = {r["id"]: (r["blocked"], r["blocked_path"]) for r in G.gate_leaves_a(d, "id", "body").collect()}
    assert gate[1] == (True, "$.a.b.c.d.e.f") and gate[2] == (False, None) and gate[3] == (True, "$")


def test_requirements_quality(spark):
    d = spark.createDataFrame(
        [(1, '```json\n{"must":["Excel avanzado"],"nice":[],"keywords":[]}\n```', "Requisitos:\n- Excel avanzado\n- Inglés"), (2, "{nada", "- Excel")], "i int, c string, o string"
    )
    r = {x["i"]: x["q"] for x in Q.requirements_quality(d, "c", "o", "q").collect()}
    assert r[1]["schema_valid"] and r[1]["grounding"] == 1.0 and r[1]["recall"] == 0.5
    assert not r[2]["json_valid"] and r[2]["score"] == 0.0


def _event(call, seq, second, type_, **kw):
    ts = f"2026-01-{1 + second // 86400:02d}T{second // 3600 % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"
    return json.dumps({"call": call, "seq": seq, "ts": ts, "type": type_, **kw})


def test_event_stream_folds_like_the_batch(spark, tmp_path):
    lines = [
        _event("a", 0, 0, "status", phase="generating"), _event("a", 1, 1, "delta", text="Ho"), _event("a", 2, 2, "delta", text="la"),
        _event("a", 3, 4, "done", content="", stats={"eval_count": 20, "eval_duration_ms": 2000}), _event("b", 0, 0, "error", message="x"), "", "broken",
    ]
    src = tmp_path / "in"
    src.mkdir()
    (src / "e.txt").write_text("\n".join(lines))
    later = json.dumps({"call": "z", "seq": 0, "ts": "2026-01-01T05:00:00Z", "type": "status"})
    (src / "f.txt").write_text(later)
    stream = ST.fold_calls(ST.read_event_lines(spark, str(src)))
    q = stream.writeStream.outputMode("append").format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["call"]: r for r in spark.table("calls").collect()}
    assert set(got) == {"a", "b"}  # given out and released; the call still within its quiet time is not
    assert (got["a"]["content"], got["a"]["ttft_ms"], got["a"]["total_ms"], got["a"]["tps"], got["a"]["ok"]) == ("Hola", 1000.0, 4000.0, 10.0, True)
    assert not got["b"]["ok"]


def _run(spark, src, out, name, lines):
    (src / name).write_text("\n".join(lines))
    d = ST.fold_calls_by_state(ST.read_event_lines(spark, str(src)))
    q = d.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [r.asDict() for r in spark.read.parquet(str(out)).collect()]


def test_a_silent_call_is_one_row_and_late_events_are_counted(spark, tmp_path):
    src, out, h = tmp_path / "in", tmp_path / "out", 3600
    src.mkdir()
    a = [_event("a", 0, 0, "status", phase="generating"), _event("a", 2, h, "delta", text="la"), _event("a", 1, 2, "delta", text="Ho")]
    open_call = [_event("c", 0, 5, "delta", text="no end")]
    assert _run(spark, src, out, "1.txt", a + open_call) == []  # an hour of silence closes nothing
    end = [_event("a", 3, 2 * h, "done", content="", stats={"eval_count": 20, "eval_duration_ms": 2000}), _event("a", 4, 2 * h + 9, "delta", text="!"), _event("b", 0, 2 * h, "error", message="x")]
    got = {r["call"]: r for r in _run(spark, src, out, "2.txt", end + [_event("z", 0, 2 * h + 300, "status")])}
    assert set(got) == {"a", "b"} and got["b"]["ok"] is False
    batch = {r["call"]: r.asDict() for r in ST.fold_calls(ST.parse_event_lines(spark.createDataFrame([(x,) for x in a + end[:1] + end[2:]], "value string"))).collect()}
    for call in "ab":
        assert {k: got[call][k] for k in batch[call]} == batch[call]
        assert got[call]["kind"] == "call" and got[call]["after_end"] == (1 if call == "a" else 0)
    _run(spark, src, out, "3.txt", [_event("a", 5, 2 * h + 400, "delta", text="?"), _event("a", 6, 2 * h + 401, "delta", text="?")])
    rows = _run(spark, src, out, "4.txt", [_event("y", 0, 4 * h, "status")])
    assert sorted((r["call"], r["kind"], r["after_end"]) for r in rows) == [("a", "call", 1), ("a", "late", 2), ("b", "call", 0)]
    rows = _run(spark, src, out, "5.txt", [_event("y", 1, 30 * h, "status")])
    (never,) = [r for r in rows if r["call"] == "c"]
    assert never["content"] == "no end" and never["ok"] and never["total_ms"] == 0 and sum(r["call"] == "a" for r in rows) == 2


def test_rows_that_change_sides_on_a_rerun(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.txt").write_text("one\ntwo\n")
    sides = [str(tmp_path / "sent"), str(tmp_path / "held")]
    for n, cond in enumerate(["value = 'one'", "false", "true", "nullif(value, 'one') <> 'two'"]):  # each run is batch 0 again
        s = spark.readStream.text(str(src)).selectExpr("value", f"{cond} AS blocked")
        ST.split_sinks(s, "blocked", *sides, str(tmp_path / f"cp{n}")).awaitTermination(120)
        sent, held = ([r["value"] for r in spark.read.parquet(p).collect()] for p in sides)
        assert (sorted(sent), sorted(held)) == [(["two"], ["one"]), (["one", "two"], []), ([], ["one", "two"]), (["two"], ["one"])][n]


def test_continuous_redaction_splits_sinks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.txt").write_text("gano Q15,000 aquí\nsin datos\nmuchos quetzales\n", encoding="utf8")
    s = spark.readStream.text(str(src))
    s = D.find_b(s, "value", "left", currency_words=True).withColumn("blocked", F.size("left") > 0)
    q = ST.split_sinks(s.drop("left"), "blocked", str(tmp_path / "sent"), str(tmp_path / "held"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()] == ["sin datos"]
    assert spark.read.parquet(str(tmp_path / "held")).count() == 2


def test_result_sink_replaces_only_its_date(spark, tmp_path):
    d = spark.createDataFrame([(1,)], "x int")
    p = str(tmp_path / "out")
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        K.write_results(d, p, day)
    assert spark.read.parquet(p).count() == 2
