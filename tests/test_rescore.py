"""Stored benchmark results: read from files, scored again, only where something changed."""
import json

import pytest
from pyspark.sql import functions as F

from veilspan.sources import cases as K

OFFER = "Buscamos analista.\nRequisitos:\n- Experiencia con Python y SQL\n- Manejo de Excel avanzado\nOfrecemos Q9,000 a Q12,000 mensuales."
NOTE = "Tu salario actual es de Q8,000 y pides Q10,000. Prepara la entrevista con tus logros y pregunta por el rango de la oferta."


def _input(i):
    return {"id": f"p{i}", "description": "d", "profile": {
        "fullName": "Ana Paz", "email": "a@b.gt", "phone": "5555-1234", "currentRole": "Analista", "currentEmployer": "Xela",
        "currentSalary": {"amount": 8000, "currency": "GTQ"}, "desiredRole": "Analista", "desiredSalary": {"amount": 10000, "currency": "GTQ"},
        "targetCompany": "Norte", "yearsExperience": 4, "achievements": "Reduje 20% los costos.", "jobOffer": OFFER}}


def _call(i, task, content, ok=True):
    return {"model": "m", "inputId": f"p{i}", "task": task, "run": 1, "kind": "warm", "ok": ok, "error": None if ok else "x",
            "stats": {"ttftMs": 10, "totalMs": 90, "evalCount": 30, "promptEvalCount": 5, "tokensPerSecond": 12.5, "loadMs": 0}, "content": content, "quality": None}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "inputs").mkdir()
    for i in (3, 1, 2):
        (tmp_path / "inputs" / f"{i}.json").write_text(json.dumps(_input(i)))
    reqs = json.dumps({"must": ["Experiencia con Python y SQL"], "nice": [], "salary": None})
    score = {"utilidad": 4, "precision": 5, "tono": 3, "fidelidad": 2}
    (tmp_path / "r.json").write_text(json.dumps({
        "meta": {"timestamp": "t", "dry": False, "models": ["m"], "tasks": ["negotiation"], "runs": 1},
        "memory": [{"model": "m", "size": 10, "sizeVram": 5, "mode": "mixed"}],
        "calls": [_call(1, "negotiation", NOTE), _call(2, "negotiation", NOTE), _call(2, "requirements", reqs), _call(3, "negotiation", "", ok=False)],
        "judge": [{"inputId": "p1", "task": "negotiation", "order": ["n", "m"], "scores": {"m": score, "n": score}, "comment": "c", "passes": None}],
    }))
    return tmp_path


def test_readers(spark, files):
    assert [r.id for r in K.read_bench_inputs(spark, str(files / "inputs"), 2).collect()] == ["p1", "p2"]
    first = K.read_bench_inputs(spark, str(files / "inputs"), 1).first()
    assert (first.current_salary, first.target_company, first.years) == (8000.0, "Norte", 4)
    calls, judge, memory = K.read_bench_results(spark, str(files / "r.json"))
    assert calls.count() == 4 and calls.where("tokens = 30 AND tps = 12.5").count() == 4
    assert {(r.model, r.position, r.criterion, r.score) for r in judge.where("model = 'm'").collect()} == {
        ("m", 1, "utilidad", 4.0), ("m", 1, "precision", 5.0), ("m", 1, "tono", 3.0), ("m", 1, "fidelidad", 2.0)}
    assert memory.first().mode == "mixed"


def test_only_changed_units_are_scored_again(spark, files, tmp_path):
    inputs = K.read_bench_inputs(spark, str(files / "inputs"))
    calls, _, _ = K.read_bench_results(spark, str(files / "r.json"))
    whole = K.rescore(calls, inputs).select("input", "task", "note_quality", "requirements_quality").collect()
    assert len(whole) == 3
    assert all((r.note_quality is None) != (r.requirements_quality is None) for r in whole)
    assert all(r.note_quality.spanish and r.note_quality.numbers_ok for r in whole if r.task == "negotiation")

    stored = str(tmp_path / "stored")
    none = K.rescore_changed(calls, inputs, K.with_unit(calls, inputs, "").limit(0).select("*", F.lit(None).alias("note_quality"), F.lit(None).alias("requirements_quality")), "v1")
    none.write.parquet(stored)
    before = spark.read.parquet(stored)
    assert {r.state for r in before.collect()} == {"rescored"} and before.count() == 3

    same = K.rescore_changed(calls, inputs, before, "v1").collect()
    assert {r.state for r in same} == {"kept"} and len(same) == 3
    assert {(r.input, r.task, r.note_quality, r.requirements_quality) for r in same} == {tuple(r) for r in whole}
    assert {r.state for r in K.rescore_changed(calls, inputs, before, "v2").collect()} == {"rescored"}

    longer = inputs.withColumn("offer", F.when(F.col("id") == "p2", F.concat("offer", F.lit("\n- Ruso fluido"))).otherwise(F.col("offer")))
    new = calls.withColumn("ok", F.col("ok") & (F.col("input") != "p1"))
    assert {(r.input, r.task, r.state) for r in K.rescore_changed(new, longer, before, "v1").collect()} == {("p2", "negotiation", "rescored"), ("p2", "requirements", "rescored")}
    text = calls.withColumn("content", F.when(F.col("input") == "p1", F.lit("Otra nota con Q99,000.")).otherwise(F.col("content")))
    got = {(r.input, r.task): r for r in K.rescore_changed(text, inputs, before, "v1").collect()}
    assert {k: r.state for k, r in got.items()} == {("p1", "negotiation"): "rescored", ("p2", "negotiation"): "kept", ("p2", "requirements"): "kept"}
    assert not got["p1", "negotiation"].note_quality.numbers_ok
