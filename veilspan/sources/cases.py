"""Readers of case, benchmark and event files, and the result sink."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROFILE = {
    "nombre": "name", "puestoActual": "current_role", "empleadorActual": "employer", "salarioActual": "current_salary",
    "monedaActual": "current_currency", "puestoDeseado": "desired_role", "empresaDestino": "target_company",
    "salarioDeseado": "desired_salary", "monedaDeseada": "desired_currency", "aniosExperiencia": "years",
    "logros": "achievements", "oferta": "offer",
}

CASE_SCHEMA = """
id string, descripcion string,
profile struct<nombre:string,puestoActual:string,empleadorActual:string,salarioActual:double,monedaActual:string,
  puestoDeseado:string,empresaDestino:string,salarioDeseado:double,monedaDeseada:string,aniosExperiencia:int,
  logros:string,oferta:string>,
canaries array<struct<type:string,value:string,dificultad:string,nota:string>>,
allowed array<string>
"""

BENCH_INPUT_SCHEMA = """
id string, description string,
profile struct<fullName:string,email:string,phone:string,currentRole:string,currentEmployer:string,
  currentSalary:struct<amount:double,currency:string>,desiredRole:string,desiredSalary:struct<amount:double,currency:string>,
  targetCompany:string,yearsExperience:int,achievements:string,jobOffer:string>
"""

BENCH_RESULT_SCHEMA = """
meta struct<timestamp:string,dry:boolean,models:array<string>,tasks:array<string>,runs:int>,
memory array<struct<model:string,size:bigint,sizeVram:bigint,mode:string>>,
calls array<struct<model:string,inputId:string,task:string,run:int,kind:string,ok:boolean,error:string,
  stats:struct<ttftMs:double,totalMs:double,evalCount:int,promptEvalCount:int,tokensPerSecond:double,loadMs:double>,
  content:string,quality:string>>,
judge array<struct<inputId:string,task:string,order:array<string>,
  scores:map<string,struct<utilidad:double,precision:double,tono:double,fidelidad:double>>,comment:string,
  passes:array<struct<order:array<string>,scores:map<string,struct<utilidad:double,precision:double,tono:double,fidelidad:double>>,comment:string>>>>
"""


def read_cases(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """Leak cases, one JSON document per file, on the canonical profile columns."""
    d = spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)
    if prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("id").startswith(p)
        d = d.where(keep)
    return d.select(
        "id",
        *[F.col(f"profile.{s}").alias(t) for s, t in _PROFILE.items()],
        F.transform(
            "canaries",
            lambda c: F.struct(c["type"].alias("type"), c["value"].alias("value"), c["dificultad"].alias("difficulty")),
        ).alias("canaries"),
        "allowed",
    )


def canary_table(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.inline("canaries"))


def allowed_table(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.explode("allowed").alias("value"))


def read_bench_inputs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Benchmark inputs in id order; `limit` keeps the first n (a top-k, not a full sort)."""
    d = spark.read.schema(BENCH_INPUT_SCHEMA).json(path, multiLine=True).select(
        "id", "description",
        F.col("profile.fullName").alias("name"), F.col("profile.email").alias("email"), F.col("profile.phone").alias("phone"),
        F.col("profile.currentRole").alias("current_role"), F.col("profile.currentEmployer").alias("employer"),
        F.col("profile.currentSalary.amount").alias("current_salary"), F.col("profile.currentSalary.currency").alias("current_currency"),
        F.col("profile.desiredRole").alias("desired_role"), F.col("profile.desiredSalary.amount").alias("desired_salary"),
        F.col("profile.desiredSalary.currency").alias("desired_currency"), F.col("profile.targetCompany").alias("target_company"),
        F.col("profile.yearsExperience").alias("years"), F.col("profile.achievements").alias("achievements"),
        F.col("profile.jobOffer").alias("offer"),
    )
    return d.orderBy("id").limit(limit) if limit is not None else d


def read_bench_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored benchmark results → calls, judge scores, memory as flat tables."""
    d = spark.read.schema(BENCH_RESULT_SCHEMA).json(path, multiLine=True)
    calls = d.select(F.inline("calls")).select(
        "model", F.col("inputId").alias("input"), "task", "run", "kind", "ok", "error",
        F.col("stats.ttftMs").alias("ttft_ms"), F.col("stats.totalMs").alias("total_ms"),
        F.col("stats.tokensPerSecond").alias("tps"), F.col("stats.evalCount").cast("double").alias("tokens"),
        F.col("stats.loadMs").alias("load_ms"), "content",
    )
    verdict = d.select(F.inline("judge"))
    single = F.array(F.struct(F.col("order"), F.col("scores"), F.col("comment")))
    passes = verdict.select(
        F.col("inputId").alias("input"), "task", F.posexplode(F.coalesce("passes", single)).alias("pass", "p")
    )
    by_model = passes.select(
        "input", "task", "pass", F.col("p.order").alias("_order"), F.explode("p.scores").alias("model", "_s")
    )
    judge = by_model.select(
        "input", "task", "pass", "model", (F.array_position("_order", F.col("model")) - 1).cast("int").alias("position"),
        F.expr("stack(4, 'utilidad', _s.utilidad, 'precision', _s.precision, 'tono', _s.tono, 'fidelidad', _s.fidelidad) AS (criterion, score)"),
    )
    return calls, judge, d.select(F.inline("memory"))


def rescore(calls: DataFrame, inputs: DataFrame) -> DataFrame:
    """Score stored outputs again with the current rules, without calling any model."""
    from veilspan.operators import compensation as C
    from veilspan.operators import quality as Q

    i = C.with_offer_range_b(inputs, "offer", C.language(F.col("offer")), "offer_range")
    i = C.with_facts_b(i, "facts")
    i = Q.with_number_reference(i, "ref_amounts", "ref_percents").select("id", "offer", "ref_amounts", "ref_percents")
    j = calls.where("ok").join(i, F.col("input") == F.col("id")).drop("id")
    j = Q.note_quality(j, "content", "note_quality")
    j = Q.requirements_quality(j, "content", "offer", "requirements_quality")
    note = F.col("task") == "negotiation"
    return j.select(
        *calls.columns,
        F.when(note, F.col("note_quality")).alias("note_quality"),
        F.when(~note, F.col("requirements_quality")).alias("requirements_quality"),
    )


def with_unit(calls: DataFrame, inputs: DataFrame, version: str) -> DataFrame:
    """Successful calls with `unit`: a digest of the call, its output, the whole input record and the version of the rules."""
    record = inputs.select(F.col("id").alias("_id"), F.sha2(F.to_json(F.struct(*inputs.columns)), 256).alias("_record"))
    own = F.to_json(F.struct("model", "input", "task", "run", "content", "_record", F.lit(version).alias("version")))
    return calls.where("ok").join(record, F.col("input") == F.col("_id")).select(*calls.columns, F.sha2(own, 256).alias("unit"))


def rescore_changed(calls: DataFrame, inputs: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """The scores of all successful calls: those in `stored` (a former result of this function) whose unit is unchanged, and
    new ones for the rest. `state` tells `kept` from `rescored`; units that are gone are left out, of equal units one stays.

    Only digests meet the stored scores, and only calls without one are scored."""
    cols = ["unit", "model", "input", "task", "run", "note_quality", "requirements_quality"]
    now = with_unit(calls, inputs, version).dropDuplicates(["unit"])
    kept = stored.select(*cols).dropDuplicates(["unit"]).join(now.select("unit"), "unit", "left_semi")
    todo = now.join(stored.select("unit"), "unit", "left_anti")
    return kept.withColumn("state", F.lit("kept")).unionByName(rescore(todo, inputs).select(*cols).withColumn("state", F.lit("rescored")))


def write_results(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """Append one run under its date partition; a repeated run of a date replaces only that date."""
    (
        df.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .format(fmt)
        .save(path)
    )
