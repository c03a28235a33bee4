"""Texts are trimmed, squeezed, counted and folded once: results as before, and fewer passes in the plan."""
import itertools

from pyspark.sql import functions as F

from veilspan.functions.regexes import _WS
from veilspan.functions.text import js_trim, squeeze
from veilspan.operators import quality as Q
from veilspan.operators import render as T
from veilspan.plans import texts as X

PROFILE = "id long, name string, employer string, current_role string, desired_role string, target_company string, years int, achievements string, offer string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trim_and_squeeze_equal_the_pattern(spark):
    marks = ["a", " ", "\n", "\t", " ", " ", "　", "é", "﻿", "🙂"]
    texts = [("".join(p),) for n in range(5) for p in itertools.product(marks, repeat=n) if n < 4 or p[0] != p[1]] + [(None,)]
    d = spark.createDataFrame(texts, "t string")
    old = d.select("t", F.regexp_replace("t", f"^[{_WS}]+|[{_WS}]+$", "").alias("trimmed"), F.trim(F.regexp_replace("t", f"[{_WS}]+", " ")).alias("squeezed"))
    bad = old.where(~js_trim(F.col("t")).eqNullSafe(F.col("trimmed")) | ~squeeze(F.col("t")).eqNullSafe(F.col("squeezed")))
    assert bad.count() == 0


def test_letter_words_are_counted_by_paragraph(spark):
    long = ". ".join(f"Coordiné el proyecto número {'abcdefghijkl'[i]} " + "con mucha dedicación " * 8 for i in range(4))
    rows = [(1, "Ana Ixcot", "Cemex", "Analista", "Jefe de ventas", "Claro", 5, "Lideré equipos. Reduje costos.", "Requisitos:\n- Excel avanzado\n- SQL"),
            (2, None, None, None, None, None, None, None, None), (3, "Mario", "Tigo", "Contador", "Gerente", "Walmart", 1, long, "- " + "largo " * 60)]
    out = T.template_letters_c(spark.createDataFrame(rows, PROFILE), "id")
    got = {r.id: r.letter for r in out.select("id", "letter", F.lit(1)).collect()}
    assert got[2].startswith("Estimado equipo de su empresa:\n\nMe dirijo a ustedes") and got[2].endswith("consideración.\n\nAtentamente,")
    words = {r.id: r.n for r in out.select("id", F.regexp_count("letter", F.lit("[\\p{L}\\p{N}]+(?:[-'’][\\p{L}\\p{N}]+)*")).alias("n")).collect()}
    assert 250 <= words[1] <= 400 and words[3] <= 400
    # seven paragraphs, not the twelve letters they can make
    assert plan(out).lower().count("regexp_count(") <= 7


def test_names_and_keywords_against_the_source(spark):
    d = spark.createDataFrame([("Trabajé con Acme y Ñandú en la ciudad, Bogotá", "acme bogota", "Excel, EXCEL. excél Ñandúes árboles Arboles."), (None, None, None)], "l string, c string, o string")
    got = d.select(Q.unknown_names(F.col("l"), F.col("c")).alias("u"), F.transform(Q.keyword_counts(F.col("o")), lambda x: F.concat_ws(":", x["word"], x["less"])).alias("k")).collect()
    assert got[0].u == ["Ñandú"] and got[0].k == ["arboles:-2", "excel:-3", "nandues:-1"] or got[0].k == ["excel:-3", "arboles:-2", "nandues:-1"]
    assert got[1].k == []


def test_own_name_reads_two_words_and_folds_the_text_once(spark):
    texts = ["Ana  Pérez, ANA-PEREZ y ana perez", "uno", "", None, "Á a B", "aa b aa b", "- & xy & xy", "é\nñu É ñu", "uno uno dos", "¡Ñandú! Óscar " * 3]
    d = X.own_name_hits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    # rows 4 and 8 begin with one word twice
    assert {r.doc_id: r.hits for r in d.collect()} == {0: 3, 5: 2, 6: 2, 7: 2, 9: 3}
    assert plan(d).count("regexp_extract_all(") == 1 and plan(d).count("regexp_extract(") <= 4
