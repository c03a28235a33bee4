"""Literal cases of the rules: input → expected spans, values, bands."""
from pyspark.sql import functions as F

from veilspan.functions import numbers as N
from veilspan.functions import spans as S
from veilspan.functions import text as X
from veilspan.operators import compensation as C
from veilspan.operators import detect as D
from veilspan.operators import money as M
from veilspan.operators import quality as Q
from veilspan.operators import redact as R


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)


def values(spark, texts, expr):
    return [r[0] for r in rows(spark, texts).orderBy("i").select(expr(F.col("t"))).collect()]


def col(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_parse_amounts(spark):
    got = values(spark, ["Q 15 000", "1.5 millones", "Q.8,500.50", "15k", "15 mil", "nada", "2000"], N.parse_amount_a)
    assert got == [15000.0, 1500000.0, 8500.5, 15000.0, 15000.0, None, 2000.0]
    assert values(spark, ["15,000.50", "15.000", "15 000", "15,5"], N.parse_number_b) == [15000.5, 15000.0, 15000.0, 15.5]
    assert values(spark, ["15,000.50", "15.000,50", "12,5", "15'000"], N.parse_number_c) == [15000.5, 15000.5, 12.5, 15000.0]


def test_spanish_words(spark):
    d = spark.createDataFrame([(float(n),) for n in (0, 100, 1000, 12500, 15000, 21031, 999999)], "n double")
    assert [r[0] for r in d.select(N.spanish_words(F.col("n"))).collect()] == [
        "cero", "cien", "mil", "doce mil quinientos", "quince mil", "veintiun mil treinta y un",
        "novecientos noventa y nueve mil novecientos noventa y nueve",
    ]


def test_half_up_goes_towards_plus_infinity(spark):
    d = spark.createDataFrame([(-2.5,), (2.5,), (-2.6,)], "x double")
    assert [r[0] for r in d.select(N.half_up(F.col("x"))).collect()] == [-2.0, 3.0, -3.0]


def test_contains_amount_in_any_form(spark):
    d = spark.createDataFrame(
        [("gano Q15,000 hoy", 15000.0), ("gano quince mil", 15000.0), ("unos 12.5k", 12500.0), ("115000", 15000.0), ("x", 0.0), ("gano 2500000", 2500000.0)], "t string, a double"
    )
    got = d.select(N.contains_amount(F.col("t"), F.col("a")).isNotNull(), N.has_amount(N.amount_haystack(F.col("t")), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (True, True), (False, False), (False, False), (True, True)]


def test_money_mentions_b(spark):
    d = M.with_mentions_b(rows(spark, ["quince mil", "2000 dólares", "1.234.567", "en 2019 subió 30 %", "treinta y cinco mil quetzales"]), "t", "m")
    got = [[(m["value"], m["currency"], m["is_money"]) for m in r] for r in col(d, "m")]
    assert got == [[(15000.0, None, True)], [(2000.0, "USD", True)], [(1234567.0, None, True)], [(2019.0, None, False)], [(35000.0, "GTQ", True)]]


def test_money_spans_c(spark):
    texts = [
        "gano Q.15,000.00 mensuales", "veinticinco mil quinientos", "Q3 2024", "10,000 usuarios", "un millón",
        "cien mil descargas", "crecí 30%", "15000 quetzales",
    ]
    d = M.with_mentions_c(rows(spark, texts), "t", "m")
    got = [[(m["raw"], m["value"]) for m in r] for r in col(d, "m")]
    assert got[:7] == [[("Q.15,000.00", 15000.0)], [("veinticinco mil quinientos", 25500.0)], [], [], [], [], []]
    assert got[7][0] == ("15000 quetzales", 15000.0)


def profile(spark, texts, employer="Banco Industrial, S.A.", name="Ana Lucía Pérez"):
    return rows(spark, texts).withColumn("e", F.lit(employer)).withColumn("n", F.lit(name)).withColumn("k", F.array(F.lit("Café Calle Real")))


def test_redact_c(spark):
    texts = {
        "mi jefe, Carlos Pérez Rodas": "mi jefe, [PERSONA]",
        "Gerente General de tienda": "Gerente General de tienda",
        "en Banco Indutrial y en BI": "en [EMPLEADOR_ACTUAL] y en [EMPLEADOR_ACTUAL]",
        "BancoIndustrial y B.I. fin": "[EMPLEADOR_ACTUAL] y [EMPLEADOR_ACTUAL] fin",
        "de 2019-2023 tel 2222-3333": "de 2019-2023 tel [TELÉFONO]",
        "6a avenida 12-34": "[DIRECCIÓN]",
        "vivo en Residenciales Los Álamos": "vivo en [DIRECCIÓN]",
        "soy ANA LUCIA PEREZ": "soy {{NOMBRE}}",
        "trabajo en Café Calle Real": "trabajo en Café Calle Real",
        "DPI 2345 67890 0101, NIT: 1234567-8": "DPI [DPI], NIT: [NIT]",
        "ya dice [SALARIO] aquí": "ya dice [SALARIO] aquí",
        "": "",
    }
    d = R.redact_c(profile(spark, list(texts)), "t", "x", "e", "n", "k")
    assert col(d, "x") == list(texts.values())
    again = R.redact_c(d, "x", "y", "e", "n", "k")
    assert col(again, "y") == list(texts.values())


def test_redact_b_masks_in_order(spark):
    d = profile(spark, ["Mi DPI 2345678900101, NIT: 123456K. gano Q15,000 en Grupo  Pantaleon o Pantaleon; ñu@é.com +502 5555-1234 2000 muchos quetzales 30%"], "Grupo Pantaleon, S.A.")
    d = R.redact_b(d.withColumn("a", F.array(F.lit(2000.0))), "t", "x", "e", "a", True)
    assert col(d, "x") == ["Mi DPI [DPI], [NIT]. gano [MONTO] en [EMPLEADOR_ACTUAL] o [EMPLEADOR_ACTUAL]; [CORREO] [TELÉFONO] [MONTO] muchos [MONEDA] 30%"]


def test_redact_a_known_salaries(spark):
    d = rows(spark, ["gano 800 y ref15000x en 2019; Q15,000, 15 mil, quince mil; BANCO-INDUSTRIAL; (502) 2222-3333; 123456-K"])
    d = d.withColumn("e", F.lit("Banco Industrial, S.A.")).withColumn("a", F.array(F.lit(15000.0), F.lit(800.0)))
    d = R.redact_a(d, "t", "x", "e", "a", findings="f")
    r = d.collect()[0]
    assert r["x"] == "gano [monto] y ref[monto]x en 2019; [monto], [monto], [monto]; [empleador actual]; [teléfono]; [NIT]"
    assert [f["kind"] for f in r["f"]][:2] == ["salary", "salary"]


def test_drop_sensitive_sentences(spark):
    d = rows(spark, ["Lideré un equipo. Gano Q15,000 al mes. Escribe a a@b.com! Fin."]).withColumn("s", R.sensitive_sentences(F.col("t")))
    got = R.clean_pieces(d, "i", "s", "c", D.find_a).collect()
    assert got[0]["c"] == ["Lideré un equipo.", "Fin."]


def test_overlap_policies_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    cases = []
    for i in range(60):
        spans = [(s, s + rnd.randint(1, 9), rnd.choice("ab")) for s in (rnd.randint(0, 120) for _ in range(rnd.randint(0, 200)))]
        cases.append((i, "x" * 140, [(s, e, k, "r", None) for s, e, k in spans]))
    df = spark.createDataFrame(cases, f"i int, t string, s {S.SPANS}")
    prio = {"a": 0, "b": 1}
    first = {r["i"]: [(x["start"], x["end"], x["kind"]) for x in r["m"]] for r in S.first_wins(df, "s", "m", prio).collect()}
    merged = {r["i"]: [(x["start"], x["end"]) for x in r["m"]] for r in S.union_merge(df, "s", "m", prio, "t").collect()}
    for i, _, spans in cases:
        order = sorted(spans, key=lambda s: (s[0], s[0] - s[1], prio[s[2]]))
        kept, isl = [], []
        for s in order:
            if all(s[0] >= k[1] or k[0] >= s[1] for k in kept):
                kept.append(s)
            if isl and s[0] < isl[-1][1]:
                isl[-1][1] = max(isl[-1][1], s[1])
            else:
                isl.append([s[0], s[1]])
        assert first[i] == [(s[0], s[1], s[2]) for s in kept]
        assert merged[i] == [tuple(x) for x in isl]


def test_many_matches_in_one_text(spark):
    n = 3000
    t = " ".join(f"w{i}" for i in range(n))
    d, (s,) = S.with_spans(rows(spark, [t]), "t", [S.Rule("n", "n", r"\d+")])
    d = S.apply_tags(d, "t", s, "x", lambda x: F.lit("#"))
    r = d.collect()[0]
    assert len(r[s]) == n and all(t[x["start"] : x["end"]] == x["raw"] for x in r[s])
    assert r["x"] == " ".join("w#" for _ in range(n))


def test_offer_ranges(spark):
    b = {
        "Rango: 8-10k": (8000, 10000, "MONTH"), "hasta Q15,000": (None, 15000, "MONTH"), "Q13,000 a Q16,000 + bono anual": (13000, 16000, "MONTH"),
        "de 2019 - 2023": None,
    }
    d = C.with_offer_range_b(rows(spark, list(b)), "t", F.lit("es"), "r")
    assert [r and (r["min"], r["max"], r["period"]) for r in col(d, "r")] == list(b.values())
    a = {"de 8 a 12 mil quetzales": (8000, 12000), "2-3 años de experiencia": None, "Sueldo: Q18,000": (18000, 18000)}
    d = C.with_offer_range_a(rows(spark, list(a)), "t", F.lit("GTQ"), "r")
    assert [r and (r["min"], r["max"]) for r in col(d, "r")] == list(a.values())
    c = {"12 - 14 mil": (12000, 14000), "USD 2000 to 2500": (2000, 2500), "Salario: Q18,000": (18000, 18000), "15000 quetzales de salario": None}
    d = C.with_offer_range_c(rows(spark, list(c)), "t", "r")
    assert [r and (r["min"], r["max"]) for r in col(d, "r")] == list(c.values())


def test_bands_and_periods(spark):
    d = spark.createDataFrame([(30.0,), (20.0,), (25.0,), (-1.0,), (60.0,)], "p double")
    got = d.select(*[N.band(F.col("p"), v).alias(v) for v in "ABC"]).collect()
    assert [r["A"] for r in got] == ["realistic", "realistic", "realistic", "below", "ambitious"]
    assert got[1]["B"] == "ambicioso" and got[2]["C"] == "ambiciosa"
    h = spark.range(1).select(N.to_monthly(F.lit(50.0), F.lit("HOUR"))).collect()[0][0]
    assert abs(h - 8666.6667) < 1e-3


def test_language_and_seniority(spark):
    assert values(spark, ["", "the team and you will", "de la que"], C.language) == ["es", "en", "es"]
    assert values(spark, ["Analista Semi Senior", "Jefe de ventas", "Analista"], lambda t: C.seniority(F.lit(4), t)) == ["semi-senior", "lead", "semi-senior"]


def test_topic_and_tone(spark):
    texts = ["Tu salario y tu expectativa para la entrevista", "Calcula el interés compuesto y el IVA", "salario"]
    assert values(spark, texts, Q.on_topic) == [True, False, False]
    assert values(spark, ["Estimado equipo: gracias.", "Hola!! vos"], Q.tone_ok) == [True, False]
    assert values(spark, ["Escribo con atención.", "Busco informacion."], Q.spanish_ok) == [True, False]


def test_canonical(spark):
    assert values(spark, ["  Q 15 000\n ÁÉ ", "1,234,567"], X.canonical) == ["q 15000 ae", "1234567"]
