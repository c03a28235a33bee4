"""Profiles with planted values, derived from `customer` by the same expressions in both dialects.

Every expression below is valid in Spark SQL and in ANSI SQL alike, so a query and its oracle start
from identical texts while the expected result is known by construction.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.session import spread, table


def case(expr: str, options: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE CAST({expr} AS INT) {whens} END"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qs(*items: str) -> list[str]:
    return [q(i) for i in items]


def comma(n: str) -> str:
    """Thousands-grouped text of an integer below one million."""
    return (
        f"(CASE WHEN {n} < 1000 THEN CAST({n} AS STRING) ELSE CAST(CAST(floor({n} / 1000) AS INT) AS STRING) || ',' || "
        f"lpad(CAST(CAST({n} % 1000 AS INT) AS STRING), 3, '0') END)"
    )


def txt(n: str) -> str:
    return f"CAST(CAST({n} AS BIGINT) AS STRING)"


K = "c_custkey"
LEVEL1 = {
    "id": f"CAST({K} AS BIGINT)",
    "k": f"CAST({K} AS BIGINT)",
    "nation": "c_nationkey",
    "segment": "c_mktsegment",
    "cur": f"CAST(5000 + ({K} * 37 % 401) * 50 AS BIGINT)",
    "pct": f"CAST(({K} * 13) % 91 - 10 AS BIGINT)",
    "years": f"CAST({K} % 16 AS INT)",
    "name": case(f"{K} % 6", qs("Ana", "Mario", "María", "José", "Lucía", "Andrés")) + " || ' ' || "
    + case(f"floor({K} / 6) % 5", qs("Pérez", "Juárez", "Ixcot", "Méndez", "Barrios")),
    "employer": case(
        f"{K} % 5",
        qs("Banco Industrial, S.A.", "Tigo Guatemala", "Grupo Pantaleon", "Cervecería Centroamericana", "Xelajú Tech"),
    ),
    "alias": case(f"{K} % 5", qs("Banco Industrial", "TIGO", "Pantaleon", "Cerveceria Centroamericana", "XelajuTech")),
    "role": case(f"{K} % 4", qs("Analista de datos", "Contadora", "Vendedor senior", "Soporte técnico")),
    "desired_role": case(f"floor({K} / 4) % 4", qs("Gerente de datos", "Contadora senior", "Jefe de ventas", "Analista")),
    "company": case(f"({K} * 3) % 4", qs("Cemex", "Walmart", "Claro", "Ingenio La Unión")),
}
LEVEL2 = {
    "desired": "CAST(CASE WHEN k % 5 = 0 THEN floor(cur * (100 + pct) / 100 / 7.7 / 10) * 10 "
    "ELSE floor(cur * (100 + pct) / 100 / 50) * 50 END AS BIGINT)",
    "desired_cur": "CASE WHEN k % 5 = 0 THEN 'USD' ELSE 'GTQ' END",
    "lo": "CAST(4000 + (k * 29 % 300) * 50 AS BIGINT)",
    "width": "CAST((k * 11 % 80) * 50 AS BIGINT)",
    "form": "CAST(k % 7 AS INT)",
    "contact": "CAST(floor(k / 7) % 4 AS INT)",
    "phone": "'5' || lpad(CAST(k * 7 % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(k * 31 % 10000 AS STRING), 4, '0')",
}
LEVEL3 = {
    "hi": "lo + width",
    "salary_text": case(
        "form",
        [
            f"'Q' || {comma('cur')}", f"'Q ' || replace({comma('cur')}, ',', ' ')", f"{txt('cur')} || ' quetzales'",
            f"'GTQ ' || {txt('cur')}", f"'Q.' || {comma('cur')} || '.00'", f"{txt('cur')}", "'doce y medio'",
        ],
    ),
    "contact_text": case(
        "contact",
        [
            "'u' || CAST(k AS STRING) || '@correo.com'", "phone", "'carla punto ruiz arroba correo punto com'",
            "'Carlos Pérez'",
        ],
    ),
}
LEVEL4 = {
    "achievements": "'Lideré un equipo de ' || CAST(k % 9 + 2 AS STRING) || ' personas. Hoy gano ' || salary_text || "
    "' y me va bien. Contacto: ' || CASE WHEN contact = 3 THEN 'mi jefe, ' ELSE '' END || contact_text || '. En ' || alias || "
    "' aprendí mucho. Reduje costos 12 %.'",
    "offer": "'Buscamos ' || desired_role || '.' || chr(10) || 'Salario: Q' || " + comma("lo")
    + " || ' - Q' || " + comma("hi")
    + " || ' mensuales.' || chr(10) || 'Requisitos:' || chr(10) || '- Excel avanzado' || chr(10) || '- Manejo de SQL' "
    "|| chr(10) || '* Experiencia de ' || CAST(years AS STRING) || ' años;'"
    " || CASE WHEN k % 9 = 0 THEN chr(10) || 'Indicar pretensión salarial.' ELSE '' END",
}
LEVELS = (LEVEL1, LEVEL2, LEVEL3, LEVEL4)


def profiles_sql() -> str:
    out = "customer"
    for i, lvl in enumerate(LEVELS):
        cols = ", ".join(f"{e} AS {n}" for n, e in lvl.items())
        out = f"(SELECT {'' if i == 0 else '*, '}{cols} FROM {out}) l{i}" if i else f"(SELECT {cols} FROM customer) l0"
    return f"SELECT * FROM {out}"


PROFILES = f"profiles AS ({profiles_sql()})"


def raw_profiles(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "customer"))
    for i, lvl in enumerate(LEVELS):
        cols = [f"{e} AS {n}" for n, e in lvl.items()]
        d = d.selectExpr(*cols) if i == 0 else d.selectExpr("*", *cols)
    return d


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical profile columns."""
    return raw_profiles(spark, sf).selectExpr(
        "id", "name", "employer", "role AS current_role", "CAST(cur AS DOUBLE) AS current_salary",
        "'GTQ' AS current_currency", "desired_role", "company AS target_company", "'Guatemala, Guatemala' AS location",
        "CAST(desired AS DOUBLE) AS desired_salary", "desired_cur AS desired_currency", "years", "achievements", "offer",
    )
