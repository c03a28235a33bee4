"""Queries over profiles (derived from `customer`): governance, leaks, compensation, letters."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.operators import audit as A
from veilspan.operators import compensation as C
from veilspan.operators import govern as G
from veilspan.operators import lookup as L
from veilspan.operators import money as M
from veilspan.operators import quality as Q
from veilspan.operators import redact as R
from veilspan.operators import render as T
from veilspan.operators import rulepack as P
from veilspan.operators import strictness as K
from veilspan.plans.base import PROFILES, case, comma, profiles, raw_profiles
from veilspan.plans.registry import query
from veilspan.session import inline_rows, table

# ------------------------------------------------------------------ projections and gates


@query("allowlist_projection", f"""
WITH {PROFILES} SELECT id, trim(regexp_replace(desired_role, '\\s+', ' ', 'g')) AS desired_role, 'Guatemala, Guatemala' AS location,
 CASE WHEN years < 1 THEN 'LESS_THAN_ONE' WHEN years <= 3 THEN 'ONE_TO_THREE' WHEN years <= 6 THEN 'FOUR_TO_SIX' WHEN years <= 9 THEN 'SEVEN_TO_NINE' WHEN years <= 14 THEN 'TEN_TO_FOURTEEN' ELSE 'ABOVE_FIFTEEN' END AS years_bucket
FROM profiles
""")
def allowlist_projection(spark, sf):
    d = profiles(spark, sf).withColumn("years_bucket", N.years_bucket(F.col("years")))
    return G.project(d, "id", "market")


@query("tier_projection", f"WITH {PROFILES} SELECT id, name, desired_role, company AS target_company, years, achievements FROM profiles")
def tier_projection(spark, sf):
    return G.tier_projection(profiles(spark, sf), "id", "third_party")


@query("known_values_join", f"""
WITH {PROFILES} SELECT id, 'employer' AS kind, employer AS value FROM profiles UNION ALL SELECT id, 'name', name FROM profiles
UNION ALL SELECT id, 'salary', CAST(cur AS STRING) FROM profiles UNION ALL SELECT id, 'salary', CAST(desired AS STRING) FROM profiles WHERE desired > 0
""")
def known_values_join(spark, sf):
    """Sensitive values of each profile, exploded in place (the dictionary side of the gate)."""
    p = raw_profiles(spark, sf)
    vals = F.array(
        F.struct(F.lit("employer").alias("kind"), F.col("employer").alias("value")), F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")),
        F.struct(F.lit("salary").alias("kind"), F.col("cur").cast("string").alias("value")),
        F.when(F.col("desired") > 0, F.struct(F.lit("salary").alias("kind"), F.col("desired").cast("string").alias("value"))))
    return p.select("id", F.inline(F.array_compact(vals)))


STRICT = K.Record({"k": K.Number(least=0, most=89, whole=True)})


@query("strict_ingest_quarantine", """
WITH b AS (SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN props WHEN 1 THEN replace(props, '{', '{"extra": 1, ') WHEN 2 THEN replace(props, '}', '') WHEN 3 THEN replace(props, '"k"', '"x"') ELSE props END AS body, CAST(props->>'k' AS INT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'invalid_json' WHEN event_id % 5 IN (1, 3) THEN 'unknown_key' WHEN k NOT BETWEEN 0 AND 89 THEN 'value:k' END AS reason FROM b
""")
def strict_ingest_quarantine(spark, sf):
    b = table(spark, sf, "events").selectExpr(
        "event_id", """CASE CAST(event_id % 5 AS INT) WHEN 0 THEN props WHEN 1 THEN replace(props, '{', '{"extra": 1, ') WHEN 2 THEN replace(props, '}', '') WHEN 3 THEN replace(props, '"k"', '"x"') ELSE props END AS body""")
    r = b.select("event_id", K.refusal(F.col("body"), STRICT).alias("r"))
    return r.select("event_id", F.when(F.col("r.reason").isin("invalid_json", "unknown_key"), F.col("r.reason")).otherwise(F.concat("r.reason", F.lit(":"), F.substring("r.path", 3, 100))).alias("reason"))


_BODY = ("'{\"fullName\":\"' || name || '\",\"currentRole\":\"' || role || '\",\"currentEmployer\":\"' || employer || '\",\"currentSalary\":{\"amount\":' || CAST(cur AS STRING) || ',\"currency\":\"GTQ\"},"
         "\"desiredRole\":\"' || desired_role || '\",\"desiredSalary\":{\"amount\":' || CAST(desired + 1 AS STRING) || ',\"currency\":\"USD\"},\"targetCompany\":\"Claro\",\"yearsExperience\":' || CAST(years AS STRING) || ',\"achievements\":\"Logros\"}'")
# what is done to the body, and what is then wrong
_HARM = [
    ("b", None, None), ("replace(b, '\"USD\"', '\"EUR\"')", "not_listed", "$.desiredSalary.currency"), ("replace(b, '\"fullName\":\"', '\"fullName\":\"  \",\"email\":\"')", "too_short", "$.fullName"),
    ("replace(b, 'Logros', repeat('x', 3001))", "too_long", "$.achievements"), ("replace(b, '\"yearsExperience\":', '\"yearsExperience\":-1')", "value", "$.yearsExperience"),
    ("replace(b, '\"targetCompany\":\"Claro\",', '')", "missing", "$.targetCompany"), ("replace(b, '\"GTQ\"}', '\"GTQ\",\"net\":1}')", "unknown_key", "$.currentSalary.net"), ("substr(b, 1, length(b) - 1)", "invalid_json", "$"),
    ("replace(b, '\"Claro\"', 'null')", "type", "$.targetCompany"), ("replace(b, '\"amount\":', '\"amount\":-')", "value", "$.currentSalary.amount"), ("replace(b, ',\"achievements\"', '.5,\"achievements\"')", "not_whole", "$.yearsExperience"),
    ("replace(b, '{\"fullName\"', '{\"salary\":1,\"fullName\"')", "unknown_key", "$.salary"), ("replace(replace(b, ',\"currency\":\"USD\"', '\",\"currency\":\"USD\"'), '\"desiredSalary\":{\"amount\":', '\"desiredSalary\":{\"amount\":\"')", "type", "$.desiredSalary.amount"),
    ("replace(b, '\"Logros\"', '\"Logros\",\"jobOffer\":7')", "type", "$.jobOffer"), ("replace(b, '\"Logros\"', '\"Logros\",\"email\":\"a@b.c\",\"jobOffer\":\"\"')", None, None), ("'[' || b || ']'", "type", "$"),
]
_FACT = "'{\"id\":' || CAST(id % 10 + 1 AS STRING) || ',\"title\":\"T\",\"snippet\":\"S\"}'"
_REQUEST = "'{\"desiredRole\":\"Jefe\",\"targetCompany\":\"' || company || '\",\"yearsExperience\":3,\"achievements\":\"\",\"jobOffer\":\"\",\"companyFacts\":[' || f || ',' || f || ']}'"
_HARM_FACTS = [
    ("b", None, None), ("replace(b, '[', '[' || f || ',' || f || ',')", "too_many", "$.companyFacts"), ("replace(b, ']}', ',{\"id\":11,\"title\":\"\",\"snippet\":\"\"}]}')", "value", "$.companyFacts[2].id"),
    ("replace(b, '\"S\"', '\"' || repeat('s', 401) || '\"')", "too_long", "$.companyFacts[0].snippet"), ("replace(b, ']}', ',{\"id\":1,\"title\":\"\",\"snippet\":\"\",\"url\":\"\"}]}')", "unknown_key", "$.companyFacts[2].url"),
    ("replace(replace(b, '[', '{\"a\":['), ']', ']}')", "type", "$.companyFacts"), ("replace(b, ']}', ',7]}')", "type", "$.companyFacts[2]"), ("replace(b, ',\"title\":\"T\"', '')", "missing", "$.companyFacts[0].title"),
]


def _harmed(harm: list) -> str:
    return case(f"id % {len(harm)}", [h for h, _, _ in harm])


def _expected(harm: list) -> str:
    wrong = [["NULL" if x is None else f"'{x}'" for x in pair] for _, *pair in harm]
    return f"{case(f'id % {len(harm)}', [r for r, _ in wrong])} AS reason, {case(f'id % {len(harm)}', [p for _, p in wrong])} AS path"


@query("strict_profile_bodies", f"WITH {PROFILES} SELECT id, {_expected(_HARM)} FROM profiles")
def strict_profile_bodies(spark, sf):
    """Profile bodies with nested amounts, optional fields and one fault each, refused with path and reason."""
    b = raw_profiles(spark, sf).selectExpr("id", f"{_BODY} AS b").selectExpr("id", f"{_harmed(_HARM)} AS body")
    return b.select("id", K.refusal(F.col("body"), K.PROFILE).alias("r")).select("id", "r.reason", "r.path")


@query("strict_letter_bodies", f"WITH {PROFILES} SELECT id, {_expected(_HARM_FACTS)} FROM profiles")
def strict_letter_bodies(spark, sf):
    """Letter requests with a list of records: too many, or one of them wrong."""
    b = raw_profiles(spark, sf).selectExpr("id", "company", f"{_FACT} AS f").selectExpr("id", "f", f"{_REQUEST} AS b").selectExpr("id", f"{_harmed(_HARM_FACTS)} AS body")
    return b.select("id", K.refusal(F.col("body"), K.LETTER_REQUEST).alias("r")).select("id", "r.reason", "r.path")


_FORM = ("CASE WHEN id % 6 = 0 THEN '  ' ELSE desired_role END AS desired_role, company AS target_company, CASE WHEN id % 7 = 0 THEN '' ELSE 'Guatemala' END AS location, "
         "CASE CAST(id % 4 AS INT) WHEN 0 THEN 'Q ' || CAST(cur AS STRING) WHEN 1 THEN 'nada' WHEN 2 THEN CAST(cur AS STRING) || '.50' ELSE '0' END AS current_salary, CAST(desired AS STRING) AS desired_salary, "
         "CASE WHEN id % 9 = 0 THEN '' WHEN id % 9 = 1 THEN '75' WHEN id % 9 = 2 THEN 'x' ELSE CAST(years AS STRING) END AS years")


@query("profile_validation_errors", f"""
WITH {PROFILES}, f AS (SELECT id, {_FORM} FROM profiles)
SELECT id, array_to_string(list_filter([CASE WHEN trim(desired_role) = '' THEN 'desired_role' END, CASE WHEN trim(location) = '' THEN 'location' END, CASE WHEN id % 4 IN (1, 3) THEN 'current_salary' END,
 CASE WHEN desired_salary = '0' THEN 'desired_salary' END, CASE WHEN id % 9 IN (0, 1, 2) THEN 'years' END], lambda x: x IS NOT NULL), ',') AS errors FROM f
""")
def profile_validation_errors(spark, sf):
    f = raw_profiles(spark, sf).selectExpr("id", *_split_cols(_FORM))
    cols = ("desired_role", "target_company", "location", "current_salary", "desired_salary", "years")
    return f.select("id", F.array_join(G.profile_errors({c: F.col(c) for c in cols}), ",").alias("errors"))


def _split_cols(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, quote, cur = [], 0, False, ""
    for ch in text:
        quote ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and not depth and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


@query("sent_blocked_split", f"""
WITH {PROFILES} SELECT CASE WHEN id % 10 = 0 THEN 'skipped' WHEN id % 3 = 1 THEN 'blocked' WHEN id % 8 = 0 THEN 'offline' WHEN id % 11 = 0 THEN 'error' ELSE 'sent' END AS status, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(CASE WHEN id % 10 <> 0 AND id % 3 <> 1 AND id % 8 <> 0 AND id % 11 <> 0 THEN strlen(achievements) ELSE 0 END) AS BIGINT) AS bytes FROM profiles GROUP BY status
""")
def sent_blocked_split(spark, sf):
    p, i = raw_profiles(spark, sf), F.col("id")
    st = G.routing_status(i % 10 != 0, i % 3 == 1, i % 8 != 0, i % 11 == 0)
    return p.select(st.alias("status"), F.octet_length("achievements").alias("b")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == "sent", F.col("b")).otherwise(0)).cast("bigint").alias("bytes"))


_DEEP = """'{"a":{"b":[{"c":{"d":{"e":{"f":[' || props || ']}}}},' || CAST(event_id AS STRING) || ']}}'"""


@query("leaf_walk", """
WITH w(p, t) AS (VALUES ('$.<key>', 'a'), ('$.a.<key>', 'b'), ('$.a.b[0].<key>', 'c'), ('$.a.b[0].c.<key>', 'd'), ('$.a.b[0].c.d.<key>', 'e'),
 ('$.a.b[0].c.d.e.<key>', 'f'), ('$.a.b[0].c.d.e.f[0].<key>', 'k'))
SELECT event_id, p AS path, t AS text FROM events, w UNION ALL SELECT event_id, '$.a.b[0].c.d.e.f[0].k', props->>'k' FROM events
UNION ALL SELECT event_id, '$.a.b[1]', CAST(event_id AS VARCHAR) FROM events
""")
def leaf_walk(spark, sf):
    return G.walk_leaves(table(spark, sf, "events").selectExpr("event_id", f"{_DEEP} AS body"), "event_id", "body")


@query("leaf_walk_escapes", r"""
WITH w(p, t) AS (VALUES ('$.<key>', 'z'), ('$.<key>', 'b'), ('$.b.<key>', 'c'), ('$.b.c.<key>', 'd'), ('$.b.c.d.<key>', 'k'))
SELECT event_id, p AS path, t AS text FROM events, w UNION ALL SELECT event_id, '$.b.c.d.k', props->>'k' FROM events
UNION ALL SELECT event_id, '$.z', '"}}" {' || CAST(event_id AS VARCHAR) FROM events
""")
def leaf_walk_escapes(spark, sf):
    """Bodies whose texts hold escaped quotes and braces."""
    body = F.concat(F.lit(r'{"z":"\"}}\" {'), F.col("event_id").cast("string"), F.lit('","b":{"c":{"d":'), F.col("props"), F.lit("}}}"))
    return G.walk_leaves(table(spark, sf, "events").select("event_id", body.alias("body")), "event_id", "body")


@query("leaf_gate_a", f"""
WITH {PROFILES} SELECT id, contact < 2 AS blocked, CASE WHEN contact < 2 THEN '$.a.b[1].contact' END AS blocked_path FROM profiles
""")
def leaf_gate_a(spark, sf):
    """Gate over all leaves of a nested payload; the first path with a finding is named."""
    p = raw_profiles(spark, sf)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("x").alias("contact")), F.struct(F.col("contact_text").alias("contact"))).alias("b"), F.lit("nada").alias("pay")).alias("a")))
    return G.gate_leaves_a(p.select("id", body.alias("body")), "id", "body").select("id", "blocked", "blocked_path")


_LINES = ("'Requisitos:' || chr(10) || '- Excel avanzado' || chr(10) || '- Enviar CV a u' || CAST(id AS STRING) || '@correo.com' || chr(10) "
          "|| '- Salario Q12,000 mensuales' || chr(10) || '- Llamar al 5555-1234' || chr(10) || '- ' || repeat('largo ', 20) "
          "|| CASE WHEN id % 2 = 0 THEN chr(10) || '- Pago en quetzales' ELSE '' END")


@query("third_party_requirements", f"""
WITH {PROFILES} SELECT id, 'Excel avanzado|Enviar CV a [CORREO]|Salario [MONTO] mensuales|Llamar al [TELÉFONO]|' || trim(repeat('largo ', 20))
 || CASE WHEN id % 2 = 0 THEN '|Pago en [MONEDA]' ELSE '' END AS requirements, false AS rejected FROM profiles
""")
def third_party_requirements(spark, sf):
    """Requirement lines of an offer that carry contact data and pay: redacted, cut, checked on arrival."""
    p = G.third_party_payload_b(profiles(spark, sf).withColumn("offer", F.expr(_LINES)), "id")
    g = G.server_gate_b(p, "id", ["name", "desired_role", "target_company", "achievements"])
    return g.select("id", F.array_join("requirements", "|").alias("requirements"), "rejected")


@query("server_gate_requirements", f"""
WITH {PROFILES} SELECT id, 'Excel avanzado|Enviar CV a [CORREO]|Salario [MONTO] mensuales|Llamar al [TELÉFONO]|' || trim(repeat('largo ', 20))
 || CASE WHEN id % 2 = 0 THEN '|Pago en quetzales' ELSE '' END AS requirements, CAST(3 AS INT) AS server_redactions, id % 2 = 0 AS rejected,
 CASE WHEN id % 2 = 0 THEN 'currency_word' ELSE '' END AS residual_kinds FROM profiles
""")
def server_gate_requirements(spark, sf):
    """The receiving side on a payload that nobody redacted: lines are redacted there, currency words reject."""
    p = profiles(spark, sf).select("id", F.lit("Ana").alias("name"), F.lit("Analista").alias("desired_role"), C.requirement_bullets(F.expr(_LINES), 15).alias("requirements"))
    g = G.server_gate_b(p, "id", ["name", "desired_role"])
    return g.select("id", F.array_join("requirements", "|").alias("requirements"), "server_redactions", "rejected", "residual_kinds")


@query("letter_payload_gate", f"""
WITH {PROFILES} SELECT id, desired_role, company AS target_company, years, 'Lideré un equipo de ' || CAST(k % 9 + 2 AS STRING) || ' personas. Hoy gano ' || CASE WHEN form = 6 THEN salary_text ELSE '[monto]' END || ' y me va bien. Contacto: ' ||
 CASE contact WHEN 0 THEN '[correo]' WHEN 1 THEN '[teléfono]' WHEN 3 THEN 'mi jefe, Carlos Pérez' ELSE contact_text END || '. En ' || CASE WHEN alias IN ('TIGO', 'Pantaleon') THEN alias ELSE '[empleador actual]' END || ' aprendí mucho. Reduje costos 12 %.' AS achievements,
 'Buscamos ' || desired_role || '.' || chr(10) || 'Salario: [monto] - [monto] mensuales.' || chr(10) || 'Requisitos:' || chr(10) || '- Excel avanzado' || chr(10) || '- Manejo de SQL' || chr(10) || '* Experiencia de ' || CAST(years AS STRING) || ' años;'
 || CASE WHEN k % 9 = 0 THEN chr(10) || 'Indicar pretensión salarial.' ELSE '' END AS offer,
 2 + CAST(form <> 6 AS INT) + CAST(contact < 2 AS INT) + CAST(alias NOT IN ('TIGO', 'Pantaleon') AS INT) AS redactions, false AS blocked, CAST(NULL AS STRING) AS blocked_field, CAST(NULL AS STRING) AS blocked_kinds FROM profiles
""")
def letter_payload_gate(spark, sf):
    """Variant A payload for destination "letter": redacted, clipped, exact columns, gated."""
    return G.letter_payload_a(profiles(spark, sf), "id")


@query("company_facts_payload", f"""
WITH {PROFILES}, e AS (SELECT id, company, CASE WHEN alias IN ('TIGO', 'Pantaleon') THEN alias ELSE '[empleador actual]' END AS who FROM profiles)
SELECT id, '1|' || company || ' invierte [monto]|Competidor de ' || who || ';2|Sede|Contacto [correo];3|Nota|' || substr(repeat('dato ', 80), 1, 350) || '…' AS facts, false AS blocked FROM e
""")
def company_facts_payload(spark, sf):
    """Company facts of a variant A payload: the first three, titles and snippets redacted, snippets clipped."""
    one = [("1", "target_company || ' invierte $300 millones'", "'Competidor de ' || alias"), ("2", "'Sede'", "'Contacto u' || CAST(id AS STRING) || '@correo.com'"),
           ("3", "'Nota'", "repeat('dato ', 80)"), ("4", "'Sobra'", "'nada'")]
    facts = F.array(*[F.struct(F.lit(int(i)).alias("id"), F.expr(t).alias("title"), F.expr(s).alias("snippet")) for i, t, s in one])
    p = profiles(spark, sf).join(raw_profiles(spark, sf).select("id", "alias"), "id").withColumn("facts", facts)
    g = G.letter_payload_a(p, "id", "facts")
    return g.select("id", F.array_join(F.transform("company_facts", lambda f: F.concat_ws("|", f["id"].cast("string"), f["title"], f["snippet"])), ";").alias("facts"), "blocked")


_GOVERNED_B = """g AS (SELECT *, 'Lideré un equipo de ' || CAST(k % 9 + 2 AS STRING) || ' personas.' AS w1, 'Hoy gano ' || CASE WHEN form = 6 THEN salary_text ELSE '[MONTO]' END || ' y me va bien.' AS w2,
 'Contacto: ' || CASE contact WHEN 0 THEN '[CORREO]' WHEN 1 THEN '[TELÉFONO]' WHEN 3 THEN 'mi jefe, Carlos Pérez' ELSE contact_text END || '. En ' || CASE WHEN alias <> 'XelajuTech' THEN '[EMPLEADOR_ACTUAL]' ELSE alias END || ' aprendí mucho. Reduje costos 12 %.' AS w3,
 CASE WHEN desired_role LIKE 'Gerente%' OR desired_role LIKE 'Jefe%' THEN 'lead' WHEN desired_role LIKE '%senior' THEN 'senior' WHEN years >= 10 THEN 'lead' WHEN years >= 5 THEN 'senior' WHEN years >= 2 THEN 'semi-senior' ELSE 'junior' END AS level FROM profiles)"""


@query("third_party_payload", f"""
WITH {PROFILES}, {_GOVERNED_B} SELECT id, name, desired_role, company AS target_company, w1 || ' ' || w2 || ' ' || w3 AS achievements, 'Excel avanzado|Manejo de SQL|Experiencia de ' || CAST(years AS STRING) || ' años' AS requirements,
 years, 'es' AS language, level AS seniority, CAST(form <> 6 AS INT) + CAST(contact < 2 AS INT) + CAST(alias <> 'XelajuTech' AS INT) AS redactions, CAST(0 AS INT) AS server_redactions, false AS rejected, '' AS residual_kinds FROM g
""")
def third_party_payload(spark, sf):
    """Variant B: third-party tier, then the receiving side redacts and checks again."""
    p = G.third_party_payload_b(profiles(spark, sf), "id")
    g = G.server_gate_b(p, "id", ["name", "desired_role", "target_company", "achievements"])
    return g.withColumn("requirements", F.array_join("requirements", "|"))


def _routed(spark, sf):
    return G.route_c(profiles(spark, sf), "id")


def canaries(spark, sf):
    """Planted values: the salary, the contact and the employer as written in the text."""
    p = raw_profiles(spark, sf)
    return p.select("id", F.inline(F.array(
        F.struct(F.lit("salary").alias("type"), F.col("salary_text").alias("value"), F.when(F.col("form") == 6, "difícil").when(F.col("form") == 0, "fácil").otherwise("media").alias("difficulty")),
        F.struct(F.expr("CASE contact WHEN 1 THEN 'phone' WHEN 3 THEN 'person_name' ELSE 'email' END").alias("type"), F.col("contact_text").alias("value"),
                 F.when(F.col("contact") == 2, "difícil").otherwise("fácil").alias("difficulty")),
        F.struct(F.lit("employer").alias("type"), F.col("alias").alias("value"), F.when(F.col("alias") == "TIGO", "difícil").otherwise("media").alias("difficulty")))))


CANARIES = f"""{PROFILES}, c AS (
 SELECT id, 'salary' AS type, CASE WHEN form = 6 THEN 'difícil' WHEN form = 0 THEN 'fácil' ELSE 'media' END AS difficulty, form <> 6 AS caught FROM profiles
 UNION ALL SELECT id, CASE contact WHEN 1 THEN 'phone' WHEN 3 THEN 'person_name' ELSE 'email' END, CASE WHEN contact = 2 THEN 'difícil' ELSE 'fácil' END, contact <> 2 FROM profiles
 UNION ALL SELECT id, 'employer', CASE WHEN alias = 'TIGO' THEN 'difícil' ELSE 'media' END, alias <> 'TIGO' FROM profiles)"""


@query("leak_recall_sets", f"""
WITH {CANARIES} SELECT type, difficulty, CAST(grouping(type) * 2 + grouping(difficulty) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS total, CAST(count_if(caught) AS BIGINT) AS caught_redactor,
 CAST(count_if(caught) AS BIGINT) AS caught_final, CAST(count_if(NOT caught) AS BIGINT) AS leaks, CAST(0 AS BIGINT) AS partial FROM c GROUP BY GROUPING SETS ((type), (difficulty), ())
""")
def leak_recall_sets(spark, sf):
    """Flagship: profiles → governed payload → gate → audit of every planted value."""
    return A.recall_sets(A.audit(canaries(spark, sf), _routed(spark, sf), "id"))


@query("weakest_types", f"""
WITH {CANARIES} SELECT type, round(count_if(caught) / count(*), 6) AS recall FROM c GROUP BY type ORDER BY recall, type LIMIT 3
""")
def weakest_types(spark, sf):
    r = A.audit(canaries(spark, sf), _routed(spark, sf), "id").groupBy("type").agg(F.round(F.avg((F.col("final") == A.CAUGHT).cast("int")), 6).alias("recall"))
    return r.orderBy("recall", "type").limit(3)


@query("case_flags", f"""
WITH {CANARIES} SELECT any_leak, false AS blocked, CAST(count(*) AS BIGINT) AS cases FROM (SELECT id, bool_or(NOT caught) AS any_leak FROM c GROUP BY id) GROUP BY any_leak
""")
def case_flags(spark, sf):
    f = A.case_flags(A.audit(canaries(spark, sf), _routed(spark, sf), "id"), "id")
    return f.groupBy("any_leak", "blocked").agg(F.count(F.lit(1)).alias("cases"))


@query("false_positives", f"""
WITH {PROFILES} SELECT CAST(count(*) AS BIGINT) * 3 AS allowed, CAST(count(*) AS BIGINT) * 3 AS kept FROM profiles
""")
def false_positives(spark, sf):
    allowed = profiles(spark, sf).select("id", F.explode(F.array(F.lit("Reduje costos 12 %"), F.lit("Excel avanzado"), F.col("target_company"))).alias("value"))
    f = A.false_positives(allowed, _routed(spark, sf), "id")
    return f.agg(F.sum("allowed").alias("allowed"), F.sum("kept").alias("kept"))


@query("structural_leaks", f"""
WITH {PROFILES} SELECT CAST(0 AS BIGINT) AS salary_leaks, CAST(0 AS BIGINT) AS employer_leaks, CAST(count(*) AS BIGINT) AS cases FROM profiles
""")
def structural_leaks(spark, sf):
    d = A.structural_leaks(_routed(spark, sf))
    return d.agg(F.count_if("salary_leak").alias("salary_leaks"), F.count_if("employer_leak").alias("employer_leaks"), F.count(F.lit(1)).alias("cases"))


@query("field_redactions", f"""
WITH {PROFILES}, r AS (SELECT 'achievements' AS field, 'salary' AS kind FROM profiles WHERE form <> 6 UNION ALL SELECT 'offer', 'salary' FROM profiles UNION ALL SELECT 'offer', 'salary' FROM profiles
 UNION ALL SELECT 'achievements', CASE contact WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'person_name' END FROM profiles WHERE contact <> 2 UNION ALL SELECT 'achievements', 'employer' FROM profiles WHERE alias <> 'TIGO')
SELECT field, kind, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY field, kind
""")
def field_redactions(spark, sf):
    r = inline_rows(_routed(spark, sf), ["id"], F.col("redactions"), "kind")
    return r.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("other_redactions", None)
def other_redactions(spark, sf):
    """Redactions that match no planted value: the published salary range of the offers."""
    r = inline_rows(_routed(spark, sf), ["id"], F.col("redactions"), "kind")
    o = A.other_redactions(r, canaries(spark, sf), "id")
    return o.groupBy("field", "kind", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("propagated_leaks", f"""
WITH {PROFILES} SELECT id, salary_text AS value FROM profiles WHERE form = 6 UNION ALL SELECT id, contact_text FROM profiles WHERE contact = 2
UNION ALL SELECT id, alias FROM profiles WHERE alias = 'TIGO'
""")
def propagated_leaks(spark, sf):
    """Leaked values found again in a letter that repeats the payload."""
    r = _routed(spark, sf)
    leaks = A.audit(canaries(spark, sf), r, "id").where(F.col("final") == A.LEAK).select("id", "type", "value")
    p = profiles(spark, sf)
    letters = p.select("id", F.concat(F.lit("Estimado equipo: "), "achievements").alias("letter"))
    return A.propagated(leaks, letters, "id").select("id", "value")


@query("outgoing_volume", None)
def outgoing_volume(spark, sf):
    r = _routed(spark, sf)
    return r.groupBy("blocked").agg(F.count(F.lit(1)).alias("letters"), F.sum(F.octet_length("payload")).alias("bytes"), F.sum(F.size("redactions")).alias("redactions"))


# ------------------------------------------------------------------ known amounts and names
@query("known_amount_match", f"""
WITH {PROFILES} SELECT id, CAST(cur AS DOUBLE) AS value FROM profiles WHERE form <> 6
""")
def known_amount_match(spark, sf):
    """Mentions equal to a known amount of the same profile (relative 0.1 % or 0.5)."""
    p = profiles(spark, sf)
    d = M.with_mentions_b(p, "achievements", "ms").select("id", "current_salary", F.explode_outer("ms").alias("m"))
    near = F.abs(F.col("m.value") - F.col("current_salary")) <= F.greatest(F.lit(V.B_KNOWN_ABS), F.col("current_salary") * V.B_KNOWN_REL)
    return d.where(near).select("id", F.col("m.value").alias("value"))


@query("amount_written_forms", f"""
WITH {PROFILES}, f AS (SELECT id, cur, {comma('cur')} AS c FROM profiles)
SELECT id, unnest(list_concat([CAST(cur AS STRING), c, replace(c, ',', '.'), replace(c, ',', ' '), 'Q' || c, 'Q ' || replace(c, ',', ' '), 'Q' || CAST(cur AS STRING), '$' || c, 'USD ' || CAST(cur AS STRING)],
 CASE WHEN cur % 1000 = 0 THEN [CAST(CAST(cur / 1000 AS INT) AS STRING) || 'k', CAST(CAST(cur / 1000 AS INT) AS STRING) || ' mil', CAST(CAST(cur / 1000 AS INT) AS STRING) || 'K'] ELSE [] END)) AS form FROM f
""")
def amount_written_forms(spark, sf):
    return profiles(spark, sf).select("id", F.explode_outer(N.written_forms_b(F.col("current_salary"))).alias("form"))


@query("amount_in_any_form", f"WITH {PROFILES} SELECT id, form NOT IN (4, 6) AS found FROM profiles")
def amount_in_any_form(spark, sf):
    """A dot right before the digits ("Q.15,000.00") does not count as a border."""
    return profiles(spark, sf).select("id", N.contains_amount(F.col("achievements"), F.col("current_salary")).isNotNull().alias("found"))


@query("redaction_idempotent", f"WITH {PROFILES} SELECT CAST(count(*) AS BIGINT) AS texts, CAST(0 AS BIGINT) AS changed FROM profiles")
def redaction_idempotent(spark, sf):
    """A second pass over redacted text changes nothing."""
    p = profiles(spark, sf).select("id", "employer", "name", "achievements")
    once = R.redact_c(p, "achievements", "r1", "employer", "name")
    twice = R.redact_c(once, "r1", "r2", "employer", "name")
    return twice.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("r1") != F.col("r2")).alias("changed"))


_REDACTED_B = f"""
WITH {PROFILES} SELECT id, 'Lideré un equipo de ' || CAST(k % 9 + 2 AS STRING) || ' personas. Hoy gano ' || CASE WHEN form = 6 THEN salary_text ELSE '[MONTO]' END || ' y me va bien. Contacto: ' ||
 CASE contact WHEN 0 THEN '[CORREO]' WHEN 1 THEN '[TELÉFONO]' WHEN 3 THEN 'mi jefe, Carlos Pérez' ELSE contact_text END || '. En ' || CASE WHEN alias IN ('Banco Industrial', 'Pantaleon', 'TIGO') THEN '[EMPLEADOR_ACTUAL]'
 WHEN alias = 'Cerveceria Centroamericana' THEN '[EMPLEADOR_ACTUAL]' ELSE alias END || ' aprendí mucho. Reduje costos 12 %.' AS redacted FROM profiles
"""


@query("redacted_achievements_b", _REDACTED_B)
def redacted_achievements_b(spark, sf):
    p = profiles(spark, sf).withColumn("amounts", F.array("current_salary"))
    return R.redact_b(p, "achievements", "redacted", "employer", "amounts").select("id", "redacted")


_REDACTED_A = f"""
WITH {PROFILES} SELECT id, 'Lideré un equipo de ' || CAST(k % 9 + 2 AS STRING) || ' personas. Hoy gano ' || CASE WHEN form = 6 THEN salary_text ELSE '[monto]' END || ' y me va bien. Contacto: ' ||
 CASE contact WHEN 0 THEN '[correo]' WHEN 1 THEN '[teléfono]' WHEN 3 THEN 'mi jefe, Carlos Pérez' ELSE contact_text END || '. En ' || CASE WHEN alias IN ('Banco Industrial', 'Cerveceria Centroamericana') OR alias = 'XelajuTech' THEN '[empleador actual]' ELSE alias END || ' aprendí mucho. Reduje costos 12 %.' AS redacted FROM profiles
"""


@query("redacted_achievements_a", _REDACTED_A)
def redacted_achievements_a(spark, sf):
    p = profiles(spark, sf).withColumn("amounts", F.array("current_salary", "desired_salary"))
    return R.redact_a(p, "achievements", "redacted", "employer", "amounts").select("id", "redacted")


# ------------------------------------------------------------------ rules from a table

CASE_RULE = ("case_file", "case_file", r"(?<![\p{L}\p{N}])EXP-\d{4,6}(?!\d)", 2, "[EXPEDIENTE]", "has EXP-")
_SEE = "' Ver EXP-' || lpad(CAST(k AS STRING), 6, '0') || ' y EXP-7.'"
_SEEN = "' Ver [EXPEDIENTE] y EXP-7.'"


def _with_case_files(spark, sf, variant):
    """Profiles whose achievements name a case file, and the built-in rules of a variant with one more kind."""
    own = spark.createDataFrame([CASE_RULE], P.SCHEMA)
    pack = P.load(P.builtin(spark, variant).unionByName(own), variant)
    seen = raw_profiles(spark, sf).selectExpr("id", f"{_SEE} AS see")
    return profiles(spark, sf).join(seen, "id").withColumn("achievements", F.concat("achievements", "see")), pack


@query("rule_pack_a", f"SELECT id, redacted || seen AS redacted FROM ({_REDACTED_A}) JOIN (WITH {PROFILES} SELECT id, {_SEEN} AS seen FROM profiles) USING (id)")
def rule_pack_a(spark, sf):
    """Variant A's rules from a table with a kind of the user's own."""
    p, pack = _with_case_files(spark, sf, "A")
    p = p.withColumn("amounts", F.array("current_salary", "desired_salary"))
    return P.redact(p, "achievements", "redacted", pack, employer="employer", amounts="amounts").select("id", "redacted")


@query("rule_pack_b", f"SELECT id, redacted || seen AS redacted FROM ({_REDACTED_B}) JOIN (WITH {PROFILES} SELECT id, {_SEEN} AS seen FROM profiles) USING (id)")
def rule_pack_b(spark, sf):
    p, pack = _with_case_files(spark, sf, "B")
    p = p.withColumn("amounts", F.array("current_salary"))
    return P.redact(p, "achievements", "redacted", pack, employer="employer", amounts="amounts").select("id", "redacted")


@query("rule_pack_c", f"""
WITH {PROFILES} SELECT id, 'Escribe a [CORREO] o llama al [TELÉFONO]. DPI [DPI], NIT: [NIT]. Gano [SALARIO] al mes. Soy {{{{NOMBRE}}}}, mi jefe, [PERSONA].' || {_SEEN} AS redacted FROM profiles
""")
def rule_pack_c(spark, sf):
    """Variant C's rules from a table: contact data, identifiers, pay, people, the user's own kind."""
    p = raw_profiles(spark, sf).selectExpr(
        "id", "name", "'Escribe a u' || CAST(k AS STRING) || '@correo.com o llama al ' || phone || '. DPI 2345 67890 0101, NIT: 1234567-8. Gano Q' || CAST(cur AS STRING) || ' al mes. Soy ' || name || ', mi jefe, Carlos Pérez.' || " + _SEE + " AS text")
    pack = P.load(P.builtin(spark, "C").unionByName(spark.createDataFrame([CASE_RULE], P.SCHEMA)), "C")
    return P.redact(p, "text", "redacted", pack, own_name="name").select("id", "redacted")


@query("humanized_text", f"""
WITH {PROFILES} SELECT id, regexp_replace(CASE WHEN id % 2 = 0 THEN 'earned ' || 'a significant amount' || ' at ' || 'my current employer' ELSE 'gané un monto significativo en mi empleador actual' END || '  fin ', '[ \\t]{{2,}}', ' ', 'g') AS text FROM profiles
""")
def humanized_text(spark, sf):
    p = raw_profiles(spark, sf).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'es' END AS lang",
                                           "CASE WHEN id % 2 = 0 THEN 'earned [MONTO] at [EMPLEADOR_ACTUAL] [CORREO] fin ' ELSE 'gané [MONTO] en [EMPLEADOR_ACTUAL] [NIT] fin ' END AS t")
    return p.select("id", R.humanize(F.col("t"), F.col("lang")).alias("text"))


@query("signed_letters", f"""
WITH {PROFILES} SELECT id, CASE WHEN id % 2 = 0 THEN 'Carta.' || chr(10) || name ELSE 'Carta.' || chr(10) || chr(10) || name END AS letter FROM profiles
""")
def signed_letters(spark, sf):
    p = raw_profiles(spark, sf).selectExpr("id", "name", "CASE WHEN id % 2 = 0 THEN 'Carta.' || chr(10) || '[[FIRMA]]' ELSE 'Carta.  ' END AS t")
    return p.select("id", R.apply_signature(F.col("t"), F.col("name")).alias("letter"))


# ------------------------------------------------------------------ compensation
_GTQ = "CASE WHEN desired_cur = 'USD' THEN desired * {fx} ELSE CAST(desired AS DOUBLE) END"
_GAPS = {
    "A": ("(g - cur) / cur * 100", "7.75", "CASE WHEN p < 0 THEN 'below' WHEN p < 10 THEN 'conservative' WHEN p <= 30 THEN 'realistic' WHEN p <= 60 THEN 'ambitious' ELSE 'out_of_range' END"),
    "B": ("floor((g - cur) / cur * 1000 + 0.5) / 10", "7.7", "CASE WHEN p < 0 THEN 'recorte' WHEN p < 10 THEN 'conservador' WHEN p < 20 THEN 'razonable' WHEN p < 35 THEN 'ambicioso' ELSE 'agresivo' END"),
    "C": ("(g - cur) / cur * 100", "7.7", "CASE WHEN p < 0 THEN 'recorte' WHEN p < 10 THEN 'conservadora' WHEN p < 25 THEN 'razonable' WHEN p < 40 THEN 'ambiciosa' ELSE 'muy_ambiciosa' END"),
}


def _gap_query(v: str):
    expr, fx, band = _GAPS[v]

    @query(f"gap_bands_{v.lower()}", f"""
WITH {PROFILES}, x AS (SELECT id, CAST(cur AS DOUBLE) AS cur, {_GTQ.format(fx=fx)} AS g FROM profiles), y AS (SELECT id, {expr} AS p FROM x) SELECT id, round(p, 6) AS gap_pct, {band} AS band FROM y
""")
    def run(spark, sf):
        p = profiles(spark, sf)
        cur = N.to_gtq(F.col("current_salary"), F.col("current_currency"), v)
        des = N.to_gtq(F.col("desired_salary"), F.col("desired_currency"), v)
        d = p.select("id", N.gap_pct(cur, des, v).alias("p"))
        return d.select("id", F.round("p", 6).alias("gap_pct"), N.band(F.col("p"), v).alias("band"))


for _v in "ABC":
    _gap_query(_v)

_RANGE_SQL = f"WITH {PROFILES} SELECT id, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max, 'GTQ' AS currency, 'MONTH' AS period FROM profiles"


def _ranges(spark, sf, v):
    p = profiles(spark, sf)
    if v == "A":
        return C.with_offer_range_a(p, "offer", F.lit("GTQ"), "offer_range")
    if v == "B":
        return C.with_offer_range_b(p, "offer", C.language(F.col("offer")), "offer_range")
    return C.with_offer_range_c(p, "offer", "offer_range")


def _range_query(v: str):
    sql = _RANGE_SQL + (" WHERE hi <= 5 * lo" if v == "A" else "")

    @query(f"offer_range_{v.lower()}", sql)
    def run(spark, sf):
        r = F.col("offer_range")
        return _ranges(spark, sf, v).select("id", r["min"].alias("min"), r["max"].alias("max"), r["currency"].alias("currency"), r["period"].alias("period"))


for _v in "ABC":
    _range_query(_v)

_POS = "CASE WHEN g < lo THEN 'below' WHEN g > hi THEN 'above' ELSE 'within' END"


@query("range_position", f"""
WITH {PROFILES}, x AS (SELECT *, {_GTQ.format(fx='7.7')} AS g FROM profiles) SELECT id, {_POS} AS position, floor((g - hi) / hi * 100 * 10 + 0.5) / 10 AS pct_vs_top FROM x
""")
def range_position(spark, sf):
    p = raw_profiles(spark, sf)
    g = N.to_gtq(F.col("desired").cast("double"), F.col("desired_cur"), "B")
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    return p.select("id", C.range_position(g, lo, hi).alias("position"), C.pct_vs_top(g, hi).alias("pct_vs_top"))


@query("facts_b", f"""
WITH {PROFILES}, x AS (SELECT *, CAST(cur AS DOUBLE) AS c, {_GTQ.format(fx='7.7')} AS g FROM profiles), y AS (SELECT *, floor((g - c) / c * 1000 + 0.5) / 10 AS p FROM x)
SELECT id, floor(g + 0.5) AS desired_gtq, p AS gap_pct, {_POS} AS vs_range, CASE WHEN k % 9 = 0 THEN 'offer-asks' WHEN lo <= g AND g <= hi THEN 'range-covers' WHEN g < lo THEN 'range-below' ELSE 'range-above' END AS timing FROM y
""")
def facts_b(spark, sf):
    d = C.with_facts_b(_ranges(spark, sf, "B"), "f")
    f = F.col("f")
    return d.select("id", f["desired_gtq"].alias("desired_gtq"), f["gap_pct"].alias("gap_pct"), f["vs_range"].alias("vs_range"), f["timing"].alias("timing"))


_MONEY = "CASE WHEN {c} = 'USD' THEN 'US$' ELSE 'Q' END || " + comma("{n}")
_ONE = "regexp_replace(printf('%.1f', {x}), '\\.0$', '')"


def _sql_case(key: str, table: dict, i: int | None = None) -> str:
    return f"CASE {key} " + " ".join("WHEN '{}' THEN '{}'".format(k, (v if i is None else v[i]).replace("'", "''")) for k, v in table.items()) + " END"


@query("note_b", f"""
WITH {PROFILES}, x AS (SELECT *, CAST(cur AS DOUBLE) AS c, {_GTQ.format(fx='7.7')} AS g FROM profiles),
y AS (SELECT *, floor((g - c) / c * 1000 + 0.5) / 10 AS p, CAST(floor(g - c + 0.5) AS BIGINT) AS delta, {_POS} AS pos, floor((g - hi) / hi * 100 * 10 + 0.5) / 10 AS top,
 CASE WHEN k % 9 = 0 THEN 'offer-asks' WHEN lo <= g AND g <= hi THEN 'range-covers' WHEN g < lo THEN 'range-below' ELSE 'range-above' END AS timing FROM x),
z AS (SELECT *, CASE WHEN p < 0 THEN 'recorte' WHEN p < 10 THEN 'conservador' WHEN p < 20 THEN 'razonable' WHEN p < 35 THEN 'ambicioso' ELSE 'agresivo' END AS band,
 CASE WHEN p >= 0 THEN '+' ELSE '' END || {_ONE.format(x='p')} AS signed FROM y)
SELECT id, {_sql_case('band', C.BAND_LABEL_B)} || ': pides ' || signed || ' % respecto a lo que ganas hoy.' || chr(10) || 'Hoy: Q' || {comma('cur')} || '/mes · Expectativa: ' || {_MONEY.format(c='desired_cur', n='desired')} || '/mes · Brecha: ' || signed
 || ' % · Diferencia: ' || CASE WHEN delta >= 0 THEN '+' ELSE '−' END || 'Q' || {comma('abs(delta)')} || '/mes' || CASE WHEN desired_cur = 'USD' THEN ' · Tipo de cambio: Q7.7 por US$1' ELSE '' END || chr(10)
 || 'La oferta publica Q' || {comma('lo')} || ' – Q' || {comma('hi')} || '/mes; tu expectativa ' || CASE pos WHEN 'within' THEN 'cae dentro del rango' WHEN 'above' THEN 'queda ' || {_ONE.format(x='top')} || ' % por encima del tope'
 ELSE 'queda por debajo del piso: estás pidiendo menos de lo que ofrecen' END || '.' || chr(10) || {_sql_case('band', C.BAND_ADVICE_B)} || chr(10) || 'Cuándo mencionarlo: ' || {_sql_case('timing', C.TIMING, 0)} || ' ' || {_sql_case('timing', C.TIMING, 1)} AS text FROM z
""")
def note_b(spark, sf):
    return C.with_note_b(_ranges(spark, sf, "B"), "n").select("id", F.col("n.text").alias("text"))


@query("timing_first_rule", f"""
WITH {PROFILES}, x AS (SELECT id, k % 9 = 0 AS asks, k % 2 = 0 AS has, CASE WHEN k % 3 <> 0 THEN lo END AS lo, CASE WHEN k % 4 <> 1 THEN hi END AS hi, {_GTQ.format(fx='7.7')} AS g, CAST(cur AS DOUBLE) AS c FROM profiles), y AS (SELECT *, (g - c) / c * 100 AS p FROM x)
SELECT id, CASE WHEN asks THEN 'offer-asks' WHEN has AND coalesce(lo, 0) <= g AND (hi IS NULL OR g <= hi) THEN 'range-covers' WHEN has AND g < lo THEN 'range-below' WHEN has AND g > hi THEN 'range-above' WHEN p < 0 THEN 'cut' WHEN p >= 35 THEN 'aggressive-no-range' ELSE 'default' END AS rule FROM y
""")
def timing_first_rule(spark, sf):
    x = raw_profiles(spark, sf).selectExpr("id", "k % 9 = 0 AS asks", "k % 2 = 0 AS has", "CAST(CASE WHEN k % 3 <> 0 THEN lo END AS DOUBLE) AS lo", "CAST(CASE WHEN k % 4 <> 1 THEN hi END AS DOUBLE) AS hi", "CAST(desired AS DOUBLE) AS d", "desired_cur", "CAST(cur AS DOUBLE) AS c")
    g = N.to_gtq(F.col("d"), F.col("desired_cur"), "B")
    p = (g - F.col("c")) / F.col("c") * 100
    band = F.when(p < 0, "recorte").when(p >= 35, "agresivo").otherwise("otro")
    return x.select("id", C.timing_rule(F.col("asks"), F.col("has"), F.col("lo"), F.col("hi"), g, band).alias("rule"))


@query("suggested_range", f"WITH {PROFILES} SELECT id, floor(desired / s + 0.5) * s AS min, floor(desired * 1.1 / s + 0.5) * s AS max FROM (SELECT id, CAST(desired AS DOUBLE) AS desired, CASE WHEN desired_cur = 'USD' THEN 50.0::DOUBLE ELSE 500.0::DOUBLE END AS s FROM profiles)")
def suggested_range(spark, sf):
    s = C.suggested_c(F.col("desired_salary"), F.col("desired_currency"))
    return profiles(spark, sf).select("id", s["min"].alias("min"), s["max"].alias("max"))


_MARKET = """m AS (SELECT p_partkey, CAST(p_partkey % 25 AS INT) AS nation, p_retailprice AS min_salary, p_retailprice * 1.5 AS median_salary, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_retailprice * 2 END AS max_salary,
 CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'HOUR' WHEN 1 THEN 'week' WHEN 2 THEN 'MONTH' WHEN 3 THEN 'YEAR' WHEN 4 THEN 'DAY' ELSE 'EON' END AS period, CASE WHEN p_partkey % 2 = 0 THEN 'usd' ELSE 'GTQ' END AS currency, p_size AS salary_count FROM part)"""
_BEST = f"""{_MARKET}, v AS (SELECT *, CASE WHEN upper(period) IN ('HOUR','DAY','WEEK','MONTH','YEAR') THEN upper(period) ELSE 'YEAR' END AS per, upper(currency) AS cu FROM m WHERE min_salary > 0 AND median_salary > 0 AND max_salary > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY salary_count DESC, p_partkey) AS rn FROM v)"""


def _best(spark, sf):
    m = table(spark, sf, "part").selectExpr(
        "p_partkey", "CAST(p_partkey % 25 AS INT) AS nation", "p_retailprice AS min_salary", "p_retailprice * 1.5 AS median_salary", "CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_retailprice * 2 END AS max_salary",
        "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'HOUR' WHEN 1 THEN 'week' WHEN 2 THEN 'MONTH' WHEN 3 THEN 'YEAR' WHEN 4 THEN 'DAY' ELSE 'EON' END AS period", "CASE WHEN p_partkey % 2 = 0 THEN 'usd' ELSE 'GTQ' END AS currency", "p_size AS salary_count")
    return L.best_market_row(m, "nation", "p_partkey")


@query("best_market_row", f"WITH {_BEST} SELECT nation, p_partkey, median_salary, per AS period, cu AS currency, CAST(salary_count AS BIGINT) AS salary_count FROM b WHERE rn = 1")
def best_market_row(spark, sf):
    return _best(spark, sf).select("nation", "p_partkey", "median_salary", "period", "currency", F.col("salary_count").cast("bigint").alias("salary_count"))


_MON = "CASE per WHEN 'YEAR' THEN {x} / 12 WHEN 'WEEK' THEN {x} * (52::DOUBLE / 12) WHEN 'DAY' THEN {x} * (260::DOUBLE / 12) WHEN 'HOUR' THEN {x} * (2080::DOUBLE / 12) ELSE {x} END * CASE cu WHEN 'USD' THEN 7.75 ELSE 1 END"


@query("market_position", f"""
WITH {PROFILES}, {_BEST}, k AS (SELECT nation, {_MON.format(x='min_salary')} AS a, {_MON.format(x='median_salary')} AS me, {_MON.format(x='max_salary')} AS z, salary_count FROM b WHERE rn = 1), x AS (SELECT id, nation, {_GTQ.format(fx='7.75')} AS g FROM profiles)
SELECT id, CASE WHEN k.nation IS NULL THEN NULL WHEN g < a THEN 'below_min' WHEN g <= me THEN 'min_median' WHEN g <= z THEN 'median_max' ELSE 'above_max' END AS position, coalesce(salary_count < 10, false) AS small_sample, CASE WHEN k.nation IS NULL THEN 'Sin referencia de mercado.' END AS reason FROM x LEFT JOIN k ON x.nation = k.nation AND k.nation % 4 <> 3
""".replace("LEFT JOIN k ON x.nation = k.nation AND k.nation % 4 <> 3", "LEFT JOIN (SELECT * FROM k WHERE nation % 4 <> 3) k ON x.nation = k.nation"))
def market_position(spark, sf):
    b = _best(spark, sf).where("nation % 4 <> 3")
    mon = [L.market_monthly(F.col(c), F.col("period"), F.col("currency")).alias(a) for c, a in (("min_salary", "lo"), ("median_salary", "mid"), ("max_salary", "top"))]
    b = b.select("nation", *mon, "salary_count", F.lit(True).alias("found"))
    p = raw_profiles(spark, sf).select("id", "nation", N.to_gtq(F.col("desired").cast("double"), F.col("desired_cur"), "A").alias("g"))
    j = p.join(b, "nation", "left")
    return j.select("id", L.market_position(F.col("g"), F.col("lo"), F.col("mid"), F.col("top")).alias("position"), L.small_sample(F.col("salary_count")).alias("small_sample"),
                    F.when(F.col("found").isNull(), "Sin referencia de mercado.").alias("reason"))


@query("period_to_month", f"""
WITH {_MARKET}, v AS (SELECT p_partkey, median_salary, upper(period) AS per, upper(currency) AS cu FROM m) SELECT p_partkey, round({_MON.format(x='median_salary')}, 6) AS monthly_gtq FROM v
""")
def period_to_month(spark, sf):
    m = table(spark, sf, "part").selectExpr("p_partkey", "p_retailprice * 1.5 AS x", "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'HOUR' WHEN 1 THEN 'WEEK' WHEN 2 THEN 'MONTH' WHEN 3 THEN 'YEAR' WHEN 4 THEN 'DAY' ELSE 'EON' END AS period", "CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'GTQ' END AS currency")
    return m.select("p_partkey", F.round(L.market_monthly(F.col("x"), F.col("period"), F.col("currency")), 6).alias("monthly_gtq"))


@query("suggested_range_a", f"""
WITH {PROFILES}, x AS (SELECT id, desired_cur, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, {_GTQ.format(fx='7.75')} AS g FROM profiles),
y AS (SELECT id, desired_cur, CASE WHEN g <= hi THEN greatest(g, lo + 0.75::DOUBLE * (hi - lo)) ELSE g END AS a, CASE WHEN g <= hi THEN greatest(greatest(g, lo + 0.75::DOUBLE * (hi - lo)), hi) ELSE g * 1.1::DOUBLE END AS b FROM x),
z AS (SELECT id, CASE WHEN desired_cur = 'GTQ' THEN 500.0::DOUBLE ELSE 50.0::DOUBLE END AS s, CASE WHEN desired_cur = 'GTQ' THEN a ELSE a / 7.75::DOUBLE END AS a, CASE WHEN desired_cur = 'GTQ' THEN b ELSE b / 7.75::DOUBLE END AS b FROM y)
SELECT id, floor(a / s + 0.5) * s AS min, floor(b / s + 0.5) * s AS max FROM z
""")
def suggested_range_a(spark, sf):
    p = raw_profiles(spark, sf)
    g = N.to_gtq(F.col("desired").cast("double"), F.col("desired_cur"), "A")
    none = F.lit(None).cast("double")
    s = C.suggested_a(g, F.col("lo").cast("double"), F.col("hi").cast("double"), none.cast("string"), none, none, F.col("desired_cur"))
    return p.select("id", s["min"].alias("min"), s["max"].alias("max"))


@query("note_c", None)
def note_c(spark, sf):
    d = C.with_note_c(_ranges(spark, sf, "C"), "n")
    n = F.col("n")
    return d.select("id", n["band"].alias("band"), n["position"].alias("position"), n["headline"].alias("headline"), F.array_join(n["advice"], "\n").alias("advice"), F.array_join(n["when"], "\n").alias("when_text"))


@query("seniority_level", f"""
WITH {PROFILES} SELECT id, CASE WHEN desired_role LIKE 'Gerente%' OR desired_role LIKE 'Jefe%' THEN 'lead' WHEN desired_role LIKE '%senior' THEN 'senior' WHEN years >= 10 THEN 'lead' WHEN years >= 5 THEN 'senior' WHEN years >= 2 THEN 'semi-senior' ELSE 'junior' END AS level FROM profiles
""")
def seniority_level(spark, sf):
    return profiles(spark, sf).select("id", C.seniority(F.col("years"), F.col("desired_role")).alias("level"))


# ------------------------------------------------------------------ quality
_NOTE = "'Tu salario de Q' || {a} || ' y tu oferta: sube ' || CAST(k % 50 AS STRING) || ' %.'"


@query("number_consistency", f"""
WITH {PROFILES}, x AS (SELECT id, cur, CASE WHEN k % 2 = 0 THEN cur WHEN k % 4 = 1 THEN CAST(floor(cur * 1.015) AS BIGINT) ELSE CAST(floor(cur * 1.3) AS BIGINT) END AS said, k % 50 AS pct FROM profiles)
SELECT id, CAST(2 AS BIGINT) AS checked, CAST((CASE WHEN abs(said - cur) / cur <= 0.02 THEN 0 ELSE 1 END) + (CASE WHEN abs(pct - 12) <= 1 THEN 0 ELSE 1 END) AS BIGINT) AS flagged FROM x
""")
def number_consistency(spark, sf):
    p = raw_profiles(spark, sf).selectExpr("id", "k", "cur", "CASE WHEN k % 2 = 0 THEN cur WHEN k % 4 = 1 THEN CAST(floor(cur * 1.015) AS BIGINT) ELSE CAST(floor(cur * 1.3) AS BIGINT) END AS said")
    p = p.selectExpr("id", _NOTE.format(a=comma("said")) + " AS note", "array(CAST(cur AS DOUBLE)) AS amounts", "array(CAST(12 AS DOUBLE)) AS pcts")
    d = Q.with_number_flags(p, "note", "amounts", "pcts", "q")
    return d.select("id", F.col("q.checked").cast("bigint").alias("checked"), F.size("q.flagged").cast("bigint").alias("flagged"))


@query("invented_numbers", f"""
WITH {PROFILES} SELECT id, CASE WHEN k % 3 = 0 THEN CAST(cur + 1 AS STRING) ELSE '' END AS invented FROM profiles
""")
def invented_numbers(spark, sf):
    p = raw_profiles(spark, sf).selectExpr("id", "'Gano ' || CAST(cur AS STRING) || ' con ' || CAST(years AS STRING) || ' años' AS corpus",
                                           "'Pido ' || CASE WHEN k % 3 = 0 THEN " + comma("(cur + 1)") + " ELSE " + comma("cur") + " END || ' tras 0' || CAST(years AS STRING) || ' años' AS letter")
    return p.select("id", F.array_join(Q.invented_numbers(F.col("letter"), F.col("corpus")), ",").alias("invented"))


def letters(spark, sf):
    p = profiles(spark, sf)
    t = T.template_letters_c(p, "id")
    return p.join(t, "id")


@query("template_letters_a", None)
def template_letters_a(spark, sf):
    return T.template_letters_a(profiles(spark, sf), "id", F.to_date(F.lit("2026-09-25")))


@query("template_letters_b", f"""
WITH {PROFILES}, {_GOVERNED_B} SELECT id, 'Estimado equipo de ' || company || ':' || chr(10) || chr(10) || 'Les escribo para expresar mi interés en la posición de ' || desired_role || '. Tengo ' ||
 CASE WHEN years = 1 THEN '1 año' ELSE CAST(years AS STRING) || ' años' END || ' de experiencia y me gustaría aportar ese recorrido a ' || company || '.' || chr(10) || chr(10) ||
 'Algunos resultados de los que me siento orgulloso(a): ' || rtrim(w1, '.') || ' y ' || replace(rtrim(w2, '.'), '[MONTO]', 'un monto significativo') || '.' || chr(10) || chr(10) ||
 'Su oferta menciona excel avanzado, manejo de sql y experiencia de ' || CAST(years AS STRING) || ' años; es justo el tipo de trabajo que he venido haciendo y en el que quiero seguir creciendo.' || chr(10) || chr(10) ||
 'Me encantaría conversar sobre cómo puedo contribuir a su equipo. Quedo atento(a) a su respuesta.' || chr(10) || chr(10) || 'Saludos cordiales,' || chr(10) || name AS letter FROM g
""")
def template_letters_b(spark, sf):
    p = G.third_party_payload_b(profiles(spark, sf), "id")
    return p.select("id", T.template_letter_b(F.col("language"), F.col("name"), F.col("desired_role"), F.col("target_company"), F.col("years"), F.col("achievements"), F.col("requirements")).alias("letter"))


@query("template_letters_c", None)
def template_letters_c(spark, sf):
    return T.template_letters_c(profiles(spark, sf), "id")


@query("letter_criteria", None)
def letter_criteria(spark, sf):
    """Six criteria of the template letters against profile and offer keywords."""
    l = letters(spark, sf)
    kw = Q.keyword_array(profiles(spark, sf), "id", "offer", 10, "keywords")
    d = Q.check_letters(l.join(kw, "id", "left"), "id")
    crit = ["ajuste_oferta", "cero_inventados", "tono", "longitud", "espanol", "cta"]
    return d.select("id", *crit)


@query("note_quality", None)
def note_quality(spark, sf):
    p = C.with_facts_b(_ranges(spark, sf, "B"), "facts")
    p = Q.with_number_reference(p, "ref_amounts", "ref_percents")
    note = F.concat(
        F.lit("Tu expectativa salarial de "), N.money_text(F.col("desired_salary"), F.col("desired_currency")),
        F.lit(" es negociable: la oferta y tus logros la sostienen. Espera a la entrevista para hablar del rango y presenta evidencia de impacto."))
    return Q.note_quality(p.withColumn("note", note), "note", "q").select("id", "q.*")


_NOTES = ("CASE WHEN k % 4 = 3 THEN '# ' ELSE '' END || 'Tu oferta salarial de Q' || CAST(CASE WHEN k % 4 = 1 THEN cur * 2 ELSE cur END AS STRING) "
          "|| ' es negociable y la entrevista es buen momento para decirlo.' "
          "|| CASE WHEN k % 4 = 2 THEN '' ELSE repeat(' Presenta evidencia de tus logros con calma y pide el rango a tu favor.', 5) END")


@query("note_summary", f"""
WITH {PROFILES}, x AS (SELECT k % 3 AS model, k % 4 AS form, {_NOTES} AS note FROM profiles)
SELECT model, count(*) AS n, CAST(1 AS DOUBLE) AS spanish, avg(CAST(form <> 2 AS INT)) AS length_ok, avg(CAST(form <> 1 AS INT)) AS numbers_ok, CAST(1 AS DOUBLE) AS on_topic, CAST(1 AS DOUBLE) AS second_person,
 CAST(count_if(form = 1) AS BIGINT) AS invented, CAST(0 AS BIGINT) AS off_topic_cases, round(avg(len(string_split(note, ' '))), 6) AS words, round(avg(CASE WHEN form = 0 THEN 1.0 ELSE 5.0 / 6 END), 6) AS score FROM x GROUP BY model
""")
def note_summary(spark, sf):
    """Notes of three models, a quarter each sound, with an invented number, too short, with markdown."""
    p = raw_profiles(spark, sf).selectExpr("k % 3 AS model", f"{_NOTES} AS note", "array(CAST(cur AS DOUBLE)) AS ref_amounts", "array(CAST(12 AS DOUBLE)) AS ref_percents")
    d = Q.note_summary(Q.note_quality(p, "note", "q"), ["model"], "q")
    return d.withColumns({c: F.round(c, 6) for c in ("words", "score")})


_CONTENT = ("CASE CAST(k % 4 AS INT) WHEN 0 THEN '{\"must\":[\"Excel avanzado\",\"Manejo de SQL\"],\"nice\":[],\"keywords\":[\"Excel\"]}' WHEN 1 THEN '{nada' "
            "WHEN 2 THEN '{\"must\":[1],\"nice\":[],\"keywords\":[]}' ELSE '{\"must\":[\"Excel avanzado\",\"Salario atractivo\"],\"nice\":[],\"keywords\":[]}' END")


@query("requirements_summary", f"""
WITH {PROFILES}, x AS (SELECT k % 3 AS model, k % 4 AS form FROM profiles)
SELECT model, count(*) AS n, round(avg(CAST(form <> 1 AS INT)), 6) AS json_valid, round(avg(CAST(form IN (0, 3) AS INT)), 6) AS schema_valid, CAST(1 AS DOUBLE) AS grounding,
 round(avg(CASE form WHEN 0 THEN 2.0 / 3 WHEN 3 THEN 1.0 / 3 END), 6) AS recall, CAST(count_if(form = 3) AS BIGINT) AS mentions_salary,
 round(avg(CASE form WHEN 0 THEN (4 + 2.0 / 3) / 5 WHEN 1 THEN 0 WHEN 2 THEN 0.25 ELSE (3 + 1.0 / 3) / 5 END), 6) AS score FROM x GROUP BY model
""")
def requirements_summary(spark, sf):
    """Extractions of three models: sound, no JSON, a wrong type, one that asks about pay."""
    p = raw_profiles(spark, sf).selectExpr("k % 3 AS model", f"{_CONTENT} AS content", "offer")
    d = Q.requirements_summary(Q.requirements_quality(p, "content", "offer", "q"), ["model"], "q")
    return d.withColumns({c: F.round(c, 6) for c in ("json_valid", "schema_valid", "recall", "score")})


@query("requirements_quality", None)
def requirements_quality(spark, sf):
    p = profiles(spark, sf)
    content = F.to_json(F.struct(F.array(F.lit("Excel avanzado"), F.lit("Manejo de SQL")).alias("must"), F.array(F.lit("Liderazgo comprobado")).alias("nice"), F.array(F.lit("Excel")).alias("keywords")))
    d = Q.requirements_quality(p.withColumn("content", content), "content", "offer", "q")
    return d.select("id", "q.*")


@query("outgoing_prompt_b", f"""
WITH {PROFILES}, {_GOVERNED_B} SELECT id, 'Nombre: ' || name || chr(10) || 'Rol al que aplica: ' || desired_role || chr(10) || 'Empresa: ' || company || chr(10) || 'Años de experiencia: ' || CAST(years AS STRING) || ' (nivel: ' || level || ')' || chr(10)
 || 'Logros:' || chr(10) || w1 || ' ' || w2 || ' ' || w3 || chr(10) || 'Requisitos de la oferta:' || chr(10) || '- Excel avanzado' || chr(10) || '- Manejo de SQL' || chr(10) || '- Experiencia de ' || CAST(years AS STRING) || ' años' AS prompt FROM g
""")
def outgoing_prompt_b(spark, sf):
    p = G.third_party_payload_b(profiles(spark, sf), "id")
    return p.select("id", T.letter_prompt_b(F.col("name"), F.col("desired_role"), F.col("target_company"), F.col("years"), F.col("seniority"), F.col("achievements"), F.col("requirements")).alias("prompt"))
