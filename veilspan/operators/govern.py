"""Egress governance: what may leave, in which form, and what is held back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.functions import spans as S
from veilspan.functions.text import clip, js_trim, squeeze
from veilspan.operators import detect as D
from veilspan.operators import redact as R

# ------------------------------------------------------------------ fixed values: policies
# (destination, column, treatment); a column that is not listed is never read for that destination
POLICY = [
    ("company", "target_company", "squeeze"), ("company", "desired_role", "squeeze"),
    ("market", "desired_role", "squeeze"), ("market", "location", "squeeze"), ("market", "years_bucket", "plain"),
    ("letter", "desired_role", "squeeze"), ("letter", "target_company", "squeeze"), ("letter", "years", "plain"),
    ("letter", "achievements", "redact"), ("letter", "offer", "redact"),
]
TIER_POLICY = {
    "device": "name email phone current_role employer current_salary current_currency desired_role desired_salary "
              "desired_currency target_company years achievements offer".split(),
    "private": "name email phone current_role employer current_salary current_currency desired_role desired_salary "
               "desired_currency target_company years achievements offer".split(),
    "third_party": "name desired_role target_company years achievements".split(),
}
NEVER_SENT = "name employer current_salary current_currency desired_salary desired_currency current_role".split()
C_ALLOWED = "current_role years desired_role target_company achievements offer".split()


def allowed(destination: str) -> list[str]:
    return [c for d, c, _ in POLICY if d == destination]


def assert_exact_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Plan-time check that a payload has exactly the listed columns."""
    extra, missing = set(df.columns) - set(expected), set(expected) - set(df.columns)
    if extra or missing:
        raise ValueError(f"payload columns differ: extra={sorted(extra)} missing={sorted(missing)}")
    return df


def never_sent_violations(df: DataFrame, forbidden: list[str] = NEVER_SENT) -> list[str]:
    """Forbidden columns present in a payload schema (names only, no job runs)."""
    return sorted(set(df.columns) & set(forbidden))


def project(df: DataFrame, key: str, destination: str) -> DataFrame:
    """Allowlist projection: only listed columns are read, each with its treatment."""
    treat = {"squeeze": lambda c: squeeze(F.coalesce(F.col(c), F.lit(""))), "plain": F.col, "redact": F.col}
    cols = [treat[t](c).alias(c) for d, c, t in POLICY if d == destination]
    return assert_exact_columns(df.select(key, *cols), [key, *allowed(destination)])


def tier_projection(df: DataFrame, key: str, tier: str) -> DataFrame:
    return assert_exact_columns(df.select(key, *TIER_POLICY[tier]), [key, *TIER_POLICY[tier]])


# ------------------------------------------------------------------ payloads
MAX_FACTS = 3  # company facts of a letter payload
_ENTRY = "array<struct<pos:int,field:string,text:string>>"


def stack_fields(df: DataFrame, key: str, fields: list[str], carry: list[str], lines: str | None = None) -> DataFrame:
    """One row per (key, field, text): every field goes through the same detectors in one pass. The texts of
    the array column `lines` follow as rows of their own. `unstack_fields` puts them back with one exchange.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)])
    if lines:
        more = F.transform(lines, lambda t, i: F.struct((i + len(fields)).alias("pos"), F.lit(lines).alias("field"), t.alias("text")))
        entries = F.concat(entries, F.coalesce(more, F.array().cast(_ENTRY)))
    return df.select(key, *carry, F.inline(entries))


def unstack_fields(rows: DataFrame, key: str, fields: list[str], keep: list[str], cells: list[str], lines: str | None = None) -> DataFrame:
    """Back to one row per key: `cells` become columns field.cell (arrays for `lines`), `keep` columns are
    constant per key."""
    # as many tasks as the session asks for: these rows are few bytes but much work, so they must
    # not be coalesced by size before the gate runs over them
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = rows.repartition(n, key).groupBy(key).agg(
        F.first(F.struct(*keep)).alias("_keep") if keep else F.lit(1).alias("_keep"),
        F.sort_array(F.collect_list(F.struct("pos", "field", *cells))).alias("_rows"),
    )
    kept = [F.col(f"_keep.{c}").alias(c) for c in keep]
    more = _line_cells(g, lines, cells) if lines else []
    return g.select(key, *kept, *[_cell(c, f, i).alias(f"{f}.{c}") for c in cells for i, f in enumerate(fields)], *more)


def _line_cells(wide: DataFrame, lines: str, cells: list[str]) -> list[Column]:
    own = F.filter("_rows", lambda r: r["field"] == lines)
    return [F.transform(own, lambda r: r[c]).alias(f"{lines}.{c}") for c in cells]


def _cell(cell: str, field: str, i: int) -> Column:
    return F.get(F.col("_rows"), F.lit(i))[cell]


def letter_payload_a(profiles: DataFrame, key: str, facts: str | None = None) -> DataFrame:
    """Destination "letter" of variant A: texts redacted, clipped and gated.

    `facts`: a column of array<struct<id, title, snippet>>; the first three go along as company_facts, each
    title and snippet redacted, snippets clipped, both gated like the fields.
    """
    p = profiles.select(
        key, "employer", "years",
        F.array(F.col("current_salary").cast("double"), F.col("desired_salary").cast("double")).alias("_amounts"),
        F.array("name").alias("_names"),
        squeeze(F.coalesce("desired_role", F.lit(""))).alias("desired_role"),
        squeeze(F.coalesce("target_company", F.lit(""))).alias("target_company"),
        js_trim(F.coalesce("achievements", F.lit(""))).alias("achievements"),
        js_trim(F.coalesce("offer", F.lit(""))).alias("offer"),
        *([F.slice(F.col(facts), 1, MAX_FACTS).alias("_given")] if facts else []),
    )
    fields, lines, mine = ["desired_role", "target_company", "achievements", "offer"], None, ["employer", "years", "_amounts", "_names"]
    if facts:
        lines, mine = "_fact", [*mine, "_ids"]
        clean = F.transform("_given", lambda f: F.array(squeeze(F.coalesce(f["title"], F.lit(""))), squeeze(F.coalesce(f["snippet"], F.lit("")))))
        p = p.select("*", F.flatten(clean).alias(lines), F.transform("_given", lambda f: f["id"]).alias("_ids"))
    rows = stack_fields(p, key, fields, mine, lines)
    rows = R.redact_a(rows, "text", "_red", "employer", "_amounts", "_names", findings="_f")
    caps = {"achievements": V.MAX_ACHIEVEMENTS, "offer": V.MAX_OFFER}
    out = F.col("text")
    for f, cap in caps.items():
        out = F.when(F.col("field") == f, clip(F.col("_red"), cap)).otherwise(out)
    free = F.col("field").isin(*caps)
    if facts:
        snippet = (F.col("pos") - len(fields)) % 2 == 1
        out = F.when(F.col("field") == lines, F.when(snippet, clip(F.col("_red"), V.MAX_SNIPPET)).otherwise(F.col("_red"))).otherwise(out)
        free = F.col("field").isin(*caps, lines)
    keep = [*mine[1:2], *(["_ids"] if facts else [])]
    rows = rows.select(key, *mine, "pos", "field", out.alias("text"), F.when(free, F.size("_f")).otherwise(0).alias("n"))
    rows = gate_rows_a(rows, "text", "employer", "_amounts", "_names")
    wide = unstack_fields(rows, key, fields, keep, ["text", "n", "kinds"], lines)

    def hit(name, kinds):
        return F.when(F.size(kinds) > 0, F.struct(F.lit(name).alias("field"), kinds.alias("kinds")))

    hits = [hit(f, F.col(f"`{f}.kinds`")) for f in fields]
    total = sum((F.col(f"`{f}.n`") for f in fields), F.lit(0))
    extra = []
    if facts:
        hits.append(hit("company_facts", F.array_distinct(F.flatten(F.col(f"`{lines}.kinds`")))))
        total += _total(f"`{lines}.n`")
        text = F.col(f"`{lines}.text`")
        extra = [F.transform("_ids", lambda x, i: F.struct(x.alias("id"), F.get(text, 2 * i).alias("title"), F.get(text, 2 * i + 1).alias("snippet"))).alias("company_facts")]
    hits = F.array_compact(F.array(*hits))
    first = F.get(hits, F.lit(0))
    payload = wide.select(
        key, F.col("`desired_role.text`").alias("desired_role"), F.col("`target_company.text`").alias("target_company"),
        F.greatest(F.lit(0), F.floor(F.col("years") + 0.5)).cast("int").alias("years"),
        F.col("`achievements.text`").alias("achievements"), F.col("`offer.text`").alias("offer"), *extra,
        total.alias("redactions"), (F.size(hits) > 0).alias("blocked"), first["field"].alias("blocked_field"),
        F.array_join(first["kinds"], ",").alias("blocked_kinds"),
    )
    more = ["company_facts"] if facts else []
    return assert_exact_columns(payload, [key, *allowed("letter"), *more, "redactions", "blocked", "blocked_field", "blocked_kinds"])


def gate_rows_a(rows: DataFrame, text: str, employer=None, amounts=None, names=None) -> DataFrame:
    """Gate: kinds still found in each text (a bare one- or two-digit number is no amount)."""
    tiny = F.col(text).rlike(r"^\d{1,2}$")
    d = D.find_a(rows, text, "_left", employer, amounts, names)
    left = F.filter("_left", lambda x: ~((x["kind"] == "money") & tiny))
    return d.withColumn("kinds", F.array_distinct(F.transform(left, lambda x: x["kind"]))).drop("_left")


MAX_LINES, MAX_LINE = 15, 240  # requirement lines of a payload and their characters


def third_party_payload_b(profiles: DataFrame, key: str) -> DataFrame:
    """Tier "third_party" of variant B, requirement lines of the offer included. The name does not pass the
    employer rules; every requirement line is redacted whole and then cut."""
    from veilspan.operators import compensation as C

    amounts = F.array(
        *[
            x
            for a, c in (("current_salary", "current_currency"), ("desired_salary", "desired_currency"))
            for x in (F.col(a).cast("double"), N.half_up(N.to_gtq(F.col(a), F.col(c), "B")))
        ]
    )
    fields = ["name", "desired_role", "target_company", "achievements"]
    p = profiles.select(
        key, "employer", amounts.alias("_amounts"), "years", *[F.coalesce(f, F.lit("")).alias(f) for f in fields],
        C.requirement_bullets(F.coalesce("offer", F.lit("")), MAX_LINES).alias("requirements"),
        C.language(F.col("offer")).alias("language"),
        C.seniority(F.col("years"), F.col("desired_role"), F.coalesce(F.col("offer"), F.lit(""))).alias("seniority"),
    )
    rows = stack_fields(p, key, fields, ["employer", "_amounts", "years", "language", "seniority"], "requirements")
    rows = rows.withColumn("employer", F.when(F.col("field") != "name", F.col("employer")))
    rows = R.redact_b(rows, "text", "red", "employer", "_amounts", True, findings="_f").withColumn("n", F.size("_f"))
    wide = unstack_fields(rows.drop("_f"), key, fields, ["years", "language", "seniority"], ["red", "n"], "requirements")
    return wide.select(
        key, *[F.col(f"`{f}.red`").alias(f) for f in fields], "years",
        F.transform("`requirements.red`", lambda t: F.substring(t, 1, MAX_LINE)).alias("requirements"), "language", "seniority",
        (sum((F.col(f"`{f}.n`") for f in fields), F.lit(0)) + _total("`requirements.n`")).alias("redactions"),
    )


def _total(numbers: str) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def server_gate_b(payload: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Second line: redact again without context, requirement lines too, then anything left (also bare
    currency words) rejects."""
    rest = [c for c in payload.columns if c not in (key, "requirements", *fields)]
    rows = stack_fields(payload, key, fields, rest, "requirements")
    rows = R.redact_b(rows, "text", "red", findings="_f").withColumn("n", F.size("_f")).drop("_f", "text")
    rows = D.find_b(rows, "red", "_left", currency_words=True)
    rows = rows.withColumn("kinds", F.transform("_left", lambda s: s["kind"])).drop("_left")
    wide = unstack_fields(rows, key, fields, rest, ["red", "n", "kinds"], "requirements")
    kinds = F.array_distinct(F.flatten(F.concat(F.array(*[F.col(f"`{f}.kinds`") for f in fields]), F.col("`requirements.kinds`"))))
    return wide.select(
        key, *[F.col(f"`{f}.red`").alias(f) for f in fields], F.col("`requirements.red`").alias("requirements"), *rest,
        (sum((F.col(f"`{f}.n`") for f in fields), F.lit(0)) + _total("`requirements.n`")).alias("server_redactions"),
        (F.size(kinds) > 0).alias("rejected"), F.array_join(F.array_sort(kinds), ",").alias("residual_kinds"),
    )


SYSTEM_C = (  # fixed value: instructions that precede every letter request
    'Eres un redactor profesional de cartas de interés (cover letters) para el mercado laboral de Guatemala.\n'
    'Escribe en español correcto y profesional, tratando de "usted" al lector.\n'
    'Reglas obligatorias:\n'
    '1. La carta debe tener entre 250 y 400 palabras.\n'
    '2. Usa SOLO los datos proporcionados. No inventes cifras, porcentajes, empresas, títulos, certificaciones, fechas ni logros.\n'
    '3. No menciones salarios, pretensiones salariales, teléfonos, correos, DPI, NIT ni direcciones.\n'
    '4. Si ves etiquetas entre corchetes como [SALARIO], [PERSONA], [EMPLEADOR_ACTUAL], [TELÉFONO] o [DIRECCIÓN], NO las copies: reformula la idea sin ese dato.\n'
    '5. Estructura: saludo dirigido al equipo de la empresa destino; 3 o 4 párrafos que conecten la experiencia y los logros con el puesto (y con la oferta, si la hay); un cierre que invite explícitamente a una entrevista o conversación; despedida y firma.\n'
    '6. Firma exactamente con el nombre indicado en "Nombre para la firma", sin cambiarlo.\n'
    '7. Tono profesional y cálido, sin exageraciones, sin emojis y sin formato markdown.\n'
    '8. Devuelve solo el texto de la carta, sin comentarios antes ni después.'
)


def outgoing_text_c(role, years, desired, company, achievements, offer) -> Column:
    """The exact text a letter request would carry."""
    def given(c, alt):
        return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(alt)

    has_offer = js_trim(F.coalesce(offer, F.lit(""))) != ""
    head = F.concat_ws(
        "\n",
        F.lit("Escribe la carta de interés con estos datos del candidato.\n"),
        F.lit(f"Nombre para la firma: {V.C_NAME_TAG}"),
        F.concat(F.lit("Puesto actual: "), given(role, F.lit("No indicado"))),
        F.lit("Empleador actual: no se menciona en la carta"),
        F.concat(F.lit("Años de experiencia: "), years.cast("string")),
        F.concat(F.lit("Puesto al que aplica: "), desired),
        F.concat(F.lit("Empresa destino: "), company),
        F.lit("\nLogros y experiencia (texto del candidato):\n<<<"),
        given(js_trim(achievements), F.lit("No indicó logros.")),
        F.lit(">>>\n"),
    )
    tail = F.when(
        has_offer,
        F.concat_ws(
            "\n", F.lit("Oferta de trabajo publicada (úsala para ajustar la carta a lo que piden):\n<<<"), js_trim(offer), F.lit(">>>")
        ),
    ).otherwise("No se proporcionó oferta: enfoca la carta en el puesto y la empresa destino.")
    return F.concat_ws("\n", head, tail)


def route_c(profiles: DataFrame, key: str) -> DataFrame:
    """Variant C: allowlist + redaction per field, final text, residual gate.

    Adds payload (the exact text), redactions (per field and kind), residual, blocked.
    """
    c = F.col
    p = profiles.select(
        key, "employer", "name", "current_salary", "desired_salary",
        F.array("target_company", "desired_role").alias("_keep"),
        F.when(F.isnan(c("years").cast("double")) | c("years").isNull(), 0)
        .otherwise(F.greatest(F.lit(0), F.floor(c("years") + 0.5)).cast("int")).alias("years"),
        *[F.coalesce(f, F.lit("")).alias(f) for f in ("current_role", "desired_role", "target_company", "achievements")],
        F.when(js_trim(F.coalesce("offer", F.lit(""))) != "", c("offer")).alias("offer"),
    )
    fields = ["current_role", "desired_role", "target_company", "achievements", "offer"]
    me = ["employer", "name", "current_salary", "desired_salary", "_keep", "years"]
    rows = R.redact_c(stack_fields(p, key, fields, me), "text", "red", "employer", "name", "_keep", findings="found")
    wide = unstack_fields(rows.drop("text"), key, fields, me, ["red", "found"])
    r = {f: F.col(f"`{f}.red`") for f in fields}
    p = wide.select(
        key, "employer", "name", "current_salary", "desired_salary", "_keep",
        F.concat(
            F.lit(SYSTEM_C + "\n"),
            outgoing_text_c(r["current_role"], c("years"), r["desired_role"], r["target_company"], r["achievements"], r["offer"]),
        ).alias("payload"),
        F.flatten(F.array(*[_labelled(f, f"`{f}.found`") for f in fields])).alias("redactions"),
    )
    return detect_residual_c(p, "payload").drop("_keep")


def _labelled(field: str, spans: str) -> Column:
    return F.transform(
        F.coalesce(F.col(spans), S.empty()),
        lambda x: F.struct(
            F.lit(field).alias("field"), x["kind"].alias("kind"), x["rule"].alias("rule"), x["raw"].alias("raw")
        ),
    )


def detect_residual_c(df: DataFrame, text: str) -> DataFrame:
    """Final gate over the exact outgoing text: rules again plus the profile's own known values."""
    f, m = S.tmp("res"), S.tmp("m")
    d = D.find_c(df, text, f, "employer", "name", "_keep")
    d = D.with_employer_matcher(d, "employer", m)
    t, h = F.col(text), F.col("_hay")
    d = d.select(
        "*", N.amount_haystack(t).alias("_hay"), N.amount_pattern(F.col("current_salary")).alias("_p1"),
        N.amount_pattern(F.col("desired_salary")).alias("_p2"),
    )
    rules = F.transform(
        F.filter(f, lambda s: s["rule"] != "own_name"), lambda s: F.struct(s["kind"].alias("kind"), s["rule"].alias("rule"))
    )
    compact = F.regexp_replace(h, "[^a-z0-9]", "")
    needle = F.regexp_replace(F.col(m)["full"], "[^a-z0-9]", "")

    def known(hit, kind, rule):
        return F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule")))

    more = F.array_compact(
        F.array(
            known(F.regexp_like(h, F.col("_p1")), "salary", "known_current_salary"),
            known(F.regexp_like(h, F.col("_p2")), "salary", "known_desired_salary"),
            known(F.coalesce((F.length(needle) >= 4) & F.contains(compact, needle), F.lit(False)), "employer", "known_employer"),
        )
    )
    d = d.withColumn("residual", F.concat(rules, more))
    return d.select(*df.columns, "residual", (F.size("residual") > 0).alias("blocked"))


def routing_status(use_cloud: Column, blocked: Column, online: Column, failed: Column) -> Column:
    return (
        F.when(~use_cloud, "skipped").when(blocked, "blocked").when(~online, "offline").when(failed, "error").otherwise("sent")
    )


# ------------------------------------------------------------------ form validation
def profile_errors(f: dict[str, Column]) -> Column:
    """Names of the form fields that fail validation, in order (variant A's form)."""

    def blank(c):
        return js_trim(F.coalesce(c.cast("string"), F.lit(""))) == ""

    def amount(c):
        return ~F.coalesce(N.parse_form_amount(c) > 0, F.lit(False))

    years = f["years"].try_cast("double")
    return F.array_compact(
        F.array(
            F.when(blank(f["desired_role"]), "desired_role"),
            F.when(blank(f["target_company"]), "target_company"),
            F.when(blank(f["location"]), "location"),
            F.when(amount(f["current_salary"]), "current_salary"),
            F.when(amount(f["desired_salary"]), "desired_salary"),
            F.when(blank(f["years"]) | years.isNull() | (years < 0) | (years > 60), "years"),
        )
    )


# ------------------------------------------------------------------ leaf walk over JSON
def nesting(body: Column) -> Column:
    """How deep objects and arrays of a JSON text lie in each other (0 for a scalar or no JSON)."""
    marks = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = F.transform(F.split(marks, "(?<=.)"), lambda m: F.when(m.isin("{", "["), 1).when(m.isin("}", "]"), -1).otherwise(0))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(
        step, state, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"]
    )


def walk_leaves(df: DataFrame, key: str, body: str, most: int = 64) -> DataFrame:
    """(key, path, text) for every key and scalar of a JSON body.

    The deepest nesting of the table is counted first (one number); the table is then opened that many
    times in one chain of generators that carries finished leaves along, so it is parsed once. A body that is
    no JSON, or is nested more than `most` deep, is one leaf with its whole text, so nothing in it escapes a gate
    and one hostile row does not make the plan longer.
    """
    depth = nesting(F.col(body))
    deepest = df.select(F.max(F.when(depth <= most, depth)).alias("d")).first()["d"] or 0
    parsed = F.when(depth <= most, F.try_parse_json(F.col(body)))
    lvl = df.select(key, F.lit("$").alias("path"), F.when(parsed.isNull(), F.col(body)).alias("text"), parsed.alias("v"))
    for _ in range(deepest):
        nested = F.schema_of_variant(F.col("v")).rlike("^(OBJECT|ARRAY)")
        lvl = lvl.select(key, "path", "text", F.when(~nested, F.col("v")).alias("_leaf"), F.when(nested, F.col("v")).alias("_open"))
        kids = lvl.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))

        def row(path, text, v):
            return F.struct(path.alias("path"), text.alias("text"), v.alias("v"))

        none, closed = F.lit(None).cast("string"), F.lit(None).cast("variant")
        named = F.when(F.col("_key").isNotNull(), row(F.concat("path", F.lit(".<key>")), F.col("_key"), closed))
        child = row(F.concat("path", F.col("_step")), none, F.col("_value"))
        here = row(F.col("path"), F.col("text"), F.col("_leaf"))
        kids = kids.select(lvl[key].alias("_id"), "path", "text", "_leaf", "_open", "pos", F.col("key").alias("_key"), step.alias("_step"), F.col("value").alias("_value"))
        out = F.when(F.col("_open").isNull(), F.array(here)).otherwise(F.array_compact(F.array(named, F.when(F.col("pos").isNotNull(), child))))
        lvl = kids.select(F.col("_id").alias(key), F.inline(out))
    text = F.coalesce("text", F.try_variant_get("v", "$", "string"))
    return lvl.select(key, "path", text.alias("text")).where(F.col("text").isNotNull())


def gate_leaves_a(df: DataFrame, key: str, body: str) -> DataFrame:
    """Variant A's gate over every key and scalar of a payload: blocked, first path (in document order by
    depth, then name) and the kinds found there."""
    found = gate_rows_a(walk_leaves(df, key, body), "text")
    first = F.min(F.when(F.size("kinds") > 0, F.struct("path", "kinds")))
    return found.groupBy(key).agg(first.alias("_f")).select(
        key, F.col("_f").isNotNull().alias("blocked"), F.col("_f.path").alias("blocked_path"), F.array_join("_f.kinds", ",").alias("blocked_kinds")
    )
