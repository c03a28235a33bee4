"""Compensation jobs: salary ranges in offers, normalisation, bands, positions, advice."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.functions import spans as S
from veilspan.functions.regexes import rx
from veilspan.functions.text import fold, js_trim
from veilspan.operators import money as M

# ------------------------------------------------------------------ fixed values
_AMOUNT_A = (
    rf"((?:US\s?\$|USD|GTQ|Q\.?|\$)?\s?{V.A_NUM}(?:\s?(?:k|mil)(?![\p{{L}}]))?"
    r"(?:\s?(?:quetzales|dólares|dolares|USD|GTQ)(?![\p{L}]))?)"
)
RANGE_A = rx(rf"(?:entre\s+|de\s+)?{_AMOUNT_A}\s*(?:-|–|—|a|al|y|hasta)\s*{_AMOUNT_A}", "i")
SINGLE_A = rx(
    rf"(?:salario|sueldo|pago|compensaci[oó]n|remuneraci[oó]n|ofrecemos)[^.\n\d$Q]{{0,40}}{_AMOUNT_A}", "i"
)
SCALED_A = rx(r"\d\s?(k|mil)(?![\p{L}])", "i")
CONNECTOR_B = rx(r"^\s*(?:-|–|—|a|y|to|and|hasta)\s*$", "i")
KEYWORD_B = rx(
    r"(salario|sueldo|salary|compensaci[oó]n|compensation|pay|ofrecemos|we offer|rango|range|hasta|up to|base)", "i"
)
YEAR_B = rx(r"(anual|al año|por año|annual|per year|a year|\/year|\/yr|yearly|annually)", "i")
BONUS_B = rx(r"(bono|bonos|bonificaci[oó]n|aguinaldo|annual bonus|bonus)\s*(anual(es)?|per year|yearly)?", "i")
UPTO_B = rx(r"(hasta|up to)\s*$", "i")
SHARED_C = rx(
    r"(?:(Q|GTQ|US\$|USD|\$)\s?)?(\d{1,3}(?:[.,]\d)?)\s*(?:-|–|—|a|al|y|to)\s*(?:Q|GTQ|US\$|USD|\$)?\s?"
    r"(\d{1,3}(?:[.,]\d)?)\s*(mil|k|K)\b\s*(quetzales|d[óo]lares|USD|GTQ)?",
    "i",
)
JOINER_C = rx(r"^\s*(?:-|–|—|a|al|y|hasta|to|and)\s*$", "i")
CONTEXT_C = rx(
    r"(salario|sueldo|salary|compensaci[oó]n|pago|pay|rango|range|ofrecemos|ingreso|remuneraci[oó]n|base)", "i"
)
ASKS_B = rx(
    r"(pretensi[oó]n salarial|expectativa salarial|salario (deseado|pretendido)|"
    r"indi(ca|que) (tu|su) (salario|pretensi)|salary expectations?|desired salary|expected salary)",
    "i",
)
ASKS_C = rx(
    r"(pretensi[oó]n(es)? salarial(es)?|expectativa(s)? salarial(es)?|aspiraci[oó]n salarial|"
    r"salario (pretendido|deseado|esperado)|indicar (su |tu )?(salario|pretensi[oó]n)|salary expectations?|"
    r"expected salary|desired salary|salary requirements?)",
    "i",
)
STEP_UP_C = rx(
    r"\b(senior|sr\.?|lead|l[ií]der|jefe|jefa|gerente|head|director|directora|principal|staff|coordinador|"
    r"coordinadora|manager|supervisor|supervisora)\b",
    "i",
)
SENIORITY_WORDS_B = [
    ("lead", rx(r"\b(lead|lider|jefe|jefa|gerente|head|manager|principal|director|directora|coordinador|coordinadora)\b")),
    ("senior", rx(r"\b(sr|senior|señor|semi ?sr)\b")),
    ("junior", rx(r"\b(jr|junior|trainee|practicante|pasante|intern|entry.level)\b")),
]
SEMI_SENIOR_B = rx(r"\bsemi ?(sr|senior)\b")
PROMOTION_TOLERANCE_PP, JUNIOR_YEARS, RANGE_WIDTH = 15, 2, 0.1

RANGE = "struct<min:double,max:double,currency:string,period:string,assumed:boolean,raw:string>"


def _range(lo, hi, currency, period, assumed, raw) -> Column:
    return F.struct(
        lo.alias("min"), hi.alias("max"), currency.alias("currency"), period.alias("period"),
        assumed.alias("assumed"), raw.alias("raw"),
    )


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


# ------------------------------------------------------------------ offer ranges
def _currency_a(s: Column) -> Column:
    return F.when(s.rlike(rx(r"US\s?\$|USD|dólar|dolar|\$", "i")), "USD").when(
        s.rlike(rx(r"(?<![\p{L}])Q\.?\s?\d|GTQ|quetzal", "i")), "GTQ"
    )


def _marked_a(s: Column) -> Column:
    return _currency_a(s).isNotNull() | s.rlike(SCALED_A)


def with_offer_range_a(df: DataFrame, offer: str, fallback: Column, out: str) -> DataFrame:
    """First believable range (marker or ≥ 1000, ratio ≤ 5), else a single amount after a keyword."""
    base = df.columns
    cand = "array<struct<at:int,lo:double,hi:double,raw:string,marked:boolean,cur:string>>"

    def pair(m):
        a, b = js_trim(F.get(m["g"], F.lit(0))), js_trim(F.get(m["g"], F.lit(1)))
        lo, hi = N.parse_amount_a(a), N.parse_amount_a(b)
        lo = F.when(b.rlike(SCALED_A) & ~a.rlike(SCALED_A) & (lo < 1000), lo * 1000).otherwise(lo)
        return F.struct(
            m["start"].alias("at"), lo.alias("lo"), hi.alias("hi"), js_trim(m["raw"]).alias("raw"),
            _marked_a(m["raw"]).alias("marked"), _currency_a(m["raw"]).alias("cur"),
        )

    def single(m):
        a = js_trim(F.get(m["g"], F.lit(0)))
        v = N.parse_amount_a(a)
        return F.struct(
            m["start"].alias("at"), v.alias("lo"), v.alias("hi"), js_trim(m["raw"]).alias("raw"),
            _marked_a(a).alias("marked"), _currency_a(a).alias("cur"),
        )

    t = F.col(offer)
    d, (p, s) = S.with_spans(
        df,
        offer,
        [
            S.Rule("range", "range", RANGE_A, 2, t.rlike(r"\d"), None, pair),
            S.Rule("single", "single", SINGLE_A, 1, t.rlike(r"\d"), None, single),
        ],
    )
    def good_pair(c):
        return (
            c["lo"].isNotNull() & c["hi"].isNotNull() & (c["marked"] | ((c["lo"] >= 1000) & (c["hi"] >= 1000)))
            & (c["lo"] > 0) & (c["hi"] >= c["lo"]) & (c["hi"] / c["lo"] <= 5)
        )

    def good_single(c):
        return (c["lo"] > 0) & (c["marked"] | (c["lo"] >= 1000))

    best = S.tmp("best")
    d = d.select(
        *base,
        F.coalesce(_first(F.filter(F.col(p), good_pair)), _first(F.filter(F.col(s), good_single))).alias(best),
    )
    b = F.col(best)
    from_ = F.greatest(F.lit(0), b["at"] - 60)
    around = F.lower(F.substring(t, from_ + 1, b["at"] + 120 - from_))
    period = (
        F.when(around.rlike("anual|al año|por año|annual|per year"), "YEAR")
        .when(around.rlike(rx(r"por hora|\/h\b|per hour|hourly")), "HOUR")
        .otherwise("MONTH")
    )
    made = _range(b["lo"], b["hi"], F.coalesce(b["cur"], fallback), period, b["cur"].isNull(), b["raw"])
    return d.select(*base, F.when(b.isNotNull(), made).alias(out))


def _adjacent(ms: Column) -> Column:
    """Mentions paired with their successor."""
    shifted = F.slice(ms, 2, F.greatest(F.size(ms) - 1, F.lit(0)))
    pairs = F.zip_with(ms, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(pairs, lambda p: p["b"].isNotNull())


def with_offer_range_b(df: DataFrame, offer: str, lang: Column, out: str) -> DataFrame:
    """Two amounts joined by a connector, else one near a keyword ("hasta" gives only a top)."""
    base = df.columns
    ms, hit, prs = S.tmp("ms"), S.tmp("hit"), S.tmp("prs")
    t = F.col(offer)
    d = M.with_mentions_b(df, offer, ms)
    d = d.select("*", F.when(F.exists(ms, lambda m: m["is_money"]), _adjacent(F.col(ms))).alias(prs))

    def shares(p):
        return ~p["a"]["is_money"] & (p["a"]["value"] < 1000) & p["b"]["raw"].rlike(rx(r"(?i)(k|mil)\s*\S*$"))

    def low(p):
        return F.when(shares(p), p["a"]["value"] * 1000).otherwise(p["a"]["value"])

    def good(p):
        gap = F.substring(t, p["a"]["end"] + 1, p["b"]["start"] - p["a"]["end"])
        return p["b"]["is_money"] & (p["a"]["is_money"] | shares(p)) & (p["b"]["value"] >= low(p)) & gap.rlike(CONNECTOR_B)

    def before(m, n):
        at = F.greatest(F.lit(0), m["start"] - n)
        return F.substring(t, at + 1, m["start"] - at)

    def near(m):
        return m["is_money"] & before(m, 60).rlike(KEYWORD_B)

    kind = "struct<min:double,max:double,currency:string,s:int,e:int>"
    two = F.transform(
        F.filter(F.col(prs), good),
        lambda p: F.struct(
            low(p).alias("min"), p["b"]["value"].alias("max"),
            F.coalesce(p["a"]["currency"], p["b"]["currency"]).alias("currency"),
            p["a"]["start"].alias("s"), p["b"]["end"].alias("e"),
        ),
    )
    one = F.transform(
        F.filter(F.col(ms), near),
        lambda m: F.struct(
            F.when(~before(m, 12).rlike(UPTO_B), m["value"]).alias("min"), m["value"].alias("max"),
            m["currency"].alias("currency"), m["start"].alias("s"), m["end"].alias("e"),
        ),
    )
    d = d.select(*base, F.coalesce(_first(two), _first(one)).cast(kind).alias(hit))
    h = F.col(hit)
    currency = F.coalesce(h["currency"], F.when(lang == "en", "USD").otherwise("GTQ"))
    from_ = F.greatest(F.lit(0), h["s"] - 30)
    context = F.substring(t, from_ + 1, h["e"] + 40 - from_)
    period = F.when(F.regexp_replace(context, BONUS_B, "").rlike(YEAR_B), "YEAR").otherwise("MONTH")
    raw = F.substring(t, h["s"] + 1, h["e"] - h["s"])
    made = _range(h["min"], h["max"], currency, period, h["currency"].isNull(), raw)
    return d.select(*base, F.when(h.isNotNull(), made).alias(out))


def monthly_gtq_b(range_: Column, side: str) -> Column:
    """A side of a range in monthly local currency, rounded (fourteen local salaries a year)."""
    v = range_[side]
    monthly = F.when(range_["period"] == "YEAR", N.annual_to_monthly_b(v, range_["currency"])).otherwise(v)
    return F.when(v.isNotNull(), N.half_up(N.to_gtq(monthly, range_["currency"], "B")))


def with_offer_range_c(df: DataFrame, offer: str, out: str) -> DataFrame:
    """Shared multiplier first, then joined amounts ≥ 500, then one amount in a salary context."""
    base = df.columns
    ms, shared, ok, hit, prs = (S.tmp(x) for x in ("ms", "sh", "ok", "hit", "prs"))
    t = F.col(offer)

    def both(m):
        def num(i):
            return N.number(F.replace(F.get(m["g"], F.lit(i)), F.lit(","), F.lit("."))) * 1000

        usd = F.concat(F.get(m["g"], F.lit(0)), F.get(m["g"], F.lit(4))).rlike(rx(r"US|\$|d[óo]lar", "i"))
        return F.struct(
            num(1).alias("min"), num(2).alias("max"), F.when(usd, "USD").otherwise("GTQ").alias("currency"),
            m["start"].alias("s"), m["end"].alias("e"),
        )

    d, (sh,) = S.with_spans(df, offer, [S.Rule("shared", "shared", SHARED_C, 5, t.rlike(r"\d"), None, both)], [shared])
    d = M.with_mentions_c(d, offer, ms)
    # start order, rule order within the same start
    d = d.select(
        *base, shared, F.array_sort(F.filter(F.col(ms), lambda m: m["value"] >= 500)).alias(ms)
    ).select(
        *base, shared, ms,
        F.concat(F.array(F.lit(0)), F.transform(F.col(ms), lambda m: m["end"])).alias(ok),
    )
    # a mention overlapping its immediate predecessor is dropped, kept or not
    paired = F.zip_with(
        F.col(ms), F.slice(F.col(ok), 1, F.size(ms)), lambda m, e: F.struct(m.alias("m"), e.alias("e"))
    )
    d = d.select(
        *base, shared,
        F.transform(F.filter(paired, lambda p: p["m"]["start"] >= p["e"]), lambda p: p["m"]).alias(ms),
    )
    d = d.select("*", _adjacent(F.col(ms)).alias(prs))

    def joined(p):
        gap = F.substring(t, p["a"]["end"] + 1, p["b"]["start"] - p["a"]["end"])
        return (p["b"]["value"] >= p["a"]["value"]) & gap.rlike(JOINER_C)

    def low(p):
        inherits = (p["a"]["value"] < 1000) & (p["b"]["value"] >= 1000) & p["b"]["raw"].rlike("(?i)mil|k")
        return F.when(inherits, p["a"]["value"] * 1000).otherwise(p["a"]["value"])

    def shape(lo, hi, cur, s, e):
        return F.struct(lo.alias("min"), hi.alias("max"), cur.alias("currency"), s.alias("s"), e.alias("e"))

    def in_context(m):
        at = F.greatest(F.lit(0), m["start"] - 40)
        return F.substring(t, at + 1, m["start"] - at).rlike(CONTEXT_C)

    gtq = F.lit("GTQ")
    first_shared = _first(F.col(shared))
    two = F.transform(
        F.filter(F.col(prs), joined),
        lambda p: shape(
            low(p), p["b"]["value"], F.coalesce(p["a"]["currency"], p["b"]["currency"], gtq), p["a"]["start"], p["b"]["end"]
        ),
    )
    one = F.transform(
        F.filter(F.col(ms), in_context),
        lambda m: shape(m["value"], m["value"], F.coalesce(m["currency"], gtq), m["start"], m["end"]),
    )
    d = d.select(
        *base,
        F.coalesce(
            F.when(first_shared["max"] >= first_shared["min"], first_shared), _first(two), _first(one)
        ).alias(hit),
    )
    h = F.col(hit)
    made = _range(
        h["min"], h["max"], h["currency"], F.lit("MONTH"), F.lit(False), F.substring(t, h["s"] + 1, h["e"] - h["s"])
    )
    return d.select(*base, F.when(h.isNotNull(), made).alias(out))


# ------------------------------------------------------------------ classification
def language(text: Column, fallback: str = "es") -> Column:
    """es / en by counting function words; ties and empty texts take the fallback."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))

    def count(vocab):
        return F.size(F.filter(words, lambda w: w.isin(*vocab)))

    es, en = count(V.LANG_ES), count(V.LANG_EN)
    return F.when(text.isNull() | (es == en), fallback).otherwise(F.when(en > es, "en").otherwise("es"))


def seniority(years: Column, *texts: Column) -> Column:
    """Keyword first, years table otherwise."""
    hay = fold(F.concat_ws(" ", *texts))
    out = F.when(hay.rlike(SEMI_SENIOR_B), "semi-senior")
    for level, pattern in SENIORITY_WORDS_B:
        out = out.when(hay.rlike(pattern), level)
    for level, least in V.SENIORITY_BY_YEARS:
        out = out.when(years >= least, level)
    return out.otherwise("junior")


def range_position(desired: Column, lo: Column, hi: Column) -> Column:
    """below / within / above a range whose open side is NULL."""
    return F.when(desired < lo, "below").when(desired > hi, "above").otherwise("within")


def pct_vs_top(desired: Column, hi: Column) -> Column:
    return F.when(hi.isNotNull() & (hi != 0), N.half_up((desired - hi) / hi * 100 * 10) / 10)


# ------------------------------------------------------------------ timing rules, first match wins
TIMING = {  # fixed values
    "offer-asks": (
        "En el formulario o correo de postulación, como rango (no en la carta).",
        "La oferta lo pide explícitamente: omitirlo te puede sacar del filtro. Da un rango cuyo piso sea tu número real.",
    ),
    "range-covers": (
        "En la primera llamada con RR. HH., sin miedo.",
        "Tu expectativa cae dentro del rango publicado: hablar de números temprano ahorra tiempo a ambos.",
    ),
    "range-below": (
        "Cuando pregunten, apunta al rango publicado, no a tu número.",
        "Pides menos de lo que ellos ya ofrecen: mencionarlo primero te ancla por debajo.",
    ),
    "range-above": (
        "Después de la entrevista técnica, cuando ya te quieran.",
        "Estás por encima del tope publicado: primero demuestra valor; luego negocia o pide otros componentes (bono, remoto, revisión a 6 meses).",
    ),
    "cut": (
        "Solo si preguntan, y explicando qué ganas a cambio.",
        "Una expectativa menor a tu salario actual se lee como urgencia; enmárcala en aprendizaje, horario o estabilidad.",
    ),
    "aggressive-no-range": (
        "Deja que ellos pongan la primera cifra.",
        "Un salto mayor a 35 % sin rango publicado suele descartarte si lo dices antes de demostrar valor.",
    ),
    "default": (
        "Nunca en la carta; en la entrevista con RR. HH. cuando te pregunten.",
        "La carta vende tu perfil; el número se negocia cuando ya hay interés mutuo.",
    ),
}


def timing_rule(asks: Column, has_range: Column, lo: Column, hi: Column, desired: Column, band: Column) -> Column:
    within = has_range & (F.coalesce(lo, F.lit(0.0)) <= desired) & (hi.isNull() | (desired <= hi))
    return (
        F.when(asks, "offer-asks")
        .when(within, "range-covers")
        .when(has_range & (desired < lo), "range-below")
        .when(has_range & (desired > hi), "range-above")
        .when(band == "recorte", "cut")
        .when(band == "agresivo", "aggressive-no-range")
        .otherwise("default")
    )


def message(key: Column, table: dict, i: int | None = None) -> Column:
    """Text of a rule from a message table."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v if i is None else v[i]).otherwise(out)
    return out


# ------------------------------------------------------------------ suggested range
def suggested_a(desired_gtq, offer_lo, offer_hi, position, market_lo, market_mid, currency) -> Column:
    """Upper quarter of a covering offer, the market floor when below it, else desired + 10 %."""
    covers = offer_lo.isNotNull() & offer_hi.isNotNull() & (desired_gtq <= offer_hi)
    under = position.eqNullSafe("below_min")
    lo_offer = F.greatest(desired_gtq, offer_lo + 0.75 * (offer_hi - offer_lo))
    lo_market = F.greatest(desired_gtq, market_lo)
    lo = F.when(covers, lo_offer).when(under, lo_market).otherwise(desired_gtq)
    hi = (
        F.when(covers, F.greatest(lo_offer, offer_hi))
        .when(under, F.greatest(lo_market * 1.1, market_mid))
        .otherwise(desired_gtq * 1.1)
    )
    step = F.when(currency == "GTQ", 500.0).otherwise(50.0)
    return F.struct(
        N.round_to(N.from_gtq(lo, currency, "A"), step).alias("min"),
        N.round_to(N.from_gtq(hi, currency, "A"), step).alias("max"),
    )


def suggested_c(desired: Column, currency: Column) -> Column:
    step = F.when(currency == "USD", 50.0).otherwise(500.0)
    return F.struct(
        N.round_to(desired, step).alias("min"), N.round_to(desired * (1 + RANGE_WIDTH), step).alias("max")
    )


# ------------------------------------------------------------------ requirement lines
def requirement_bullets(offer: Column, most: int = 8) -> Column:
    """Bullet lines of an offer, verbatim, without duplicates, first `most`."""
    lines = F.filter(F.split(offer, r"\r?\n", -1), lambda l: l.rlike(V.BULLET))
    items = F.transform(lines, lambda l: F.regexp_replace(js_trim(F.regexp_extract(l, V.BULLET, 1)), "[.;]$", ""))
    return F.slice(F.array_distinct(items), 1, most)


def offer_requirements(offer: Column, most: int = 3) -> Column:
    """Short bullet lines of an offer (variant C), first `most`."""
    lines = F.filter(F.split(offer, r"\n", -1), lambda l: l.rlike(V.OFFER_BULLET))
    items = F.transform(lines, lambda l: js_trim(F.regexp_replace(l, V.OFFER_BULLET_HEAD, "")))
    return F.slice(F.filter(items, lambda l: (F.length(l) > 4) & (F.length(l) < 140)), 1, most)


# ------------------------------------------------------------------ notes
BAND_TEXT_C = {  # fixed values
    "recorte": "Estás pidiendo menos de lo que ganas hoy. Si es a propósito (cambio de carrera, trabajo remoto, estabilidad), está bien, pero no lo menciones en la entrevista: no hace falta justificar un número bajo.",
    "conservadora": "Tu expectativa es conservadora. Tienes margen para pedir un poco más: un cambio de empresa suele justificar entre 10 % y 25 %.",
    "razonable": "Tu expectativa está en el rango típico de un cambio de empresa (10 %–25 %). Puedes sostenerla sin mayor justificación.",
    "ambiciosa": "Tu expectativa es ambiciosa (25 %–40 %). Prepárate para justificarla con logros medibles y con el alcance del nuevo puesto.",
    "muy_ambiciosa": "Tu expectativa supera el 40 % sobre tu salario actual. Es alcanzable sobre todo con un cambio de nivel o de mercado; ten a mano ejemplos concretos y una cifra mínima aceptable.",
}
BAND_LABEL_C = {  # fixed values
    "recorte": "Por debajo de tu salario actual", "conservadora": "Conservadora", "razonable": "Razonable",
    "ambiciosa": "Ambiciosa", "muy_ambiciosa": "Muy ambiciosa",
}
BAND_LABEL_A = {  # fixed values
    "below": "Por debajo de tu salario actual", "conservative": "Conservadora", "realistic": "Realista",
    "ambitious": "Ambiciosa — justifícala", "out_of_range": "Fuera de rango sin cambio de rol/seniority",
}
BAND_ADVICE_B = {  # fixed values
    "recorte": "Solo tiene sentido si ganas otra cosa (aprendizaje, horario, remoto). Dilo en esos términos, no como descuento.",
    "conservador": "Fácil de aceptar. Probablemente estás dejando dinero en la mesa: revisa si el rol lo justifica.",
    "razonable": "Es el rango típico de un cambio de trabajo. Defiéndelo con 1–2 logros medibles.",
    "ambicioso": "Alcanzable si el rol nuevo es más grande que el actual. Llega con evidencia de impacto.",
    "agresivo": "Solo se sostiene con un salto de rol o de mercado. Prepara un plan B (bono, fecha de revisión, remoto).",
}
NOTE_B = {  # fixed values: the sentences of the note
    "headline": ": pides {} % respecto a lo que ganas hoy.", "now": "Hoy: {}/mes", "asked": "Expectativa: {}/mes", "gap": "Brecha: {} %",
    "delta": "Diferencia: {}/mes", "fx": "Tipo de cambio: Q{} por US$1", "range": "La oferta publica {} – {}{}; tu expectativa {}.",
    "within": "cae dentro del rango", "above": "queda {} % por encima del tope", "below": "queda por debajo del piso: estás pidiendo menos de lo que ofrecen",
    "when": "Cuándo mencionarlo: {} {}",
}
BAND_LABEL_B = {  # fixed values
    "recorte": "Pides menos que hoy", "conservador": "Conservador", "razonable": "Razonable",
    "ambicioso": "Ambicioso", "agresivo": "Agresivo",
}


def note_c(band, gap, promotion, years, offer_range, position) -> Column:
    """Advice lines of variant C, in order, as an array."""
    r = F.concat(
        N.money_text(offer_range["min"], offer_range["currency"]),
        F.when(
            offer_range["max"] != offer_range["min"],
            F.concat(F.lit(" – "), N.money_text(offer_range["max"], offer_range["currency"])),
        ).otherwise(""),
    )
    top = 40 + PROMOTION_TOLERANCE_PP
    offer_line = (
        F.when(position == "within", F.concat(F.lit("La oferta publica "), r, F.lit(" y tu expectativa cae dentro: apunta a la mitad superior del rango.")))
        .when(position == "above", F.concat(F.lit("La oferta publica "), r, F.lit(" y tu expectativa está por encima: negocia el máximo del rango más beneficios (bono, vacaciones, trabajo remoto) o pregunta si hay flexibilidad.")))
        .when(position == "below", F.concat(F.lit("La oferta publica "), r, F.lit(" y tu expectativa está por debajo: puedes pedir más, al menos el punto medio del rango.")))
    )
    return F.array_compact(
        F.array(
            message(band, BAND_TEXT_C),
            F.when(promotion & (gap >= 25), f"El puesto deseado es un paso arriba en responsabilidad: eso justifica hasta ~{top} % de incremento."),
            F.when(
                (years < JUNIOR_YEARS) & (gap >= 25),
                f"Con menos de {JUNIOR_YEARS} años de experiencia, un salto mayor al 25 % es más difícil de sostener: considera negociar también capacitación o revisión salarial a los 6 meses.",
            ),
            F.when(offer_range.isNotNull(), offer_line),
        )
    )


def with_note_c(df: DataFrame, out: str, offer_range: str = "offer_range") -> DataFrame:
    """Whole note of variant C from a profile row that already has its offer range."""
    c = F.col
    cur = N.to_gtq(c("current_salary"), c("current_currency"), "C")
    des = N.to_gtq(c("desired_salary"), c("desired_currency"), "C")
    d = df.select("*", cur.alias("_cur"), des.alias("_des"), N.gap_pct(cur, des, "C").alias("_gap"))
    r = c(offer_range)
    lo, hi = N.to_gtq(r["min"], r["currency"], "C"), N.to_gtq(r["max"], r["currency"], "C")
    d = d.select(
        "*",
        N.band(c("_gap"), "C").alias("_band"),
        F.when(r.isNotNull(), range_position(c("_des"), lo, hi)).alias("_pos"),
        (c("desired_role").rlike(STEP_UP_C) & ~c("current_role").rlike(STEP_UP_C)).alias("_promo"),
        F.coalesce(c("offer"), F.lit("")).rlike(ASKS_C).alias("_asks"),
        suggested_c(c("desired_salary"), c("desired_currency")).alias("_sug"),
    )
    pct = F.concat(F.when(c("_gap") >= 0, "+").otherwise(""), F.format_string("%.1f", c("_gap")), F.lit(" %"))
    sug = F.concat(
        N.money_text(c("_sug.min"), c("desired_currency")), F.lit(" – "), N.money_text(c("_sug.max"), c("desired_currency"))
    )
    when = F.array(
        F.lit("Nunca escribas cifras de salario en la carta de interés."),
        F.lit('No reveles tu salario actual. Si te lo preguntan, redirige a tu expectativa: "Para este puesto busco un rango de …".'),
        F.when(
            c("_asks"),
            F.concat(F.lit("La oferta pide pretensión salarial: ponla en el formulario o en el correo de envío (no en la carta), como rango: "), sug, F.lit(".")),
        )
        .when(r.isNotNull(), "La oferta ya publica un rango: menciona tu cifra hasta la primera llamada con Recursos Humanos, cuando te pregunten.")
        .otherwise("Espera a que Recursos Humanos saque el tema (normalmente en la primera llamada de filtro) y ten tu rango listo."),
    )
    headline = F.concat(
        message(c("_band"), BAND_LABEL_C), F.lit(": "), pct, F.lit(" (de "),
        N.money_text(c("current_salary"), c("current_currency")), F.lit(" a "),
        N.money_text(c("desired_salary"), c("desired_currency")), F.lit(")"),
    )
    return d.select(
        *df.columns,
        F.struct(
            c("_gap").alias("gap_pct"), c("_band").alias("band"), c("_promo").alias("promotion"),
            c("_pos").alias("position"), c("_asks").alias("asks"), c("_sug").alias("suggested"),
            headline.alias("headline"),
            note_c(c("_band"), c("_gap"), c("_promo"), c("years"), r, c("_pos")).alias("advice"),
            when.alias("when"),
        ).alias(out),
    )


def with_facts_b(df: DataFrame, out: str, offer_range: str = "offer_range") -> DataFrame:
    """Every deterministic figure of variant B (gap, band, range position, timing, language, level)."""
    c = F.col
    cur = N.to_gtq(c("current_salary"), c("current_currency"), "B")
    des = N.to_gtq(c("desired_salary"), c("desired_currency"), "B")
    r = c(offer_range)
    d = df.select(
        "*", cur.alias("_cur"), des.alias("_des"), N.gap_pct(cur, des, "B").alias("_gap"),
        monthly_gtq_b(r, "min").alias("_lo"), monthly_gtq_b(r, "max").alias("_hi"),
    )
    d = d.select("*", N.band(c("_gap"), "B").alias("_band"))
    timing = timing_rule(
        F.coalesce(c("offer").rlike(ASKS_B), F.lit(False)), r.isNotNull(), c("_lo"), c("_hi"), c("_des"), c("_band")
    )
    return d.select(
        *df.columns,
        F.struct(
            N.half_up(c("_cur")).alias("current_gtq"), N.half_up(c("_des")).alias("desired_gtq"),
            N.half_up(c("_des") - c("_cur")).alias("delta_gtq"), c("_gap").alias("gap_pct"), c("_band").alias("band"),
            c("_lo").alias("offer_min"), c("_hi").alias("offer_max"),
            F.when(r.isNotNull(), range_position(c("_des"), c("_lo"), c("_hi"))).alias("vs_range"),
            pct_vs_top(c("_des"), c("_hi")).alias("pct_vs_top"), timing.alias("timing"),
            language(c("offer")).alias("language"),
            seniority(c("years"), c("desired_role"), F.coalesce(c("offer"), F.lit(""))).alias("seniority"),
        ).alias(out),
    )


# ------------------------------------------------------------------ note B
def fill(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, t in zip(values, parts[1:]):
        out += [v, F.lit(t)]
    return F.concat(*out)


def short_number(x: Column) -> Column:
    """A figure with one decimal at most, without a trailing ".0"."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def with_note_b(df: DataFrame, out: str, offer_range: str = "offer_range") -> DataFrame:
    """The note of variant B from its figures alone: headline, figures, range note, advice, timing, text."""
    c, t = F.col, NOTE_B
    d = with_facts_b(df, "_fb", offer_range)
    f, r = c("_fb"), c(offer_range)
    signed = F.concat(F.when(f["gap_pct"] >= 0, "+").otherwise(""), short_number(f["gap_pct"]))
    delta = F.concat(F.when(f["delta_gtq"] >= 0, "+").otherwise("−"), N.money_text(F.abs(f["delta_gtq"]), F.lit("GTQ")))
    mixed = c("current_currency") != c("desired_currency")
    figures = F.array_compact(F.array(
        fill(t["now"], N.money_text(c("current_salary"), c("current_currency"))), fill(t["asked"], N.money_text(c("desired_salary"), c("desired_currency"))),
        fill(t["gap"], signed), fill(t["delta"], delta), F.when(mixed, F.lit(t["fx"].format(f"{V.FX['B']:g}"))),
    ))
    place = F.when(f["vs_range"] == "within", t["within"]).when(f["vs_range"] == "above", fill(t["above"], short_number(f["pct_vs_top"]))).otherwise(t["below"])
    edge = [F.coalesce(N.money_text(r[x], r["currency"]), F.lit("—")) for x in ("min", "max")]
    note = F.when(r.isNotNull(), fill(t["range"], *edge, F.when(r["period"] == "year", " anuales").otherwise("/mes"), place))
    headline = F.concat(message(f["band"], BAND_LABEL_B), fill(t["headline"], signed))
    when = fill(t["when"], message(f["timing"], TIMING, 0), message(f["timing"], TIMING, 1))
    advice = message(f["band"], BAND_ADVICE_B)
    text = F.concat_ws("\n", headline, F.array_join(figures, " · "), note, advice, when)
    return d.select(*df.columns, F.struct(
        headline.alias("headline"), figures.alias("figures"), message(f["band"], BAND_LABEL_B).alias("band_label"), advice.alias("advice"),
        f["timing"].alias("timing"), note.alias("range_note"), text.alias("text"),
    ).alias(out))
