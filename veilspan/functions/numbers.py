"""Amounts as column expressions: parsing, spelled numbers, written forms, currency, periods, rounding."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions.regexes import WORD_END, WORD_START, WS, rx
from veilspan.functions.text import amount_haystack, fold, js_trim
from veilspan.session import let


def number(c: Column) -> Column:
    return c.try_cast("double")


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards +∞ (Spark's round goes away from zero)."""
    return F.floor(x + 0.5).cast("double")


def round_to(x: Column, step: int | Column) -> Column:
    return half_up(x / step) * step


# ------------------------------------------------------------------ parsing, three dialects
_A_CURRENCY = rx(r"us\s?\$|usd|gtq|quetzales|quetzal|dólares|dolares|\$")
_A_SCALE_TAIL = rx(r"\s?(k|mil|millones|millón|millon)$")
_A_GROUP = r"^\d{1,3}(?:[., ]\d{3})+(?:[.,]\d{1,2})?$"


def parse_amount_a(raw: Column) -> Column:
    """"Q15,000.00", "15 000", "15k", "1.5 millones" → number, NULL when it is none."""

    def scaled(b):
        s, scale = b["s"], b["scale"]
        cents = F.regexp_extract(s, r"[.,](\d{1,2})$", 1)
        whole = F.regexp_replace(F.regexp_replace(s, r"[.,]\d{1,2}$", ""), "[., ]", "")
        return F.when(
            s.rlike(_A_GROUP), number(F.when(cents != "", F.concat_ws(".", whole, cents)).otherwise(whole))
        ).when(s.rlike(r"^\d+(?:[.,]\d{1,2})?$"), number(F.replace(s, F.lit(","), F.lit(".")))) * scale

    def body(t):
        unit = F.regexp_extract(t, _A_SCALE_TAIL, 1)
        rest = js_trim(F.regexp_replace(t, _A_SCALE_TAIL, ""))
        return let(
            F.struct(
                F.regexp_replace(rest, r"[\u00a0\u202f]", " ").alias("s"),
                F.when(unit == "", 1.0).when(unit.isin("k", "mil"), 1e3).otherwise(1e6).alias("scale"),
            ),
            scaled,
        )

    bare = F.regexp_replace(F.regexp_replace(F.lower(raw), _A_CURRENCY, ""), rx(r"^\s*q\.?"), "")
    return let(js_trim(bare), body)


_B_GROUP = r"^(\d{1,3})((?:[., ]\d{3})+)(?:[.,](\d{1,2}))?$"


def parse_number_b(num: Column) -> Column:
    """"15,000.50" → 15000.5, "15.000" → 15000, "15,5" → 15.5."""

    def body(s):
        cents = F.regexp_extract(s, _B_GROUP, 3)
        whole = F.concat(F.regexp_extract(s, _B_GROUP, 1), F.regexp_replace(F.regexp_extract(s, _B_GROUP, 2), "[., ]", ""))
        return F.when(
            s.rlike(_B_GROUP), number(F.when(cents != "", F.concat_ws(".", whole, cents)).otherwise(whole))
        ).otherwise(number(F.regexp_replace(s, ",", ".")))

    return let(js_trim(F.regexp_replace(num, r"\u00a0", " ")), body)


def parse_number_c(raw: Column) -> Column:
    """Last separator is a thousands mark when exactly three digits follow it, else the decimal mark."""

    def body(s):
        after = F.regexp_extract(s, r"[.,](\d*)$", 1)
        head = F.regexp_replace(F.regexp_extract(s, r"^(.*)[.,]\d*$", 1), "[.,]", "")
        return F.when(~s.rlike("[.,]"), number(s)).when(
            F.length(after) == 3, number(F.regexp_replace(s, "[.,]", ""))
        ).otherwise(number(F.concat_ws(".", head, after)))

    return let(F.regexp_replace(raw, rx(r"[\s']"), ""), body)


def parse_form_amount(raw: Column) -> Column:
    """Number typed into an amount field of a profile form."""
    return let(
        F.regexp_replace(raw, r"[^\d.,]", ""),
        lambda s: F.when(s.rlike(r"^\d{1,3}([.,]\d{3})+$"), number(F.regexp_replace(s, "[.,]", ""))).otherwise(
            number(F.regexp_replace(s, ",", ""))
        ),
    )


def _lookup(values: dict[str, int]):
    m = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    return lambda w: F.try_element_at(m, w)


def word_value_b(w: Column) -> Column:
    return _lookup(V.B_NUMBER_WORDS)(F.lower(w))


def words_value_c(raw: Column) -> Column:
    """"veinte mil quinientos" → 20500; a bare leading "mil" is one thousand."""
    look = _lookup(V.C_NUMBER_VALUES)

    def total(s):
        return F.aggregate(
            F.split(s, WS + "+", -1), F.lit(0), lambda a, w: a + F.coalesce(look(w), F.lit(0))
        )

    def body(parts):
        before = total(F.get(parts, F.lit(0)))
        return F.when(before == 0, 1).otherwise(before) * 1000 + total(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))

    return let(F.split(fold(raw), rx(r"\bmil\b"), -1), body).cast("double")


# ------------------------------------------------------------------ numbers as Spanish words
def _below_1000(n: int) -> str:
    if n == 100:
        return "cien"
    parts = [V.SPANISH_HUNDREDS[n // 100]] if n >= 100 else []
    rest = n % 100
    if 0 < rest < 30:
        parts.append(V.SPANISH_UNITS[rest])
    elif rest:
        tens = V.SPANISH_TENS[rest // 10]
        parts.append(f"{tens} y {V.SPANISH_UNITS[rest % 10]}" if rest % 10 else tens)
    return " ".join(parts)


def spanish_words(n: Column) -> Column:
    """Accent-free Spanish words of an integer below one million (digits from there on)."""
    table = F.array(*[F.lit(_below_1000(i)) for i in range(1000)])

    def body(v):
        hi, lo = F.floor(v / 1000).cast("int"), (v % 1000).cast("int")
        thousands = F.when(hi == 1, "mil").when(hi > 1, F.concat(F.get(table, hi), F.lit(" mil")))
        rest = F.when(lo > 0, F.get(table, lo))
        return F.when(v == 0, "cero").when(v >= 1_000_000, v.cast("string")).otherwise(
            F.concat_ws(" ", thousands, rest)
        )

    return let(half_up(n).cast("long"), body)


# ------------------------------------------------------------------ written forms
def grouped(n: Column, sep: str = ",") -> Column:
    s = F.format_number(n, 0)
    return s if sep == "," else F.replace(s, F.lit(","), F.lit(sep))


def written_forms_a(amount: Column) -> Column:
    """The ways an amount is commonly written (leak probes of variant A)."""

    def body(n):
        comma, dot, space, flat = grouped(n), grouped(n, "."), grouped(n, " "), n.cast("long").cast("string")
        k = (n / 1000).cast("long").cast("string")
        fixed = [
            flat, comma, dot, space, F.concat(comma, F.lit(".00")), F.concat(F.lit("Q"), comma),
            F.concat(F.lit("Q "), comma), F.concat(F.lit("Q"), flat), F.concat(F.lit("Q "), space),
            F.concat(F.lit("Q."), comma), F.concat(F.lit("$"), comma), F.concat(F.lit("USD "), flat),
            F.concat(flat, F.lit(" quetzales")),
        ]
        round_k = [F.concat(k, F.lit("k")), F.concat(k, F.lit("K")), F.concat(k, F.lit(" mil"))]
        return F.array_distinct(
            F.concat(F.array(*fixed), F.when(n % 1000 == 0, F.array(*round_k)).otherwise(F.array().cast("array<string>")))
        )

    return let(half_up(amount), body)


def written_forms_b(amount: Column) -> Column:
    def body(n):
        comma, dot, space, flat = grouped(n), grouped(n, "."), grouped(n, " "), n.cast("long").cast("string")
        k = (n / 1000).cast("long").cast("string")
        fixed = [
            flat, comma, dot, space, F.concat(F.lit("Q"), comma), F.concat(F.lit("Q "), space),
            F.concat(F.lit("Q"), flat), F.concat(F.lit("$"), comma), F.concat(F.lit("USD "), flat),
        ]
        round_k = [F.concat(k, F.lit("k")), F.concat(k, F.lit(" mil")), F.concat(k, F.lit("K"))]
        return F.array_distinct(
            F.concat(F.array(*fixed), F.when(n % 1000 == 0, F.array(*round_k)).otherwise(F.array().cast("array<string>")))
        )

    return let(half_up(amount), body)


def _plain(x: Column) -> Column:
    """Number without a trailing ".0"."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def amount_variants(amount: Column) -> Column:
    """Forms under which an amount counts as written, in canonical text; decimals as a pattern."""

    def body(n):
        flat = n.cast("long").cast("string")
        whole = n % 1000 == 0
        k = F.when(whole, (n / 1000).cast("long").cast("string")).otherwise(
            F.replace(_plain(n / 1000), F.lit("."), F.lit("[.,]"))
        )
        big = F.array(F.concat(k, F.lit("k")), F.concat(k, F.lit(" k")), F.concat(k, F.lit(" mil")), F.concat(k, F.lit("mil")))
        odd = F.array(
            F.concat(F.floor(n / 1000).cast("string"), F.lit(" mil "), (n % 1000).cast("long").cast("string"))
        )
        none = F.array().cast("array<string>")
        return F.array_distinct(
            F.concat(
                F.array(flat),
                F.when(n >= 1000, big).otherwise(none),
                F.when((n >= 1000) & ~whole, odd).otherwise(none),
                F.array(spanish_words(n)),
            )
        )

    return let(half_up(amount), body)


def contains_amount(text: Column, amount: Column) -> Column:
    """First written form of `amount` found in `text`, else NULL."""

    def body(b):
        def found(v):
            word = F.concat(F.lit(WORD_START), v, F.lit(WORD_END))
            digits = F.concat(F.lit(r"(?i)(?:^|[^\d.,])"), F.replace(v, F.lit(" "), F.lit(WS + "*")), F.lit(r"(?![\d])"))
            return F.when(v.rlike("^[a-z ]+$"), F.regexp_like(b["h"], word)).otherwise(F.regexp_like(b["h"], digits))

        return F.get(F.filter(b["v"], found), F.lit(0))

    return F.when(
        amount > 0, let(F.struct(amount_haystack(text).alias("h"), amount_variants(amount).alias("v")), body)
    )


def amount_pattern(amount: Column) -> Column:
    """One pattern for all written forms of an amount, over `amount_haystack` text."""

    def body(vs):
        words = F.filter(vs, lambda v: v.rlike("^[a-z ]+$"))
        digits = F.transform(F.filter(vs, lambda v: ~v.rlike("^[a-z ]+$")), lambda v: F.replace(v, F.lit(" "), F.lit(WS + "*")))
        # the lookaheads let nearly every position fail on its first character
        first = F.substring(F.get(words, F.lit(0)), 1, 1)
        by_digits = F.concat(F.lit(r"(?=\d)(?<![\d.,])(?:"), F.array_join(digits, "|"), F.lit(r")(?![\d])"))
        by_words = F.concat(F.lit("|(?="), first, F.lit(")" + WORD_START + "(?:"), F.array_join(words, "|"), F.lit(")" + WORD_END))
        return F.concat(by_digits, F.when(F.size(words) > 0, by_words).otherwise(""))

    return F.when(amount > 0, let(amount_variants(amount), body))


def has_amount(haystack: Column, amount: Column) -> Column:
    """Whether any written form of `amount` stands in the haystack: one scan of the text."""
    return F.coalesce(F.regexp_like(haystack, amount_pattern(amount)), F.lit(False))


# ------------------------------------------------------------------ currency, period, money text
def to_gtq(amount: Column, currency: Column, variant: str) -> Column:
    """Local-currency amount; variant A knows no other currency than these two (NULL)."""
    usd = amount * F.lit(V.FX[variant])
    if variant == "A":
        return F.when(currency == "GTQ", amount).when(currency == "USD", usd)
    return F.when(currency == "USD", usd).otherwise(amount)


def from_gtq(amount: Column, currency: Column, variant: str) -> Column:
    return F.when(currency == "USD", amount / F.lit(V.FX[variant])).otherwise(amount)


def to_monthly(amount: Column, period: Column) -> Column:
    return (
        F.when(period == "YEAR", amount / 12)
        .when(period == "WEEK", amount * F.lit(V.WEEKS_PER_MONTH))
        .when(period == "DAY", amount * F.lit(V.DAYS_PER_MONTH))
        .when(period == "HOUR", amount * F.lit(V.HOURS_PER_MONTH))
        .otherwise(amount)
    )


def annual_to_monthly_b(amount: Column, currency: Column) -> Column:
    """Fourteen salaries a year in local currency, twelve in dollars."""
    return F.when(currency == "GTQ", amount / 14).otherwise(amount / 12)


def money_text(amount: Column, currency: Column) -> Column:
    n = F.format_number(half_up(amount), 0)
    return (
        F.when(currency == "GTQ", F.concat(F.lit("Q"), n))
        .when(currency == "USD", F.concat(F.lit("US$"), n))
        .otherwise(F.concat(n, F.lit(" "), currency))
    )


def gap_pct(current: Column, desired: Column, variant: str) -> Column:
    """Percent of increase; a current amount ≤ 0 is NULL (A, B) or 0 (C). B keeps one decimal."""
    pct = (desired - current) / current * 100
    if variant == "B":
        return F.when(current > 0, half_up((desired - current) / current * 1000) / 10)
    return F.when(current > 0, pct).otherwise(F.lit(0.0) if variant == "C" else F.lit(None).cast("double"))


def band(pct: Column, variant: str) -> Column:
    """Band id from the edge table; a CASE over five fixed rows, so no join is needed."""
    out = None
    for name, _, hi, hi_incl in V.BANDS[variant]:
        cond = F.lit(True) if hi is None else (pct <= hi if hi_incl else pct < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.when(pct.isNotNull(), out)


def years_bucket(years: Column) -> Column:
    out = None
    for name, op, edge in V.YEARS_BUCKETS:
        if op is None:
            return out.otherwise(name)
        cond = years < edge if op == "lt" else years <= edge
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out
