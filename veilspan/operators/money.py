"""Money mentions in free text, one rule set per variant."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.functions import program
from veilspan.functions import spans as S
from veilspan.functions.regexes import rx
from veilspan.functions.text import fold, js_trim
from veilspan.session import let

MENTION = (
    "struct<start:int,ord:int,end:int,raw:string,value:double,currency:string,marked:boolean,is_money:boolean>"
)
MENTIONS = f"array<{MENTION}>"


def _mention(m, ord_, value, currency, marked, is_money, start=None, raw=None):
    r = m["raw"] if raw is None else raw
    st = m["start"] if start is None else start
    return F.struct(
        st.alias("start"),
        F.lit(ord_).alias("ord"),
        (st + F.length(r)).alias("end"),
        r.alias("raw"),
        value.alias("value"),
        currency.alias("currency"),
        marked.alias("marked"),
        is_money.alias("is_money"),
    )


def _year_like(raw: Column, value: Column, years: tuple[int, int]) -> Column:
    return raw.rlike(r"^\d{4}$") & value.between(*years)


# ------------------------------------------------------------------ variant B
def _currency_b(prefix: Column, suffix: Column) -> Column:
    tag = F.lower(F.concat_ws(" ", prefix, suffix))
    return F.when(tag.rlike(r"usd|\$|d[oó]lar|dls"), "USD").when(tag.rlike("gtq|q|quetzal"), "GTQ")


def with_mentions_b(df: DataFrame, text: str, out: str) -> DataFrame:
    """Marked amounts, plain numbers and spelled thousands, in start order."""
    return program.apply(df, ("mentions_b",), {"__text": text}, lambda d, o: mentions_b_chain(d, "__text", o), out)


def mentions_b_chain(df, text: str, out: str):

    def numeric(m):
        pre, num, mult, suf = (F.get(m["g"], F.lit(i)) for i in range(4))

        def body(v):
            value = F.when(mult != "", v * 1000).otherwise(v)
            marked = (pre != "") | (suf != "") | (mult != "")
            digits = F.length(F.regexp_replace(F.regexp_replace(num, r"[.,]\d{1,2}$", ""), r"\D", ""))
            return _mention(
                m, 0, value, _currency_b(pre, suf), marked,
                marked | ((digits >= 4) & ~_year_like(num, value, V.B_YEARS)),
            )

        return let(N.parse_number_b(num), body)

    def spelled(m):
        w1, w2, suf = (F.get(m["g"], F.lit(i)) for i in range(3))
        value = (N.word_value_b(w1) + F.when(w2 == "", 0).otherwise(N.word_value_b(w2))) * 1000.0
        return _mention(m, 1, value, _currency_b(F.lit(""), suf), F.lit(True), F.lit(True))

    t = F.col(text)
    d, names = S.with_spans(
        df,
        text,
        [
            S.Rule("money", "number", V.B_MONEY, 4, guard=t.rlike(r"\d"), make=numeric),
            S.Rule("money", "words", V.B_SPELLED, 3, guard=t.rlike("(?iu)mil"), make=spelled),
        ],
    )
    return d.select(
        *df.columns,
        F.array_sort(F.concat(*[F.coalesce(F.col(n), S.empty(MENTIONS)) for n in names])).alias(out),
    )


def with_money_field(df: DataFrame, raw: str, fallback: Column, out: str) -> DataFrame:
    """Amount typed into a salary field: the first mention that is money, else the first mention."""
    t, ms = S.tmp("field"), S.tmp("ms")
    d = with_mentions_b(df.select("*", js_trim(F.col(raw)).alias(t)), t, ms)
    best = F.coalesce(
        F.get(F.filter(F.col(ms), lambda m: m["is_money"]), F.lit(0)), F.get(F.col(ms), F.lit(0))
    )
    return d.select("*", best.alias(ms + "b")).select(
        *df.columns,
        F.when(
            F.col(ms + "b")["value"] > 0,
            F.struct(
                F.col(ms + "b")["value"].alias("amount"),
                F.coalesce(F.col(ms + "b")["currency"], fallback).alias("currency"),
            ),
        ).alias(out),
    )


# ------------------------------------------------------------------ variant C
def currency_c(raw: Column) -> Column:
    n = fold(raw)
    return F.when(n.rlike(r"(usd|us\$|u\$s|\$|dolar|dls)"), "USD").when(
        n.rlike(rx(r"(gtq|quetzal|\bq\.?\s*\d|^q)")), "GTQ"
    )


def mention_rules_c(text: str, folded: str) -> list[S.Rule]:
    """Five rules: prefix, multiplier, currency word, spelled, bare number."""
    yes, f, t = F.lit(True), F.col(folded), F.col(text)
    digits = t.rlike(r"\d")

    def g(m, i):
        return F.get(m["g"], F.lit(i))

    def prefixed(m):
        v = N.parse_number_c(g(m, 0))
        return _mention(m, 0, F.when(g(m, 1) != "", v * 1000).otherwise(v), currency_c(m["raw"]), g(m, 1) != "", yes)

    def keep_prefixed(m):
        glued = (m["start"] > 0) & m["raw"].rlike("^[qQ]") & F.substring(t, m["start"], F.lit(1)).rlike("^[A-Za-z]$")
        return (m["marked"] | (m["value"] >= 100)) & ~glued

    def multiplied(m):
        return _mention(m, 1, N.parse_number_c(g(m, 0)) * 1000, currency_c(m["raw"]), yes, yes)

    def worded(m):
        return _mention(m, 2, N.parse_number_c(g(m, 0)), currency_c(m["raw"]), yes, yes)

    def spelled(m):
        return _mention(m, 3, N.words_value_c(m["raw"]), currency_c(m["raw"]), yes, yes)

    def bare(m):
        return _mention(m, 4, N.parse_number_c(m["raw"]), F.lit(None).cast("string"), F.lit(False), yes)

    def after(m):
        return F.substring(t, m["end"] + 1, F.lit(30))

    def real_words(m):
        counted = F.regexp_replace(after(m), rx(r"^\s*de\s+", "i"), " ").rlike(V.C_COUNT_NOUNS)
        return (js_trim(F.lower(m["raw"])) != "mil") & ~counted

    def real_bare(m):
        return (
            (m["value"] >= 1000)
            & ~_year_like(js_trim(m["raw"]), m["value"], V.C_YEARS)
            & ~after(m).rlike(rx(r"^\s*%"))
            & ~after(m).rlike(V.C_COUNT_NOUNS)
        )

    def has(*words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(f, F.lit(w))
        return out

    mil, unit = has("mil"), has("quetzal", "dolar", "usd", "gtq", "dls")
    # the prefix rule starts with a currency sign or word: q also begins "quetzales"
    prefix = has("$", "usd", "gtq") | f.rlike(rx(r"q\.?\s?\d|quetzales\s?\d"))
    scale = mil | f.rlike(rx(r"\d\s?k"))
    return [
        S.Rule("money", "prefix", V.C_MONEY_A, 3, digits & prefix, keep_prefixed, prefixed),
        S.Rule("money", "scale", V.C_MONEY_B, 2, digits & scale, None, multiplied),
        S.Rule("money", "unit", V.C_MONEY_C, 1, digits & unit, None, worded),
        S.Rule("money", "words", V.C_WORDS_AMOUNT, 0, mil, real_words, spelled),
        S.Rule("money", "bare", V.C_MONEY_E, 1, digits, real_bare, bare),
    ]


def all_mentions(names: list[str]) -> Column:
    every = F.concat(*[F.coalesce(F.col(n), S.empty(MENTIONS)) for n in names])
    return F.filter(every, lambda m: m["value"].isNotNull())


def with_mentions_c(df: DataFrame, text: str, out: str) -> DataFrame:
    """Mentions of all five rules; they may overlap, rule order is kept."""

    def build(d, o):
        base, f = d.columns, S.tmp("fold")
        d = d.select("*", fold(F.col("__text")).alias(f))
        d, names = S.with_spans(d, "__text", mention_rules_c("__text", f))
        return d.select(*base, all_mentions(names).alias(o))

    return program.apply(df, ("mentions_c",), {"__text": text}, build, out)


def mention_spans(mentions: Column, kind: str, rule: str = "money") -> Column:
    return F.transform(
        mentions,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.lit(rule).alias("rule"),
            m["raw"].alias("raw"),
        ),
    )


# ------------------------------------------------------------------ percent mentions
def percent_rule(text: str) -> S.Rule:
    """array<struct<start,end,raw,value>> of percentages."""

    def make(m):
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["raw"].alias("raw"),
            N.number(F.replace(F.get(m["g"], F.lit(0)), F.lit(","), F.lit("."))).alias("value"),
        )

    return S.Rule("percent", "percent", V.B_PERCENT, 1, F.col(text).rlike(r"\d"), None, make)
