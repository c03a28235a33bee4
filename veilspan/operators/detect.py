"""Sensitive-span detection per rule variant: a table with a text column → the same table with a
column of spans.

`employer`, `name`/`names`, `amounts`, `keep` name columns of the same row (the declared values of
the profile the text belongs to). Only projections are added, so nothing is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.functions import program
from veilspan.functions import spans as S
from veilspan.functions.regexes import WS, rx
from veilspan.functions.text import fold, js_trim, quote_regex, squeeze
from veilspan.operators import money as M
from veilspan.session import let

Rule = S.Rule


def _finish(d: DataFrame, base: list[str], names: list[str], out: str) -> DataFrame:
    return d.select(*base, F.concat(*[F.coalesce(F.col(n), S.empty()) for n in names]).alias(out))


# ================================================================== variant A
def phrase_pattern(phrase: Column) -> Column:
    """Pattern for a declared name: accents and case folded, ≤ 3 other characters between its words."""
    p = js_trim(fold(phrase))
    for _ in range(3):
        p = F.regexp_replace(F.regexp_replace(p, rx(r"[,\s]+$"), ""), V.A_LEGAL_SUFFIX, "")
    words = F.filter(F.split(p, r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
    body = F.array_join(words, r"[^\p{L}\p{N}]{0,3}")
    return F.when(body != "", F.concat(F.lit(r"(?<![\p{L}\p{N}])"), body, F.lit(r"(?![\p{L}\p{N}])")))


def with_candidates_a(
    df: DataFrame,
    text: str,
    out: str,
    employer: str | None = None,
    amounts: str | None = None,
    names: str | None = None,
    rules=None,
    numbers_too: bool = True,
) -> DataFrame:
    """Every span variant A's rules produce, before overlaps are resolved.

    `rules`, from the names of the text and of its folded form to a list, stands for the built-in regex rules.
    """
    base = df.columns
    t, known, folded, pats = (S.tmp(x) for x in ("t", "known", "fold", "pats"))
    none = F.array().cast("array<double>")
    amounts_col = F.coalesce(F.filter(F.col(amounts), lambda a: a > 0), none) if amounts else none
    d = df.select("*", S.plain(F.col(text)).alias(t), amounts_col.alias(known))
    extra = []
    if rules and not (employer or names):
        d = d.select("*", fold(F.col(t)).alias(folded))
    if employer or names:
        phrases = []
        if employer:
            ok = js_trim(F.coalesce(F.col(employer), F.lit(""))) != ""
            d = d.select("*", F.when(ok, phrase_pattern(F.col(employer))).alias(pats + "e"))
            phrases.append(("employer", pats + "e"))
        if names:
            listed = F.filter(F.col(names), lambda n: F.length(js_trim(n)) >= 3)
            d = d.select("*", F.filter(F.transform(listed, phrase_pattern), lambda p: p.isNotNull()).alias(pats + "l"))
            d = d.select("*", F.when(F.size(pats + "l") > 0, F.array_join(F.col(pats + "l"), "|")).alias(pats + "n"))
            phrases.append(("name", pats + "n"))
        d = d.select("*", fold(F.col(t)).alias(folded))

        def original(kind):
            return lambda m: S.span(
                m["start"], m["end"], kind, "declared", F.substring(F.col(t), m["start"] + 1, m["end"] - m["start"])
            )

        extra = [
            Rule(k, "declared", F.col(p), 0, F.col(p).isNotNull(), None, original(k), folded) for k, p in phrases
        ]

    tc, kc = F.col(t), F.col(known)
    digits = tc.rlike(r"\d")
    has_known = F.size(kc) > 0

    def valued(s):
        """Known amounts become "salary"; trailing blanks do not belong to the span."""
        raw = F.regexp_replace(s["raw"], WS + "+$", "")
        hit = let(N.parse_amount_a(raw), lambda v: F.exists(kc, lambda k: F.abs(k - v) < 0.5))
        kind = F.when(has_known & F.coalesce(hit, F.lit(False)), "salary").otherwise("money")
        return S.span(s["start"], s["start"] + F.length(raw), kind, s["rule"], raw)

    def counts(s):
        """Years are no money unless known; the catch-all number rule only finds known amounts."""
        year = (s["rule"] == "bare") & s["raw"].rlike(r"^\d{4}$") & s["raw"].try_cast("int").between(*V.A_YEARS)
        return (s["kind"] == "salary") | ((s["rule"] != "any") & ~F.coalesce(year, F.lit(False)))

    glued = F.concat(
        F.lit(r"(?<!\d)(?:"),
        F.array_join(F.transform(kc, lambda k: N.half_up(k).cast("long").cast("string")), "|"),
        F.lit(r")(?!\d)"),
    )
    unit = tc.rlike("(?iu)quetzal|d[óo]lares|usd|gtq")
    scale = tc.rlike(rx(r"(?iu)\d\s?(?:k|mil)"))
    money = [
        Rule("money", "prefix", V.A_MONEY_PREFIX, 0, digits),
        Rule("money", "suffix", V.A_MONEY_SUFFIX, 0, digits & unit),
        Rule("money", "scale", V.A_MONEY_SCALE, 0, digits & scale),
        Rule("money", "grouped", V.A_GROUPED, 0, digits),
        Rule("money", "bare", V.A_BARE, 0, digits),
    ]
    other = [
        Rule("email", "email", V.A_EMAIL, 0, F.contains(tc, F.lit("@"))),
        Rule("dpi", "dpi", V.A_DPI, 0, digits),
        Rule("nit", "nit_labeled", V.A_NIT_LABELED, 0, digits & tc.rlike("(?i)nit")),
        Rule("nit", "nit_bare", V.A_NIT_BARE, 0, digits & F.contains(tc, F.lit("-"))),
        Rule("phone", "phone", V.A_PHONE, 0, digits),
        Rule("money", "words", V.A_MONEY_WORDS, 0, tc.rlike("(?iu)mil")),
    ]
    if rules:
        money, other = money if numbers_too else [], rules(t, folded)
    if amounts:
        money.append(Rule("money", "any", V.A_ANY_NUMBER, 0, has_known & digits))
        other.append(Rule("salary", "glued", glued, 0, has_known & digits))
    d, cols = S.with_spans(d, t, money + other + extra)
    numbers, rest = cols[: len(money)], cols[len(money):]
    if not numbers:
        return _finish(d, base, rest, out)
    allm = S.tmp("amounts")
    d = _finish(d, [*base, known, *rest], numbers, allm)
    d = d.select(*base, *rest, F.filter(F.transform(F.col(allm), valued), counts).alias(allm))
    return _finish(d, base, [allm, *rest], out)


def find_a(df, text, out, employer=None, amounts=None, names=None) -> DataFrame:
    """Variant A: earliest span wins."""
    cols = {"__text": text, "__employer": employer, "__amounts": amounts, "__names": names}
    has = {k: k if v else None for k, v in cols.items()}

    def build(d, o):
        c = S.tmp("cand")
        d = with_candidates_a(d, "__text", c, has["__employer"], has["__amounts"], has["__names"])
        return S.first_wins(d, c, o, V.A_PRIORITY)

    return program.apply(df, ("find_a",), cols, build, out)


# ================================================================== variant B
def _clean_employer_b(employer: Column) -> Column:
    return js_trim(F.regexp_replace(fold(js_trim(employer)), V.B_LEGAL_SUFFIX, ""))


def employer_pattern_b(employer: Column) -> Column:
    e = _clean_employer_b(employer)
    body = F.array_join(F.transform(F.split(e, WS + "+", -1), quote_regex), rx(r"[\s\-]+"))
    return F.when(F.length(e) >= 3, F.concat(F.lit(r"(?<![\p{L}\d])"), body, F.lit(r"(?![\p{L}\d])")))


def distinctive_tokens_b(employer: Column) -> Column:
    return F.filter(
        F.split(_clean_employer_b(employer), rx(r"[\s,.\-]+"), -1),
        lambda t: (F.length(t) >= 4) & ~t.isin(*V.B_GENERIC_EMPLOYER),
    )


def _stage_b(d: DataFrame, kind: str, pattern, work: str, out: str, guard: Column, folded: str | None = None):
    """One detector: its spans on the current text, and the text masked for the next one."""
    d, (s,) = S.with_spans(
        d, folded or work, [Rule(kind, kind, pattern, 0, guard)], [S.tmp("found")]
    )
    if folded is None:
        d = d.select("*", F.when(guard, S.mask(F.col(work), pattern)).otherwise(F.col(work)).alias(out))
    else:
        d = d.select("*", F.coalesce(F.col(s), S.empty()).alias(s + "f")).drop(s)
        s = s + "f"
        d = S.apply_tags(d, work, s, out, _filler)
    return d, s


def _filler(s):
    return F.repeat(F.lit("░"), s["end"] - s["start"])


def find_b(
    df: DataFrame,
    text: str,
    out: str,
    employer: str | None = None,
    amounts: str | None = None,
    currency_words: bool = False,
) -> DataFrame:
    """Variant B: detectors run one after another, what one found is masked for the next."""
    cols = {"__text": text, "__employer": employer, "__amounts": amounts}
    has = {k: k if v else None for k, v in cols.items()}

    def build(d, o):
        words = [lambda text, _: Rule("currency_word", "currency_word", V.B_CURRENCY_WORD)] if currency_words else []
        return chain_b(d, "__text", o, has["__employer"], has["__amounts"], B_STAGES, True, words)

    return program.apply(df, ("find_b", currency_words), cols, build, out)


def _digits_b(kind: str, pattern: str):
    return lambda text, _: Rule(kind, kind, pattern, 0, F.col(text).rlike(r"\d"))


B_STAGES = [
    lambda text, _: Rule("email", "email", V.B_EMAIL, 0, F.contains(F.col(text), F.lit("@"))),
    _digits_b("dpi", V.B_DPI), _digits_b("nit", V.B_NIT), _digits_b("phone", V.B_PHONE),
]


def _rule_stage(d: DataFrame, make_rule, work: str):
    """One rule on the current text: frame, its spans, and the name of the text masked for the next rule."""
    nxt, fo, found = S.tmp("w"), S.tmp("fold"), S.tmp("found")
    rule = make_rule(work, fo)
    d = d.select("*", fold(F.col(work)).alias(fo))  # pruned where the rule does not read it
    if isinstance(rule.pattern, str) and not (rule.keep or rule.make or rule.text):
        guard = F.lit(True) if rule.guard is None else rule.guard
        d, (s,) = S.with_spans(d, work, [rule], [found])
        return d.select("*", F.when(guard, S.mask(F.col(work), rule.pattern)).otherwise(F.col(work)).alias(nxt)).drop(work, fo), s, nxt
    d, (s,) = S.with_spans(d, work, [rule], [found])
    d = d.select("*", F.coalesce(F.col(s), S.empty()).alias(s + "f")).drop(s, fo)
    return S.apply_tags(d, work, s + "f", nxt, _filler).drop(work), s + "f", nxt


def _money_stage(d: DataFrame, w: str, amounts: str | None):
    ms, spans, known = S.tmp("ms"), S.tmp("money"), S.tmp("known")
    none = F.array().cast("array<double>")
    amounts_col = F.coalesce(F.filter(F.col(amounts), lambda a: a > 0), none) if amounts else none
    d = M.mentions_b_chain(d.select("*", amounts_col.alias(known)), w, ms)

    def wanted(m):
        near = F.exists(
            F.col(known),
            lambda k: F.abs(m["value"] - k) <= F.greatest(F.lit(V.B_KNOWN_ABS), F.abs(k) * V.B_KNOWN_REL),
        )
        return ~F.contains(m["raw"], F.lit("░")) & (m["is_money"] | near)

    d = d.select("*", M.mention_spans(F.filter(F.col(ms), wanted), "money").alias(spans)).drop(ms, known)
    nxt, solo = S.tmp("w"), S.tmp("solo")
    d = S.first_wins(d.select("*", F.col(spans).alias(solo)), solo, solo + "d", {"money": 0})
    d = S.apply_tags(d, w, solo + "d", nxt, _filler).drop(w, solo + "d")
    return d, spans, nxt


def chain_b(df, text, out, employer, amounts, before, money, after):
    """`before` and `after`: functions from the names of the text and its folded form to a rule; between them the
    detectors for amounts (if `money`) and the employer."""
    base = df.columns
    w = S.tmp("w")
    d = df.select("*", S.plain(F.col(text)).alias(w))
    found = []
    for make_rule in before:
        d, s, w = _rule_stage(d, make_rule, w)
        found.append(s)
    if money:
        d, s, w = _money_stage(d, w, amounts)
        found.append(s)
    if employer:
        one, many = S.tmp("pat"), S.tmp("pat")
        d = d.select(
            "*", employer_pattern_b(F.col(employer)).alias(one), distinctive_tokens_b(F.col(employer)).alias(many)
        )
        tokens = F.concat(
            F.lit(r"(?<![\p{L}\d])(?:"), F.array_join(F.transform(F.col(many), quote_regex), "|"), F.lit(r")(?![\p{L}\d])")
        )
        d = d.select("*", F.when(F.size(many) > 0, tokens).alias(many + "p")).drop(many)
        for p in (one, many + "p"):
            nxt, fo = S.tmp("w"), S.tmp("fold")
            d = d.select("*", fold(F.col(w)).alias(fo))
            d, s = _stage_b(d, "employer", F.col(p), w, nxt, F.col(p).isNotNull(), fo)
            # spans were cut from the folded text: take the characters of the original
            d = d.drop(w, fo)
            found.append(s)
            w = nxt
    for make_rule in after:
        d, s, w = _rule_stage(d, make_rule, w)
        found.append(s)
    d = _finish(d, base, found, out)
    t = F.col(text)
    return d.select(
        *base,
        F.transform(
            F.sort_array(F.col(out)),
            lambda s: S.span(
                s["start"], s["end"], s["kind"], s["rule"], F.substring(t, s["start"] + 1, s["end"] - s["start"])
            ),
        ).alias(out),
    )


# ================================================================== variant C
def clean_company(name: Column) -> Column:
    """Company name for matching: no parentheses, no legal suffix, folded, only letters/digits/&."""
    s = F.regexp_replace(F.regexp_replace(name, r"\(.*?\)", " "), V.C_CORPORATE_SUFFIX, "")
    return squeeze(F.regexp_replace(fold(s), rx(r"[^a-z0-9&\s]"), " "))


def with_employer_matcher(df, employer: str, out: str):
    """Add struct<full, acronym, aliases, distinctive> of a declared employer (NULL when blank)."""
    full, words = S.tmp("full"), S.tmp("words")
    d = df.select("*", clean_company(F.coalesce(F.col(employer), F.lit(""))).alias(full))
    d = d.select("*", F.filter(F.split(F.col(full), " ", -1), lambda w: ~w.isin(*V.C_STOP)).alias(words))
    aliases = F.filter(
        F.transform(F.regexp_extract_all(F.col(employer), F.lit(r"\(([^)]+)\)"), F.lit(1)), clean_company),
        lambda a: a != "",
    )
    initials = F.array_join(F.transform(F.col(words), lambda w: F.substring(w, 1, 1)), "")
    return d.select(
        *df.columns,
        F.when(
            F.col(full) != "",
            F.struct(
                F.col(full).alias("full"),
                F.when(F.size(words) >= 2, initials).alias("acronym"),
                aliases.alias("aliases"),
                F.filter(F.col(words), lambda w: (F.length(w) >= 5) & ~w.isin(*V.C_GENERIC)).alias("distinctive"),
            ),
        ).alias(out),
    )


def _pieces(phrase: Column, limit: Column) -> Column:
    """limit + 1 disjoint parts of a phrase, none across a blank; NULL when it is too short for that.

    Each edit spoils one part at most, so a text within `limit` edits contains one of them as it is.
    """
    words = F.filter(F.split(phrase, " ", -1), lambda w: w != "")
    k = F.ceil((limit + 1) / F.greatest(F.size(words), F.lit(1))).cast("int")

    def cut(w):
        n = F.ceil(F.length(w) / k).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.substring(w, j * n + 1, n))

    parts = F.filter(F.flatten(F.transform(words, cut)), lambda x: x != "")
    by_length = F.array_sort(F.transform(parts, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x"))))
    longest = F.transform(F.slice(by_length, F.lit(1), limit + 1), lambda e: e["x"])
    return F.when(F.size(parts) > limit, longest)


def employer_needles(m: Column) -> Column:
    """Strings one of which any employer match must contain; NULL when no such set exists."""

    def fuzzy(p):
        return _pieces(p, F.when(F.length(p) >= 8, F.greatest(F.lit(1), F.floor(F.length(p) / 8).cast("int"))).otherwise(0))

    def together(p):
        c = F.replace(p, F.lit(" "), F.lit(""))
        return _pieces(c, F.when(F.length(c) >= 10, 1).otherwise(0))

    def single(d):
        return _pieces(d, F.when(F.length(d) >= 7, 1).otherwise(0))

    phrases = F.concat(F.array(m["full"]), m["aliases"])
    return F.flatten(F.concat(F.transform(phrases, fuzzy), F.transform(phrases, together), F.transform(m["distinctive"], single)))


def _close(a: Column, b: Column, limit: Column) -> Column:
    """Edit distance within `limit`; cheap tests first."""
    return (a == b) | (
        (limit > 0) & (F.abs(F.length(a) - F.length(b)) <= limit) & (F.levenshtein(a, b) <= limit)
    )


def token_rule(guard: Column | None = None) -> Rule:
    def make(m):
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), fold(m["raw"]).alias("norm")
        )

    return Rule("token", "token", V.C_TOKEN, 0, guard, None, make)


def employer_rules_c(d, matcher: str, folded: str):
    """The acronym pattern of a matcher as a column, and the rules for acronym and tokens.

    Cutting a text into tokens is the dear part; texts without any part of the name are spared it.
    """
    mc, acr, nd = F.col(matcher), S.tmp("acr"), S.tmp("needles")
    d = d.select("*", F.when(mc.isNotNull(), employer_needles(mc)).alias(nd))
    maybe = mc.isNotNull() & (F.col(nd).isNull() | F.exists(nd, lambda n: F.contains(F.col(folded), n)))
    letters = F.filter(F.split(F.upper(mc["acronym"]), "", -1), lambda x: x != "")
    pattern = F.concat(
        F.lit(r"(?<![\p{L}\p{N}])"), F.array_join(F.transform(letters, quote_regex), r"\.?"), F.lit(r"\.?(?![\p{L}\p{N}])")
    )
    d = d.select("*", F.when(F.length(mc["acronym"]) >= 2, pattern).alias(acr))
    return d, [
        Rule("employer", "employer_acronym", F.col(acr), 0, F.col(acr).isNotNull()),
        token_rule(maybe),
    ]


def with_employer_spans_c(d, text: str, m: str, a_spans: str, toks: str, out: str):
    """Declared employer: exact, with typos, written together, as an acronym, by distinctive word."""
    base = d.columns
    mc, tc, norms = F.col(m), F.col(text), S.tmp("norms")
    phrases, k = S.tmp("phr"), F.col(toks)
    d = d.select(
        "*",
        F.transform(
            F.concat(F.array(mc["full"]), mc["aliases"]),
            lambda p: F.struct(
                p.alias("p"),
                F.replace(p, F.lit(" "), F.lit("")).alias("c"),
                F.size(F.split(p, " ", -1)).alias("n"),
                F.when(F.length(p) >= 8, F.greatest(F.lit(1), F.floor(F.length(p) / 8).cast("int"))).otherwise(0).alias("lim"),
            ),
        ).alias(phrases),
        F.transform(k, lambda x: x["norm"]).alias(norms),
    )
    nc = F.col(norms)

    def window(ph):
        def at(x, i):
            end = F.get(k, i + ph["n"] - 1)["end"]
            cand = F.array_join(F.slice(nc, i + 1, ph["n"]), " ")
            return F.when(
                end.isNotNull() & _close(cand, ph["p"], ph["lim"]),
                F.struct(x["start"].alias("s"), end.alias("e"), (cand == ph["p"]).alias("same")),
            )

        return F.transform(
            F.filter(F.transform(k, at), lambda w: w.isNotNull()),
            lambda w: S.span(
                w["s"], w["e"], "employer", F.when(w["same"], "employer_exact").otherwise("employer_fuzzy"),
                F.substring(tc, w["s"] + 1, w["e"] - w["s"]),
            ),
        )

    def together(ph):
        near = F.when(F.length(ph["c"]) >= 10, 1).otherwise(0)
        use = (ph["n"] > 1) & (F.length(ph["c"]) >= 6)
        return F.transform(
            F.filter(k, lambda x: use & _close(x["norm"], ph["c"], near)),
            lambda x: S.span(x["start"], x["end"], "employer", "employer_compact", x["raw"]),
        )

    def distinctive(x):
        return x["raw"].rlike(r"^\p{Lu}") & F.exists(
            mc["distinctive"], lambda w: _close(x["norm"], w, F.when(F.length(w) >= 7, 1).otherwise(0))
        )

    single = F.transform(
        F.filter(k, distinctive), lambda x: S.span(x["start"], x["end"], "employer", "employer_token", x["raw"])
    )
    parts = [
        F.flatten(F.transform(F.col(phrases), window)),
        F.flatten(F.transform(F.col(phrases), together)),
        F.col(a_spans),
        single,
    ]
    return d.select(*base, F.concat(*[F.coalesce(p, S.empty()) for p in parts]).alias(out))


_NOT_NAME_HEAD = "^(?:(?:" + "|".join(V.C_NOT_NAMES) + r")(?:[ \t]+|$))+"
_VETO = list(dict.fromkeys(V.C_NOT_NAMES + V.C_JOB_WORDS))


# stems one of which every role / title contains
ROLE_STEMS = (
    "jef gerente companer colega supervis director coordinador lider manager boss mentor cliente socio socia encargad "
    "reclutador recruiter contacto referencia teammate coworker"
).split()
TITLE_STEMS = "Lic Ing Dr Doct Sr Señ Don Doñ Arq Mr Ms MSc".split()


def any_of(text: Column, words: list[str]) -> Column:
    """Plain substring tests: far cheaper than a regex that fails at every position."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def people_rules(text: str, folded: str) -> list[Rule]:
    """People introduced by a role or a title."""

    def by_role(m):
        name = F.get(m["g"], F.lit(0))
        n = F.length(F.regexp_replace(fold(name), _NOT_NAME_HEAD, ""))
        return S.span(m["end"] - n, m["end"], "person_name", "person_role", F.right(name, n))

    def by_title(m):
        words = F.split(fold(F.get(m["g"], F.lit(0))), r"[ \t]+", -1)
        job = F.exists(words, lambda w: w.isin(*_VETO))
        return F.when(~job, S.span(m["start"], m["end"], "person_name", "person_title", m["raw"]))

    return [
        Rule("person_name", "person_role", V.C_PERSON_ROLE, 1, any_of(F.col(folded), ROLE_STEMS), lambda s: s["end"] > s["start"], by_role),
        Rule("person_name", "person_title", V.C_PERSON_TITLE, 1, any_of(F.col(text), TITLE_STEMS), lambda s: s.isNotNull(), by_title),
    ]


def own_name_pattern(name: Column) -> Column:
    """The author's own declared name as a sequence of words (over folded text).

    Words may be joined by dots or hyphens in the text or in the name: a name is masked in all of these
    forms, which is wider than comparing blank-separated words and errs on the side of masking.
    """
    words = F.transform(F.split(fold(js_trim(name)), WS + "+", -1), quote_regex)
    return F.when(
        F.length(js_trim(name)) >= 3,
        F.concat(
            F.lit(r"(?<![\p{L}\p{N}&])"), F.array_join(words, r"[^\p{L}\p{N}&]+"), F.lit(r"(?![\p{L}\p{N}&])")
        ),
    )


def keep_covers(folded: str, needles: str) -> Column:
    """Every occurrence of every public string, one string at a time, so strings that begin alike or overlap
    all count."""

    def places(needle):
        parts = F.split(F.col(folded), quote_regex(needle), -1)
        n = F.length(needle)

        def step(acc, part):
            a = acc["at"] + F.length(part)
            return F.struct((a + n).alias("at"), F.concat(acc["found"], F.array(S.span(a, a + n, "keep", "keep", needle))).alias("found"))

        start = F.struct(F.lit(0).alias("at"), S.empty().alias("found"))
        return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda acc: acc["found"])

    return F.flatten(F.transform(F.col(needles), places))


def no_year_pair(s):
    d = F.regexp_replace(s["raw"], r"\D", "")
    a = F.substring(d, F.length(d) - 7, F.lit(4)).try_cast("int")
    b = F.right(d, F.lit(4)).try_cast("int")
    return ~(a.between(*V.C_YEARS) & b.between(*V.C_YEARS) & s["raw"].rlike("[-–]"))


def contact_rules(text: str) -> list[Rule]:
    t = F.col(text)
    digits = t.rlike(r"\d")

    def labeled(m):
        g = F.get(m["g"], F.lit(0))
        at = m["start"] + F.instr(m["raw"], g) - 1
        return S.span(at, at + F.length(g), "nit", "nit_labeled", g)

    return [
        Rule("email", "email", V.C_EMAIL, 0, F.contains(t, F.lit("@"))),
        Rule("dpi", "dpi_4_5_4", V.C_DPI, 0, digits),
        Rule("nit", "nit_labeled", V.C_NIT_LABELED, 1, digits & (F.contains(t, F.lit("NIT")) | t.rlike("(?i)nit")), None, labeled),
        Rule("nit", "nit_shape", V.C_NIT_SHAPE, 0, digits & F.contains(t, F.lit("-"))),
        Rule("phone", "phone_gt", V.C_PHONE, 0, digits, no_year_pair),
    ]


ADDRESS_STEMS = {
    "address_zona": ["zona"], "address_street_numbered": ["calle", "avenida", "av."],
    "address_street_named": ["calle", "avenida", "av.", "diagonal", "bulevar", "boulevard", "blvd", "calzada", "carretera"],
    "address_km": ["km", "kilometro"],
    "address_area": ["colonia", "col.", "residencial", "condominio", "barrio", "aldea", "lotificacion", "canton"],
    "address_unit": ["casa", "apto", "apartamento", "lote", "manzana"], "address_house_number": ["zona"],
}


def address_rules(text: str, folded: str) -> list[Rule]:
    digits, f = F.col(text).rlike(r"\d"), F.col(folded)
    wordy = ("address_street_named", "address_area")
    return [
        Rule("address", rule, p, 0, any_of(f, ADDRESS_STEMS[rule]) if rule in wordy else digits & any_of(f, ADDRESS_STEMS[rule]))
        for rule, p in V.C_ADDRESS.items()
    ]


def with_candidates_c(
    df: DataFrame,
    text: str,
    out: str,
    employer: str | None = None,
    own_name: str | None = None,
    keep: str | None = None,
    rules=None,
    amounts_too: bool = True,
) -> DataFrame:
    """Every span of variant C's rules, public strings and existing tags already taken out.

    `rules`, from the names of the text and of its folded form to a list, stands for the built-in regex rules.
    """
    base = df.columns
    t, folded, emp, covers, allc = (S.tmp(x) for x in ("t", "fold", "emp", "cov", "all"))
    d = df.select("*", S.plain(F.col(text)).alias(t))
    d = d.select("*", fold(F.col(t)).alias(folded))
    rules = rules(t, folded) if rules else contact_rules(t) + address_rules(t, folded) + people_rules(t, folded)
    cover_rules = [Rule("tag", "tag", V.C_TAG_PATTERN, 0, F.col(t).rlike(r"[\[{]"))]
    if own_name or keep:
        cols = []
        if own_name:
            cols.append(own_name_pattern(F.col(own_name)).alias(folded + "n"))
        if keep:
            needles = F.filter(
                F.transform(F.col(keep), lambda k: fold(js_trim(k))), lambda n: n.isNotNull() & (F.length(n) >= 3)
            )
            cols.append(needles.alias(folded + "k"))
        d = d.select("*", *cols)
    if own_name:
        p = folded + "n"

        def own(m):
            raw = F.substring(F.col(t), m["start"] + 1, m["end"] - m["start"])
            return S.span(m["start"], m["end"], "person_name", "own_name", raw)

        rules.append(Rule("person_name", "own_name", F.col(p), 0, F.col(p).isNotNull(), None, own, folded))
    if keep:
        d = d.select("*", keep_covers(folded, folded + "k").alias(folded + "kc"))
    money, emp_rules, matcher = M.mention_rules_c(t, folded) if amounts_too else [], [], S.tmp("m")
    if employer:
        d = with_employer_matcher(d, employer, matcher)
        d, emp_rules = employer_rules_c(d, matcher, folded)
    d, names = S.with_spans(d, t, rules + cover_rules + money + emp_rules)
    n, k = len(rules), len(rules) + len(cover_rules)
    hits, cov, mon, emps = names[:n], names[n:k], names[k : k + len(money)], names[k + len(money):]
    if employer:
        d = with_employer_spans_c(d, t, matcher, emps[0], emps[1], emp)
    parts = [F.coalesce(F.col(x), S.empty()) for x in hits] + ([M.mention_spans(M.all_mentions(mon), "salary")] if mon else [])
    parts += [F.col(emp)] if employer else []
    d = d.select(
        *base,
        F.concat(*parts).alias(allc),
        F.concat(*[F.coalesce(F.col(x), S.empty()) for x in [*cov, *([folded + "kc"] if keep else [])]]).alias(covers),
    )
    kept = F.when(F.size(covers) == 0, F.col(allc)).otherwise(S.drop_inside(F.col(allc), F.col(covers)))
    return d.select(*base, kept.alias(out))


def find_c(df, text, out, employer=None, own_name=None, keep=None) -> DataFrame:
    """Variant C: overlapping spans merge into their union."""
    cols = {"__text": text, "__employer": employer, "__own": own_name, "__keep": keep}
    has = {k: k if v else None for k, v in cols.items()}

    def build(d, o):
        c = S.tmp("cand")
        d = with_candidates_c(d, "__text", c, has["__employer"], has["__own"], has["__keep"])
        return S.union_merge(d, c, o, V.C_PRIORITY, "__text")

    return program.apply(df, ("find_c",), cols, build, out)


# ================================================================== generic pack (volume tables)
GENERIC = (
    ("email", V.G_EMAIL, "@"), ("phone", V.G_PHONE, "+1 ("), ("id16", V.G_ID16, None), ("secret", V.G_SECRET, "token"),
)
GENERIC_PRIORITY = {"email": 0, "phone": 1, "id16": 2, "secret": 3}
GENERIC_TAGS = {"email": "[EMAIL]", "phone": "[PHONE]", "id16": "[ID]", "secret": "[SECRET]"}


def with_generic_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    t = F.col(text)
    rules = [
        Rule(kind, kind, p, 0, F.contains(t, F.lit(g)) if g else t.rlike("[0-9]{16}")) for kind, p, g in GENERIC
    ]
    d, names = S.with_spans(df, text, rules)
    return _finish(d, df.columns, names, out)
