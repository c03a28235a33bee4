"""Detection rules as a table: load, check, compile to the staged column chains, run.

A pack is a DataFrame of `SCHEMA`. `pattern` is a Java regex, or `@name` for a detector that is no single regex (amounts,
declared names, employers). `guard` joins terms by ` & `:

    digits          only texts with a digit are searched
    has X           only texts that contain X
    like R          only texts in which R is found
    stems a,b       only texts whose folded form contains one of the stems
    on folded       the pattern runs over the text without accents and case; offsets stay those of the text
    group N         the finding is group N of the match
    unless R        a match in which R is found is none
    check NAME      a match must also pass a named test (`CHECKS`)
    as NAME         a match is trimmed or refused by a named rule about people (`PEOPLE`)

Rules of one kind share one priority; a rule's tag goes before the tag of its kind. Overlaps follow the variant: A the
earliest span, B one rule after the other (in the order of priorities, each masks what it found), C the union.
A pack is small by nature: it is fetched to the driver, and refused beyond `MOST` rules.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import program
from veilspan.functions import spans as S
from veilspan.operators import detect as D

SCHEMA = "rule_id string, kind string, pattern string, priority int, tag string, guard string"
MOST = 1000
CHECKS = {"no_year_pair": D.no_year_pair}
PEOPLE = ("person_role", "person_title")
DETECTORS = {
    "A": ("@amounts", "@known_amounts", "@employer", "@names"),
    "B": ("@money", "@employer"),
    "C": ("@salary", "@employer", "@own_name"),
}


def _rows_a() -> list[tuple]:
    p, t = V.A_PRIORITY, V.A_TAGS
    own = [
        ("email", "email", V.A_EMAIL, "has @"), ("dpi", "dpi", V.A_DPI, "digits"), ("nit_labeled", "nit", V.A_NIT_LABELED, "digits & like (?i)nit"),
        ("nit_bare", "nit", V.A_NIT_BARE, "digits & has -"), ("phone", "phone", V.A_PHONE, "digits"), ("words", "money", V.A_MONEY_WORDS, "like (?iu)mil"),
        ("amounts", "money", "@amounts", None), ("known_amounts", "salary", "@known_amounts", None), ("employer", "employer", "@employer", None), ("names", "name", "@names", None),
    ]
    return [(i, k, x, p[k], t[k], g) for i, k, x, g in own]


def _rows_b(currency_words: bool = False) -> list[tuple]:
    order = ("email", "dpi", "nit", "phone", "money", "employer", "currency_word")
    own = [
        ("email", "email", V.B_EMAIL, "has @"), ("dpi", "dpi", V.B_DPI, "digits"), ("nit", "nit", V.B_NIT, "digits"), ("phone", "phone", V.B_PHONE, "digits"),
        ("money", "money", "@money", None), ("employer", "employer", "@employer", None),
    ]
    own += [("currency_word", "currency_word", V.B_CURRENCY_WORD, None)] if currency_words else []
    return [(i, k, x, order.index(k), V.B_TAGS[k], g) for i, k, x, g in own]


def _rows_c() -> list[tuple]:
    p, t = V.C_PRIORITY, V.C_TAGS
    wordy = ("address_street_named", "address_area")
    own = [
        ("email", "email", V.C_EMAIL, "has @"), ("dpi_4_5_4", "dpi", V.C_DPI, "digits"), ("nit_labeled", "nit", V.C_NIT_LABELED, "digits & like (?i)nit & group 1"),
        ("nit_shape", "nit", V.C_NIT_SHAPE, "digits & has -"), ("phone_gt", "phone", V.C_PHONE, "digits & check no_year_pair"),
        *[(r, "address", x, f"stems {','.join(D.ADDRESS_STEMS[r])}" + ("" if r in wordy else " & digits")) for r, x in V.C_ADDRESS.items()],
        ("person_role", "person_name", V.C_PERSON_ROLE, f"stems {','.join(D.ROLE_STEMS)} & as person_role"), ("person_title", "person_name", V.C_PERSON_TITLE, f"like {'|'.join(D.TITLE_STEMS)} & as person_title"),
        ("salary", "salary", "@salary", None), ("employer", "employer", "@employer", None),
    ]
    rows = [(i, k, x, p[k], t[k], g) for i, k, x, g in own]
    return [*rows, ("own_name", "person_name", "@own_name", p["person_name"], V.C_NAME_TAG, None)]


def builtin(spark: SparkSession, variant: str, **options) -> DataFrame:
    """The built-in rules of variant A, B (`currency_words`: also bare currency words) or C as a table."""
    return spark.createDataFrame({"A": _rows_a, "B": _rows_b, "C": _rows_c}[variant](**options), SCHEMA)


# ------------------------------------------------------------------ checking
class PackError(ValueError):
    """What is wrong with a pack, one line for each fault."""


def _terms(guard: str | None) -> list[tuple[str, str]]:
    parts = [p.strip() for p in (guard or "").split(" & ") if p.strip()]
    return [(p, "") if p in ("digits", "on folded") else tuple((p.split(" ", 1) + [""])[:2]) for p in parts]


def faults(spark: SparkSession, rows: list, variant: str) -> list[str]:
    """What is wrong with each rule: unknown terms, broken or empty patterns, groups that do not exist, tags and priorities."""
    java, out, seen, of_kind = spark._jvm.java.util.regex.Pattern, [], set(), {}

    def compiled(pattern):
        try:
            return java.compile(pattern), None
        except Exception as e:  # the pattern's own message
            return None, str(getattr(e, "java_exception", e)).split("\n")[0]

    for r in rows:
        bad = []
        if not r["rule_id"] or r["rule_id"] in seen:
            bad.append("rule_id is empty or used twice")
        seen.add(r["rule_id"])
        if not r["kind"] or "'" in (r["kind"] or "") or "'" in (r["rule_id"] or ""):
            bad.append("kind is empty, or kind or rule_id holds a quote")
        if not r["tag"]:
            bad.append("tag is empty")
        if r["priority"] is None or of_kind.setdefault(r["kind"], r["priority"]) != r["priority"]:
            bad.append("priority is missing or differs within the kind")
        x, groups = r["pattern"] or "", 0
        if x.startswith("@"):
            if x not in DETECTORS[variant]:
                bad.append(f"no detector {x} in variant {variant}")
        else:
            p, message = compiled(x)
            if not x or message:
                bad.append(f"pattern: {message or 'empty'}")
            else:
                groups = p.matcher("").groupCount()
                if p.matcher("").find():
                    bad.append("pattern matches the empty text")
            if any(c in x for c in "﷐﷑﷒"):
                bad.append("pattern holds a reserved character")
        for name, arg in _terms(r["guard"]):
            if x.startswith("@"):
                bad.append("a detector takes no guard")
            elif name in ("like", "unless") and (not arg or compiled(arg)[1]):
                bad.append(f"{name}: {compiled(arg)[1] or 'empty'}")
            elif name == "group" and not (arg.isdigit() and 1 <= int(arg) <= groups):
                bad.append(f"group {arg} is not in the pattern")
            elif name in ("has", "stems") and not arg:
                bad.append(f"{name} needs a text")
            elif name == "check" and arg not in CHECKS:
                bad.append(f"no check {arg}")
            elif name == "as" and (arg not in PEOPLE or groups < 1):
                bad.append(f"no rule about people {arg}, or no group for it")
            elif name not in ("digits", "on folded", "has", "like", "stems", "group", "unless", "check", "as"):
                bad.append(f"unknown term {name}")
        out += [f"{r['rule_id']}: {b}" for b in bad]
    return out


# ------------------------------------------------------------------ compiling
@dataclass(frozen=True)
class Pack:
    """Checked rules, ordered by priority and identifier."""

    variant: str
    rows: tuple

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.variant, self.rows)).encode()).hexdigest()

    @property
    def detectors(self) -> set[str]:
        return {x for _, _, x, *_ in self.rows if x.startswith("@")}

    @property
    def priority(self) -> dict[str, int]:
        return {kind: priority for _, kind, _, priority, _, _ in self.rows}

    def rules(self, text: str, folded: str) -> list[S.Rule]:
        return [rule_of(r, text, folded) for r in self.rows if not r[2].startswith("@")]

    def tag(self, s: Column) -> Column:
        kinds: dict[str, str] = {}
        for _, kind, _, _, tag, _ in self.rows:
            kinds.setdefault(kind, tag)
        out = S.tag_of(kinds)(s)
        for rule, kind, _, _, tag, _ in self.rows:
            if tag != kinds[kind]:
                out = F.when(s["rule"] == rule, tag).otherwise(out)
        return out


def load(rules: DataFrame, variant: str) -> Pack:
    """Fetch, check and order a pack; `PackError` names every fault."""
    rows = rules.select("rule_id", "kind", "pattern", F.col("priority").cast("int").alias("priority"), "tag", "guard").limit(MOST + 1).collect()
    wrong = faults(rules.sparkSession, rows, variant) if len(rows) <= MOST else [f"more than {MOST} rules"]
    if wrong:
        raise PackError("\n".join(wrong))
    return Pack(variant, tuple(sorted((tuple(r) for r in rows), key=lambda r: (r[3], r[0]))))


def rule_of(row: tuple, text: str, folded: str) -> S.Rule:
    """One regex rule over the columns `text` and `folded`."""
    rule_id, kind, pattern, _, _, guard = row
    t, when, keep, make, groups, over = F.col(text), [], [], None, 0, None
    for name, arg in _terms(guard):
        if name == "digits":
            when.append(t.rlike(r"\d"))
        elif name == "has":
            when.append(F.contains(t, F.lit(arg)))
        elif name == "like":
            when.append(t.rlike(arg))
        elif name == "stems":
            when.append(D.any_of(F.col(folded), arg.split(",")))
        elif name == "on folded":
            over = folded
            make = _original(text, kind, rule_id)
        elif name == "group":
            groups, make = int(arg), _group(int(arg), kind, rule_id)
        elif name == "unless":
            keep.append(_unless(arg))
        elif name == "check":
            keep.append(CHECKS[arg])
        elif name == "as":
            person = next(r for r in D.people_rules(text, folded) if r.rule == arg)
            groups, make = person.groups, person.make
            keep.append(person.keep)
    cond = when[0] if when else None
    for w in when[1:]:
        cond = cond & w

    def kept(s):
        out = keep[0](s)
        for k in keep[1:]:
            out = out & k(s)
        return out

    return S.Rule(kind, rule_id, pattern, groups, cond, kept if keep else None, make, over)


def _original(text: str, kind: str, rule_id: str):
    return lambda m: S.span(m["start"], m["end"], kind, rule_id, F.substring(F.col(text), m["start"] + 1, m["end"] - m["start"]))


def _group(n: int, kind: str, rule_id: str):
    def make(m):
        g = F.get(m["g"], F.lit(n - 1))
        at = m["start"] + F.instr(m["raw"], g) - 1
        return S.span(at, at + F.length(g), kind, rule_id, g)

    return make


def _unless(pattern: str):
    return lambda s: ~s["raw"].rlike(pattern)


# ------------------------------------------------------------------ running
def find(df: DataFrame, text: str, out: str, pack: Pack, employer=None, amounts=None, names=None, own_name=None, keep=None) -> DataFrame:
    """Spans of `text` under a pack. Columns with declared values serve the detectors that the pack switches on."""
    on = pack.detectors
    cols = {
        "__text": text, "__employer": employer if "@employer" in on else None,
        "__amounts": amounts if {"@known_amounts", "@money"} & on else None, "__names": names if "@names" in on else None,
        "__own": own_name if "@own_name" in on else None, "__keep": keep if pack.variant == "C" else None,
    }
    has = {k: k if v else None for k, v in cols.items()}

    def build(d, o):
        c = S.tmp("cand")
        if pack.variant == "A":
            d = D.with_candidates_a(d, "__text", c, has["__employer"], has["__amounts"], has["__names"], pack.rules, "@amounts" in on)
            return S.first_wins(d, c, o, pack.priority)
        if pack.variant == "B":
            return D.chain_b(d, "__text", o, has["__employer"], has["__amounts"], *_stages(pack))
        d = D.with_candidates_c(d, "__text", c, has["__employer"], has["__own"], has["__keep"], pack.rules, "@salary" in on)
        return S.union_merge(d, c, o, pack.priority, "__text")

    return program.apply(df, ("rulepack", pack.key), cols, build, out)


def _stages(pack: Pack) -> tuple[list, bool, list]:
    """Regex rules before the detectors of variant B, whether amounts are looked for, and the rules behind."""
    at = min((r[3] for r in pack.rows if r[2].startswith("@")), default=1 << 30)

    def of(rows):
        return [lambda text, folded, r=r: rule_of(r, text, folded) for r in rows if not r[2].startswith("@")]

    return of(r for r in pack.rows if r[3] < at), "@money" in pack.detectors, of(r for r in pack.rows if r[3] >= at)


def redact(df: DataFrame, text: str, out: str, pack: Pack, findings: str | None = None, **declared) -> DataFrame:
    """Add the text with every finding replaced by its tag (and, if named, the findings)."""
    f = findings or S.tmp("f")
    d = S.apply_tags(find(df, text, f, pack, **declared), text, f, out, pack.tag)
    return d if findings else d.drop(f)
