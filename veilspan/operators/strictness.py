"""Strict acceptance of JSON bodies against a schema tree: the first thing wrong and where.

A tree of `Text`, `Number`, `OneOf`, `Items` and `Record` nodes compiles to one column expression over the parsed
variant: no Python per row, each body parsed once. Order: a record's unknown keys (by name), then its fields as
declared, each missing, of another type, or wrong inside; list items by position. Reasons: invalid_json, unknown_key,
missing, type, too_short, too_long, too_many, not_whole, value, not_listed. NULL is of no type, so an optional field may
be left out but not be null. A NULL body, broken JSON and JSON with a repeated key are invalid_json. Lengths are code points.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.text import js_trim
from veilspan.session import let

FAULT = "struct<reason:string,path:string>"


@dataclass(frozen=True)
class Text:
    least: int = 0
    most: int | None = None
    trim: bool = False


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    above: float | None = None
    whole: bool = False


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Items:
    of: object
    most: int | None = None


@dataclass(frozen=True)
class Record:
    fields: dict = field(default_factory=dict)
    optional: frozenset = frozenset()
    more: bool = False  # unknown keys are let through


def _fault(reason: str, path: Column) -> Column:
    return F.struct(F.lit(reason).alias("reason"), path.alias("path"))


def _first(pairs: list[tuple[Column, str]], path: Column) -> Column:
    out = F.when(pairs[0][0], _fault(pairs[0][1], path))
    for cond, reason in pairs[1:]:
        out = out.when(cond, _fault(reason, path))
    return out


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^(?:{'|'.join(kinds)})"), F.lit(False))


def _text(v: Column, node: Text, path: Column) -> Column:
    def body(s):
        n = F.length(js_trim(s) if node.trim else s)
        pairs = [(n < node.least, "too_short")] if node.least else []
        pairs += [(n > node.most, "too_long")] if node.most is not None else []
        return _first(pairs, path) if pairs else F.lit(None).cast(FAULT)

    return F.when(~_is(v, "STRING"), _fault("type", path)).otherwise(let(F.try_variant_get(v, "$", "string"), body))


def _number(v: Column, node: Number, path: Column) -> Column:
    def body(x):
        pairs = [(x != F.floor(x), "not_whole")] if node.whole else []
        low, high = node.least is not None, node.most is not None
        pairs += [(x < node.least, "value")] if low else []
        pairs += [(x <= node.above, "value")] if node.above is not None else []
        pairs += [(x > node.most, "value")] if high else []
        return _first(pairs, path) if pairs else F.lit(None).cast(FAULT)

    return F.when(~_is(v, "BIGINT", "DECIMAL", "DOUBLE"), _fault("type", path)).otherwise(let(F.try_variant_get(v, "$", "double"), body))


def _items(v: Column, node: Items, path: Column) -> Column:
    def body(items):
        inside = F.transform(items, lambda x, i: fault(x, node.of, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        first = F.get(F.filter(inside, lambda p: p.isNotNull()), F.lit(0))
        return first if node.most is None else F.when(F.size(items) > node.most, _fault("too_many", path)).otherwise(first)

    return F.when(~_is(v, "ARRAY"), _fault("type", path)).otherwise(let(F.try_variant_get(v, "$", "array<variant>"), body))


def _record(v: Column, node: Record, path: Column) -> Column:
    def body(m):
        found = []
        if not node.more:
            known = F.array(*[F.lit(k) for k in node.fields]) if node.fields else F.array().cast("array<string>")
            other = F.array_min(F.array_except(F.map_keys(m), known))
            found.append(F.when(other.isNotNull(), _fault("unknown_key", F.concat(path, F.lit("."), other))))
        for name, child in node.fields.items():
            at = F.concat(path, F.lit(f".{name}"))
            inside = F.when(F.map_contains_key(m, name), let(F.try_element_at(m, F.lit(name)), _checker(child, at)))
            found.append(inside if name in node.optional else F.when(~F.map_contains_key(m, name), _fault("missing", at)).otherwise(inside))
        return F.coalesce(*found) if found else F.lit(None).cast(FAULT)

    return F.when(~_is(v, "OBJECT"), _fault("type", path)).otherwise(let(F.try_variant_get(v, "$", "map<string,variant>"), body))


def _checker(node, path: Column):
    return lambda v: fault(v, node, path)


def fault(v: Column, node, path: Column) -> Column:
    """(reason, path) of the first fault of a variant, NULL if there is none."""
    if isinstance(node, Record):
        return _record(v, node, path)
    if isinstance(node, Items):
        return _items(v, node, path)
    if isinstance(node, Text):
        return _text(v, node, path)
    if isinstance(node, Number):
        return _number(v, node, path)
    text = F.try_variant_get(v, "$", "string")
    return F.when(~_is(v, "STRING"), _fault("type", path)).when(~text.isin(*node.values), _fault("not_listed", path))


def refusal(body: Column, node) -> Column:
    """Why a JSON body is refused: (reason, path), NULL if it is accepted."""
    root = F.lit("$")
    return let(F.try_parse_json(body), lambda v: F.when(v.isNull(), _fault("invalid_json", root)).otherwise(fault(v, node, root)))


# ------------------------------------------------------------------ fixed values: fields, bounds and lists of the bodies
SHORT = Text(1, 120, trim=True)
CURRENCIES = OneOf(("GTQ", "USD"))
MONEY = Record({"amount": Number(above=0, most=10_000_000), "currency": CURRENCIES})
YEARS = Number(least=0, most=60, whole=True)
PROFILE = Record(
    {
        "fullName": Text(1, 80, trim=True), "email": Text(0, 120), "phone": Text(0, 40), "currentRole": SHORT, "currentEmployer": SHORT,
        "currentSalary": MONEY, "desiredRole": SHORT, "desiredSalary": MONEY, "targetCompany": SHORT, "yearsExperience": YEARS,
        "achievements": Text(0, 3000), "jobOffer": Text(0, 12000),
    },
    frozenset({"email", "phone", "jobOffer"}),
)
THIRD_PARTY_LETTER = Record({
    "fullName": Text(1, 80, trim=True), "desiredRole": SHORT, "targetCompany": SHORT, "yearsExperience": YEARS, "achievements": Text(0, 3000),
    "requirements": Items(Text(0, 240), 15), "language": OneOf(("es", "en")), "seniority": OneOf(("junior", "semi-senior", "senior", "lead")),
})
REQUIREMENTS = Record({"must": Items(Text(1, 200), 12), "nice": Items(Text(1, 200), 12), "keywords": Items(Text(1, 60), 15)}, more=True)
COMPANY_REQUEST = Record({"company": SHORT, "role": SHORT})
SALARY_REQUEST = Record({
    "jobTitle": SHORT, "location": SHORT,
    "yearsBucket": OneOf(("LESS_THAN_ONE", "ONE_TO_THREE", "FOUR_TO_SIX", "SEVEN_TO_NINE", "TEN_TO_FOURTEEN", "ABOVE_FIFTEEN")),
})
LETTER_REQUEST = Record({
    "desiredRole": SHORT, "targetCompany": SHORT, "yearsExperience": YEARS, "achievements": Text(0, 2100), "jobOffer": Text(0, 4100),
    "companyFacts": Items(Record({"id": Number(least=1, most=10, whole=True), "title": Text(0, 300), "snippet": Text(0, 400)}), 3),
})
