"""Spans inside one text as array columns: find, suppress, resolve overlaps, apply.

A span is struct<start:int,end:int,kind:string,rule:string,raw:string>; offsets are code points,
end exclusive. Everything here is a chain of narrow projections: texts never move and no Python
runs per row. Work is staged column by column (`select` after `select`), because an expression
that sits inside a lambda is evaluated once per array element; a staged array is only ever handed
to a higher-order function as its argument.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:string,rule:string,raw:string>"
SPANS = f"array<{SPAN}>"
HIT = "struct<start:int,end:int,raw:string,g:array<string>>"

# Unicode non-characters used as separators while matches are cut out of a text.
_OPEN, _GROUP, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"
# `aggregate` copies its accumulator at every step, so lists are only ever grown within a block.
_BLOCK = 64
_ids = itertools.count()


def tmp(label: str) -> str:
    """A fresh helper column name."""
    return f"__{label}{next(_ids)}"


def plain(text: Column) -> Column:
    """Text without the separator code points (same length)."""
    marks = _OPEN + _GROUP + _CLOSE
    return F.when(text.rlike(f"[{_OPEN}-{_CLOSE}]"), F.translate(text, marks, "\ufffd" * 3)).otherwise(text)


def empty(ddl: str = SPANS) -> Column:
    return F.array().cast(ddl)


def span(start, end, kind, rule, raw) -> Column:
    """A span struct; `kind` and `rule` may be plain strings."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    r = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(start.alias("start"), end.alias("end"), k.alias("kind"), r.alias("rule"), raw.alias("raw"))


# ------------------------------------------------------------------ finding
@dataclass
class Rule:
    """One pattern over one text column.

    `guard` is a cheap test that spares the regex on most texts; `make` turns a hit into a span (or
    any struct), default: the whole match under (kind, rule); `keep` filters what was made.
    """

    kind: str
    rule: str
    pattern: str | Column
    groups: int = 0
    guard: Column | None = None
    keep: Callable[[Column], Column] | None = None
    make: Callable[[Column], Column] | None = None
    text: str | None = None


def _cut_sql(pieces: str, groups: int) -> str:
    """Each piece "match⟂group1⟂…⟂⟂rest" → its match, groups and widths."""
    head = f"substring_index(p, '{_CLOSE}', 1)"
    raw = f"substring_index({head}, '{_GROUP}', 1)"
    g = f"slice(split({head}, '{_GROUP}', -1), 2, {groups})" if groups else "cast(array() AS array<string>)"
    return (
        f"CASE WHEN size({pieces}) > 1 THEN transform(slice({pieces}, 2, size({pieces})), p -> named_struct("
        f"'raw', {raw}, 'g', {g}, 'size', length({raw}), 'width', length({raw}) + length(p) - length({head}) - 1)) END"
    )


def _blocks_sql(arr: str) -> str:
    last = f"cast(floor((greatest(size({arr}), 1) - 1) / {_BLOCK}) AS int)"
    return (
        f"CASE WHEN {arr} IS NOT NULL THEN transform(sequence(0, {last}), "
        f"i -> slice({arr}, i * {_BLOCK} + 1, {_BLOCK})) END"
    )


def _starts_sql(blocks: str, base: str) -> str:
    """Start offset of every match: sums per block first, then within each block."""
    zero = "named_struct('pos', {0}, 'out', cast(array() AS array<int>))"
    grow = "named_struct('pos', a.pos + {0}, 'out', concat(a.out, array(a.pos)))"
    totals = f"transform({blocks}, b -> aggregate(b, 0, (a, c) -> a + c.width))"
    entry = f"aggregate({totals}, {zero.format(base)}, (a, w) -> {grow.format('w')}, a -> a.out)"
    within = f"aggregate(b, {zero.format('pos')}, (a, c) -> {grow.format('c.width')}, a -> a.out)"
    return f"flatten(zip_with({blocks}, {entry}, (b, pos) -> {within}))"


def _hits_sql(cuts: str, starts: str) -> str:
    return (
        f"zip_with({cuts}, {starts}, (c, s) -> "
        "named_struct('start', s, 'end', s + c.size, 'raw', c.raw, 'g', c.g))"
    )


def _span_sql(cuts: str, starts: str, kind: str, rule: str) -> str:
    return (
        f"zip_with({cuts}, {starts}, (c, s) -> named_struct('start', s, 'end', s + c.size, "
        f"'kind', '{kind}', 'rule', '{rule}', 'raw', c.raw))"
    )


def with_spans(df: DataFrame, text: str, rules: list[Rule], names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Add one array column per rule; returns the frame and the column names.

    Each rule costs one regex pass (matches are marked in place and cut out with a split). The
    array mechanics shared by all rules are SQL text: one call each while the plan is built.
    """
    keep = df.columns
    ids = [tmp("r") for _ in rules]
    names = names or [f"{i}x" for i in ids]

    def pieces(r: Rule) -> Column:
        repl = _OPEN + "$0" + "".join(f"{_GROUP}${i}" for i in range(1, r.groups + 1)) + _CLOSE
        p = F.lit(r.pattern) if isinstance(r.pattern, str) else r.pattern
        cut = F.split(F.regexp_replace(F.col(r.text or text), p, F.lit(repl)), _OPEN, -1)
        return cut if r.guard is None else F.when(r.guard, cut)

    def add(suffix: str, sql) -> list[Column]:
        return [F.expr(sql(i, r)).alias(i + suffix) for i, r in zip(ids, rules)]

    d = df.select("*", *[pieces(r).alias(i + "p") for i, r in zip(ids, rules)])
    d = d.select(
        *keep,
        *add("b", lambda i, r: f"length(get({i}p, 0))"),
        *add("c", lambda i, r: _cut_sql(f"{i}p", r.groups)),
    )
    d = d.select(*keep, *[i + "b" for i in ids], *[i + "c" for i in ids], *add("k", lambda i, r: _blocks_sql(f"{i}c")))
    def shaped(i: str, r: Rule) -> Column:
        if r.make is None:
            made = F.expr(_span_sql(f"{i}c", _starts_sql(f"{i}k", f"{i}b"), r.kind, r.rule))
        else:
            made = F.transform(F.expr(_hits_sql(f"{i}c", _starts_sql(f"{i}k", f"{i}b"))), r.make)
        return F.filter(made, r.keep) if r.keep is not None else made

    d = d.select(*keep, *[shaped(i, r).alias(n) for i, r, n in zip(ids, rules, names)])
    return d, names


def gather(df: DataFrame, names: list[str], out: str) -> DataFrame:
    """Concatenate span columns (missing ones count as empty) into `out`."""
    rest = [c for c in df.columns if c not in names]
    return df.select(
        *rest, F.concat(*[F.coalesce(F.col(n), empty()) for n in names]).alias(out)
    )


def mask(text: Column, pattern: str | Column, filler: str = "░") -> Column:
    """Same-length masking of every match, one regex pass."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    cut = F.split(F.regexp_replace(text, p, F.lit(_OPEN + "$0" + _CLOSE)), _OPEN, -1)

    def cover(x, i):
        return F.when(i == 0, x).otherwise(
            F.concat(
                F.repeat(F.lit(filler), F.length(F.substring_index(x, _CLOSE, 1))), F.substring_index(x, _CLOSE, -1)
            )
        )

    return F.array_join(F.transform(cut, cover), "")


# ------------------------------------------------------------------ overlap policies
def drop_inside(spans: Column, covers: Column) -> Column:
    """Remove spans lying fully inside one of `covers` (both staged columns)."""
    return F.filter(
        spans,
        lambda f: ~F.exists(covers, lambda k: (f["start"] >= k["start"]) & (f["end"] <= k["end"])),
    )


def ranked(spans: Column, priority: dict[str, int]) -> Column:
    """Sort by start, longer first, then kind priority (natural struct order, no comparator)."""
    table = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            (-(s["end"] - s["start"])).alias("neg_len"),
            F.coalesce(F.try_element_at(table, s["kind"]), F.lit(99)).alias("prio"),
            s.alias("s"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def _scan_entry(blocks: Column, zero: Column, step) -> Column:
    """State on entering every block, and the final state."""

    def over(acc, block):
        return F.struct(
            F.aggregate(block, acc["s"], lambda s, x: step(s, x)[0]).alias("s"),
            F.concat(acc["seen"], F.array(acc["s"])).alias("seen"),
        )

    return F.aggregate(blocks, F.struct(zero.alias("s"), F.slice(F.array(zero), 1, 0).alias("seen")), over)


def _scan_emit(blocks: Column, seen: Column, step) -> Column:
    def within(block, s):
        def merge(acc, x):
            new, emitted = step(acc["s"], x)
            return F.struct(new.alias("s"), F.concat(acc["out"], emitted).alias("out"))

        return F.aggregate(
            block, F.struct(s.alias("s"), empty().alias("out")), merge, lambda acc: acc["out"]
        )

    return F.flatten(F.zip_with(blocks, seen, within))


def _with_scan(df: DataFrame, spans: str, out: str, priority, zero, step, close) -> DataFrame:
    keep = [c for c in df.columns if c != spans]
    r, b, e = tmp("rank"), tmp("blk"), tmp("entry")
    d = df.select("*", ranked(F.col(spans), priority).alias(r))
    d = d.select(*keep, spans, F.expr(_blocks_sql(r)).alias(b))
    d = d.select(*keep, spans, b, F.when(F.size(spans) > 1, _scan_entry(F.col(b), zero, step)).alias(e))
    done = close(_scan_emit(F.col(b), F.col(e)["seen"], step), F.col(e)["s"])
    return d.select(*keep, F.when(F.col(e).isNull(), F.col(spans)).otherwise(done).alias(out))


def first_wins(df: DataFrame, spans: str, out: str, priority: dict[str, int]) -> DataFrame:
    """Earliest start, then longest, then priority; a span overlapping a kept one is dropped."""

    def step(last_end, s):
        free = s["start"] >= last_end
        return F.when(free, s["end"]).otherwise(last_end), F.when(free, F.array(s)).otherwise(empty())

    return _with_scan(df, spans, out, priority, F.lit(0), step, lambda emitted, _: emitted)


def union_merge(df: DataFrame, spans: str, out: str, priority: dict[str, int], text: str) -> DataFrame:
    """Overlapping spans merge into their union; the longest member names it, ties by order."""
    fields = (("start", "int"), ("end", "int"), ("longest", "int"), ("kind", "string"), ("rule", "string"))

    def fresh(s):
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            (s["end"] - s["start"]).alias("longest"),
            s["kind"].alias("kind"),
            s["rule"].alias("rule"),
        )

    def closed(isl):
        return span(isl["start"], isl["end"], isl["kind"], isl["rule"], F.lit(None).cast("string"))

    def step(isl, s):
        overlaps = isl["end"].isNotNull() & (s["start"] < isl["end"])
        longer = (s["end"] - s["start"]) > isl["longest"]
        grown = F.struct(
            isl["start"].alias("start"),
            F.greatest(isl["end"], s["end"]).alias("end"),
            F.greatest(isl["longest"], s["end"] - s["start"]).alias("longest"),
            F.when(longer, s["kind"]).otherwise(isl["kind"]).alias("kind"),
            F.when(longer, s["rule"]).otherwise(isl["rule"]).alias("rule"),
        )
        return (
            F.when(overlaps, grown).otherwise(fresh(s)),
            F.when(overlaps | isl["end"].isNull(), empty()).otherwise(F.array(closed(isl))),
        )

    blank = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    mid = tmp("isl")
    d = _with_scan(
        df, spans, mid, priority, blank, step, lambda emitted, last: F.concat(emitted, F.array(closed(last)))
    )
    keep = [c for c in d.columns if c != mid]
    t = F.col(text)
    return d.select(
        *keep,
        F.transform(
            F.col(mid),
            lambda s: span(
                s["start"], s["end"], s["kind"], s["rule"], F.substring(t, s["start"] + 1, s["end"] - s["start"])
            ),
        ).alias(out),
    )


# ------------------------------------------------------------------ applying
def apply_tags(df: DataFrame, text: str, spans: str, out: str, tag) -> DataFrame:
    """Rebuild a text with sorted, disjoint spans replaced by `tag(span)`.

    Works chunk by chunk: each chunk of spans first cuts its own stretch of text, so the cost of
    addressing characters does not grow with (spans × whole text).
    """
    size = 256
    keep = df.columns
    e, c = tmp("ends"), tmp("chunks")
    t, sp = F.col(text), F.col(spans)
    d = df.select("*", F.transform(sp, lambda s: s["end"]).alias(e))
    ends = F.col(e)

    def chunk(i):
        base = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i * size - 1))
        last = F.get(ends, F.least((i + 1) * size, F.size(ends)) - 1)
        return F.struct(
            base.alias("base"),
            F.substring(t, base + 1, last - base).alias("piece"),
            F.slice(sp, i * size + 1, size).alias("mine"),
        )

    n = F.floor((F.size(ends) - 1) / size).cast("int")
    d = d.select(
        *keep, e, F.when(F.size(ends) > 0, F.transform(F.sequence(F.lit(0), n), chunk)).alias(c)
    )

    def fill(ch):
        def one(s, i):
            prev = F.when(i == 0, ch["base"]).otherwise(F.get(ch["mine"], i - 1)["end"])
            return F.concat(F.substring(ch["piece"], prev - ch["base"] + 1, s["start"] - prev), tag(s))

        return F.array_join(F.transform(ch["mine"], one), "")

    tail = F.substring(t, F.get(ends, F.size(ends) - 1) + 1, F.length(t))
    rebuilt = F.concat(F.array_join(F.transform(F.col(c), fill), ""), tail)
    return d.select(*keep, F.when(F.col(c).isNull(), t).otherwise(rebuilt).alias(out))


def tag_of(tags: dict[str, str]):
    """Tag per span kind."""

    def pick(s):
        out = F.lit("")
        for kind, tag in tags.items():
            out = F.when(s["kind"] == kind, tag).otherwise(out)
        return out

    return pick


def preview(raw: Column) -> Column:
    """First character and up to six bullets; nothing of a very short value."""
    t = F.trim(raw)
    return F.when(F.length(t) <= 2, F.lit("••")).otherwise(
        F.concat(F.substring(t, 1, 1), F.repeat(F.lit("•"), F.least(F.lit(6), F.length(t) - 1)))
    )
