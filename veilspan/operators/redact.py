"""Redaction: spans → tagged text, counts, restoration for readers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import spans as S
from veilspan.functions.regexes import rx
from veilspan.functions.text import js_trim
from veilspan.operators import detect as D
from veilspan.session import keep_rows


def redact_a(df, text, out, employer=None, amounts=None, names=None, findings=None) -> DataFrame:
    """Add the redacted text under variant A (and, if named, the findings)."""
    f = findings or S.tmp("f")
    d = D.find_a(df, text, f, employer, amounts, names)
    d = S.apply_tags(d, text, f, out, S.tag_of(V.A_TAGS))
    return d if findings else d.drop(f)


def redact_b(df, text, out, employer=None, amounts=None, currency_words=False, findings=None) -> DataFrame:
    f = findings or S.tmp("f")
    d = D.find_b(df, text, f, employer, amounts, currency_words)
    d = S.apply_tags(d, text, f, out, S.tag_of(V.B_TAGS))
    return d if findings else d.drop(f)


def tag_c(s):
    return F.when(s["rule"] == "own_name", V.C_NAME_TAG).otherwise(S.tag_of(V.C_TAGS)(s))


def redact_c(df, text, out, employer=None, own_name=None, keep=None, findings=None) -> DataFrame:
    f = findings or S.tmp("f")
    d = D.find_c(df, text, f, employer, own_name, keep)
    d = S.apply_tags(d, text, f, out, tag_c)
    return d if findings else d.drop(f)


def redact_one_kind(text: Column, pattern: str, tag: str) -> Column:
    """Fast path for one disjoint pattern: a plain replace."""
    return F.regexp_replace(text, pattern, tag)


def clean_pieces(df: DataFrame, key: str, pieces: str, out: str, find) -> DataFrame:
    """key → the pieces (sentences, list items) in which nothing is found, in order.

    Pieces become rows so that the same detectors judge each on its own; only clean pieces are
    shuffled back together, one short list per key.
    """
    rows = df.select("*", F.posexplode_outer(F.col(pieces)).alias("_pos", "_piece")).where(F.col("_pos").isNotNull())
    f = S.tmp("f")
    clean = keep_rows(find(rows, "_piece", f), F.size(f) == 0).select(key, F.struct("_pos", "_piece").alias("_p"))
    return clean.groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias(out)).select(
        key, F.transform(out, lambda p: p["_piece"]).alias(out)
    )


def sensitive_sentences(text: Column) -> Column:
    """Sentences and lines of a text, the unit that is dropped when something is found in it."""
    return F.filter(F.transform(F.split(text, V.A_SENTENCE_SPLIT, -1), js_trim), lambda p: p != "")


def humanize(text: Column, lang: Column) -> Column:
    """Placeholders → neutral phrases for a human reader."""

    def chain(words):
        out = text
        for tag, phrase in words.items():
            out = F.replace(out, F.lit(tag), F.lit(phrase))
        return out

    out = F.when(lang == "en", chain(V.HUMAN_WORDS["en"])).otherwise(chain(V.HUMAN_WORDS["es"]))
    return F.regexp_replace(out, r"[ \t]{2,}", " ")


def apply_signature(letter: Column, name: Column, token: str = "[[FIRMA]]") -> Column:
    """Put the name where the signature token is, else at the end."""
    who = F.when(js_trim(name) == "", "[Tu nombre]").otherwise(js_trim(name))
    return F.when(F.contains(letter, F.lit(token)), F.replace(letter, F.lit(token), who)).otherwise(
        F.concat(F.regexp_replace(letter, rx(r"\s+$"), ""), F.lit("\n\n"), who)
    )


def finalize_letter(raw: Column, name: Column) -> Column:
    """Strip thinking blocks, fences and markdown, restore the name."""
    t = F.regexp_replace(raw, r"(?s)<\|channel\>thought.*?<channel\|>", "")
    t = F.regexp_replace(t, r"(?s)</?(?:think|thinking)>.*?</(?:think|thinking)>", "")
    t = F.regexp_replace(t, r"```[a-z]*\n?|```", "")
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "$1")
    t = F.regexp_replace(t, rx(r"^#+\s*", "m"), "")
    who = F.coalesce(name, F.lit(""))
    t = F.replace(t, F.lit(V.C_NAME_TAG), who)
    # the placeholder with inner blanks or other case
    t = F.array_join(F.split(t, rx(r"\{\{\s*NOMBRE\s*\}\}", "i"), -1), "\ufdd0")
    return js_trim(F.replace(t, F.lit("\ufdd0"), who))


# ------------------------------------------------------------------ span tables
def span_table(df: DataFrame, key: str, spans: Column) -> DataFrame:
    """Long table key, ord, start, end, kind, rule, raw; only spans travel on, never texts."""
    d = df.select(key, F.posexplode_outer(spans).alias("ord", "s")).where(F.col("ord").isNotNull())
    return d.select(key, "ord", "s.*")


def merge_islands(spans: DataFrame, key: str, priority: Column | None = None) -> DataFrame:
    """Union merge on a span table: gaps and islands with a running maximum of `end`."""
    prio = priority if priority is not None else F.lit(0)
    w = Window.partitionBy(key).orderBy("start", F.col("end").desc(), "prio", "kind", "rule")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = spans.withColumn("prio", prio).withColumn("reach", F.max("end").over(before))
    isl = flagged.withColumn(
        "island", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(upto)
    )
    return isl.groupBy(key, "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("kind", F.struct(-(F.col("end") - F.col("start")), "start", "prio", "kind")).alias("kind"),
        F.count(F.lit(1)).alias("members"),
    )


def suppress_inside(spans: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """Spans of one text that lie fully inside a cover of the same text are dropped."""
    c = covers.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    cond = (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    return spans.join(c, cond, "left_anti")
