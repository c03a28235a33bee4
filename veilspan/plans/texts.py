"""Queries over free text: detection, overlap, redaction, text measures."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import spans as S
from veilspan.functions.text import clip, squeeze, token_count, word_count
from veilspan.operators import compensation as C
from veilspan.operators import detect as D
from veilspan.operators import quality as Q
from veilspan.operators import redact as R
from veilspan.plans.registry import query
from veilspan.session import inline_rows, keep_rows, spread, table

EMAIL = V.G_EMAIL
SQL_EMAIL = EMAIL.replace("'", "''")


def docs(spark, sf, *cols):
    return spread(table(spark, sf, "documents").select(*(cols or ("doc_id", "text", "lang", "source"))))


def _span_sql(rel: str, key: str, pattern: str) -> str:
    """Offsets of all matches in SQL: lengths of the pieces between and of the matches before."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT {key}, m[i] AS raw, i,
        CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) +
             coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s0
      FROM (SELECT {key}, s, m, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT {key}, string_split_regex(text, '{p}') AS s, regexp_extract_all(text, '{p}') AS m FROM {rel}) WHERE len(m) > 0)
    """


@query("email_spans", f"""
SELECT doc_id, s0 AS start, s0 + length(raw) AS "end", raw FROM ({_span_sql('documents', 'doc_id', EMAIL)})
""")
def email_spans(spark, sf):
    d = docs(spark, sf, "doc_id", "text")
    t = F.col("text")
    d, (s,) = S.with_spans(d, "text", [S.Rule("email", "email", EMAIL, 0, F.contains(t, F.lit("@")))])
    return R.span_table(d, "doc_id", F.col(s)).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "raw"
    )


@query("email_redact_by_lang", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(regexp_extract_all(text, '{SQL_EMAIL}'))) AS BIGINT) AS emails,
  CAST(sum(length(regexp_replace(text, '{SQL_EMAIL}', '[EMAIL]', 'g'))) AS BIGINT) AS chars_after
FROM documents GROUP BY lang
""")
def email_redact_by_lang(spark, sf):
    d = docs(spark, sf, "text", "lang")
    has = F.contains(F.col("text"), F.lit("@"))
    red = F.when(has, R.redact_one_kind(F.col("text"), EMAIL, "[EMAIL]")).otherwise(F.col("text"))
    n = F.when(has, F.regexp_count("text", F.lit(EMAIL))).otherwise(0)
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n).cast("bigint").alias("emails"),
        F.sum(F.length(red)).cast("bigint").alias("chars_after"),
    )


# a run of digits never shares its border once every other character is doubled
_DOUBLED = "regexp_replace(text, '([^0-9])', '\\1\\1', 'g')"
def generic_sql(key: str, rel: str) -> str:
    patterns = ", ".join(
        f"len(regexp_extract_all({t}, '{p}'))"
        for t, p in (
            ("text", SQL_EMAIL), ("text", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"), (_DOUBLED, "(^|[^0-9])[0-9]{16}([^0-9]|$)"),
            ("text", 'token = "[^"\\n]+"'),
        )
    )
    return f"""
SELECT {key}, kind, CAST(sum(n) AS BIGINT) AS spans, CAST(count_if(n > 0) AS BIGINT) AS texts FROM (
  SELECT {key}, unnest(['email', 'phone', 'id16', 'secret']) AS kind, unnest([{patterns}]) AS n FROM {rel})
GROUP BY {key}, kind HAVING sum(n) > 0
"""


def _generic_counts(d: DataFrame, *keys):
    d = D.with_generic_spans(d, "text", "s")
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.size(_of_kind("s", k)).alias("n")) for k in D.GENERIC_PRIORITY]))
    r = d.select(*keys, per.alias("x")).where("x.n > 0")
    return r.groupBy(*keys, F.col("x.kind").alias("kind")).agg(
        F.sum("x.n").cast("bigint").alias("spans"), F.count(F.lit(1)).alias("texts"))


def _of_kind(col, kind):
    return F.filter(col, lambda x: x["kind"] == kind)


@query("id16_phone_secret_spans", generic_sql("lang", "documents"))
def id16_phone_secret_spans(spark, sf):
    return _generic_counts(docs(spark, sf, "text", "lang"), "lang")


@query("redaction_counts", generic_sql("source", "documents"))
def redaction_counts(spark, sf):
    return _generic_counts(docs(spark, sf, "text", "source"), "source")


@query("conversation_sensitive_counts", generic_sql("role", "conversations"))
def conversation_sensitive_counts(spark, sf):
    return _generic_counts(spread(table(spark, sf, "conversations").select("text", "role")), "role")


@query("masked_preview", f"""
SELECT doc_id, CASE WHEN length(trim(raw)) <= 2 THEN '••' ELSE substr(trim(raw), 1, 1) || repeat('•', least(6, length(trim(raw)) - 1)) END AS preview
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{SQL_EMAIL}')) AS raw FROM documents)
""")
def masked_preview(spark, sf):
    d = docs(spark, sf, "doc_id", "text").where(F.contains("text", F.lit("@")))
    return d.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("raw")).where("raw IS NOT NULL").select(
        "doc_id", S.preview(F.col("raw")).alias("preview"))


# ------------------------------------------------------------------ overlapping spans
P1, P2, P3 = r"[A-Za-z]+tion [A-Za-z]+", r"[A-Za-z]+ [A-Za-z]*the[A-Za-z]*", r"[A-Z][a-z]+ [a-z]+ [a-z]+"
_TWO = f"""
 SELECT doc_id, s0 AS s, s0 + length(raw) AS e, 'a' AS kind FROM ({_span_sql('documents', 'doc_id', P1)})
 UNION ALL SELECT doc_id, s0, s0 + length(raw), 'b' FROM ({_span_sql('documents', 'doc_id', P2)})
"""
_PRIO = {"a": 0, "b": 1}


def _two(spark, sf, third=False):
    rules = [S.Rule("a", "a", P1), S.Rule("b", "b", P2)] + ([S.Rule("keep", "keep", P3)] if third else [])
    d, names = S.with_spans(docs(spark, sf, "doc_id", "text"), "text", rules)
    return d.select("doc_id", "text", F.concat(*[F.coalesce(F.col(n), S.empty()) for n in names[:2]]).alias("both"),
                    *([F.coalesce(F.col(names[2]), S.empty()).alias("cov")] if third else []))


_MERGE_SQL = f"""
WITH sp AS ({_TWO}),
f AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
i AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC, kind ROWS UNBOUNDED PRECEDING) AS isl FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY e - s DESC, s, kind) AS rn FROM i)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", max(CASE WHEN rn = 1 THEN kind END) AS kind
FROM r GROUP BY doc_id, isl
"""


@query("span_union_merge", _MERGE_SQL)
def span_union_merge(spark, sf):
    """Union merge on a span table (running maximum)."""
    d = R.span_table(_two(spark, sf), "doc_id", F.col("both"))
    m = R.merge_islands(d, "doc_id")
    return m.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")


@query("span_union_merge_in_row", _MERGE_SQL)
def span_union_merge_in_row(spark, sf):
    """The same policy inside each row, without any shuffle."""
    d = S.union_merge(_two(spark, sf), "both", "m", _PRIO, "text")
    return inline_rows(d, ["doc_id"], F.col("m"), "start").select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")


@query("span_first_wins", f"""
WITH RECURSIVE sp AS ({_TWO}),
o AS (SELECT doc_id, s, e, kind, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, kind) AS rn FROM sp),
walk AS (
  SELECT doc_id, rn, s, e, kind, e AS reach, true AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.rn, o.s, o.e, o.kind, CASE WHEN o.s >= w.reach THEN o.e ELSE w.reach END, o.s >= w.reach
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", kind FROM walk WHERE kept
""")
def span_first_wins(spark, sf):
    d = S.first_wins(_two(spark, sf), "both", "m", _PRIO)
    return inline_rows(d, ["doc_id"], F.col("m"), "start").select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")


_KEEP_SQL = f"""
WITH sp AS ({_TWO}), c AS (SELECT doc_id, s0 AS s, s0 + length(raw) AS e FROM ({_span_sql('documents', 'doc_id', P3)}))
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", kind FROM sp
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = sp.doc_id AND sp.s >= c.s AND sp.e <= c.e)
"""


@query("keep_span_suppress", _KEEP_SQL)
def keep_span_suppress(spark, sf):
    d = _two(spark, sf, True)
    return inline_rows(d, ["doc_id"], S.drop_inside(F.col("both"), F.col("cov")), "start").select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")


@query("keep_span_suppress_table", _KEEP_SQL)
def keep_span_suppress_table(spark, sf):
    """Containment anti join on span tables: equi on the text, range as the rest."""
    d = _two(spark, sf, True)
    sp, cov = R.span_table(d, "doc_id", F.col("both")), R.span_table(d, "doc_id", F.col("cov"))
    return R.suppress_inside(sp, cov, "doc_id").select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")


@query("adjacent_dedupe", f"""
WITH sp AS ({_TWO}), l AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e, kind) AS prev FROM sp)
SELECT doc_id, CAST(count(*) AS BIGINT) AS kept, CAST(sum(e - s) AS BIGINT) AS chars FROM l WHERE prev IS NULL OR prev <= s GROUP BY doc_id
""")
def adjacent_dedupe(spark, sf):
    d = R.span_table(_two(spark, sf), "doc_id", F.col("both"))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "kind")
    return (
        d.withColumn("prev", F.lag("end").over(w)).where("prev IS NULL OR prev <= start").groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("kept"), F.sum(F.expr("end - start")).cast("bigint").alias("chars"))
    )


@query("redact_union_text", None)
def redact_union_text(spark, sf):
    """Redacted texts under the generic rules with union merge."""
    d = D.with_generic_spans(docs(spark, sf, "doc_id", "text"), "text", "s")
    d = S.union_merge(d, "s", "m", D.GENERIC_PRIORITY, "text")
    d = S.apply_tags(d, "text", "m", "redacted", S.tag_of(D.GENERIC_TAGS))
    return d.select("doc_id", F.size("m").alias("spans"), F.sha2("redacted", 256).alias("redacted_hash"))


# ------------------------------------------------------------------ text measures
@query("clip_text", """
SELECT doc_id, CASE WHEN length(t) > 350 THEN substr(t, 1, 350) || '…' ELSE t END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
""")
def clip_text(spark, sf):
    return docs(spark, sf, "doc_id", "text").select("doc_id", squeeze(F.col("text")).alias("t")).select(
        "doc_id", clip(F.col("t"), V.MAX_SNIPPET).alias("snippet"))


def _list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


@query("language_detect", f"""
WITH c AS (SELECT doc_id, lang, len(list_filter(w, lambda x: list_contains({_list(V.LANG_ES)}, x))) AS es,
  len(list_filter(w, lambda x: list_contains({_list(V.LANG_EN)}, x))) AS en
  FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents))
SELECT doc_id, lang, CASE WHEN es = en THEN 'es' WHEN en > es THEN 'en' ELSE 'es' END AS detected FROM c
""")
def language_detect(spark, sf):
    return docs(spark, sf, "doc_id", "lang", "text").select("doc_id", "lang", C.language(F.col("text")).alias("detected"))


@query("length_check", """
SELECT conv_id, turn, CAST(w AS BIGINT) AS words, CAST(t AS BIGINT) AS tokens, w BETWEEN 250 AND 400 AS letter_ok, t BETWEEN 60 AND 220 AS note_ok
FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[-''’][\\p{L}\\p{N}]+)*')) AS w, len(regexp_extract_all(text, '\\S+')) AS t FROM conversations)
""")
def length_check(spark, sf):
    d = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    t = F.col("text")
    return d.select(
        "conv_id", "turn", word_count(t).cast("bigint").alias("words"), token_count(t).cast("bigint").alias("tokens"),
        Q.length_ok(t).alias("letter_ok"), Q.length_ok(t, Q.NOTE_WORDS, token_count).alias("note_ok"))


_CLOSE = "CASE WHEN doc_id % 3 = 0 THEN ' Quedo a su disposición.' WHEN doc_id % 3 = 1 THEN ' Me gustaría agendar una reunión.' ELSE '' END"
_CTA_SQL = (
    "(entrevista|conversar|conversaci[oó]n|platicar|reuni[oó]n|reunirnos|llamada|quedo (atent[oa]|a (su|la|tu) (entera )?disposici[oó]n)|"
    "me encantar[ií]a (conversar|platicar|reunirme|comentar|ampliar|conocer)|agendar|coordinar una|contactarme|comunicarse conmigo)"
)


@query("cta_tail", f"""
SELECT doc_id, regexp_matches(substr(t, CAST(floor(length(t) * 0.6) AS BIGINT) + 1), '(?i){_CTA_SQL}') AS cta
FROM (SELECT doc_id, text || {_CLOSE} AS t FROM documents)
""")
def cta_tail(spark, sf):
    d = docs(spark, sf, "doc_id", "text").selectExpr("doc_id", f"text || {_CLOSE} AS t")
    return d.select("doc_id", Q.cta_in_tail(F.col("t")).alias("cta"))


_STOP = _list(dict.fromkeys(V.KEYWORD_STOPWORDS))


@query("keywords_topk", f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}][\\p{{L}}\\p{{N}}+#.]*')) AS r FROM documents),
n AS (SELECT doc_id, regexp_replace(strip_accents(lower(r)), '\\.+$', '') AS word FROM w),
c AS (SELECT doc_id, word, count(*) AS n FROM n WHERE length(word) >= 5 AND NOT list_contains({_STOP}, word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rk FROM c)
SELECT doc_id, word, CAST(n AS BIGINT) AS n, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= 10
""")
def keywords_topk(spark, sf):
    return Q.keywords_topk(docs(spark, sf, "doc_id", "text"), "doc_id", "text", 10).select(
        "doc_id", "word", "n", F.col("rank").cast("bigint").alias("rank"))


_LINES = "replace(text, '. ', chr(10) || '- ')"


@query("requirement_bullets", f"""
WITH l AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split({_LINES}, chr(10)) AS ls FROM documents))),
b AS (SELECT doc_id, i, regexp_replace(trim(regexp_extract(x, '^\\s*(?:[-*•·▪◦–]|\\d+[.)])\\s+(.{{3,160}})$', 1)), '[.;]$', '') AS b
  FROM l WHERE regexp_matches(x, '^\\s*(?:[-*•·▪◦–]|\\d+[.)])\\s+(.{{3,160}})$')),
d AS (SELECT doc_id, b, min(i) AS i FROM b GROUP BY doc_id, b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM d)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(b, ' | ' ORDER BY i) AS bullets FROM r WHERE rn <= 8 GROUP BY doc_id
""")
def requirement_bullets(spark, sf):
    d = docs(spark, sf, "doc_id", "text").selectExpr("doc_id", f"{_LINES} AS offer")
    d = keep_rows(d.select("doc_id", C.requirement_bullets(F.col("offer")).alias("b")), F.size("b") > 0)
    return d.select(
        "doc_id", F.size("b").cast("bigint").alias("n"), F.array_join("b", " | ").alias("bullets"))


@query("own_name_ngram", """
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}&]+'), lambda x: strip_accents(lower(x))) AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1] = w[1] || ' ' || w[2])) AS BIGINT) AS hits
FROM t WHERE len(w) >= 2 AND w[1] <> w[2] AND length(w[1] || w[2]) >= 3
""")
def own_name_ngram(spark, sf):
    """Occurrences of a declared two-word name: here the first two words of each text."""
    return own_name_hits(docs(spark, sf, "doc_id", "text"))


_OTHER = V.C_TOKEN.replace("[", "[^", 1)  # what stands between words
_FIRST_TWO = rf"\A{_OTHER[:-1]}*+({V.C_TOKEN}+){_OTHER}+({V.C_TOKEN}+)"


def own_name_hits(d: DataFrame) -> DataFrame:
    """(doc_id, hits): a text's first two words are read off its head and staged, so that neither the test nor the pattern cuts the text again."""
    d = d.select("doc_id", "text", *[F.regexp_extract("text", _FIRST_TWO, i + 1).alias(n) for i, n in enumerate("ab")])
    a, b = D.fold(F.col("a")), D.fold(F.col("b"))
    d = keep_rows(d, (F.col("b") != "") & (a != b) & (F.length(F.concat(a, b)) >= 3))
    d = d.select("doc_id", D.fold(F.col("text")).alias("folded"), D.own_name_pattern(F.concat_ws(" ", "a", "b")).alias("name"))
    return d.select("doc_id", F.regexp_count("folded", F.col("name")).cast("bigint").alias("hits"))
