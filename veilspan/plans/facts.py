"""Queries over search results, blind labels, stored answers and percent mentions."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import benchstats as B
from veilspan.operators import facts as K
from veilspan.operators import money as M
from veilspan.operators import redact as R
from veilspan.plans.base import PROFILES, raw_profiles
from veilspan.plans.registry import query
from veilspan.session import inline_rows, table

_PAGES = "SELECT page_id, page_id % 40 AS company, CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Page ' || CAST(page_id AS STRING) END AS title, CASE WHEN page_id % 5 = 0 THEN '  some   words ' ELSE '' END AS content FROM pages"


@query("facts_top3", f"""
WITH p AS ({_PAGES}), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY page_id) AS fact FROM p WHERE url IS NOT NULL AND (title <> '' OR content <> ''))
SELECT company, CAST(fact AS BIGINT) AS fact, title, url, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS snippet FROM r WHERE fact <= 3
""")
def facts_top3(spark, sf):
    cols = _PAGES.removeprefix("SELECT ").removesuffix(" FROM pages")
    p = table(spark, sf, "pages").select("page_id", "url").selectExpr(
        "page_id", "page_id % 40 AS company", *[c.strip() + e for c, e in _columns(cols)])
    return K.top_facts(p, "company", "page_id").withColumn("fact", F.col("fact").cast("bigint"))


def _columns(cols: str):
    """The three CASE columns of the shared select list."""
    parts = cols.split(", CASE")[1:]
    return [("CASE" + p, "") for p in parts]


@query("used_facts", """
SELECT event_id, array_to_string(list_filter([event_id % 5, event_id % 3, 9], lambda n: list_contains(range(1, CAST(event_id % 4 + 1 AS BIGINT)), n)), ',') AS used FROM events
""")
def used_facts(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    offered = F.filter(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)]), lambda n: n <= F.col("event_id") % 4)
    used = F.array(F.col("event_id") % 5, F.col("event_id") % 3, F.lit(9).cast("bigint"))
    return e.select("event_id", F.array_join(F.transform(K.used_facts(used, offered), lambda n: n.cast("string")), ",").alias("used"))


@query("unblinded_scores", """
WITH s AS (SELECT doc_id, unnest(['A', 'B', 'C']) AS label, unnest([quality, toxic, quality + toxic]) AS score FROM labels),
m AS (SELECT doc_id, unnest(['A', 'B', 'C']) AS label, CASE WHEN doc_id % 2 = 0 THEN unnest(['local', 'nube', 'plantilla']) ELSE unnest(['nube', 'plantilla', 'local']) END AS source FROM labels)
SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS score FROM s JOIN m USING (doc_id, label) GROUP BY source
""")
def unblinded_scores(spark, sf):
    l = table(spark, sf, "labels")
    s = l.selectExpr("doc_id", "stack(3, 'A', quality, 'B', toxic, 'C', quality + toxic) AS (label, score)")
    m = l.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN array('local', 'nube', 'plantilla') ELSE array('nube', 'plantilla', 'local') END AS o").selectExpr(
        "doc_id", "stack(3, 'A', o[0], 'B', o[1], 'C', o[2]) AS (label, source)")
    j = K.unblind(s, m, "doc_id", "label")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("unanswered_requests", """
WITH r AS (SELECT conv_id, turn, substr(sha256('sys' || chr(10) || text), 1, 12) AS digest FROM conversations), s AS (SELECT DISTINCT conv_id, digest FROM r WHERE turn % 2 = 0)
SELECT conv_id, turn, digest FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = r.conv_id AND s.digest = r.digest)
""")
def unanswered_requests(spark, sf):
    c = table(spark, sf, "conversations")
    r = c.select("conv_id", "turn", K.prompt_hash(F.lit("sys"), F.col("text")).alias("digest"))
    return K.unanswered(r, r.where("turn % 2 = 0"), "conv_id", "digest").select("conv_id", "turn", "digest")


@query("percent_mentions", f"""
WITH {PROFILES} SELECT id, CAST(strpos(achievements, '12 %') - 1 AS BIGINT) AS start, CAST(12 AS DOUBLE) AS value FROM profiles
""")
def percent_mentions(spark, sf):
    p = raw_profiles(spark, sf).select("id", "achievements")
    d, (n,) = S.with_spans(p, "achievements", [M.percent_rule("achievements")])
    return inline_rows(d, ["id"], F.col(n), "start").select("id", F.col("start").cast("bigint").alias("start"), "value")


@query("finalized_letters", f"""
WITH {PROFILES} SELECT id, 'Estimados: fuerte' || chr(10) || 'Atentamente, ' || name AS letter FROM profiles
""")
def finalized_letters(spark, sf):
    p = raw_profiles(spark, sf).selectExpr(
        "id", "name", "'```text' || chr(10) || '<think>plan</think># Estimados: **fuerte**' || chr(10) || 'Atentamente, {{ nombre }}' || chr(10) || '```' AS t")
    return p.select("id", R.finalize_letter(F.col("t"), F.col("name")).alias("letter"))


@query("rule_vs_rater_by_source", """
WITH r AS (SELECT d.source, l.quality = 1 AS a, length(d.text) >= 500 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count_if(a = b) AS BIGINT) AS agree FROM r GROUP BY source
""")
def rule_vs_rater_by_source(spark, sf):
    """Agreement of a length rule with the quality rating."""
    d = table(spark, sf, "documents").select("doc_id", "source", (F.length("text") >= 500).alias("b"))
    j = d.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("a")), "doc_id")
    return B.kappa(j, ["source"], "a", "b").select("source", "n", "agree")
