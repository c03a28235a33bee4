"""Line dedup by log templates: a fixed-depth tree generalises variable fields, recurring templates go.

Tree: a line's tokens (fields between blanks; fields with a digit are variable from the start) lead by
their number and the first `depth` of them to a leaf. Inside a leaf every token is counted at its position over
documents (a document counts once, whichever and however many of its lines there hold it). A line's usual count is the one that `percent` % of its
tokens reach; tokens of at least half that count are its constants, the others variable fields. The rule compares
counts with each other, so a leaf that grows as a whole keeps its templates. Where the usual count is below `min_docs`,
or too many fields hold digits, the line is its own template, as masked. A template found in at least `min_docs`
documents is recurring: its first line (smallest doc_id, then place) stays, all others are dropped. A document counts
once for a template however many lines of it have that template.

Exact counts without a hot key: a template with a line that `min_docs` documents hold recurs, whatever its other
lines; in any other template every line has fewer documents than that, so they travel with the line.
A line that a third of all documents share is one row from the second aggregation on.

Only DataFrame functions. Lines are cut at '\\n'; blank lines always stay. NULL texts stay NULL, NULL ids
sort first, rows that repeat id and text count as one document and share their fate, an empty table gives no rows and
other columns are untouched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import written

BLANK, ANY = r"[ \t\x0B\f\r]", "<*>"
ODD_BLANKS = r"[\t\x0B\f\r]|  "
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"  # tried at the start of a token only


def masked(line: Column) -> Column:
    """The line with single blanks and `<*>` for fields that hold a digit; '' for a blank line."""
    even = F.trim(F.when(line.rlike(ODD_BLANKS), F.regexp_replace(line, BLANK + "+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(even, VARIABLE, ANY)).otherwise(even)


def line_keys(docs: DataFrame, depth: int) -> DataFrame:
    """Every non-blank line: doc_id, th (hash of the text), pos, leaf, line (hash), n (tokens), masked."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    filled = lines.where(F.col("raw").rlike(BLANK.replace("[", "[^")))  # on the raw line: a filter on the masked one would mask twice
    tokens = filled.select("doc_id", "th", "pos", masked(F.col("raw")).alias("masked")).withColumn("tokens", F.split("masked", " "))
    return tokens.select(
        "doc_id", "th", "pos", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.xxhash64("masked").alias("line"),
        F.size("tokens").alias("n"), "masked",
    )


def per_line(keys: DataFrame) -> DataFrame:
    """(leaf, line, n): documents that hold it, documents whose first line of the leaf it is, whether one of those that hold it
    has other lines of the leaf, its first place."""
    placed = keys.select("leaf", "line", "n", "doc_id", "th", "pos").repartition("leaf", "doc_id", "th")
    once = placed.groupBy("leaf", "doc_id", "th", "line", "n").agg(F.min("pos").alias("pos"))
    own = Window.partitionBy("leaf", "doc_id", "th")  # one document's lines
    leads = F.col("pos") == F.min("pos").over(own)
    return once.withColumns({"leads": leads.cast("long"), "several": F.count("*").over(own) > 1}).groupBy("leaf", "line", "n").agg(
        F.count("*").alias("docs"), F.sum("leads").alias("leads"), F.bool_or("several").alias("several"), F.min(F.struct("doc_id", "th", "pos")).alias("first")
    )


def counted_again(keys: DataFrame, shown: DataFrame) -> DataFrame:
    """(leaf, p, token, extra): how often a document with several lines of a leaf counts a token beyond the first time, when
    each of its lines counts. Only such documents' lines are looked at."""
    held = keys.join(shown.where("several").select("leaf", "line"), ["leaf", "line"], "left_semi").select("leaf", "line", "doc_id", "th").distinct()
    several = held.withColumn("lines", F.count("*").over(Window.partitionBy("leaf", "doc_id", "th"))).where("lines > 1")
    tokens = several.join(shown.select("leaf", "line", "masked"), ["leaf", "line"]).select("leaf", "doc_id", "th", F.posexplode(F.split("masked", " ")).alias("p", "token"))
    times = tokens.where(F.col("token") != ANY).groupBy("leaf", "doc_id", "th", "p", "token").count().where("count > 1")
    return times.groupBy("leaf", "p", "token").agg(F.sum(F.col("count") - 1).alias("extra"))


def templates(keys: DataFrame, lines: DataFrame, min_docs: int, percent: int) -> DataFrame:
    """(leaf, line, template, docs, first, owners) of the lines that are generalised; `owners` are the documents of a
    line in fewer than `min_docs`, else NULL."""
    open_leaves = lines.groupBy("leaf").agg(F.sum("leads").alias("leaf_docs"), F.count("*").alias("forms"))
    open_leaves = open_leaves.where((F.col("leaf_docs") >= min_docs) & (F.col("forms") > 1)).select("leaf")
    need = F.ceil(F.col("n") * percent / 100.0)
    varied = lines.where(F.col("n") > need).join(open_leaves, "leaf", "left_semi")
    rare = F.col("docs") < min_docs
    here = F.col("at").eqNullSafe(F.col("first"))
    shown = keys.select("leaf", "line", "masked", F.struct("doc_id", "th", "pos").alias("at")).join(varied, ["leaf", "line"]).where(here | rare)
    shown = shown.groupBy("leaf", "line", "n", "docs", "several", "first").agg(
        F.first(F.when(here, F.col("masked")), True).alias("masked"),
        F.collect_set(F.when(rare, F.struct("at.doc_id", "at.th"))).alias("owners"),  # fewer than min_docs
    )
    shown = written(shown.withColumn("owners", F.when(rare, F.col("owners"))), "varied-lines")
    tokens = shown.select("leaf", "line", "n", "docs", F.posexplode(F.split("masked", " ")).alias("p", "token")).where(F.col("token") != ANY)
    every = tokens.groupBy("leaf", "p", "token").agg(F.sum("docs").alias("every")).where(F.col("every") >= min_docs)
    seen = F.col("every") - F.coalesce("extra", F.lit(0))
    seen = every.join(counted_again(keys, shown), ["leaf", "p", "token"], "left").select("leaf", "p", "token", seen.alias("seen")).where(F.col("seen") >= min_docs)
    fields = tokens.drop("docs").join(seen, ["leaf", "p", "token"]).groupBy("leaf", "line", "n").agg(F.collect_list(F.struct("seen", "p", "token")).alias("fields"))
    usual = F.get(F.sort_array(F.col("fields.seen"), asc=False), (need - 1).cast("int"))
    usual = fields.withColumn("usual", usual).where(F.col("usual").isNotNull())
    fixed = F.sort_array(F.transform(F.expr("filter(fields, f -> 2 * f.seen >= usual)"), lambda f: F.struct(f["p"], f["token"])))
    return usual.select("leaf", "line", F.xxhash64("leaf", fixed).alias("template")).join(
        shown.select("leaf", "line", "docs", "first", "owners"), ["leaf", "line"]
    )


def recurring(keys: DataFrame, min_docs: int, percent: int) -> DataFrame:
    """(leaf, line, stays): lines of recurring templates and the one place where the template stays."""
    lines = written(per_line(keys), "lines")
    of = written(templates(keys, lines, min_docs, percent), "templates")
    alone = lines.where(F.col("docs") >= min_docs).join(of.select("leaf", "line"), ["leaf", "line"], "left_anti").select("leaf", "line", F.col("first").alias("stays"))
    owned = of.select("leaf", "template", "docs", "first", F.explode_outer("owners").alias("owner"))
    often = (
        owned.groupBy("leaf", "template", "owner").agg(F.max("docs").alias("docs"), F.min("first").alias("first"))
        .groupBy("leaf", "template").agg(F.greatest(F.max("docs"), F.count("owner")).alias("seen"), F.min("first").alias("stays"))
        .where(F.col("seen") >= min_docs)
    )
    return alone.unionByName(of.join(often, ["leaf", "template"]).select("leaf", "line", "stays"))


def drop_recurring(docs: DataFrame, depth: int = 2, min_docs: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with the recurring lines cut from `text`, and line counts `lines_before`, `lines_dropped`."""
    keys = written(line_keys(docs, depth), "line-keys")
    gone = keys.drop("masked").join(recurring(keys, min_docs, percent), ["leaf", "line"]).where(
        ~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("stays"))
    )
    cut = gone.groupBy(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th")).agg(F.collect_set("pos").alias("cut_pos"))
    cut = cut.select(F.struct("cut_id", "cut_th", "cut_pos").alias("__cut"))
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__th"))
    both = whole.join(cut, F.col("__id").eqNullSafe(F.col("__cut.cut_id")) & (F.col("__th") == F.col("__cut.cut_th")), "left")
    lines = F.split("__doc.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cut.cut_pos"))
    text = F.when(F.col("__cut").isNull(), F.col("__doc.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n"))
    both = both.withColumn("__lines", F.when(F.col("__cut").isNotNull(), lines))
    rest = [text.alias("text") if c == "text" else F.col("__doc")[c].alias(c) for c in docs.columns]
    counts = [F.when(lines.isNull(), 0).otherwise(F.size(lines)).alias("lines_before"), F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut.cut_pos")).alias("lines_dropped")]
    return both.select(*rest, *[c for c, n in zip(counts, ("lines_before", "lines_dropped")) if n not in docs.columns])


SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' '), '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g') AS masked FROM raw),
k AS (SELECT doc_id, pos, masked, len(string_split(masked, ' ')) AS n, (len(string_split(masked, ' ')), string_split(masked, ' ')[1:2]) AS leaf FROM m WHERE masked <> ''),
l AS (SELECT leaf, masked, n, count(DISTINCT doc_id) AS docs, min(row(doc_id, pos)) AS first FROM k GROUP BY leaf, masked, n),
h AS (SELECT leaf, masked, count(*) AS leads FROM (SELECT doc_id, leaf, arg_min(masked, pos) AS masked FROM k GROUP BY doc_id, leaf) GROUP BY leaf, masked),
o AS (SELECT leaf FROM l GROUP BY leaf HAVING count(*) > 1 AND leaf IN (SELECT leaf FROM h GROUP BY leaf HAVING sum(leads) >= 5)),
t AS (SELECT leaf, masked, n, unnest(string_split(masked, ' ')) AS token, generate_subscripts(string_split(masked, ' '), 1) - 1 AS p
    FROM l WHERE leaf IN (SELECT leaf FROM o)),
c AS (SELECT t.leaf, p, token, sum(leads) AS seen FROM t JOIN h ON t.leaf = h.leaf AND t.masked = h.masked WHERE token <> '<*>'
    GROUP BY t.leaf, p, token HAVING sum(leads) >= 5),
u AS (SELECT leaf, masked, p, token, seen, (n * 80 + 99) // 100 AS need, row_number() OVER (PARTITION BY leaf, masked ORDER BY seen DESC, p) AS place
    FROM t JOIN c USING (leaf, p, token)),
v AS (SELECT leaf, masked, seen AS usual FROM u WHERE place = need),
f AS (SELECT u.leaf, u.masked, string_agg(CAST(p AS VARCHAR) || ':' || token, ' ' ORDER BY p) AS fixed
    FROM u JOIN v ON u.leaf = v.leaf AND u.masked = v.masked WHERE 2 * seen >= usual GROUP BY u.leaf, u.masked),
g AS (SELECT l.leaf, l.masked, l.first, CASE WHEN f.fixed IS NOT NULL THEN 'T' || f.fixed ELSE 'L' || l.masked END AS template
    FROM l LEFT JOIN f ON l.leaf = f.leaf AND l.masked = f.masked),
e AS (SELECT g.leaf, template, count(DISTINCT doc_id) AS docs FROM g JOIN k ON g.leaf = k.leaf AND g.masked = k.masked GROUP BY g.leaf, template),
r AS (SELECT leaf, template, min(first) AS stays FROM g GROUP BY leaf, template HAVING (leaf, template) IN (SELECT (leaf, template) FROM e WHERE docs >= 5)),
d AS (SELECT k.doc_id, k.pos FROM k JOIN g ON k.leaf = g.leaf AND k.masked = g.masked JOIN r ON g.leaf = r.leaf AND g.template = r.template
    WHERE row(k.doc_id, k.pos) <> r.stays),
s AS (SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.pos) FILTER (WHERE d.pos IS NULL) AS text, count(*) AS lines_before, count(d.pos) AS lines_dropped
    FROM raw LEFT JOIN d ON raw.doc_id = d.doc_id AND raw.pos = d.pos GROUP BY raw.doc_id)
SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
    CAST(coalesce(lines_before, 0) AS INT) AS lines_before, CAST(coalesce(lines_dropped, 0) AS INT) AS lines_dropped
FROM documents LEFT JOIN s USING (doc_id)
"""
