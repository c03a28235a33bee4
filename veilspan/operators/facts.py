"""Company facts, blind labels and memoised requests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.text import squeeze


def top_facts(rows: DataFrame, key: str, order: str, most: int = 3, snippet: int = 350) -> DataFrame:
    """First usable search results per key (a link and a title or content), numbered from 1.

    A rank filter directly over the window lets Spark keep only `most` rows per key and task before
    the shuffle, so a key with very many results stays cheap.
    """
    text = F.coalesce("title", F.lit("")) != ""
    body = F.coalesce("content", F.lit("")) != ""
    good = rows.where(F.col("url").isNotNull() & (F.col("url") != "") & (text | body))
    w = Window.partitionBy(key).orderBy(order)
    return good.withColumn("fact", F.row_number().over(w)).where(F.col("fact") <= most).select(
        key, "fact", F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, 200).alias("title"), "url",
        F.substring(squeeze(F.coalesce("content", F.lit(""))), 1, snippet).alias("snippet"),
    )


def used_facts(used: Column, offered: Column) -> Column:
    """Cited fact numbers that were really offered."""
    return F.filter(used, lambda n: F.array_contains(offered, n))


def unblind(scores: DataFrame, mapping: DataFrame, case: str, label: str) -> DataFrame:
    """Scores under blind labels → scores per source."""
    return scores.join(mapping, [case, label])


def prompt_hash(system: Column, user: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", system, user), 256), 1, 12)


def unanswered(requests: DataFrame, store: DataFrame, key: str, digest: str) -> DataFrame:
    """Requests whose exact text has no stored answer."""
    return requests.join(store.select(key, digest).distinct(), [key, digest], "left_anti")
