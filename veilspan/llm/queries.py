"""The registered queries of this subpackage and, where SQL can express them, their SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import bpe, cotraining, exactdedup, langkernel, linedrop, mixing, orcids, rarefeatures, resampling, setsketch, simhash, toxicity, turnrepair
from veilspan.llm.common import documents, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_cotraining_quality")
def op1(spark, sf):
    docs = documents(spark, sf)
    return cotraining.scores(docs, cotraining.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op2_orc_token_ids")
def op2(spark, sf):
    path = shared_folder(spark, "orc-ids")
    orcids.write(documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"))
    return orcids.read_digests(spark, path)


@query("op3_rare_feature_digest")
def op3(spark, sf):
    return rarefeatures.compare_with_edits(documents(spark, sf))


@query(
    "op4_poisson_mixing",
    """
WITH d AS (SELECT *, CAST(length(coalesce(text, '')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY source),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size END AS rate FROM s),
c AS (SELECT source, floor(rate / 8) * 8 AS certain, rate - floor(rate / 8) * 8 AS rest FROM r),
cdf AS (SELECT source, certain, k, sum(exp(-rest) * pow(rest, k) / CASE WHEN k = 0 THEN 1.0 ELSE exp(lgamma(k + 1.0)) END)
    OVER (PARTITION BY source ORDER BY k) AS p FROM c, range(0, 40) t(k)),
n AS (SELECT d.doc_id, CAST(any_value(certain) + count(CASE WHEN p <= u THEN 1 END) AS INT) AS mix_copies
    FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n.mix_copies, CAST(t.k AS INT) AS mix_copy,
    CAST(('0x' || substr(md5('8|' || CAST(d.doc_id AS VARCHAR) || '|' || CAST(t.k AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 AS mix_order
FROM documents d JOIN n USING (doc_id), range(0, 10000) t(k) WHERE t.k < n.mix_copies
""",
)
def op4(spark, sf):
    return mixing.replicate(documents(spark, sf).select("doc_id", "text", "lang", "source", "n_chars"))


@query("op5_convolution_toxicity")
def op5(spark, sf):
    docs = documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op6_bpe_round_trip")
def op6(spark, sf):
    return bpe.round_trip_digests(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op7_exact_dedup",
    """
WITH g AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM g WINDOW w AS (PARTITION BY t)
""",
)
def op7(spark, sf):
    return exactdedup.exact_groups(documents(spark, sf))


@query("op10_simhash_near_dedup")
def op10(spark, sf):
    return simhash.near_groups(documents(spark, sf))


@query("op9_log_template_lines", linedrop.SQL)
def op9(spark, sf):
    return linedrop.drop_recurring(documents(spark, sf).select("doc_id", "text"))


@query("op8_string_kernel_language")
def op8(spark, sf):
    docs = documents(spark, sf)
    return langkernel.score(docs, langkernel.fit(docs))


@query("op12_prefix_crc_resampling", resampling.SQL)
def op12(spark, sf):
    return resampling.resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), longest=1, buckets=10_000, percent=10, least_words=20)


@query("op13_block_table_turn_repair")
def op13(spark, sf):
    return turnrepair.repair_digests(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op11_setsketch_near_dedup")
def op11(spark, sf):
    return setsketch.near_groups(documents(spark, sf), width=5, percent=85)
