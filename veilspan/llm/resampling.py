"""Importance resampling towards a target: hashed n-gram features, gains per bucket, Gumbel top-k.

Every text is normalised once: A-Z lower-cased, everything ASCII but letters and digits a separator, words joined by
one blank. One scan keeps the running CRC-32 at every word's end. The CRC of a word run [i, j) then needs no second
look at its bytes: CRC is linear over GF(2), so crc(run) = P[j] xor shift(P[i], length), where P[i] is the running
CRC at its first byte and `shift` appends that many zero bytes (a 32 x 32 bit matrix, applied as four byte tables
for each power of two in the length).

Two passes over the texts: one counts buckets in every task and sums `buckets` numbers per task by a shuffle, the
other adds up the gains, which are broadcast (`buckets` numbers, however large the corpus). Ranks come from a sort by
range of the narrow scores and one row count per sorted part; no row passes the driver.

NULL texts and texts without a word have no features, weight 0 and are never drawn. A NULL identifier hashes as ''.
Rows with the same identifier are drawn one by one; rows alike in score and identifier get their ranks in any order.
An empty table gives no rows, an empty target only T = 0. Other columns of the inputs are left behind.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, written

# separators become blanks, A-Z lower case; every byte of a non-ASCII character stays
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ONES = np.uint32(0xFFFFFFFF)
BLOCK = 1 << 16


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = _byte_table()


@lru_cache(maxsize=64)
def zeros(power: int) -> np.ndarray:
    """4 x 256: what 2**power zero bytes make of a remainder, by its bytes."""
    if power == 0:
        v = np.arange(256, dtype=np.uint32)
        each = [v << np.uint32(8 * k) for k in range(4)]
        return np.stack([STEP[x & 255] ^ (x >> 8) for x in each]).astype(np.uint32)
    half = zeros(power - 1)
    return np.stack([applied(half, half[k]) for k in range(4)])


def applied(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]


def shift(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """`v` with that many zero bytes after it."""
    out, power = v.copy(), 0
    while len(out) and int(lengths.max()) >> power:
        at = np.flatnonzero(lengths >> power & 1)
        out[at] = applied(zeros(power), out[at])
        power += 1
    return out


def run_crcs(words: list[bytes], longest: int, shortest: int = 1) -> np.ndarray:
    """Unsigned CRC-32 of all runs of `shortest` to `longest` consecutive words, joined by a blank."""
    if not words:
        return np.zeros(0, np.uint32)
    # running CRC after each word of the joined text, one scan
    first, *rest = words
    ends = np.fromiter(accumulate((b" " + w for w in rest), lambda c, w: crc32(w, c), initial=crc32(first)), np.uint32, len(words))
    # one blank further on the next word starts
    state = ends[:-1] ^ ONES
    starts = np.concatenate([np.zeros(1, np.uint32), STEP[(state ^ 32) & 255] ^ (state >> 8) ^ ONES]).astype(np.uint32)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    heads = np.concatenate([np.zeros(1, np.int64), stops[:-1] + 1])
    out = []
    for n in range(shortest, min(longest, len(words)) + 1):
        k = len(words) - n + 1
        out.append(ends[n - 1 :] ^ shift(starts[:k], stops[n - 1 :] - heads[:k]))
    return np.concatenate([*out, np.zeros(0, np.uint32)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT).split()


def features(text: str | None, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words new in it, feature CRCs) of a text in blocks, so that a very long text needs little memory."""
    words = words_of(text)
    yield len(words[:BLOCK]), run_crcs(words[:BLOCK], longest)
    for at in range(BLOCK, len(words), BLOCK):
        # runs that end in this block: all runs of it and its lead, less those that lie in the lead alone
        lead = words[max(0, at - longest + 1) : at]
        block = words[at : at + BLOCK]
        yield len(block), _ending_after(lead, block, longest)


def _ending_after(lead: list[bytes], block: list[bytes], longest: int) -> np.ndarray:
    out = []
    for n in range(1, longest + 1):
        part = (lead[len(lead) - n + 1 :] if n > 1 else []) + block
        out.append(run_crcs(part, n, n))
    return np.concatenate(out)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): features of the column `text` by bucket."""

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for text in column(b, "text"):
                for _, crcs in features(text, longest):
                    seen += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    part = texts.select("text").mapInArrow(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """By bucket: 1000 times the log of how much likelier it is in the target, smoothed by one, as whole numbers."""
    corpus = bucket_counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, longest, buckets).select("bucket", F.lit(0).cast("long"), "n")
    both = corpus.union(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # `buckets` rows at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = np.uint32(len(gain))

    def run(batches):
        for b in batches:
            n_words, n_features, weight = [], [], []
            for text in column(b, "text"):
                w = f = total = 0
                for words, crcs in features(text, longest):
                    w, f, total = w + words, f + len(crcs), total + int(held.value[crcs % buckets].sum())
                n_words.append(w), n_features.append(f), weight.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame) -> DataFrame:
    """`rows` with `rank` 1, 2, 3… by score from the highest, ties to the smaller doc_id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the high bits of the id are the sorted part, the low 33 bits the place in it
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "resampling-order")
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before, offsets = 0, []
    for r in sorted(placed.groupBy("__part").count().collect()):  # one row for each sorted part
        offsets.append((r["__part"], before))
        before += r["count"]
    sizes = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    return placed.join(F.broadcast(sizes), "__part").withColumn("rank", F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Every row: doc_id, n_words, n_features, weight, score and rank; the rank is NULL unless the row is among the
    floor(percent · N / 100) highest scores of the N rows with `least_words` words."""
    weighed = weights(docs, gains(docs, target, longest, buckets), longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel), "resampling-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    draw = fit.count() * percent // 100
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(fit).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rest)


# the registered query (runs of one word, 10,000 buckets, a tenth of the rows) as SQL: a CRC-32 byte table, the CRC of
# every distinct word, then counts, gains and the draw
SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM docs GROUP BY doc_id, w),
tw AS (SELECT w, count(*) AS n FROM target GROUP BY w),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
crc AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM tw JOIN crc USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
    FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
