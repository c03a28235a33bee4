"""Improbable-feature digests: rare byte windows in chained Bloom filters.

Every 64-byte window has an entropy (of its byte counts, quantised to 0 … 1000). How often each value
occurs in all windows of all documents gives its rank: the rarer, the better; windows of nearly no or
nearly full entropy never count. Among any 64 neighbouring windows the best-ranked one (the first of equals)
is voted for; windows with at least `votes` votes are features. Features, hashed, go five bits each into a
chain of 2048-bit Bloom filters, 160 to a filter. Likeness: each filter of the shorter chain takes its best
overlap with a filter of the other; the overlap is normalised between what chance gives (plus a tenth) and
the most possible, and averaged by set bits.

Text is taken as UTF-8. Texts with no feature (under 64 bytes, or of one letter) have a single one, their
whole bytes; empty texts have none: two of them are alike (1), one and any other are not (0). Equal texts
have equal fingerprints. The fingerprint is `features:base64 of the filters`.

Long texts are worked on in blocks with a margin, short ones many at a time; both give the same digest.
"""
from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column

W, VOTES, PER_FILTER, BITS, HASHES = 64, 16, 160, 2048, 5
LOW, HIGH = 100, 990  # entropies outside are never features
BLOCK = 1 << 19
SCALE = 1024
PART = np.round(np.array([0.0, *(n * math.log2(n) for n in range(1, W + 2))]) * SCALE).astype(np.int64)
FULL = int(PART[W])
NEVER = np.int64(1) << np.int64(62)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def entropies(b: np.ndarray) -> np.ndarray:
    """Quantised entropy of every window of `b`, by what leaves and what enters."""
    n = len(b) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    after, before = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    step = 1 << 15
    for s in range(0, len(b), step):  # pieces that stay in the cache
        part = b[s : s + step + W - 1]
        for k in range(1, min(W, len(part))):
            same = part[k:] == part[:-k]
            m = min(step, len(same))
            after[s : s + m] += same[:m]
            before[s + k : s + k + m] += same[:m]
    first = int(PART[np.bincount(b[:W], minlength=256)].sum())
    leave, enter = after[: n - 1].astype(np.intp), before[W:].astype(np.intp)
    # the window without its first byte holds that byte `leave` times and the next one `enter` times,
    # where `enter` is counted over the 63 bytes before it
    change = PART[leave] - PART[leave + 1] + PART[enter + 1] - PART[enter]
    total = np.concatenate([[first], first + np.cumsum(change)])
    return (FULL - total) * 1000 // FULL


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, starts, and for every byte whether a window of its own text begins there."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    fits = np.zeros(len(b) + 1, np.int64)
    some = lengths >= W
    np.add.at(fits, starts[some], 1)
    np.add.at(fits, (starts + lengths - W + 1)[some], -1)
    return b, starts, np.cumsum(fits[:-1]) > 0


def histogram(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(1001, np.int64)
    for group in _groups(texts):
        for t in _blocks(group, W - 1):
            b, _, fits = joined(t)
            e = entropies(b)
            out += np.bincount(e[fits[: len(e)]], minlength=1001)
    return out


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BLOCK:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _blocks(group: list[bytes], margin: int) -> Iterator[list[bytes]]:
    """A group as it is; a single long text in blocks, each with the `margin` bytes that follow it."""
    if len(group) > 1 or len(group[0]) <= 2 * BLOCK:
        yield group
    else:
        for a in range(0, len(group[0]) - margin, BLOCK):
            yield [group[0][a : a + BLOCK + margin]]


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of every entropy, the rarest 0; -1 where a window never counts."""
    order = np.argsort(counts, kind="stable")
    rank = np.empty(1001, np.int64)
    rank[order] = np.arange(1001)
    rank[:LOW], rank[HIGH + 1 :] = -1, -1
    return rank


def voted(b: np.ndarray, fits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the features. Between two texts lie 63 places without a window, so no vote sees both."""
    e = entropies(b)
    r = rank[e]
    key = np.where((r >= 0) & fits[: len(e)], (r << 32) | np.arange(len(e)), NEVER)
    edge = np.full(W - 1, NEVER)
    m = np.concatenate([edge, key, edge])
    for shift in (1, 2, 4, 8, 16, 32):
        m = np.minimum(m[:-shift], m[shift:])
    won = m[m < NEVER] & 0xFFFFFFFF
    return np.flatnonzero(np.bincount(won, minlength=1) >= VOTES) if len(won) else np.zeros(0, np.int64)


def hashed(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(b, W)[at]
    h = (np.ascontiguousarray(windows).view("<u8") * MIX).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of every text, in their order, each once."""
    out: list[np.ndarray] = []
    for group in _groups(texts):
        if len(group) == 1 and len(group[0]) > 2 * BLOCK:
            t, found, margin = group[0], [], 2 * W
            for a in range(0, len(t) - W + 1, BLOCK):
                lo, hi = max(0, a - margin), min(len(t), a + BLOCK + margin + W)
                b = np.frombuffer(t[lo:hi], np.uint8)
                at = voted(b, np.arange(len(b)) + W <= len(b), rank)
                found.append(hashed(b, at[(at >= a - lo) & (at < a - lo + BLOCK)]))
            each = [np.concatenate(found)]
        else:
            b, starts, fits = joined(group)
            at = voted(b, fits, rank) if len(b) >= W else np.zeros(0, np.int64)
            h = hashed(b, at) if len(at) else np.zeros(0, np.uint64)
            each = np.split(h, np.searchsorted(at, starts[1:]))
        for t, h in zip(group, each):
            if len(h) > 1:
                _, first = np.unique(h, return_index=True)
                h = h[np.sort(first)]
            if not len(h) and t:
                h = np.array([xxhash.xxh64_intdigest(t)], np.uint64)
            out.append(h)
    return out


def filters(h: np.ndarray) -> np.ndarray:
    """The chain: one row of BITS / 8 bytes per PER_FILTER features."""
    n = -(-len(h) // PER_FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(h)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y = y, x
    nx, ny = (np.bitwise_count(v).sum(axis=1, dtype=np.int64).astype(float) for v in (x, y))
    best = np.zeros(len(x))
    for i in range(0, len(x), 64):
        a = np.unpackbits(x[i : i + 64], axis=1).astype(np.float32)
        for j in range(0, len(y), 512):
            both = a @ np.unpackbits(y[j : j + 512], axis=1).astype(np.float32).T
            chance = nx[i : i + 64, None] * ny[None, j : j + 512] / BITS
            most = np.minimum(nx[i : i + 64, None], ny[None, j : j + 512])
            floor = chance + 0.1 * (most - chance)
            best[i : i + 64] = np.maximum(best[i : i + 64], ((both - floor) / np.maximum(most - floor, 1e-9)).max(axis=1))
    return float(min(1.0, (best * nx).sum() / nx.sum()))


def text_form(h: np.ndarray, chain: np.ndarray) -> str:
    return f"{len(h)}:{base64.b64encode(chain.tobytes()).decode()}"


def parse(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


# --- on tables -----------------------------------------------------------------------------------


def _raw(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Entropy counts over every window of every document: at most 1001 numbers reach the driver."""

    def run(batches):
        total = np.zeros(1001, np.int64)
        for b in batches:
            total += histogram([_raw(t) for t in column(b, "text")])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["entropy", "n"])

    counts = np.zeros(1001, np.int64)
    for r in docs.select("text").mapInArrow(run, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r["entropy"]] = r["n"]
    return ranks(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint of every row."""
    rank = corpus_ranks(docs) if rank is None else rank

    def run(batches):
        for b in batches:
            h = features([_raw(t) for t in column(b, "text")], rank)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_form(x, filters(x)) for x in h], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def place(key: Column, bounds: list[int]) -> Column:
    """Number of `bounds` (ascending) that are ≤ key, found in two steps of √n comparisons."""
    if not bounds:
        return F.lit(0)
    w = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + w] for i in range(0, len(bounds), w)]
    row = F.greatest(F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda x: x <= key)) - 1, F.lit(0))
    table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    return row * w + F.size(F.filter(F.get(table, row), lambda x: x <= key))


def with_next(docs: DataFrame) -> DataFrame:
    """(k, bucket, peek, doc_id, text): range buckets sorted by descending id inside their partition. Each
    bucket ends with a copy of the first row of the bucket that follows (after the last one: the first),
    marked peek, so every row finds the next document beside it. NULL ids come last; rows of one id are
    ordered by text. One exchange of the texts; the driver sees one number per bucket."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = 3 * parts
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    at = place(F.col("k"), sorted(set(cuts or [])))
    rows = rows.withColumn("bucket", at)
    tops = [(r["bucket"], r["k"]) for r in rows.groupBy("bucket").agg(F.max("k").alias("k")).orderBy("bucket").collect()]
    # the best row of a bucket is peeked at from the bucket above it; that of the top one from the lowest
    peeks = [(k, tops[(i + 1) % len(tops)][0]) for i, (_, k) in enumerate(tops)]
    aims = spark.createDataFrame(peeks, "top long, aim int")
    rows = rows.join(F.broadcast(aims), F.col("k") == F.col("top"), "left")
    own, copy = (F.struct(F.col(c).alias("bucket"), F.lit(p).alias("peek")) for c, p in (("own", False), ("aim", True)))
    goes = F.when(F.col("aim").isNull(), F.array(own)).otherwise(F.array(own, copy))
    sent = rows.withColumnRenamed("bucket", "own").select("k", "doc_id", "text", F.inline(goes))
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", F.desc("k"), "text").select("k", "bucket", "peek", "doc_id", "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rank = corpus_ranks(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def answers(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (bucket, peek, doc_id, text), the last one only as the next of the one before."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        changed = {i: edited(rows[i][3], rows[i + 1][3]) for i in own}
        needed = sorted({j for i in own for j in (i, i + 1)})
        h = features([_raw(rows[j][3]) for j in needed] + [_raw(changed[i]) for i in own], rank)
        chain = [filters(x) for x in h]
        of = {j: x for x, j in enumerate(needed)}
        out = []
        for x, i in enumerate(own):
            a, b, e = of[i], of[i + 1], len(needed) + x
            out.append((
                rows[i][2], len(rows[i][3]), hashlib.sha256(_raw(changed[i])).hexdigest(), text_form(h[a], chain[a]), text_form(h[e], chain[e]),
                likeness(chain[a], chain[e]), likeness(chain[a], chain[b]),
            ))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(column(b, c) for c in ("bucket", "peek", "doc_id", "text"))):
                if r[1] and held and held[-1][1] and held[-1][0] == r[0]:
                    continue  # one copy of the next bucket's first row is enough
                held.append(r)
                size += len(r[3])
                if size > 2 * BLOCK and len(held) > 1:
                    yield answers(held)
                    held, size = held[-1:], len(r[3])
        if len(held) > 1:
            yield answers(held)

    return with_next(docs).mapInArrow(run, schema)
