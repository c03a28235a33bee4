"""SimHash near-duplicates: fingerprints compared at the anchors of a covering code.

The 64 bits are two blocks of 31 and 33. Fingerprints at 4 or fewer differing bits differ in at most 2
bits of the first block or at most 1 of the second. Anchors of a block are the words of a perfect Hamming
code on 31 bits (the second block has two free bits more), covering radius 1: every block is within 1 of
exactly one anchor, its home. By the triangle inequality, a partner within t bits of the block is within
t + 1 of that home, so each fingerprint is replicated to all anchors within covering radius plus
threshold, and the pairs (home, visitor) of one anchor are compared on all 64 bits. No link is lost.

Equal fingerprints are one node. Fingerprints are first linked to the smallest of their home anchor; the
components of these stars then keep a large group of near copies from emitting its pairs, since a
comparison only yields links between different components.

Shingles, hash and majority are fixed: A-Z lower-cased, words between ASCII blanks, `width` words joined by
a blank, repeats counted, XXH64 with seed 42; a bit is 1 if set in over half the hashes. Fewer words: their
whole sequence; none (or NULL): fingerprint zero, linked like any other. Repeated rows share a component;
NULL identifiers only name a component that has no other. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, ids_and_texts, written
from veilspan.llm.components import components

CHUNK = 1 << 20
LEAST = -(1 << 63)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANE = (256 * np.arange(8, dtype=np.int64))[None, :]


def word_runs(raw: bytes, width: int) -> Iterator[list[bytes]]:
    """The words in stretches of about CHUNK bytes, each after the last `width` - 1 words of the one before."""
    at, carry = 0, []
    while at < len(raw):
        stop = min(len(raw), at + CHUNK)
        while stop < len(raw) and raw[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        words = carry + raw[at:stop].split()
        yield words
        carry, at = words[-(width - 1) :] if width > 1 else [], stop


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    return np.fromiter((digest(joined[a:b]) for a, b in cuts), np.uint64, len(words) - width + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + LANE
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()


def fingerprint(text: str, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    total, ones, last = 0, np.zeros(64, np.int64), []
    for words in word_runs(raw, width):
        last = words
        if len(words) >= width:
            h = shingle_hashes(words, width)
            total, ones = total + len(h), ones + bit_counts(h)
    if total == 0 and last:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(last), seed=42)], np.uint64)
        total, ones = 1, bit_counts(h)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, th, fp) of every row; th is a hash of the text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in column(b, "text")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])

    rows = ids_and_texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


# --- anchors -------------------------------------------------------------------------------------

LOW = np.uint64((1 << 31) - 1)


def _patterns(radius: int) -> list[np.ndarray]:
    """By syndrome: the error patterns of at most `radius` bits that lead to a word of the code."""
    by: list[list[int]] = [[] for _ in range(32)]
    for weight in range(radius + 1):
        for bits in combinations(range(1, 32), weight):
            s = 0
            for i in bits:
                s ^= i
            by[s].append(sum(1 << (i - 1) for i in bits))
    return [np.array(x, np.uint64) for x in by]


PATTERNS = [_patterns(r) for r in range(4)]
FREE = [(f, bin(f).count("1")) for f in range(4)]  # flips of the second block's two free bits


def syndrome(block: np.ndarray) -> np.ndarray:
    s = np.zeros(len(block), np.int64)
    for i in range(31):
        s ^= np.where(block >> np.uint64(i) & np.uint64(1), i + 1, 0)
    return s


def anchors(fp: np.ndarray, reach: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all anchors within reach[0] of the first block and reach[1] of the second; without
    `reach`, for the two home anchors."""
    rows, keys = [], []
    for second, radius in enumerate(reach or (1, 1)):
        block = fp >> np.uint64(31) if second else fp
        word, free, tag = block & LOW, (block >> np.uint64(31) if second else np.zeros_like(fp)), np.uint64(second << 33)
        s = syndrome(word)
        for flip, cost in FREE if second and reach else FREE[:1]:
            if cost > radius:
                continue
            for value in range(32):
                at, errors = np.flatnonzero(s == value), PATTERNS[radius - cost][value]
                if len(at) and len(errors):
                    code = (word[at, None] ^ errors[None, :]) | ((free[at, None] ^ np.uint64(flip)) << np.uint64(31)) | tag
                    rows.append(np.repeat(at, len(errors)))
                    keys.append(code.ravel())
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, np.uint64)])


def at_anchors(nodes: DataFrame, reach: tuple[int, int] | None = None) -> DataFrame:
    """(key, fp, label) for each row (fp, label) and anchor."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                fp, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows, keys = anchors(fp.astype(np.uint64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(fp[rows]), pa.array(label[rows])], names=["key", "fp", "label"])

    return nodes.select("fp", "label").mapInArrow(run, "key long, fp long, label long")


def differing(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def linked(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint of `nodes` under links of at most `bits` ≤ 4.

    Spark sizes the anchors' tables like the fingerprints they come from, up to 175 times too low, and would broadcast
    them; the merge hints make both sides meet by a shuffle at every size."""
    same = nodes.select("fp", F.col("fp").alias("label"))
    homes = at_anchors(same).select("key", "fp")
    least = homes.groupBy("key").agg(F.min("fp").alias("least"))
    stars = homes.join(least.hint("merge"), "key").where((F.col("fp") != F.col("least")) & (differing(F.col("fp"), F.col("least")) <= bits))
    near = components(stars.select(F.col("fp").alias("a"), F.col("least").alias("b")))
    labelled = written(nodes.select("fp").join(near, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label")), "labels")
    h = at_anchors(labelled).toDF("key", "h_fp", "h_label")
    v = at_anchors(labelled, (3, 2)).toDF("key", "v_fp", "v_label")
    links = h.join(v.hint("merge"), "key").where((F.col("h_fp") < F.col("v_fp")) & (F.col("h_label") != F.col("v_label")) & (differing(F.col("h_fp"), F.col("v_fp")) <= bits))
    far = components(links.select(F.col("h_label").alias("a"), F.col("v_label").alias("b")))
    return labelled.join(far, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("root", "label").alias("root"))


def groups(docs: DataFrame, width: int = 4, bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, fp), and per distinct fingerprint (fp, root, first, n)."""
    rows = written(fingerprints(docs, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return rows, linked(nodes.select("fp"), bits).join(nodes, "fp")


def near_groups(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """Every row: doc_id, fingerprint (16 hex digits), component_id, component_size (rows), near (its
    component has other fingerprints)."""
    rows, of = groups(docs, width, bits)
    whole = of.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"), (F.count("*") > 1).alias("near"))
    named = of.select("fp", "root").join(whole, "root").select("fp", "component_id", "component_size", "near")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size", "near")


def representatives(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """(__id, __th) of the row with the smallest doc_id of every component (of equal ids the one whose text hashes lowest). A
    NULL id counts as the smallest."""
    rows, of = groups(docs, width, bits)
    per_fp = rows.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("__id"), F.col("th").alias("__th"))).alias("row"))
    return of.select("fp", "root").join(per_fp, "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.__id", "row.__th")


def only(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of `docs` that `stay` names, repeats included."""
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "__th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return keyed.join(stay, ["__id", "__th"], "left_semi")


def keep_one(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """The representatives' rows (of rows alike in id and text, one), with all columns of `docs`."""
    return only(docs, representatives(docs, width, bits)).dropDuplicates(["__id", "__th"]).select(*docs.columns)
