"""Byte-level BPE with the ranks of a vocabulary file: encoding and decoding in two tiers.

A text is cut by the splitting pattern into pre-tokens. Tier one: a minimal perfect hash over the
vocabulary answers for every pre-token that is itself a token. Tier two: the others are merged lowest
rank first, with a heap of candidate pairs over a doubly linked list of their bytes (n log n, so a
pre-token of a million letters is no trouble).

A single blank between two non-blanks always begins a pre-token, so texts are first cut there and
the pieces' ids are remembered in a bounded table; a text with other white space beside a blank goes
through the pattern whole. NULL texts count as empty (no ids).
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import MASK64, column, ids_and_texts

ODD = 0x9E3779B97F4A7C15


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank. `path` is a local file of the driver or anything Spark reads."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]  # as many as the vocabulary has tokens
    else:
        with open(path) as f:
            lines = f.read().split("\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys, n slots; a slot names the key's value."""

    def __init__(self, table: dict[bytes, int], load: int = 2):
        keys = list(table)
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // load)
        self.keys: list[bytes | None] = [None] * self.n
        self.values = array("q", [0]) * self.n
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = array("q", [0]) * self.buckets
        free = np.ones(self.n, bool)
        members: dict[int, list[int]] = {}
        for i, b in enumerate(bucket.tolist()):
            members.setdefault(b, []).append(i)
        spare: Iterator[int] | None = None
        for b, rows in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(rows) == 1:  # the last ones take what is left: a negative shift is the slot itself
                spare = spare or iter(np.flatnonzero(free).tolist())
                slots = np.array([next(spare)])
                self.shift[b] = -1 - int(slots[0])
            else:
                at, d = np.array(rows), 0
                while True:
                    slots = ((h[at] ^ np.uint64(d)) * np.uint64(ODD) >> np.uint64(32)) % np.uint64(self.n)
                    if free[slots].all() and len(set(slots.tolist())) == len(rows):
                        break
                    d += ODD >> 20
                self.shift[b] = d
            free[slots] = False
            for i, s in zip(rows, slots.tolist()):
                self.keys[s], self.values[s] = keys[i], table[keys[i]]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -1 - d if d < 0 else (((h ^ d) * ODD & MASK64) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost among equals, until no neighbouring pair is a token."""
    n, get = len(piece), ranks.get
    w = n.bit_length()
    low = (1 << w) - 1
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    # a candidate is one integer: rank, start, end
    heap = [(r << w | i) << w | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        c = heapq.heappop(heap)
        stop, i = c & low, c >> w & low
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        k = after[j]
        end[i], end[j], after[i] = stop, -1, k
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r << w | i) << w | end[k])
        if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r << w | p) << w | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class BesideBlank(Exception):
    """A cut at this blank would not be the pattern's."""


def beside_blank(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace()


class Remembered(dict):
    """Keys → ids as little-endian 32-bit bytes, in two generations of at most `limit` keys."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 250_000):
        self.ranks, self.pattern, self.limit = ranks, pattern, limit
        self.whole = PerfectHash(ranks)
        self.tokens = {i: t for t, i in ranks.items()}
        self._start()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "pattern", "limit", "whole", "tokens")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self):
        self.split = regex.compile(self.pattern).findall
        self.pre_tokens = Remembered(self._pre_token, self.limit)
        self.pieces = Remembered(self._piece, self.limit)

    def _pre_token(self, token: str) -> bytes:
        raw = token.encode("utf-8", "surrogatepass")
        if (whole := self.whole.get(raw)) is not None:
            return whole.to_bytes(4, "little")
        return array("I", merge_bytes(raw, self.ranks)).tobytes()

    def _piece(self, piece: str) -> bytes:
        if beside_blank(piece):
            raise BesideBlank
        return self._all(" " + piece)

    def _all(self, text: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace() and rest:
                raise BesideBlank
            raw = self._all(first) + b"".join(map(self.pieces.__getitem__, rest))
        except BesideBlank:
            raw = self._all(text)
        return np.frombuffer(raw, "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(spark: SparkSession, ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(spark, ranks_path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every row of `docs` without its text, with n_tokens, ids array<int> and round_trip (the ids decode to
    the text's bytes). Columns of these names in `docs` give way."""
    bpe = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, ranks_path, pattern))  # the vocabulary, a fixed size
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.value
        for b in batches:
            for at in range(0, b.num_rows, 256):  # small answers: ids take more room than their text
                part = b.slice(at, 256)
                texts = [t or "" for t in column(part, "text")]
                ids = [model.encode(t) for t in texts]
                same = [model.decode(x.tolist()) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
                counts = [len(x) for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in rest] + [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(same)],
                    names=[*rest, "n_tokens", "ids", "round_trip"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n_tokens long", "ids array<int>", "round_trip boolean"])
    return docs.select(*rest, F.col("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`encoded` with its ids turned back into bytes: column `decoded`; NULL ids give empty bytes."""
    bpe = encoded.sparkSession.sparkContext.broadcast(load(encoded.sparkSession, ranks_path, pattern))
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def run(batches):
        for b in batches:
            raw = [bpe.value.decode(x or ()) for x in column(b, "ids")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(raw, pa.binary())], names=[*rest, "decoded"])

    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    return encoded.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "decoded binary"]))


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text in one task: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bpe = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, ranks_path, pattern))

    def run(batches):
        model = bpe.value
        decimal = {i: str(i) for i in model.tokens}
        for b in batches:
            n, a, d = [], [], []
            for t in column(b, "text"):
                ids = model.encode(t).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
