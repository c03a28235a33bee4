"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded in that order and written as ORC: the ids are
an integer list column (run-length encoded and bit-packed by the format), each stripe carries row indexes
and a Bloom filter on doc_id. Readers take stripes in parallel, and a look-up by id skips the files,
stripes and row groups whose statistics or filters rule the id out.

Each row also holds `part` (the writing task) and `part_start` (ids before it in that task), so global
offsets come from one number per file. Every document ends with `end_id`. NULL texts count as empty and
get the end id alone; NULL identifiers come first; rows of one identifier are ordered by their text. An
empty table gives a readable, empty set of files.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.bpe import beside_blank
from veilspan.llm.common import column, ids_and_texts

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
SIGNS = ",.;:!?"


class PieceEncoder:
    """The tokenizers library, asked once for every piece between lone blanks and remembered in two
    bounded generations. Such a blank always begins a new pre-token, so the pieces' ids put together are
    the text's; texts with other blank runs, or with the literal of an added token, go to the library whole."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()  # a token's characters stand for a byte each
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ask_pieces(self, pieces: list[str], at_once: int = 2000) -> Iterator[bytes]:
        """Ids of pieces that follow a blank and hold none: many in one text, cut apart again by their bytes."""
        for k in range(0, len(pieces), at_once):
            text = " " + " ".join(pieces[k : k + at_once])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            bytes_of = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            ends = np.append(np.flatnonzero(bytes_of == 32)[1:], len(bytes_of))
            cut = (4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *cut], cut))

    def learn(self, new: set[str]) -> None:
        """Ask for pieces; signs after a last letter are a pre-token of their own and asked apart."""
        young, tails = self.young, self.tails
        stems = {p: x for p in new if p[-1] in SIGNS and (x := p.rstrip(SIGNS)) and x[-1].isalpha()}
        ask = [p for p in {*(new - stems.keys()), *stems.values()} if p not in young]
        young.update(zip(ask, self.ask_pieces(ask)))
        ends = [t for t in {p[len(x) :] for p, x in stems.items()} if t not in tails]
        tails.update(zip(ends, self.ask(ends)))
        young.update((p, young[x] + tails[p[len(x) :]]) for p, x in stems.items())
        if len(tails) > 10_000:
            self.tails = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        literal = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        parts = [[""] if i in literal else t.split(" ") for i, t in enumerate(texts)]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        # every piece is looked up once; only those that nobody remembers are looked at again
        flat = [p for x in parts for p in x[1:]]
        found = list(map(self.young.get, flat))
        gaps = list(compress(range(len(flat)), map(not_, found)))
        new = {flat[k] for k in gaps}
        kept = {p: ids for p in new if (ids := self.old.get(p)) is not None}
        self.young.update(kept)
        beside = {p for p in new if beside_blank(p)}
        self.learn(new - kept.keys() - beside)
        bounds = np.cumsum([0, *(len(x) - 1 for x in parts)])
        odd = literal | {i for i, x in enumerate(parts) if len(x) > 1 and x[0] and x[0][-1].isspace()}
        if beside:
            odd.update((np.searchsorted(bounds, [k for k in gaps if flat[k] in beside], "right") - 1).tolist())
        for k in gaps:
            found[k] = self.young.get(flat[k])
        odd = sorted(odd)
        whole = dict(zip(odd, self.ask([texts[i] for i in odd])))
        heads = list({x[0] for x in parts})
        first = dict(zip(heads, self.ask(heads)))
        cuts = bounds.tolist()
        return [whole[i] if i in whole else first[x[0]] + b"".join(found[a:b]) for i, (x, a, b) in enumerate(zip(parts, cuts, cuts[1:]))]


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return PieceEncoder(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order. `tokenizer` is installed at the same place on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, end = 0, TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = b.slice(k, 256)
                ids = encoder(tokenizer).encode(column(rows, "text"))
                n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(end.join([*ids, b""]))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([part] * len(n), pa.int32()), pa.array(at + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    rows = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    (
        encode(docs, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("orc.row.index.stride", 2000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """The rows of a few documents; the list of ids is pushed down to file, stripe and row-group metadata."""
    return read(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids before each file, from metadata columns alone; one row per file."""
    per_file = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return per_file.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    import zlib

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            cut = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(3)] + [pa.array(np.diff(cut).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(offsets(spark, path), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
