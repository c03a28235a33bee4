"""Byte-level BPE and ORC token ids against the libraries."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from veilspan.llm import bpe, orcids, queries
from veilspan.llm.common import shared_folder

from . import edge

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(bpe.read_ranks(None, RANKS), public_tokenizers.PATTERN, limit=300)


def odd_texts():
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a  b", "a \n b", " a ", "a b ", "\n a", "don't we'll", "<|endoftext|> x", "foo\n bar", "x" * 3000, "é" * 400 + " ", "🙂🙂 🙂", "a\x1c b", "word,\nNext ...' ok'"]
    return texts + ["".join(rnd.choice(" \n\t ab1'!,.é 　\x1c\x85日") for _ in range(rnd.randint(0, 30))) for _ in range(1500)]


def test_perfect_hash_is_minimal_and_exact(own):
    assert sorted(own.whole.values) == sorted(own.ranks.values()) and None not in own.whole.keys
    assert all(own.whole.get(k) == v for k, v in own.ranks.items())
    assert own.whole.get(b"not a token at all") is None


def test_bpe_equals_library(own, library):
    for t in odd_texts():
        ids = own.encode(t).tolist()
        assert ids == library.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


def test_long_pre_token(own, library):
    assert own.encode("ab" * 20000).tolist() == library.encode_ordinary("ab" * 20000)


def test_piece_encoder_equals_library():
    texts = odd_texts()
    tok = Tokenizer.from_file(JSON)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    assert added
    texts = texts + [f"x {added[0]} y", added[0], f"a{added[0]}b  c\n{added[-1]} d e", f"plain words then {added[0]}."]
    enc = orcids.PieceEncoder(JSON, limit=200)
    got = [x for i in range(0, len(texts), 100) for x in enc.encode(texts[i : i + 100])]
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_remembered_pieces_are_never_listed():
    """A batch costs its own pieces, however many are remembered."""

    class Remembered(dict):
        def listed(self):
            raise AssertionError("all remembered pieces were listed")

        keys = __iter__ = items = values = listed

    enc, tok = orcids.PieceEncoder(JSON), Tokenizer.from_file(JSON)
    enc.young, enc.old = Remembered(), Remembered()
    texts = ["one two, three. été", "two three one, naïve?!", " one  two ", "日本 two", "two"]
    for _ in range(2):
        for t, raw in zip(texts, enc.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def brute_orc(docs):
    tok = Tokenizer.from_file(JSON)
    out, at = [], 0
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_orc_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.QUERIES["op2_orc_token_ids"](spark, SF).collect())
    assert got == brute_orc(docs)


def test_orc_awkward_rows_and_lookup(spark):
    data = sorted(((r[0], r[1] or "") for r in edge.rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    path = shared_folder(spark, "orc-test")
    orcids.write(edge.table(spark), path, JSON)
    got = sorted((tuple(r) for r in orcids.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == brute_orc(data)
    found = orcids.lookup(spark, path, [5, 6, 999])
    assert sorted(r.doc_id for r in found.collect()) == [5, 6, 6, 6]
    assert "PushedFilters: [In(doc_id, [5,6,999])]" in found._jdf.queryExecution().executedPlan().toString()
    none = shared_folder(spark, "orc-none")
    orcids.write(edge.table(spark, []), none, JSON)
    assert orcids.read_digests(spark, none).collect() == []


def test_round_trip_on_awkward_rows(spark, library):
    df = edge.table(spark)
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert out.columns == [c for c in df.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "round_trip"]
    back = bpe.decode(out, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r[1] or "").encode() for r in edge.rows())
    assert all(r.round_trip for r in back)
    want = sorted((r[0] or -1, hashlib.sha256(" ".join(map(str, library.encode_ordinary(r[1] or ""))).encode()).hexdigest()) for r in edge.rows())
    got = bpe.round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.ids_sha256) for r in got) == want
    assert bpe.round_trip_digests(edge.table(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []
