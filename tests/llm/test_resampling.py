"""Importance resampling against SQL and a slow version from the definition."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from oracle_check import compare, connect
from veilspan.llm import queries, resampling

from . import edge


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest, buckets, percent, least):
    s = Counter(c % buckets for _, t in docs for c in runs(t, longest)[1])
    t = Counter(c % buckets for x in target for c in runs(x, longest)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, crcs = runs(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in crcs)
        out.append([i, words, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES["op12_prefix_crc_resampling"](spark, sf), connect(sf), queries.ORACLES["op12_prefix_crc_resampling"]) is None


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_of_several_words(spark, longest):
    rnd = random.Random(longest)
    some = ["Alpha", "beta", "señor", "x9", "the", "END", "日本", "a-b"]
    docs = [(i, " ".join(rnd.choice(some) for _ in range(rnd.randrange(60)))) for i in range(120)]
    target = [(0, "the the beta x9"), (1, None), (2, "señor, beta. the")]
    df = resampling.resample(edge.plain(spark, docs).repartition(4), edge.plain(spark, target), longest=longest, buckets=97, percent=30, least_words=5)
    assert got(df) == brute(docs, [t for _, t in target], longest, 97, 30, 5)


def test_crcs_come_from_prefixes():
    rnd = random.Random(1)
    for _ in range(100):
        words = [bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(40))]
        want = [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert resampling.run_crcs(words, 3).tolist() == want


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 13}" for i in range(100))
    whole = runs(text, 3)
    for block in (1, 2, 7, 99, 100, 101):
        monkeypatch.setattr(resampling, "BLOCK", block)
        parts = list(resampling.features(text, 3))
        assert sum(n for n, _ in parts) == whole[0] and sorted(c for _, x in parts for c in x.tolist()) == sorted(whole[1])


def test_awkward_rows(spark):
    df = edge.table(spark)
    docs = [(r[0], r[1]) for r in edge.rows()]
    for target in ([(1, "the lazy dog"), (2, None)], []):
        out = resampling.resample(df, edge.plain(spark, target), longest=2, buckets=1000, percent=50, least_words=2)
        assert got(out) == brute(docs, [t for _, t in target], 2, 1000, 50, 2)
    assert resampling.resample(edge.table(spark, []), df).collect() == []
