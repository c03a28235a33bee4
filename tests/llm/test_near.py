"""SimHash covering and improbable-feature digests against brute force."""
import hashlib
import random

import numpy as np
import pytest

from veilspan.llm import rarefeatures as R
from veilspan.llm import simhash
from veilspan.llm.queries import QUERIES

from . import edge


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_blocks_agree(monkeypatch):
    text = edge.PROSE * 40 + "A B\tC\x0bD\n\n E"
    want = edge.simhash(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO three") == edge.simhash("one two three") != 0


def test_every_pair_within_four_bits_meets():
    rnd = random.Random(3)
    for _ in range(3000):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            y ^= 1 << b
        home = set(simhash.anchors(np.array([x], np.uint64))[1].tolist())
        visit = set(simhash.anchors(np.array([y], np.uint64), (3, 2))[1].tolist())
        assert len(home) == 2 and home & visit


def test_linked_equals_all_pairs(spark):
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(300):  # chains and balls around them
        x = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys([*fps, 0, 1, 15, (1 << 64) - 1]))
    want = edge.classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {r.fp: r.root for r in simhash.linked(df).collect()}
    got = [root[signed(x)] for x in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_anchors_are_never_broadcast(spark, monkeypatch):
    """Spark takes them to be as small as the fingerprints, of which each has some 175."""
    plans, whole = [], simhash.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return whole(edges)

    monkeypatch.setattr(simhash, "components", seen)
    simhash.linked(spark.createDataFrame([(i << 20,) for i in range(50)], "fp long"))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_near_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [edge.simhash(t) for _, t in docs]
    want = {docs[i][0]: (f"{fps[i]:016x}", docs[c][0]) for i, c in enumerate(edge.classes(fps, lambda a, b: (a ^ b).bit_count() <= 4))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_near_dedup"](spark, sf).collect()}
    assert got == want


def test_near_on_awkward_rows(spark):
    df = edge.table(spark)
    out = simhash.near_groups(df).collect()
    assert len(out) == len(edge.rows())
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {1} and len(zero) == 5
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({r.component_id for r in out})  # one without an id stays for the texts without words
    assert simhash.near_groups(edge.table(spark, [])).collect() == [] and simhash.keep_one(edge.table(spark, [])).collect() == []


# --- digests ---------------------------------------------------------------------------------------


def slow_features(raw: bytes, rank) -> list[int]:
    """Straight from the definition."""
    n = len(raw) - 63
    es = []
    for i in range(max(0, n)):
        counts = np.bincount(np.frombuffer(raw[i : i + 64], np.uint8), minlength=256)
        es.append((R.FULL - sum(int(R.PART[c]) for c in counts)) * 1000 // R.FULL)
    votes = [0] * max(0, n)
    for s in range(-63, max(0, n)):
        ok = [(rank[es[p]], p) for p in range(max(0, s), min(n, s + 64)) if rank[es[p]] >= 0]
        if ok:
            votes[min(ok)[1]] += 1
    return [p for p, v in enumerate(votes) if v >= 16]


def test_features_equal_definition():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for n, k in ((0, 3), (1, 3), (63, 9), (64, 9), (65, 9), (400, 25), (900, 4), (300, 1))]
    counts = R.histogram(texts)
    assert counts.sum() == sum(max(0, len(t) - 63) for t in texts)
    rank = R.ranks(counts)
    for raw, h in zip(texts, R.features(texts, rank)):
        at = slow_features(raw, rank)
        b = np.frombuffer(raw, np.uint8)
        want = list(dict.fromkeys(R.hashed(b, np.array(at)).tolist())) if at else None
        assert want is None and len(h) == bool(raw) or h.tolist() == want


def test_blocks_do_not_change_a_digest(monkeypatch):
    t = bytes(np.random.default_rng(5).integers(97, 120, 20000).astype(np.uint8))
    rank = R.ranks(R.histogram([t]))
    whole = R.features([t], rank)[0]
    counts = R.histogram([t])
    monkeypatch.setattr(R, "BLOCK", 1500)
    assert (R.features([t], rank)[0] == whole).all() and (R.histogram([t]) == counts).all()


def test_likeness():
    rng = np.random.default_rng(6)
    a = R.filters(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    b = R.filters(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    none = R.filters(np.zeros(0, np.uint64))
    assert R.likeness(a, a) == 1 and R.likeness(a, b) < 0.1 and R.likeness(none, none) == 1 and R.likeness(a, none) == 0
    assert (R.parse(R.text_form(np.zeros(500), a)) == a).all()


def neighbours(data):
    """(row, next text) in descending id, NULL ids last, ties by text."""
    data = sorted(data, key=lambda r: r[1])
    data = sorted(data, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    return [(r, data[(i + 1) % len(data)][1]) for i, r in enumerate(data)]


@pytest.mark.parametrize("parts", ["2", "7"])
def test_edited_texts(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for data in ([(r[0], r[1] or "") for r in edge.rows()], [(i, f"text {i} " * (i % 7)) for i in range(90)], [(4, "alone")]):
            got = R.compare_with_edits(edge.plain(spark, data)).collect()
            want = sorted((i is None, i or 0, hashlib.sha256(R.edited(t, n).encode()).hexdigest()) for (i, t), n in neighbours(data))
            assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in got) == want
            for r in got:
                assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_digest_empty_table_and_equal_texts(spark):
    none = edge.table(spark, [])
    assert R.compare_with_edits(none).collect() == [] and R.fingerprints(none).collect() == []
    out = {}
    for r in R.fingerprints(edge.table(spark)).collect():
        out.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert out[5] <= out[6] and out[1] == out[2] == {"0:"} and len(out[4]) == 1


def test_half_edited_is_nearer_than_next(spark):
    got = QUERIES["op3_rare_feature_digest"](spark, "/root/testdata/sf0.001").where("n_chars > 400").collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)
    assert 0.3 < sum(r.near_edited for r in got) / len(got) < 0.7 and sum(r.near_next for r in got) / len(got) < 0.1
