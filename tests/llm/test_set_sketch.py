"""SetSketch near copies against all pairs by exact Jaccard of five-word shingles."""
import importlib
import random

import numpy as np
import pytest

from veilspan.llm import queries, setsketch

from . import edge


def shingles(text, width=5):
    words = edge.words(text)
    return frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([" ".join(words)] if words else [])


def alike(percent, empty=False):
    return lambda x, y: (empty and x == y) or bool(x & y) and 100 * len(x & y) >= percent * len(x | y)


def brute(data, percent):
    """(doc_id, n, component, kept) by an inverted index over the shingles: every pair that shares one is compared."""
    data = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in data]
    first = edge.classes_sharing(sets, alike(percent))
    return sorted(((i, len(s), data[c][0], i == data[c][0]) for (i, _), s, c in zip(data, sets, first)), key=repr)


def copies():
    """Texts, near copies on both sides of 0.8, a chain, a large group, one passage shared by many, short texts."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(200)]
    texts = [" ".join(base), "", "a b", "A  b", "a b c", None]
    for edits in [1, 2, 3, 4, 5, 6, 8] * 6:
        one = list(base) if rnd.random() < 0.5 else [word() for _ in range(rnd.choice([30, 120, 400]))]
        texts.append(" ".join(one))
        for at in rnd.sample(range(len(one)), min(edits, len(one) // 20)):
            one[at] = word()
        texts.append(" ".join(one))
    texts += [" ".join([word() for _ in range(n)] + passage) for n in range(5, 65, 3)]
    return list(enumerate(texts))


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_of_copies(spark, percent):
    data = copies()
    want = brute(data, percent)
    assert 10 < sum(r[3] for r in want) < len(data) - 10
    assert got(setsketch.near_groups(edge.plain(spark, data).repartition(5), percent=percent)) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op11_setsketch_near_dedup"](spark, sf)) == brute(data, 85)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "CROWDED", 0)  # every bucket is dealt by differences from its head
    data = copies()
    assert got(setsketch.near_groups(edge.plain(spark, data).repartition(5), percent=80)) == brute(data, 80)


def test_nodes_of_several_crowded_buckets_come_under_few_heads(spark, monkeypatch):
    """Near copies of one text, many below the bound: each is compared with about one head, not with one for every bucket."""
    rnd = random.Random(3)
    base, texts = [f"w{i}" for i in range(200)], []
    for _ in range(150):
        one = list(base)
        for at in rnd.sample(range(200), rnd.randint(1, 8)):
            one[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(one))
    seen, real = [], setsketch.differing
    monkeypatch.setattr(setsketch, "CROWDED", 0)
    monkeypatch.setattr(setsketch, "differing", lambda m, *rest: seen.append((m.count(), m.select("node").distinct().count())) or real(m, *rest))
    data = list(enumerate(texts))
    assert got(setsketch.near_groups(edge.plain(spark, data).repartition(5), percent=85)) == brute(data, 85)
    [(rows, nodes)] = seen
    assert nodes > 100 and rows < 1.2 * nodes


def test_texts_that_no_pair_wants_do_not_travel(spark):
    data = [(None if i == 7 else i % 900, f"text {i} " * 20) for i in range(1000)]
    docs = edge.plain(spark, data)
    rows = setsketch.known(docs).where("id IS NULL OR id IN (3, 44, 500)").selectExpr("id % 2 AS node", "id AS w_id", "th AS w_th")
    found = {(r.id, r.text) for r in setsketch.marked(docs, rows).select("id", "text").collect()}
    want = {(i, t) for i, t in data if i in (None, 3, 44, 500)}
    assert len(want) == 6 and want <= found and len(found) < 12
    assert setsketch.marked(docs, rows.limit(0)).count() == 0


def test_pipeline_stage_keeps_the_first_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = sorted((r.doc_id, r.text) for r in docs.collect())
    stage = importlib.import_module("corpus_pipeline").STAGES[2][1]
    first = {data[c][0] for c in edge.classes([shingles(t) for _, t in data], alike(80, empty=True))}
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(first)


def test_awkward_rows(spark):
    df = edge.table(spark)
    assert got(setsketch.near_groups(df)) == brute([(r[0], r[1]) for r in edge.rows()], 80)
    out = setsketch.keep_one(df)
    assert out.columns == df.columns
    data = sorted(((-1 if r[0] is None else r[0], r[1]) for r in edge.rows()), key=lambda r: r[0])
    first = edge.classes([shingles(t) for _, t in data], alike(80, empty=True))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == sorted(data[c][0] for c in set(first))
    assert setsketch.near_groups(edge.table(spark, [])).collect() == [] == setsketch.keep_one(edge.table(spark, [])).collect()


def test_repeated_rows_and_clashing_names(spark):
    rows = [(i, edge.PROSE, 1, 2) for i in (4, 4, 4, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id_4 int, node int")
    assert [tuple(r) for r in setsketch.keep_one(df).collect()] == [rows[0]]
    assert got(setsketch.near_groups(df)) == sorted([(4, 18, 4, True)] * 3 + [(9, 18, 4, False)], key=repr)


def pair(rng, n, similarity):
    both = round(2 * n * similarity / (1 + similarity))
    h = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
    return np.sort(h[:n]), np.sort(np.concatenate([h[:both], h[n : 2 * n - both]]))


def naive_points(hashes):
    """The least point of every register, shingle by shingle and point by point, without stopping early."""
    low = [float("inf")] * setsketch.REGISTERS
    for h in hashes:
        own = int(setsketch.mixed(np.array([h ^ setsketch.GOLD], np.uint64))[0])
        x = 0.0
        for j in range(setsketch.REGISTERS):
            with np.errstate(over="ignore"):
                bits = int(setsketch.mixed(np.array([h + np.uint64(j + 1) * setsketch.GOLD], np.uint64))[0]) >> 11
            x += -np.log((bits + 0.5) * 2.0**-53) / (setsketch.RATE * (setsketch.REGISTERS - j))
            at = (own % 256 + j * ((own >> 20) % 256 | 1)) % 256
            low[at] = min(low[at], x)
    return low


def test_registers():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 700):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert np.allclose(setsketch.least_points(h), naive_points(h), rtol=1e-9)
    a, b = pair(rng, 300, 0.4)
    assert (setsketch.registers(np.union1d(a, b)) == setsketch.merged(setsketch.registers(a), setsketch.registers(b))).all()
    assert (setsketch.registers(a[:0]) == 0).all()


def test_estimate_is_near_and_bands_find_the_alike():
    rng = np.random.default_rng(6)
    for similarity in (0.3, 0.6, 0.85):
        sketches = [[setsketch.registers(x) for x in pair(rng, 250, similarity)] for _ in range(100)]
        x, y = (np.array([s[k] for s in sketches]) for k in (0, 1))
        grid = np.linspace(0, 1, 201)
        size = np.full(100, 250.0)
        best = grid[setsketch.likelihoods((x > y).sum(axis=1), (x < y).sum(axis=1), size, size, grid).argmax(axis=1)]
        assert abs(best.mean() - similarity) < 0.02 and best.std() < 0.06
        met = [(setsketch.band_keys(a) == setsketch.band_keys(b)).any() for a, b in zip(x, y)]
        assert setsketch.may_reach(x, y, size, size, 85).all() == (similarity == 0.85)
        assert sum(met) == 100 if similarity == 0.85 else sum(met) < 80


def test_band_keys_of_unrelated_sets_differ():
    rng = np.random.default_rng(7)
    keys = np.concatenate([setsketch.band_keys(setsketch.registers(rng.integers(0, 1 << 63, 300).astype(np.uint64))) for _ in range(400)])
    assert len(np.unique(keys)) == len(keys)


@pytest.mark.parametrize("percent", [80, 85])
def test_differences_from_the_head_lose_no_pair(spark, percent):
    """Members around a head, half of their changes from a small pool: all alike pairs of different labels are found."""
    rnd = random.Random(percent)
    like = alike(percent)
    head = frozenset(range(200))
    pools = [(rnd.sample(range(200), 40), rnd.sample(range(1000, 1060), 40)) for _ in range(3)]
    sets = {0: head}
    for node in range(1, 150):
        gone, come = pools[node % 3]
        out = rnd.sample(gone, rnd.randint(0, 25)) + rnd.sample(range(200), rnd.randint(0, 4))
        sets[node] = (head - set(out)) | set(rnd.sample(come, rnd.randint(0, 25))) | {rnd.randrange(10**6, 10**9) for _ in range(rnd.randint(0, 5))}
    label = {n: 0 if like(s, head) else n for n, s in sets.items()}
    outside = [n for n in sets if label[n]]
    label |= {n: outside[0] for n in outside[:10]}
    members = spark.createDataFrame([(0, n, len(s), label[n]) for n, s in sets.items()], "head long, node long, n long, label long")
    table = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, set array<long>")
    found = {tuple(r) for r in setsketch.across(setsketch.differing(members, table, percent), percent, None)[0].collect()}
    want = {(a, b) for a in sets for b in sets if a < b and label[a] != label[b] and like(sets[a], sets[b])}
    every = {(a, b) for a in sets for b in sets if a < b and label[a] != label[b]}
    assert len(want) > 20 and want <= found and len(found) < len(every) * 0.8


def test_keys_of_sets_are_never_broadcast(spark, monkeypatch):
    """Spark takes exploded band keys, and the shingles that sets differ in, to be as small as what they come from."""
    plans, whole = {}, setsketch.written

    def seen(df, what):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, what)

    monkeypatch.setattr(setsketch, "written", seen)
    entries = spark.createDataFrame([(k, n, 9) for k in range(3) for n in range(5)], "key long, node long, n long")
    setsketch.stars(entries, 80)
    sets = spark.createDataFrame([(i, [1, 2, 3, 10 + i]) for i in range(5)], "node long, set array<long>")
    members = spark.createDataFrame([(0, i, 4, i) for i in range(5)], "head long, node long, n long, label long")
    plans["placed"] = setsketch.differing(members, sets, 80)._jdf.queryExecution().executedPlan().toString()
    assert all("SortMergeJoin" in plans[p] and "Broadcast" not in plans[p] for p in ("sketch-met", "placed"))
