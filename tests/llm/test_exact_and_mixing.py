"""Exact dedup, Poisson mixing and log-template lines: SQL, brute force and awkward rows."""
import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from oracle_check import compare, connect

from veilspan.llm import exactdedup, linedrop, mixing, queries

from . import edge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    groups = defaultdict(list)
    for r in edge.rows():
        groups[r[1] or ""].append(r[0])
    got = exactdedup.exact_groups(edge.table(spark), keep, fan_in=2).collect()
    assert len(got) == len(edge.rows())
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = of[r.text_sha256]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)


def test_hot_text_over_many_partitions(spark):
    df = edge.plain(spark, [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(600)]).repartition(17)
    got = {r.doc_id: r for r in exactdedup.exact_groups(df, fan_in=2).collect()}
    assert got[0].group_size == 200 and got[0].keep_id == 597 and not got[0].kept and got[597].kept and got[1].kept


def test_every_level_is_sorted_runs(spark):
    df = edge.plain(spark, [(i, "same" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]).repartition(17)
    for level in exactdedup.levels(df, fan_in=3):
        got = level.selectExpr("spark_partition_id() AS part", "monotonically_increasing_id() AS at", "*").collect()
        runs = [(r.part, r.shard, r.node, bytes(r.digest), r.n_bytes, r.check) for r in sorted(got, key=lambda r: (r.part, r["at"]))]
        assert runs == sorted(set(runs)) and sum(r.n for r in got) == 600
    assert len({r[1:3] for r in runs}) == len({r[1] for r in runs}) and len(runs) == len({"same" if i % 3 == 0 else f"t{i % 50}" for i in range(600)})


def test_a_run_goes_on_over_batches():
    entries = [(0, 0, bytes([i // 5]), 1, i // 5, i, 1) for i in range(23)]
    schema = pa.schema([("shard", pa.int32()), ("node", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int32()), ("check", pa.int64()), ("best", pa.int64()), ("n", pa.int64())])
    for size in (1, 2, 3, 7, 23):
        cut = [pa.RecordBatch.from_pylist([dict(zip(schema.names, e)) for e in entries[i : i + size]], schema=schema) for i in range(0, 23, size)]
        got = [tuple(r.values()) for b in exactdedup.folded(cut + [cut[0].slice(0, 0)]) for r in b.to_pylist()]
        assert got == [(0, 0, bytes([k]), 1, k, 5 * k, 5 if k < 4 else 3) for k in range(5)]


def test_empty_tables(spark):
    none = edge.table(spark, [])
    assert exactdedup.exact_groups(none).collect() == []
    assert mixing.replicate(none).collect() == []
    assert linedrop.drop_recurring(none).collect() == []


def test_poisson_mean_and_weights(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'0123456789' AS text", "'en' AS lang", "CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS source", "10L AS n_chars")
    n = Counter(r.source for r in mixing.replicate(df, {"a": 3.0, "b": 1.0}).select("source").collect())
    assert abs(n["a"] - 15000) < 500 and abs(n["b"] - 5000) < 300  # rates 3 and 1/3
    high = mixing.replicate(df.limit(1000), {"a": 1.0, "b": 0.0}, seed=3).groupBy("doc_id").count().collect()
    assert all(r["doc_id"] % 4 == 0 for r in high) and abs(sum(r["count"] for r in high) - 1000) < 120


def test_mixing_keeps_columns_and_order(spark):
    df = edge.table(spark)
    out = mixing.replicate(df, alpha=0.7)
    assert out.columns[: len(df.columns)] == df.columns
    again = [r.mix_order for r in out.collect()]
    assert again == [r.mix_order for r in mixing.replicate(df.repartition(5), alpha=0.7).collect()] or sorted(again) == sorted(r.mix_order for r in mixing.replicate(df.repartition(5), alpha=0.7).collect())
    assert all(r.rate == 2.0 for r in out.collect())


def test_templates_generalise_variable_fields(spark):
    names = "ana bob cyd dan eva fay gil hal".split()
    docs = [(i, f"one field too many {n} {n[::-1]}\nlogged in user {n} from the main office in town\npage {i} of 90") for i, n in enumerate(names)]
    got = {r.doc_id: r for r in linedrop.drop_recurring(edge.plain(spark, docs), min_docs=5).collect()}
    # the fourth token differs everywhere: a variable field found from the leaf; digits are variable from the start;
    # two fields in six tokens are over the fifth that may vary
    assert got[0].text == docs[0][1] and got[0].lines_dropped == 0
    for i, n in enumerate(names[1:], 1):
        assert got[i].text == f"one field too many {n} {n[::-1]}" and got[i].lines_dropped == 2


def test_too_short_or_too_rare_lines_stay(spark):
    docs = [(i, f"short line {w}\nonce {w}") for i, w in enumerate("ab cd ef gh ij kl".split())] + [(i, "shared by few") for i in range(10, 14)]
    assert all(r.lines_dropped == 0 for r in linedrop.drop_recurring(edge.plain(spark, docs), min_docs=5).collect())


def test_one_document_counts_once(spark):
    own = "\n".join(f"the section about {w} was reviewed by the whole board today" for w in "alpha beta gamma delta epsilon zeta".split())
    docs = [(0, own), (1, "an unrelated text"), (2, own.split("\n")[0]), (3, own.split("\n")[1])]
    got = linedrop.drop_recurring(edge.plain(spark, docs)).collect()
    assert {r.doc_id: r.text for r in got} == dict(docs) and all(r.lines_dropped == 0 for r in got)
    more = docs + [(i, f"the section about {w} was reviewed by the whole board today") for i, w in enumerate("eta theta iota".split(), 4)]
    kept = {r.doc_id: r.text for r in linedrop.drop_recurring(edge.plain(spark, more)).collect()}
    assert kept == {0: own.split("\n")[0], 1: "an unrelated text", **{i: "" for i in range(2, 7)}}


@pytest.mark.parametrize("n", [500, 50_000])
def test_a_template_recurs_alike_at_every_size(spark, n):
    name = "translate(cast(pmod(xxhash64(id, {}), 1000) AS string), '0123456789', 'abcdefghij')"
    line = f"concat('posted by ', {name.format(1)}, ' on behalf of the council from ', {name.format(2)}, ' and filed with it')"
    df = spark.range(n).selectExpr("id AS doc_id", f"{line} AS text")
    assert linedrop.drop_recurring(df).where("lines_dropped = 1").count() == n - 1


def test_short_lines_are_generalised(spark):
    docs = [(i, f"posted by {w} in lima") for i, w in enumerate("ana bob cyd dan eva".split())]
    assert sum(r.lines_dropped for r in linedrop.drop_recurring(edge.plain(spark, docs)).collect()) == 4


def test_lines_on_awkward_rows(spark):
    df = edge.table(spark)
    got = linedrop.drop_recurring(df, min_docs=2)
    assert got.columns == [*df.columns, "lines_dropped"]
    out = got.collect()
    assert len(out) == len(edge.rows())
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in edge.rows())
    assert [r.text for r in out if r.doc_id == 1] == [None]
    kept = [r.text for r in out if r.text == edge.PROSE * 3]
    assert len(kept) == 1  # the smallest doc_id's line stays


def test_lines_after_a_documents_first_count_for_their_tokens(spark):
    names = "ana bob cyd dan eva fay".split()
    odd = [" ".join(n[::-1] + c for c in "qwxyz") for n in names]  # every document's first line of the leaf
    docs = [(i, f"posted by {odd[i]}\nposted by {n} in lima town hall\nposted by {n} in lima town again") for i, n in enumerate(names)]
    got = {r.doc_id: r.text for r in linedrop.drop_recurring(edge.plain(spark, docs)).collect()}
    # six documents hold each token that is alike, though two lines of each do
    assert got == {0: docs[0][1], **{i: f"posted by {odd[i]}" for i in range(1, 6)}}
    few = [(i, t) for i, t in docs if i < 4]
    assert {r.doc_id: r.text for r in linedrop.drop_recurring(edge.plain(spark, few)).collect()} == dict(few)
