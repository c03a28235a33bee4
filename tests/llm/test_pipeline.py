"""The pipeline's stages against a brute-force version of each, on its own input."""
import base64
import importlib
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken

from veilspan.llm import cotraining, linedrop, queries

from . import edge
from .test_set_sketch import alike, shingles

SF = "/root/testdata/sf0.001"


def sql(text: str, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(text).df()


def test_stages(spark):
    stages = dict(importlib.import_module("corpus_pipeline").STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.toPandas()

    good = stages["quality classifier"](spark, docs, SF).toPandas()
    score = cotraining.scores(docs, cotraining.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).toPandas()
    assert set(good.doc_id) == set(score[score.score >= 0.5].doc_id) and list(good.columns) == list(start.columns)

    cut = stages["line dedup"](spark, spark.createDataFrame(good, docs.schema), SF).toPandas()
    want = sql(linedrop.SQL, good)
    assert dict(zip(cut.doc_id, cut.text)) == dict(zip(want.doc_id, want.text)) and list(cut.columns) == list(start.columns)
    assert (cut.n_chars == cut.text.str.len()).all()

    one = stages["near-dedup"](spark, spark.createDataFrame(cut, docs.schema), SF).toPandas()
    ordered = cut.sort_values("doc_id").reset_index(drop=True)
    first = {ordered.doc_id[c] for c in edge.classes([shingles(t) for t in ordered.text], alike(80, empty=True))}
    assert sorted(one.doc_id) == sorted(first) and list(one.columns) == list(start.columns)

    mixed = stages["mixing"](spark, spark.createDataFrame(one, docs.schema), SF).toPandas()
    want = sql(queries.ORACLES["op4_poisson_mixing"], one)
    assert Counter(mixed.doc_id) == Counter(want.doc_id) and list(mixed.columns) == list(start.columns)

    ids = stages["byte-level bpe"](spark, spark.createDataFrame(mixed, docs.schema), SF).toPandas()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(zip(mixed.doc_id, mixed.text))
    assert len(ids) == len(mixed) and ids.round_trip.all()
    assert all(list(r.ids) == library.encode_ordinary(text[r.doc_id]) for r in ids.itertuples())


def test_run_equals_its_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(r.doc_id for r in docs.collect()) == Counter(r.doc_id for r in pipeline.run(spark, SF).collect())


def test_near_stage_links_by_fingerprint(spark):
    """Texts that SimHash links though they share no shingle set at 0.8: same words, the tail of one in another order."""
    near = dict(importlib.import_module("corpus_pipeline").STAGES)["near-dedup"]
    word = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(600)]
    loop = " ".join(word[:40])
    docs = [(1, loop + " " + loop), (2, " ".join([loop] * 3)), (3, " ".join(word[300:380])), (4, None), (5, "")]
    prints = [edge.simhash(t) for _, t in docs]
    links = {(a, b) for a in range(5) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4}
    kept = {r.doc_id for r in near(spark, edge.plain(spark, docs), "").collect()}
    assert (4, 3) in links and not any(docs[a][0] in kept and docs[b][0] in kept for a, b in links)
    # far in shingles, equal in fingerprint: a long run of one shingle outvotes what follows it
    one = "same " * 400
    pair = [(1, one + " ".join(word[:150])), (2, one + " ".join(word[200:350]))]
    assert (edge.simhash(pair[0][1]) ^ edge.simhash(pair[1][1])).bit_count() <= 4
    assert [r.doc_id for r in near(spark, edge.plain(spark, pair), "").collect()] == [1]


def test_near_stage_moves_the_texts_once(spark):
    """No names are broadcast here, as with large tables: one exchange for them and one for the rows."""
    near = dict(importlib.import_module("corpus_pipeline").STAGES)["near-dedup"]
    docs = edge.plain(spark, [(i, f"a text of its own {i}") for i in range(20)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = near(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
