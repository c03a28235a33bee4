"""The trained operators: held-out accuracy, awkward rows, nothing to learn from."""
import itertools
import random

import numpy as np
import pandas as pd
import pytest

from veilspan.llm import cotraining, langkernel, toxicity
from veilspan.llm.queries import QUERIES

from . import edge

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, labels):
    got = QUERIES["op1_cotraining_quality"](spark, SF).toPandas()
    assert len(got) == 10000 and got.score.between(0, 1).all()
    test = got[got.held_out].merge(labels)
    assert test[test.quality == 1].keep.mean() > 0.98 and (~test[test.quality == 0].keep).mean() > 0.95


def test_toxicity_held_out(spark, labels):
    got = QUERIES["op5_convolution_toxicity"](spark, SF).toPandas()
    assert len(got) == 10000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    test = got[got.held_out].merge(labels)
    assert test[test.toxic == 1].predicted.mean() > 0.8 and test[test.toxic == 0].predicted.mean() < 0.02


def test_language_held_out(spark):
    got = QUERIES["op8_string_kernel_language"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "lang"]))
    assert len(got) == 10000 and got.score.between(0, 1).all()
    test = got[got.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.99


def test_awkward_rows(spark):
    df = edge.table(spark)
    named = langkernel.score(df, langkernel.fit(df)).collect()
    assert len(named) == len(edge.rows())
    assert {r.lang_pred for r in named if r.doc_id in (1, 2, 3, 8, 9)} == {"und"}
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 15)] + [(None, 0, 1), (3, None, None), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = cotraining.fit(df, marks)
    kept = cotraining.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() <= len(edge.rows())
    assert cotraining.scores(df, model).count() == len(edge.rows())
    toxic = toxicity.score(df, toxicity.fit(df, marks)).collect()
    assert len(toxic) == len(edge.rows()) and all(0 <= r.score <= 1 for r in toxic)


def test_nothing_to_learn_from(spark):
    df, none = edge.table(spark), edge.table(spark, [])
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.score == 1 for r in cotraining.scores(df, cotraining.fit(df, marks)).collect())
    assert cotraining.scores(none, cotraining.fit(none, marks)).collect() == []
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.score(df, toxicity.fit(df, marks)).collect())
    assert toxicity.score(none, toxicity.fit(none, marks)).collect() == []
    assert langkernel.score(none, langkernel.fit(none)).collect() == []
    assert all(r.lang_pred == "und" for r in langkernel.score(df, langkernel.fit(none)).collect())


def test_blocks_do_not_change_a_toxicity_score(monkeypatch):
    texts = [toxicity.parts_of(toxicity.words(t)) for t in ("good day to all of you", "you vile idiot", "nice words here", "vile and mean idiot")]
    net = toxicity.train(texts, __import__("numpy").array([0, 1, 0, 1]), epochs=2)
    text = edge.PROSE * 20 + "you vile idiot " + edge.PROSE * 20
    whole = toxicity.Scorer(net).score(text)
    monkeypatch.setattr(toxicity, "BLOCK", 300)
    assert abs(toxicity.Scorer(net).score(text) - whole) < 1e-6


def test_texts_scored_together_score_as_alone(monkeypatch):
    base = ["good day to all of you", "you vile idiot", "nice words here", "vile and mean idiot"] * 8
    texts, tags = [toxicity.parts_of(toxicity.words(t)) for t in base], ["en", "de"] * 16
    net = toxicity.train(texts, np.arange(32) % 2, epochs=2)
    toxicity.learn_languages(net, texts, tags)
    net.threshold = {"en": 0.3, "de": -0.2}
    odd = ["", " ", "1 2 _", "idiot", "Übel ärger", "日本 語", "vile " * 400, *base]
    monkeypatch.setattr(toxicity, "BLOCK", 900)  # one is read in blocks
    alone = [toxicity.Scorer(net).score(t) for t in odd]
    for size in (1, 40, 1 << 19):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        assert toxicity.Scorer(net).scores(odd) == alone
    assert toxicity.Scorer(net).scores([]) == []


def test_every_language_tag_is_learned(spark):
    """80 tags of a word each, the rarest ones at a tenth of the others: all of them are named."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(80)]
    rows = [(n * 100 + i, " ".join([w] * (3 + n)), f"t{i:02d}") for i, w in enumerate(words) for n in range(40 if i < 64 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langkernel.score(docs, langkernel.fit(docs)).collect()}
    assert {got[i] for i, _, _ in rows} == {f"t{i:02d}" for i in range(80)}


def test_no_language_with_enough_texts_is_left_out_of_the_thresholds():
    word = ["".join(c) for c in itertools.islice(itertools.product("abcdefg", repeat=5), 0, 4100, 100)]
    texts = [toxicity.parts_of([word[i]]) for i in range(41) for _ in range(15 if i < 40 else 3)]
    tags = [f"t{i}" for i in range(41) for _ in range(15 if i < 40 else 3)]
    net = toxicity.train(texts, np.arange(len(tags)) % 2, epochs=1)
    toxicity.learn_languages(net, texts, tags)
    assert sorted(net.languages) == sorted(["", *(f"t{i}" for i in range(40))])
    scorer = toxicity.Scorer(net)
    assert [scorer.raw(word[i])[1] for i in range(41)] == [f"t{i}" for i in range(40)] + [""]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Words that only one toxic text in 40 holds, and one behind 120,000 characters: all are learned, in several tasks."""
    odd = ["".join(c) for c in itertools.islice(itertools.product("bcdfg", repeat=6), 0, 15000, 375)]
    rows = [(i, f"good day to all {odd[i // 2 % 40] if i % 2 else 'people'} here", "en", i % 2) for i in range(8000)]
    rows += [(10_000 + i, "a calm word " * 10_000 + "zzyzzyx", "en", 1) for i in range(40)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "counted", lambda table, counted=toxicity.counted: seen.append(table.count()) or counted(table))
    net = toxicity.fit(docs, marks, epochs=2, per_task=1500)
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % 5
    assert seen == [sum(fold(r[0]) > 1 for r in rows)]
    scorer = toxicity.Scorer(net)
    assert all(scorer.score(f"good day {w}") > 0.5 for w in [*odd, "zzyzzyx"]) and scorer.score("good day to all people here") < 0.5


def test_long_texts_are_cut_for_training_without_a_change(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(0, toxicity.BUCKETS, (n, toxicity.PARTS)) for n in (0, 1, 2, 7, 40, 41)]
    state = toxicity.start(rnd.normal(0, 1, toxicity.BUCKETS))
    whole, under = toxicity.strongest(state, texts)
    scorer = toxicity.Scorer(state.network())
    logits = [scorer.raw_of(t)[0] for t in texts]
    assert np.allclose(logits, np.maximum(whole, 0) @ state.params[-2] + state.params[-1], atol=1e-4)
    for row, ids in enumerate(texts[1:], 1):
        pad = np.full((2, toxicity.PARTS), toxicity.PAD)
        x = state.emb[np.concatenate([pad, ids, pad])].sum(axis=1)
        for v, w in enumerate(toxicity.WIDTHS):
            z = [sum(x[a + j] @ state.params[v][j] for j in range(w)) for a in range(3 - w, len(ids) + 2)]
            assert np.allclose(np.max(z, axis=0), whole[row, v * toxicity.FILTERS : (v + 1) * toxicity.FILTERS], atol=1e-5)
    monkeypatch.setattr(toxicity, "STRETCH", 5)
    monkeypatch.setattr(toxicity, "GROUP", 12)
    again, there = toxicity.strongest(state, texts)
    assert np.allclose(whole, again, atol=1e-5) and all((a == b).all() for a, b in zip(under, there))
