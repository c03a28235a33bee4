"""Toxicity with a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the lower-cased word and of its first 3, 4 and 5
letters. Filters of the widths 1, 2 and 3 run over the words, a ReLU and the maximum over the text give one
number per filter, a linear layer the logit. It is trained by Adam on mini-batches of every task; embeddings start with
one coordinate that holds the smoothed log-odds of the part in the training texts. Thresholds are
calibrated per language on a labelled fold the filters never saw: a text's language is guessed from its
words alone (a linear word model fitted beside the filters), and the score is shifted so that 0.5 is the
threshold of that language. Languages are not capped; those too rare in the fitted texts share the general threshold.

For scoring, embeddings times filters are tabulated per hashed part once; a batch's distinct words are
summed from it, and a text costs a gather and running maxima. Texts are read whole, in blocks that overlap
by the widest filter.

Fitted on every labelled row outside fold 0, whole texts: parts are counted by Spark, each epoch is one pass in
which every task trains on its rows and the changes are averaged, thresholds come from counts of all checked rows.
Labels, language tags, sources and ids are never inputs of a score. NULL and empty texts score as texts without words. Without both classes every score is 0. Rows of equal text score
alike; a document labelled twice counts once, as toxic if either label is.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, fold_of, held_out, shared_folder, written

BUCKETS, DIM, FILTERS, WIDTHS, PARTS = 1 << 15, 12, 8, (1, 2, 3), 4
PAD = BUCKETS  # a zero row around every text
BLOCK = 1 << 20  # characters
WORD = re.compile(r"[^\W\d_]+")
SIGNS = [zlib.crc32(x) for x in (b"=", b"3", b"4", b"5")]  # what a part's hash begins with: the whole word, its first letters
AT_ONCE = 1 << 19  # characters of the texts that are scored together


class Parts(dict):
    """Word → its hashed parts, as bytes of PARTS 32-bit numbers; a bounded table."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        heads = [raw[:k] for k in (3, 4, 5)] if len(raw) == len(word) else [word[:k].encode("utf-8", "surrogatepass") for k in (3, 4, 5)]
        crcs = [zlib.crc32(x, sign) % BUCKETS for x, sign in zip((raw, *heads), SIGNS)]
        self[word] = parts = pack("=4I", *crcs)
        return parts


PARTS_OF = Parts()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts_of(tokens: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(PARTS_OF.__getitem__, tokens)), np.uint32).reshape(-1, PARTS).astype(np.int64)


def summed(table: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The rows of the table that a word's parts name, added up."""
    out = table.take(parts[:, 0], axis=0)
    for j in range(1, PARTS):
        out += table.take(parts[:, j], axis=0)
    return out


@dataclass
class Network:
    emb: np.ndarray  # (BUCKETS + 1) × DIM
    filters: list[np.ndarray]  # width × DIM × FILTERS
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    word_language: np.ndarray | None = None  # BUCKETS × languages, log share
    threshold: dict[str, float] = field(default_factory=dict)
    general: float = 0.0

    def tabulate(self) -> np.ndarray:
        """Every part's contribution to every (filter, offset), then to every language."""
        flat = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
        table = self.emb @ flat
        if self.languages:
            tongue = np.vstack([self.word_language, np.zeros((1, len(self.languages)), np.float32)])
            table = np.concatenate([table, tongue], axis=1)
        return table.astype(np.float32)


class Scorer:
    def __init__(self, net: Network):
        self.net, self.table = net, net.tabulate()

    def pooled(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Filter maxima and summed language evidence of a stretch of words."""
        n_lang = len(self.net.languages)
        if not tokens:
            return np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(n_lang, np.float32)
        index: dict[str, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for w in tokens), np.int64, len(tokens))
        parts = parts_of(list(index))
        own = summed(self.table, parts)
        if n_lang:
            own[:, -n_lang:] = self.table[parts[:, 0], -n_lang:]
        seq = own[at]
        return self.strongest(seq), seq[:, sum(WIDTHS) * FILTERS :].sum(axis=0)

    def strongest(self, seq: np.ndarray) -> np.ndarray:
        """Every filter's maximum over words whose rows of the table are given."""
        best, c = [], 0
        for width in WIDTHS:
            padded = np.zeros((len(seq) + 2 * (width - 1), width * FILTERS), np.float32)
            padded[width - 1 : width - 1 + len(seq)] = seq[:, c : c + width * FILTERS]
            z = sum(padded[j : len(padded) - width + 1 + j, j * FILTERS : (j + 1) * FILTERS] for j in range(width))
            best.append(np.maximum(z.max(axis=0), 0))
            c += width * FILTERS
        return np.concatenate(best)

    def raw_of(self, parts: np.ndarray) -> tuple[float, str | None]:
        """`raw` of a text that is cut into parts already."""
        n_lang, edge = len(self.net.languages), max(WIDTHS) - 1
        best, tongue = np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(n_lang, np.float32)
        for k in range(0, len(parts), GROUP):
            some = parts[max(0, k - edge) : k + GROUP]
            best = np.maximum(best, self.strongest(summed(self.table, some)))
            tongue += self.table[parts[k : k + GROUP, 0], -n_lang:].sum(axis=0) if n_lang else 0
        return self.judged(best, tongue)

    def judged(self, best: np.ndarray, tongue: np.ndarray) -> tuple[float, str | None]:
        logit = float(best @ self.net.out + self.net.bias)
        return logit, self.net.languages[int(tongue.argmax())] if self.net.languages and tongue.any() else None

    def raw(self, text: str) -> tuple[float, str | None]:
        best, tongue, carry = np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(len(self.net.languages), np.float32), []
        at = 0
        while at < len(text) or at == 0:
            stop = min(len(text), at + BLOCK)
            while stop < len(text) and text[stop].isalpha():
                stop += 1
            tokens = carry + words(text[at:stop])
            b, t = self.pooled(tokens)
            best, tongue, carry = np.maximum(best, b), tongue + t, tokens[-(max(WIDTHS) - 1) :]
            at = stop
            if not text:
                break
        return self.judged(best, tongue)

    def raw_together(self, texts: list[str]) -> list[tuple[float, str | None]]:
        """`raw` of several texts of a block at most: two blank rows lie before each, so one pass gives all windows."""
        tokens = [words(t) for t in texts]
        index = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(tokens)), 1)}
        edge, n_lang, c = max(WIDTHS) - 1, len(self.net.languages), sum(WIDTHS) * FILTERS
        own = np.zeros((len(index) + 1, self.table.shape[1]), np.float32)  # row 0: blank
        if index:
            parts = parts_of(list(index))
            own[1:] = summed(self.table, parts)
            own[1:, c:] = self.table[parts[:, 0], c:]
        begin = np.cumsum([0, *(len(x) + edge for x in tokens)])
        at = np.zeros(begin[-1] + edge, np.int64)
        for x, k in zip(tokens, begin.tolist()):
            at[k + edge : k + edge + len(x)] = list(map(index.__getitem__, x))
        seq = own[at]
        windows, k = np.empty((begin[-1], FILTERS * len(WIDTHS)), np.float32), 0
        for v, width in enumerate(WIDTHS):
            cols = windows[:, v * FILTERS : (v + 1) * FILTERS]
            cols[:] = seq[: len(cols), k : k + FILTERS]
            for j in range(1, width):
                cols += seq[j : len(cols) + j, k + j * FILTERS : k + (j + 1) * FILTERS]
            k += width * FILTERS
        best = np.maximum(np.maximum.reduceat(windows, begin[:-1], axis=0), 0)
        tongue = [seq[a + edge : b, c:].sum(axis=0) if n_lang and b - a > edge else np.zeros(n_lang, np.float32) for a, b in zip(begin.tolist(), begin[1:].tolist())]
        return [self.judged(b, t) for b, t in zip(best, tongue)]

    def scores(self, texts: list[str]) -> list[float]:
        """`score` of many texts: those of a block at most are read in groups of AT_ONCE characters."""
        out, group, size = np.zeros(len(texts)), [], 0
        for i, t in enumerate(texts):
            if len(t) > BLOCK:
                out[i] = self.score(t)
                continue
            group.append(i)
            size += len(t)
            if size >= AT_ONCE or len(group) == 1024:
                out[group], group, size = self.risk(self.raw_together([texts[k] for k in group])), [], 0
        if group:
            out[group] = self.risk(self.raw_together([texts[k] for k in group]))
        return out.tolist()

    def risk(self, raw: list[tuple[float, str | None]]) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(logit - self.net.threshold.get(tongue, self.net.general), -30, 30)))) for logit, tongue in raw]

    def score(self, text: str) -> float:
        return self.risk([self.raw(text)])[0]


STRETCH, GROUP, CHUNK, BATCH = 8192, 1 << 16, 2048, 32  # words of a stretch and of a group; texts that are mixed, of a step
RANGE, FINE = 100, 1000  # logits are counted on a grid of 1 / FINE within ± RANGE
EXACT = float(1 << 32)  # changes are summed as whole numbers, so their order does not matter


def log_odds(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """n: 2 × BUCKETS texts of a class that hold a part, total: texts of a class."""
    total = np.maximum(1, total)
    odds = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    seen = n.sum(axis=0)
    return np.clip(odds * seen / (seen + 8), -4, 8)


def weights(total: np.ndarray) -> np.ndarray:
    """Both classes weigh the same, however many texts they have."""
    return 0.5 * total.sum() / np.maximum(1, total)


@dataclass
class State:
    """What training changes: embeddings with their squared gradients, and the rest with Adam's two means."""

    emb: np.ndarray
    emb_sq: np.ndarray
    params: list[np.ndarray]  # filters by width, out, bias
    means: list[np.ndarray]
    squares: list[np.ndarray]
    step: int = 0

    def small(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (*self.params, *self.means, *self.squares)])

    def with_small(self, flat: np.ndarray) -> None:
        at = 0
        for xs in (self.params, self.means, self.squares):
            for k, x in enumerate(xs):
                xs[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size

    def copy(self) -> State:
        return State(self.emb.copy(), self.emb_sq.copy(), *[[x.copy() for x in xs] for xs in (self.params, self.means, self.squares)], self.step)

    def network(self) -> Network:
        return Network(self.emb, self.params[: len(WIDTHS)], self.params[-2], float(self.params[-1][0]))


def start(odds: np.ndarray, seed: int = 5) -> State:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    emb[:-1, 0] = odds / 8
    emb[PAD] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = np.abs(f[0, 0, : FILTERS // 2]) + 0.5
    params = [*filters, rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.array([-1.0], np.float32)]
    return State(emb, np.full(BUCKETS + 1, 1e-4, np.float32), params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])


def stretches(texts: list[np.ndarray]):
    """Groups of (row, first window, words of the row, parts of a stretch between two more words or blanks): a long text is cut, so
    memory follows the group and not the text."""
    group, size, edge = [], 0, max(WIDTHS) - 1
    for row, ids in enumerate(texts):
        blank = np.full((edge, PARTS), PAD, np.int64)
        for k in range(0, len(ids) + edge if len(ids) else 0, STRETCH):
            lo, hi = k - edge, k + STRETCH
            own = [blank[: max(0, -lo)], ids[max(0, lo) : hi], blank[: max(0, min(hi, len(ids) + edge) - max(lo, len(ids)))]]
            group.append((row, k, len(ids), np.concatenate(own)))
            size += len(group[-1][3])
            if size >= GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def strongest(state: State, texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Every filter's maximum over each text, and the parts under that window: rows × width × FILTERS × PARTS."""
    edge = max(WIDTHS) - 1
    pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    under = [np.full((len(texts), w, FILTERS, PARTS), PAD, np.int64) for w in WIDTHS]
    each = np.arange(FILTERS)
    for group in stretches(texts):
        ids = np.concatenate([g[3] for g in group])
        x = summed(state.emb, ids)
        for v, width in enumerate(WIDTHS):
            cols = slice(v * FILTERS, (v + 1) * FILTERS)
            z = sum(x[j : len(x) - width + 1 + j] @ state.params[v][j] for j in range(width))
            base = 0
            for row, k, n, own in group:
                # windows by their first word, counted from `edge` blanks before the text
                lo, hi = max(k, edge - width + 1), min(k + STRETCH, edge + n, k + len(own) - width + 1)
                part = z[base + lo - k : base + hi - k]
                if len(part):
                    spot = part.argmax(axis=0)
                    best = part[spot, each]
                    better = best > pooled[row, cols]
                    pooled[row, cols] = np.where(better, best, pooled[row, cols])
                    for j in range(width):
                        under[v][row, j, better] = ids[base + lo - k + spot[better] + j]
                base += len(own)
    pooled[np.isinf(pooled)] = 0
    return pooled, under


def learn(state: State, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One step of Adam (embeddings: Adagrad) on a mini-batch."""
    pooled, under = strongest(state, texts)
    out, bias = state.params[-2], state.params[-1]
    act = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ out + bias[0], -30, 30)))
    g = (weight[y] * (p - y) / len(texts)).astype(np.float32)
    d_act = (g[:, None] * out[None, :]) * (pooled > 0)
    grads, touched, d_emb = [], [], []
    for v, width in enumerate(WIDTHS):
        d = d_act[:, v * FILTERS : (v + 1) * FILTERS]
        df = np.zeros_like(state.params[v])
        for j in range(width):
            df[j] = np.einsum("rfd,rf->df", state.emb[under[v][:, j]].sum(axis=2), d)
            touched.append(under[v][:, j].reshape(-1, PARTS))
            d_emb.append((d[:, :, None] * state.params[v][j].T[None, :, :]).reshape(-1, DIM))
        grads.append(df + 1e-4 * state.params[v])
    grads += [act.T @ g + 1e-3 * out, g.sum(keepdims=True)]
    state.step += 1
    for k, grad in enumerate(grads):
        state.means[k] = (0.9 * state.means[k] + 0.1 * grad).astype(np.float32)
        state.squares[k] = (0.999 * state.squares[k] + 0.001 * grad**2).astype(np.float32)
        change = rate * (state.means[k] / (1 - 0.9**state.step)) / (np.sqrt(state.squares[k] / (1 - 0.999**state.step)) + 1e-8)
        state.params[k] = (state.params[k] - change).astype(np.float32)
    delta = np.concatenate(d_emb)
    moved = delta.any(axis=1)
    used, inverse = np.unique(np.concatenate(touched)[moved], return_inverse=True)
    acc = np.zeros((len(used), DIM), np.float32)
    np.add.at(acc, inverse.reshape(-1), np.repeat(delta[moved], PARTS, axis=0))
    state.emb_sq[used] += (acc**2).sum(axis=1)
    state.emb[used] -= 0.02 * acc / np.sqrt(state.emb_sq[used])[:, None]
    state.emb[PAD] = 0


def epoch(state: State, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, rng) -> None:
    order = rng.permutation(len(texts))
    for k in range(0, len(order), BATCH):
        rows = order[k : k + BATCH]
        learn(state, [texts[i] for i in rows], y[rows], weight, rate)


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 5) -> Network:
    """The same on texts at hand: words × PARTS bucket numbers."""
    n, total = np.zeros((2, BUCKETS)), np.bincount(y, minlength=2)
    for p, label in zip(texts, y):
        n[label, np.unique(p)] += 1
    state, rng = start(log_odds(n, total), seed), np.random.default_rng(seed + 1)
    for _ in range(epochs):
        epoch(state, texts, y, weights(total), rate, rng)
    return state.network()


# ------------------------------------------------------------------ the same on every labelled row, by Spark
_SMALL = [f"d{i}" for i in range(DIM + 1)]  # a part's change and that of its squared gradient, or as many of the other numbers


def unpacked(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    texts = [np.frombuffer(p, np.uint16).reshape(-1, PARTS).astype(np.int64) for p in column(batch, "parts")]
    return texts, np.array(column(batch, "class"), int)


def cut(docs: DataFrame, known: DataFrame, per_task: int, most: int) -> DataFrame:
    """Parts of every text in `docs` with a class in `known`, in about one file for `per_task` rows and at most `most`, in an order that
    mixes the classes. Texts travel once: they are dealt by the key that the classes are joined on."""
    n = max(1, min(most, docs.select("doc_id").join(known, "doc_id").count() // per_task))

    def run(batches):
        for b in batches:
            parts = [parts_of(words(t)).astype(np.uint16).tobytes() for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parts, pa.binary())], names=["class", "checked", "lang", "parts"])

    rows = docs.repartition(n, "doc_id").join(known, "doc_id")
    mixed = rows.sortWithinPartitions(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("text")), "doc_id")
    table = mixed.select("class", (fold_of(F.col("doc_id")) == 1).alias("checked"), "lang", "text")
    schema, path = "class int, checked boolean, lang string, parts binary", shared_folder(docs.sparkSession, "toxic-parts")
    table.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def counted(table: DataFrame) -> DataFrame:
    """(what, bucket, n): texts of a class (what: its number) that hold a part, words of a language tag (what: = and the tag)."""

    def run(batches):
        held, tongues = np.zeros((2, BUCKETS), np.int64), {}
        for b in batches:
            for p, label, tag in zip(*unpacked(b), column(b, "lang")):
                held[label, np.unique(p)] += 1
                if tag:
                    n = tongues.setdefault(tag, np.zeros(BUCKETS, np.int64))
                    np.add.at(n, p[:, 0], 1)
        for what, n in [("0", held[0]), ("1", held[1]), *((f"={t}", n) for t, n in tongues.items())]:
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([what] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["what", "bucket", "n"])

    return table.mapInArrow(run, "what string, bucket int, n long")


def pass_over(table: DataFrame, state: State, weight: np.ndarray, rate: float, seed: int) -> State:
    """One epoch over all rows: every task steps through its rows from the same state; a number becomes the mean of the tasks that changed
    it, so a part that one task has seen keeps that task's change."""
    shared = table.sparkSession.sparkContext.broadcast((state, weight))

    def run(batches):
        (first, w), rng = shared.value, np.random.default_rng(seed)
        own, texts, labels = first.copy(), [], []

        def learned():
            epoch(own, texts, np.array(labels, int), w, rate, rng)
            texts.clear()
            labels.clear()

        for b in batches:
            for p, label in zip(*unpacked(b)):
                texts.append(p)
                labels.append(label)
                if len(texts) == CHUNK or sum(map(len, texts[-BATCH:])) > 32 * STRETCH:
                    learned()
        if texts:
            learned()
        if own.step == first.step:
            return
        change = np.concatenate([own.emb - first.emb, (own.emb_sq - first.emb_sq)[:, None]], axis=1)
        at = np.flatnonzero(change.any(axis=1))
        small = own.small() - first.small()
        small = np.append(np.concatenate([small, [own.step - first.step]]), np.zeros(-(len(small) + 1) % len(_SMALL))).reshape(-1, len(_SMALL))
        keys = np.concatenate([at, -1 - np.arange(len(small))]).astype(np.int32)
        whole = np.rint(np.concatenate([change[at], small]).astype(np.float64) * EXACT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c) for c in whole.T)], names=["key", *_SMALL])

    changes = table.select("class", "parts").mapInArrow(run, "key int, " + ", ".join(f"{c} long" for c in _SMALL))
    means = changes.groupBy("key").agg(*[(F.sum(c) / F.count(F.lit(1)) / EXACT).alias(c) for c in _SMALL])
    got = np.array([tuple(r) for r in means.collect()], np.float64)  # as many rows as the model has parts
    new = state.copy()
    if not len(got):
        return new
    keys, mean = got[:, 0].astype(np.int64), got[:, 1:]
    parts = keys >= 0
    new.emb[keys[parts]] += mean[parts, :DIM].astype(np.float32)
    new.emb_sq[keys[parts]] += mean[parts, DIM].astype(np.float32)
    flat = mean[~parts][np.argsort(-keys[~parts])].reshape(-1)
    small = state.small()
    new.with_small(small + flat[: len(small)])
    new.step += int(round(flat[len(small)]))
    return new


def name_languages(net: Network, texts_of: dict[str, int], words_of: dict[str, np.ndarray], least: int = 15) -> None:
    """Word shares of every language tag with `least` fitted texts or more, however many tags those are; rarer tags share one
    nameless column (with fewer texts no threshold of their own could be set) and get the general threshold."""
    known = sorted((t for t, n in texts_of.items() if n >= least), key=lambda t: (-texts_of[t], t)) + [""] * any(n < least for n in texts_of.values())
    at = {t: i for i, t in enumerate(known)}
    counts = np.full((BUCKETS, len(known)), 0.5)
    for t, n in words_of.items():
        counts[:, at[t if texts_of[t] >= least else ""]] += n
    share = np.log(counts / counts.sum(axis=0))
    net.languages, net.word_language = known, (share - share.mean(axis=1, keepdims=True)).astype(np.float32)


def learn_languages(net: Network, texts: list[np.ndarray], tags: list[str | None], least: int = 15) -> None:
    """The same on texts at hand."""
    n = Counter(t for t in tags if t)
    own = {t: np.zeros(BUCKETS) for t in n}
    for p, t in zip(texts, tags):
        if t:
            np.add.at(own[t], p[:, 0], 1)
    name_languages(net, n, own, least)


def best_threshold(logit: np.ndarray, clean: np.ndarray, toxic: np.ndarray, false_cost: float = 1.5) -> float:
    """The middle of the gap whose cut costs least, from ascending logits and the texts of each class there; labelled texts hold too few
    clean ones, so a false alarm counts `false_cost` times a miss."""
    missed, false = np.concatenate([[0], np.cumsum(toxic)]), clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    errors = missed + false_cost * false
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[logit[0] - 1], (logit[1:] + logit[:-1]) / 2, [logit[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def calibrate(net: Network, rows: DataFrame, least: int = 15) -> None:
    """Thresholds over every row of the checked fold: logits are counted on a fine grid, so a language is as many rows as the grid has."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            texts, label = unpacked(b)
            raw = [scorer.raw_of(p) for p in texts]
            level = [int(round(min(RANGE, max(-RANGE, logit)) * FINE)) for logit, _ in raw]
            yield pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in raw], pa.string()), pa.array(level, pa.int32()), pa.array(label, pa.int32())], names=["tongue", "level", "class"])

    def threshold(part):
        part = part.sort_values("level")
        clean, toxic = part["clean"].to_numpy(), part["toxic"].to_numpy()
        best = best_threshold(part["level"].to_numpy() / FINE, clean, toxic)
        return part.iloc[:1][["tongue"]].assign(threshold=best, clean=clean.sum(), toxic=toxic.sum())

    raw = rows.select("class", "parts").mapInArrow(run, "tongue string, level int, class int")
    grid = raw.groupBy("tongue", "level").agg(F.count_if(F.col("class") == 0).alias("clean"), F.count_if(F.col("class") == 1).alias("toxic"))
    cells = "tongue string, level int, clean long, toxic long"
    grid = written(grid.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in cells.split(", ")]), "toxic-grid")
    every = grid.groupBy("level").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = grid.unionByName(every.select(F.lit(None).cast("string").alias("tongue"), "level", "clean", "toxic"))
    found = both.groupBy("tongue").applyInPandas(threshold, "tongue string, threshold double, clean long, toxic long")
    for r in found.collect():  # a row for every language, and one for all
        if r["tongue"] is None:
            net.general = r["threshold"]
        elif r["tongue"] and min(r["clean"], r["toxic"]) >= least:
            net.threshold[r["tongue"]] = r["threshold"]


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 6, rate: float = 0.01, seed: int = 5, per_task: int = 4000, tasks: int = 128) -> Network | None:
    """On every labelled row outside fold 0, whole texts: fold 1 sets the thresholds, the others train."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("class"))
    known = known.where(fold_of(F.col("doc_id")) != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    every = cut(rows.where(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0)), known, per_task, tasks)
    table = every.where(~F.col("checked"))
    tags = table.groupBy("class", "lang").count().collect()  # two rows for every language
    total = np.array([sum(r["count"] for r in tags if r["class"] == c) for c in (0, 1)])
    if not total.all():
        return None
    held, own, texts_of = np.zeros((2, BUCKETS)), {}, Counter()
    for what, bucket, n in counted(table).groupBy("what", "bucket").agg(F.sum("n").alias("n")).collect():  # as many as the model's cells
        if what.startswith("="):
            own.setdefault(what[1:], np.zeros(BUCKETS))[bucket] = n
        else:
            held[int(what), bucket] = n
    for r in tags:
        if r["lang"]:
            texts_of[r["lang"]] += r["count"]
    state = start(log_odds(held, total), seed)
    for k in range(epochs):
        state = pass_over(table, state, weights(total), rate, seed + 1 + k)
    net = state.network()
    name_languages(net, texts_of, own)
    calibrate(net, every.where("checked"))
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """Every row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # BUCKETS × DIM numbers and some

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            s = scorer.scores([t or "" for t in column(b, "text")]) if scorer else [0.0] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
