"""Quality by co-training two views of a document.

Text view: frequencies of hashed byte trigrams of the whole text. Metadata view: what a crawler records
beside the words: source, language tag, length, and the page's layout (lines, word lengths, shares of
capitals, digits, signs and repeats). Each view has a logistic regression. Over `rounds`, each one names
the documents of an unlabelled pool it is surest of (as many of each class as their share), and these
pseudo-labels join the other view's training rows. Afterwards both are calibrated (Platt) on labelled
rows that neither was fitted on, and a document's score is their calibrated combination.

Bounds of the fit, documented parameters: about `labelled` rows per class and `pool` unlabelled rows, drawn
by a hash of the id. Everything is scored, from whole texts. NULL texts count as empty, NULL sources,
tags and lengths as a value of their own; without labels of both classes every score is 1 (all kept).
Quality 1 is good. Repeated rows score alike; labels given twice count once (the lower one).
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, fold_of, held_out, spread_hash
from veilspan.llm.sampling import bounded

TEXT_DIM, SOURCES, LANGS, LAYOUT = 2048, 32, 16, 14
BLOCK = 1 << 20


def text_view(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(TEXT_DIM, np.int64)
    for at in range(0, max(0, len(raw) - 2), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(65599) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(2654435761) >> np.uint32(21)
        counts += np.bincount(h, minlength=TEXT_DIM)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


CLASS = np.zeros(256, np.uint8)
CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1] = 1, 2
CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 3
CLASS[[9, 10, 11, 12, 13, 32]] = 4
CLASS[128:] = 5


def layout(text: str) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    kinds = sum((np.bincount(CLASS[raw[a : a + BLOCK]], minlength=6) for a in range(0, len(raw), BLOCK)), np.zeros(6, np.int64)) / n
    words = text.split()
    k = max(1, len(words))
    again = sum(map(str.__eq__, words[1:], words)) / k
    ends = sum(not w[-1].isalnum() for w in words) / k
    lines = text.split("\n")
    return [*kinds[1:].tolist(), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / k / 10, len(set(words)) / k, again, ends, len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0)), 1.0]


def metadata_view(source: str | None, lang: str | None, n_chars: int | None, page: list[float]) -> np.ndarray:
    x = np.zeros(SOURCES + LANGS + 2 + LAYOUT, np.float32)
    x[zlib.crc32(f"s{source}".encode()) % SOURCES] = 1
    x[SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGS] = 1
    x[SOURCES + LANGS : SOURCES + LANGS + 2] = (n_chars is None, np.log1p(max(0, n_chars or 0)) / 10)
    x[SOURCES + LANGS + 2 :] = page
    return x


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 250) -> Logistic:
    """Class-balanced, on standardised columns, by accelerated gradient steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    rate = 1 / (0.25 * float(np.linalg.eigvalsh((z.T * weight) @ z)[-1] if z.shape[1] <= 256 else _norm(z, weight)) + penalty + 0.25)
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    for t in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y)
        w2, b2 = v - rate * (z.T @ g + penalty * v), c - rate * float(g.sum())
        k = (t - 1) / (t + 2)
        v, c, w, b = w2 + k * (w2 - w), b2 + k * (b2 - b), w2, b2
    return Logistic(mean, scale, w.astype(np.float32), float(b))


def _norm(z: np.ndarray, weight: np.ndarray) -> float:
    u = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        u = z.T @ (weight * (z @ u))
        u /= max(1e-12, float(np.linalg.norm(u)))
    return 1.2 * float(np.linalg.norm(z.T @ (weight * (z @ u))))


def platt(f: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients (columns of f, then constant) of a logistic fit by damped Newton steps."""
    x = np.column_stack([f, np.ones(len(f))])
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 1e-3 * np.eye(x.shape[1])
        theta -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * theta), -2, 2)
    return theta


@dataclass
class TwoViews:
    text: Logistic | None
    page: Logistic | None
    each: list[np.ndarray]
    both: np.ndarray

    def score(self, a: np.ndarray, m: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.ones(len(a))
        views = np.column_stack([c[0] * f + c[1] for c, f in zip(self.each, (self.text(a), self.page(m)))])
        logit = views @ self.both[:-1] + self.both[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def co_train(a, m, y, calibrate, pool_a, pool_m, rounds: int = 5, grow: int = 40) -> TwoViews:
    """a, m: the two views of the labelled rows, y their classes, calibrate: rows kept for calibration."""
    if len(set(y[~calibrate].tolist())) < 2 or len(set(y[calibrate].tolist())) < 2:
        return TwoViews(None, None, [], np.zeros(0))
    views, pools, own = [a[~calibrate], m[~calibrate]], [pool_a, pool_m], y[~calibrate].astype(np.float32)
    extra = [(np.zeros(0, int), np.zeros(0, np.float32)) for _ in range(2)]
    left = np.arange(len(pool_a))
    good = float(own.mean())

    def fitted(v):
        return logistic(np.concatenate([views[v], pools[v][extra[v][0]]]), np.concatenate([own, extra[v][1]]))

    models = [fitted(0), fitted(1)]
    for _ in range(rounds):
        taken = set()
        for v in (0, 1):
            if not len(left):
                break
            f = models[v](pools[v][left])
            order = np.argsort(f, kind="stable")
            n_good = max(1, round(grow * good))
            high = [i for i in left[order[::-1][:n_good]] if models[v](pools[v][[i]])[0] > 0]
            low = [i for i in left[order[: max(1, grow - n_good)]] if models[v](pools[v][[i]])[0] < 0]
            rows, named = extra[1 - v]
            extra[1 - v] = (np.concatenate([rows, np.array(high + low, int)]), np.concatenate([named, np.array([1.0] * len(high) + [0.0] * len(low), np.float32)]))
            taken |= {*high, *low}
        left = np.array([i for i in left if i not in taken], int)
        models = [fitted(0), fitted(1)]
    truth = y[calibrate].astype(float)
    f = [models[0](a[calibrate]), models[1](m[calibrate])]
    each = [platt(x[:, None], truth) for x in f]
    both = platt(np.column_stack([c[0] * x + c[1] for c, x in zip(each, f)]), truth)
    return TwoViews(models[0], models[1], each, both)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in column(batch, "text")]
    a = np.array([text_view(t) for t in texts], np.float32).reshape(-1, TEXT_DIM)
    rows = zip(column(batch, "source"), column(batch, "lang"), column(batch, "n_chars"), texts)
    m = np.array([metadata_view(s, g, n, layout(t)) for s, g, n, t in rows], np.float32).reshape(-1, SOURCES + LANGS + 2 + LAYOUT)
    return a, m


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def _collected(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Views of a bounded sample: ids, class, text view, metadata view."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                a, m = _views(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(part.schema.get_field_index("class")), part.column(part.schema.get_field_index("fold")),
                     pa.array([r.astype(np.float16).tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())],
                    names=["doc_id", "class", "fold", "a", "m"],
                )

    got = sorted(rows.mapInArrow(run, "doc_id long, class int, fold int, a binary, m binary").collect(), key=lambda r: (str(r[0]), r["a"]))
    a = np.array([np.frombuffer(r["a"], np.float16) for r in got], np.float32).reshape(-1, TEXT_DIM)
    m = np.array([np.frombuffer(r["m"], np.float32) for r in got], np.float32).reshape(-1, SOURCES + LANGS + 2 + LAYOUT)
    return [r["fold"] for r in got], np.array([r["class"] for r in got], int), a, m


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 1500, pool: int = 3000, rounds: int = 5) -> TwoViews:
    """`labels`: doc_id, quality 0/1. Fold 0 is left out, fold 1 calibrates."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    fold = fold_of(F.col("doc_id")).cast("int").alias("fold")
    chosen = bounded(known.where(fold_of(F.col("doc_id")) != 0), F.col("quality"), labelled).select("doc_id", "class")
    inputs = _inputs(docs)
    train = inputs.join(chosen, "doc_id").select("doc_id", "text", "source", "lang", "n_chars", "class", fold)
    folds, y, a, m = _collected(train)
    n = docs.count()
    others = inputs.where(fold_of(F.col("doc_id")) != 0).where(spread_hash(F.lit("pool"), F.col("doc_id")) < pool / max(n, 1)).limit(2 * pool)
    others = others.join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text", "source", "lang", "n_chars", F.lit(-1).alias("class"), fold)
    _, _, pool_a, pool_m = _collected(others)
    return co_train(a, m, y, np.array(folds, int) == 1, pool_a, pool_m, rounds)


def scored(docs: DataFrame, model: TwoViews, name: str = "quality_score") -> DataFrame:
    """Every row of `docs` with the score (0 to 1) in a new column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                score = shared.value.score(*_views(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{name}` double")


def keep_good(docs: DataFrame, model: TwoViews, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all their columns, whose score is at least `least`."""
    return scored(docs, model, "__quality").where(F.col("__quality") >= least).select(*docs.columns)


def scores(docs: DataFrame, model: TwoViews, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, keep."""
    return scored(_inputs(docs), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= least).alias("keep")
    )
