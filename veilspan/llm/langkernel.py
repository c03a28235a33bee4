"""Language identification with string kernels.

Kernel: blended-spectrum presence. Two texts are compared by the byte n-grams (n = 1, 2, 3 of the
lower-cased text, hashed to `DIM` places) that both hold, over the geometric mean of their numbers:
k(x, y) = |x ∧ y| / √(|x| |y|). Fitting: Nyström landmarks, the same number from every language, and
one-versus-rest kernel ridge regression on them. A text's decision values are its kernel row with the
landmarks times the dual weights; as the kernel is linear in presence vectors, landmarks and weights
are multiplied once and texts are scored by one matrix product per batch. Score: softmax of the decision values.

Fitted on about `per_language` rows of each language that `fold_of` does not hold out, and in all on `FIT_ROWS`
rows (documented bounds): beyond 64 languages each gives fewer rows and landmarks, but all are learned;
text alone is used for a prediction. NULL texts and texts without a letter: `und`, score 0; so too when
there is nothing to learn from. Rows of equal text are scored alike; whole texts are read.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, fold_of, held_out
from veilspan.llm.sampling import bounded

DIM = 1 << 13
SHARPNESS = 6.0
BLOCK = 1 << 20
FIT_ROWS, FIT_LANDMARKS = 32_000, 6_144  # 64 languages' worth
LETTER = re.compile(r"[^\W\d_]")


def presence(texts: list[str]) -> np.ndarray:
    """One row per text, 1.0 where it holds an n-gram of the place."""
    x = np.zeros((len(texts), DIM), np.float32)
    for row, text in enumerate(texts):
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(raw), BLOCK):
            b = raw[at : at + BLOCK + 2].astype(np.uint32)
            x[row, b] = 1  # single bytes have places of their own
            if len(b) > 1:
                two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1)
                x[row, 256 + (two * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(DIM - 256)] = 1
                three = two[:-1] * np.uint32(263) + b[2:]
                x[row, 256 + (three * np.uint32(2246822519) >> np.uint32(7)) % np.uint32(DIM - 256)] = 1
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class StringKernel:
    languages: list[str]
    weights: np.ndarray  # DIM × languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        named, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        for k in range(0, len(at), 128):
            some = at[k : k + 128]
            f = SHARPNESS * (unit(presence([texts[i] for i in some])) @ self.weights)
            p = np.exp(f - f.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, row in zip(some, p.argmax(axis=1).tolist(), p):
                named[i], scores[i] = self.languages[best], float(row[best])
        return named, scores


def ridge(x: np.ndarray, classes: list[str], landmarks: int, penalty: float) -> StringKernel:
    languages = sorted(set(classes))
    if not languages:
        return StringKernel([], np.zeros((DIM, 0), np.float32))
    landmarks = max(1, min(landmarks, FIT_LANDMARKS // len(languages)))
    labels, u = np.array(classes), unit(x)
    of = np.concatenate([np.flatnonzero(labels == c)[:landmarks] for c in languages])
    marks = u[of]
    k_nm, k_mm = (u @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    y = np.where(labels[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([1 / np.sum(labels == c) for c in labels])[:, None]  # languages weigh alike
    left = k_nm.T @ (share * k_nm) + penalty * k_mm + 1e-9 * np.eye(len(of))
    dual = np.linalg.lstsq(left, k_nm.T @ (share * y), rcond=None)[0]
    return StringKernel(languages, (marks.T @ dual).astype(np.float32))


def fit(docs: DataFrame, per_language: int = 500, landmarks: int = 96, penalty: float = 1e-3) -> StringKernel:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = rows.where((fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = bounded(known, F.col("lang"), per_language, FIT_ROWS).select("doc_id", "class", "text")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                bits = np.packbits(presence(column(part, "text")).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in bits], pa.binary())], names=["doc_id", "class", "bits"])

    got = sorted(sample.mapInArrow(run, "doc_id long, class string, bits binary").collect(), key=lambda r: (str(r["doc_id"]), r["class"], bytes(r["bits"])))
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in got], np.float32).reshape(-1, DIM)
    return ridge(x, [r["class"] for r in got], landmarks, penalty)


def score(docs: DataFrame, model: StringKernel) -> DataFrame:
    """Every row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM × languages numbers

    def run(batches):
        for b in batches:
            named, scores = shared.value.predict(column(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
