"""Quality classifier: naive Bayes support vectors.

Indicators of hashed character n-grams are scaled by the class log-count ratio of the
training rows and normalised to length 1; a linear model with squared hinge loss is fitted
to them by dual coordinate descent. Scores are margins passed through a sigmoid whose two
parameters are fitted on out-of-fold margins.

The model is fitted on at most ``sample`` labelled rows, the first by a hash of doc_id, from
outside the held-out fold; its size is fixed by ``2 ** bits``. Every document is scored, over
its whole text, in one map over the table without a shuffle; only the fixed-size weights are sent out.

Null and empty texts have no n-grams: their score is that of a zero vector. Labels without a
document, null labels and null ids are ignored; of repeated labels the largest counts. Without rows of both
classes every score is 0.5. Repeated documents are scored each on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

BITS = 18
ORDERS = (1, 2, 3, 4)
SAMPLE = 4000
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct hashed byte n-grams of a text; letters keep their case, digits count as one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int32)
    codes = np.where((raw >= 0x30) & (raw <= 0x39), 0x30, raw).astype(np.uint64)
    found, gram = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        gram = (gram[: len(codes) - n + 1] << np.uint64(8)) | codes[n - 1 :]
        if n in ORDERS:
            found.append(((gram + np.uint64(n << 40)) * _MIX) >> np.uint64(64 - bits))
    if len(codes) << 4 < 1 << bits:  # sorting few numbers costs less than a flag for each possible one
        return np.unique(np.concatenate(found)).astype(np.int32)
    seen = np.zeros(1 << bits, bool)
    for x in found:
        seen[x] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class NbSvm:
    """weights already hold the log-count ratios; a and b map a margin to a score."""

    ratio: np.ndarray
    weights: np.ndarray
    a: float
    b: float

    def margin(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratio[ids]).sum())) if len(ids) else 0.0
        return float(self.weights[ids].sum()) / norm + float(self.weights[-1]) if norm else float(self.weights[-1])

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.a * margin + self.b, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float = 1.0) -> np.ndarray:
    p, q = np.full(size, smoothing), np.full(size, smoothing)
    for ids, positive in zip(rows, y > 0):
        (p if positive else q)[ids] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """L2-regularised squared hinge loss; weights with the bias last. Each class carries half of the cost."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    share = {s: len(y) / 2.0 / max(1, int((y == s).sum())) for s in (1.0, -1.0)}
    diagonal = np.array([0.5 / (cost * share[s]) for s in y])
    norms = np.array([np.square(v).sum() + 1.0 for v in values]) + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0 + diagonal[i] * alpha[i]
            projected = min(gradient, 0.0) if alpha[i] == 0 else gradient
            worst = max(worst, abs(projected))
            if projected:
                step = max(alpha[i] - gradient / norms[i], 0.0) - alpha[i]
                alpha[i] += step
                w[rows[i]] += (step * y[i]) * values[i]
                w[-1] += step * y[i]
        if worst < tolerance:
            break
    return w


def _fit_margin(rows: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    ratio = log_count_ratio(rows, y, size)
    values = [((v := ratio[ids]) / max(float(np.sqrt(np.square(v).sum())), 1e-12)).astype(np.float32) for ids in rows]
    w = dual_coordinate_descent(rows, values, y, size)
    return ratio, np.append(w[:-1] * ratio, w[-1])


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> NbSvm:
    """y: 1 and -1. The sigmoid is fitted on two halves, each scored by the other's model."""
    size = 1 << bits
    if not len(y) or (y == y[0]).all():
        return NbSvm(np.zeros(size), np.zeros(size + 1), 1.0, 0.0)
    margins = np.zeros(len(y))
    for fold in (0, 1):
        train, test = np.flatnonzero(np.arange(len(y)) % 2 != fold), np.flatnonzero(np.arange(len(y)) % 2 == fold)
        if (y[train] == y[train[:1]]).all():
            continue
        half = NbSvm(*_fit_margin([rows[i] for i in train], y[train], size), 1.0, 0.0)
        margins[test] = [half.margin(rows[i]) for i in test]
    a, b = _platt(margins, y)
    return NbSvm(*_fit_margin(rows, y, size), a, b)


def _platt(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method on the log loss of sigmoid(a * margin + b), targets drawn in from 0 and 1."""
    n, p = int((y < 0).sum()), int((y > 0).sum())
    target = np.where(y > 0, (p + 1.0) / (p + 2.0), 1.0 / (n + 2.0))
    x = np.stack([margins, np.ones(len(y))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        prob = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (prob - target) + 1e-6 * theta
        step = np.linalg.solve((x * (prob * (1 - prob))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> NbSvm:
    """Fits on at most ``sample`` labelled documents. Their texts become n-gram numbers on the executors."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def encode(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "ids": [features(t, bits).tobytes() for t in batch["text"]]})

    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` narrow rows
    got = joined.mapInPandas(encode, "doc_id bigint, quality int, ids binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return fit([np.frombuffer(r["ids"], np.int32) for r in got], np.array([1.0 if r["quality"] == 1 else -1.0 for r in got]), bits)


def score(documents: DataFrame, model: NbSvm, bits: int = BITS, text: str = "text") -> DataFrame:
    """All columns of documents and ``score``, which replaces a column of that name; put columns to be kept into a struct. text: the column or field scored."""
    sent = documents.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float32), model.weights.astype(np.float32), model.a, model.b))
    documents = documents.drop("score")

    def run(texts: pd.Series) -> pd.Series:
        own = NbSvm(*sent.value)
        return pd.Series([own.score(own.margin(features(t, bits))) for t in texts], dtype="float64")

    return documents.withColumn("score", F.pandas_udf(run, "double")(text))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    return score(documents, train(documents, labels, sample)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(documents, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
