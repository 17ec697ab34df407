"""Quality classifier from positives and unlabelled text (non-negative PU learning).

Trusted positives are texts labelled 1 in the learning folds; unlabelled texts are drawn
from all documents of those folds, whatever their labels. A first model tells the two
apart and gives the share of positives among the unlabelled (the least ratio of the two
tails of its scores, best-bin estimation). The second minimises the non-negative unbiased
risk  prior * R_p+ + max(0, R_u- - prior * R_p-)  by mini-batches; where the part in the
maximum falls below zero, its gradient is taken back instead. Both samples are bounded
(POSITIVES, UNLABELLED); every document is scored.

Scores use the text alone. Edge cases: a null text is an empty one and is scored; null or
missing labels teach nothing; several labels of one document count as one; a null doc_id
is never held out; repeated rows are scored each and alike; very long texts are measured
whole; a score of exactly 0.5 predicts 1; without a positive every score is 0.5; with fewer
than 20 positives or unlabelled texts the prior cannot be estimated and is 0.5, and an
estimate outside 0.05 to 0.98 is taken as that bound; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, table
from .quality_rules import measure

#: Texts that the driver learns from, at most: the documented bound of the training sample.
POSITIVES, UNLABELLED = 8_000, 16_000
FOLDS, HELD_OUT, SEED = 3, 1, 11
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 512, 0.005


def featurize(text: str | None) -> np.ndarray:
    """Shares of ASCII characters and of bytes beyond them, and shapes of words and lines."""
    text = text or ""
    b = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(b, minlength=256).astype(np.float64)
    n_words, chars, symbols, lines, dups, repeats = measure(text)
    words, total = max(n_words, 1), max(len(b), 1)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    letters = max(upper + lower + counts[128:].sum(), 1)
    shape = [
        np.log1p(n_words), chars / words / 10, min(symbols / words, 3), dups / max(lines, 1), repeats / words,
        upper / letters, digits / letters, counts[33] / words, counts[124] / words, lines / words * 10,
        np.log1p(lines), float(n_words < 50), counts[128:].sum() / total, lower / total,
    ]
    return np.concatenate((np.sqrt(counts[32:127] / total), shape))


WIDTH = 95 + 14


class Network:
    """One hidden layer; numpy, a few kilobytes."""

    def __init__(self, width: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((width, HIDDEN)) / np.sqrt(width), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.first, self.second, self.steps = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0

    def standardize(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, h @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -50, 50)))

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step along the gradient whose derivative by each output is slope."""
        z, h, _ = self.forward(x)
        back = slope[:, None] * self.w[2][None, :] * (1 - h * h)
        grads = [z.T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]
        self.steps += 1
        for w, m, v, g in zip(self.w, self.first, self.second, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _batches(n: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(n)
    for i in range(0, n, BATCH):
        yield order[i : i + BATCH]


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS) -> Network:
    """Minimise the non-negative PU risk with the sigmoid loss l(z) = 1 / (1 + exp(z))."""
    net, rng = Network(unl.shape[1]), np.random.default_rng(SEED)
    net.standardize(np.vstack((pos, unl)))
    for _ in range(epochs):
        for u in _batches(len(unl), rng):
            p = rng.integers(0, len(pos), max(1, min(len(pos), BATCH)))
            x = np.vstack((pos[p], unl[u]))
            s = 1 / (1 + np.exp(-np.clip(net.forward(x)[2], -50, 50)))
            d = s * (1 - s)
            sp, su, dp, du = s[: len(p)], s[len(p) :], d[: len(p)], d[len(p) :]
            negative = su.mean() - prior * sp.mean()  # risk of calling negatives positive
            by_u, by_p = du / len(u), prior * dp / len(p)
            slope = np.concatenate((-by_p - by_p, by_u)) if negative >= 0 else np.concatenate((by_p, -by_u))
            net.step(x, slope)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled, by best-bin estimation on halves that the separating model has not seen."""
    rng = np.random.default_rng(SEED + 1)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    if min(len(pos), len(unl)) < 20:
        return 0.5
    hp, hu = len(pos) // 2, len(unl) // 2
    net = Network(unl.shape[1], SEED + 2)
    x = np.vstack((pos[:hp], unl[:hu]))
    y = np.concatenate((np.ones(hp), np.zeros(hu)))
    weight = np.where(y == 1, 0.5 / hp, 0.5 / hu) * len(y)
    net.standardize(x)
    for _ in range(12):
        for i in _batches(len(y), rng):
            net.step(x[i], (net.score(x[i]) - y[i]) * weight[i] / len(i))
    sp, su = np.sort(net.score(pos[hp:])), np.sort(net.score(unl[hu:]))
    cuts = np.unique(sp)
    tail_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(20) / 2 / len(sp)) + np.sqrt(np.log(20) / 2 / len(su))
    best = int(np.argmin((tail_u + slack) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def _drawn(*by: str) -> Column:
    """A number from 0 to 2**30 - 1, the same each time."""
    return F.pmod(F.xxhash64(*by, F.lit(SEED)), F.lit(1 << 30))


def _sampled(df: DataFrame, most: int, total: int, *by: str) -> DataFrame:
    """About most rows of total, or a few more, by a hash."""
    return df.where(_drawn(*by) < int((1 << 30) * min(1.0, 1.1 * most / max(total, 1))))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _matrix(docs: DataFrame, most: int) -> np.ndarray:
    """Features of most sampled texts, those of least hash, gathered at the driver."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"drawn": batch["drawn"], "x": [featurize(t).astype(np.float32) for t in batch["text"]]})

    rows = docs.select(_drawn("doc_id", "text").alias("drawn"), "text").mapInPandas(frugal(features), "drawn long, x array<float>")
    rows = rows.orderBy("drawn").limit(most).toPandas()["x"]
    return np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, WIDTH))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network | None, float]:
    """(model, prior) from (doc_id, text) and (doc_id, quality); None without positives."""
    small_batches(docs.sparkSession)
    learn = fold(F.col("doc_id")) != HELD_OUT
    trusted = labels.where("quality = 1").where(learn).select("doc_id").distinct()
    chosen = _sampled(trusted, positives, trusted.count(), "doc_id")  # bounded by `positives`, hence broadcast
    pos = _matrix(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), positives)
    others = docs.where(learn)
    unl = _matrix(_sampled(others, unlabelled, others.select("doc_id").count(), "doc_id", "text"), unlabelled)
    if not len(pos) or not len(unl):
        return None, 0.5
    prior = estimate_prior(pos, unl)
    return fit_pu(pos, unl, prior), prior


def score(docs: DataFrame, model: Network | None, text: str = "text") -> DataFrame:
    """row (docs' columns) and score of each row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    @frugal
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None:
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                yield pd.Series(model.score(np.stack([featurize(t) for t in texts])) if len(texts) else np.zeros(0))

    return docs.select(F.struct("*").alias("row")).withColumn("score", scored(F.col(f"row.{text}")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = score(docs, model)
    return out.select(
        "row.doc_id", F.coalesce(fold(F.col("row.doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
