"""Quality classifier by positive-unlabelled learning with non-negative risk.

Trusted positives are documents labelled good; everything else is unlabelled
web text, good and bad mixed. Labels of bad documents are never used. The class
prior is estimated from the two sets alone: a classifier of positive against
unlabelled ranks the texts, and the least ratio of the two tails at its top is
the share of positives in the unlabelled (the best bin of Garg et al. 2021).
The final scorer minimises the non-negative risk of Kiryo et al. (2017),

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),

with the logistic loss, so its score is a probability under that prior.

Features are statistics of the whole text, made in one pass over the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, read_table, text_of

#: Bounds of the training sample: so many positives, and so many unlabelled, at most.
MOST_POSITIVES = 15_000
MOST_UNLABELLED = 15_000
THRESHOLD = 0.3


def features(text: str) -> np.ndarray:
    """Statistics of a text, none of which grows with its length but the logarithm of the length."""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    plain = np.r_[counts[33:48], counts[58:65], counts[91:97], counts[123:127]]  # each ASCII mark
    groups = np.array([counts[48:58].sum(), counts[65:91].sum(), counts[97:123].sum(), counts[:33].sum(), counts[128:].sum(), counts[10]])
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    own = len(set(words)) / (m + 5)
    pairs = len(set(zip(words, words[2:]))) / (m + 5)
    upper = sum(map(bytes.isupper, words)) / (m + 5)
    rest = np.array([np.log1p(m), m and (n - counts[:33].sum()) / m / 10, own, pairs, own * np.log1p(m), same / (m + 5), upper, len(set(lines)) / (len(lines) + 1), np.log1p(len(lines)), m / (len(lines) + 1) / 100, m < 5, m < 20])
    return np.r_[np.sqrt(plain / (n + 20)), np.sqrt(groups / (n + 20)), rest]


def _features_of(df: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t).tolist() for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | {"x": pa.array(x, pa.list_(pa.float64()))})

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep) + ", x array<double>"
    return df.select(*keep, text_of().alias("__text")).mapInArrow(run, schema)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _descend(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Adam from zero; full batches, so that reruns agree."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.05) -> float:
    """Share of positives among unlabelled scores u, given scores p of positives: least ratio of upper tails."""
    cuts = np.quantile(p, np.linspace(least, 0.98, 60))
    tail_p = (p[None, :] >= cuts[:, None]).mean(1)
    tail_u = (u[None, :] >= cuts[:, None]).mean(1)
    slack = np.sqrt(0.5 * np.log(200)) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))  # what chance may add at a thin tail
    best = np.argmin((tail_u + slack) / np.maximum(tail_p, 1e-9))
    return float(np.clip(tail_u[best] / tail_p[best], 0.02, 0.98))


class PuModel:
    """Linear scorer over standardised features and the squares of them."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 400, decay: float = 1e-4):
        both = np.r_[positive, unlabelled]
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = self.expand(positive), self.expand(unlabelled)
        size = p.shape[1]

        def against(w):  # positive against unlabelled, each half the weight
            return -(p.T @ (1 - _sigmoid(p @ w))) / len(p) / 2 + u.T @ _sigmoid(u @ w) / len(u) / 2 + decay * w

        first = _descend(against, size, rounds // 2, 0.02)
        self.prior = estimate_prior(p @ first, u @ first)

        def risk(w):
            gp, gu = p @ w, u @ w
            negative = np.logaddexp(0, gu).mean() - self.prior * np.logaddexp(0, gp).mean()
            of_p = -self.prior * (p.T @ (1 - _sigmoid(gp))) / len(p)
            of_u = u.T @ _sigmoid(gu) / len(u) - self.prior * (p.T @ _sigmoid(gp)) / len(p)
            return (of_p + of_u if negative >= 0 else -of_u) + decay * w  # below zero the estimate is undone, not followed

        self.w = _descend(risk, size, rounds, 0.02)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[z, np.minimum(z * z, 9), np.ones(len(z))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.expand(x) @ self.w)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> PuModel | None:
    """Fits on a bounded sample of the training folds; None where there is no positive or no document."""
    seeded = F.xxhash64(F.lit("quality"), key)
    pos = labels.where((fold_of(key) != 0) & (F.col("quality") == 1)).select(key).distinct().orderBy(seeded, key).limit(MOST_POSITIVES)
    unl = docs.where(fold_of(key) != 0).select(key).orderBy(F.xxhash64(F.lit("unlabelled"), key), key).limit(MOST_UNLABELLED).distinct()
    chosen = pos.select(key, F.lit(True).alias("positive")).unionByName(unl.select(key, F.lit(False).alias("positive")))
    # at most MOST_POSITIVES + MOST_UNLABELLED ids: a proven bound, so they may be broadcast
    rows = _features_of(docs.select(key, "text").join(F.broadcast(chosen), key), ["positive"]).toPandas()
    x = np.array(rows.x.tolist(), np.float64)
    good = rows.positive.to_numpy(bool) if len(rows) else np.array([], bool)
    if not good.any() or good.all():
        return None
    return PuModel(x[good], x[~good])


def score(spark: SparkSession, docs: DataFrame, model: PuModel | None, key: str = "doc_id") -> DataFrame:
    """Rows (key, score): the probability of good quality; 0.5 where there is no model. One narrow pass."""
    shared = spark.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches):
        for b in batches:
            texts = b.column("__text").to_pylist()
            got = np.full(len(texts), 0.5) if shared.value is None or not texts else shared.value.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(got)], [key, "score"])

    return docs.select(key, text_of().alias("__text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and the prediction at 0.3.

    Null and empty texts are scored as texts without words. Repeated rows are
    scored each. Without labels every score is 0.5; an empty table gives no rows.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score(spark, docs, train(spark, docs, labels))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
