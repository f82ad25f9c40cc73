"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from; documents that are labelled bad are not used. A logistic
model over measures of the text minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).
The class prior is estimated first: no set of documents can hold a larger share of the positives, times the prior, than its
share of the unlabelled text, so the prior is the least ratio of the two shares over the upper sets of a first model's score
(of two, in fact, each scoring the rows that the other one learnt from).

The fit uses at most `most_rows` positives and `most_rows` unlabelled documents, those with the smallest hashes of their ids
(documented bound; the driver holds that many rows of about 20 numbers). Every document is scored over its whole text.
Null and empty texts have the measures of a text without words. Repeated rows score alike, and ids that repeat count once in the
fit (the row with the least measures). Equal id hashes are told apart by the ids themselves. Without positives the model says
0.5 for all, and an empty table gives an empty one. Other columns pass through; one with the new column's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import crc_mod, documents, slices, without
from mediaflow.llm.quality_rules import Measures

MOST_ROWS = 20_000
THRESHOLD = 0.3


def features(texts: pa.Array) -> np.ndarray:
    """One row of measures per text."""
    m = Measures(texts)
    w, bounds = m.words, m.words.bounds
    n = np.maximum(1, m.n_words).astype(float)
    letters = np.maximum(1, m.n_upper + m.n_lower).astype(float)
    data = w.bytes
    chars = np.maximum(1, m._per_text((data & 0xC0) != 0x80)).astype(float)
    codes = w.codes
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    starts = bounds[:-1][bounds[:-1] < len(codes)]
    same[starts] = False
    owner = w.owners()
    distinct = np.bincount(np.unique(owner * (len(w.dictionary) + 1) + codes) // (len(w.dictionary) + 1), minlength=len(m)) if len(codes) else np.zeros(len(m))
    shares = [
        m.n_symbols / n, m.n_bangs / n, m.n_bare_words / n, m.n_upper / letters, m.n_dup_lines / np.maximum(1, m.n_lines),
        m.n_repeat_words / n, m._sum(same, bounds) / n, distinct / n, m.n_lines / n, m.word_chars / n / 10,
        m._per_text((data >= 48) & (data <= 57)) / chars, m._per_text((data == 44) | (data == 46)) / n, m._per_text(data == 10) / n,
        m._per_text((data == 123) | (data == 125) | (data == 61) | (data == 59) | (data == 64)) / n, m._per_text(data >= 128) / chars,
        np.log1p(m.n_words) / 5, np.log1p(m.word_chars) / 5,
    ]
    return np.stack([np.asarray(s, np.float32) for s in shares], 1) if len(m) else np.zeros((0, len(shares)), np.float32)


N_FEATURES = 17


class Basis:
    """Standardised measures, and for each the steps between quantiles of the fitted rows."""

    LEVELS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.88, 0.92, 0.95, 0.98, 0.995)

    def __init__(self, x: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.edges = [np.unique(np.quantile(x[:, k], self.LEVELS)) for k in range(x.shape[1])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        steps = [(x[:, k : k + 1] > e).astype(np.float32) for k, e in enumerate(self.edges)]
        return np.concatenate([z, *steps, np.ones((len(x), 1))], 1).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def adam(w: np.ndarray, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray, least: float = 0.2, z: float = 1.5) -> float:
    """The least ratio of unlabelled to positive share over upper sets {score >= t}, at `z` standard errors above; sets with
    less than the share `least` of the positives are left out."""
    if len(score_p) == 0 or len(score_u) == 0:
        return 0.5
    p, u = np.sort(score_p), np.sort(score_u)
    cuts = np.unique(np.quantile(p, np.linspace(0, 1, 201)))
    share_p = 1 - np.searchsorted(p, cuts) / len(p)
    share_u = 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(share_u * (1 - share_u) / len(u) + (share_u / share_p) ** 2 * share_p * (1 - share_p) / len(p))
    ratio = (share_u + z * error) / share_p
    return float(np.clip(ratio[share_p >= min(least, share_p.max())].min(), 0.05, 0.99))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk of the logistic loss."""
    w = np.zeros(xp.shape[1])

    def gradient(w):
        sp, su = sigmoid(xp @ w), sigmoid(xu @ w)
        plus = prior * xp.T @ (sp - 1) / len(xp)
        negative = np.logaddexp(0, xu @ w).mean() - prior * np.logaddexp(0, xp @ w).mean()
        minus = xu.T @ su / len(xu) - prior * xp.T @ sp / len(xp)
        # a negative risk below zero is overfitting: step back on it alone
        return (plus + minus if negative >= 0 else -minus) + ridge * w

    return adam(w, gradient, steps)


class Model:
    def __init__(self, basis: Basis | None, weights: np.ndarray | None, prior: float):
        self.basis, self.weights, self.prior = basis, weights, prior

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None or not len(texts):
            return np.full(len(texts), 0.5)
        return sigmoid(self.basis(features(texts)) @ self.weights)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the measures, one row for each id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                x = features(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], [key, "x"])

    schema = T.StructType([docs.schema[key], T.StructField("x", T.ArrayType(T.FloatType()))])
    return docs.select(key, text).mapInArrow(run, schema).groupBy(key).agg(F.min("x").alias("x"))


def fit(positives: DataFrame, unlabelled: DataFrame, key: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS) -> Model:
    """Fits on the `most_rows` rows of each with the smallest id hashes."""

    def sample(df: DataFrame) -> np.ndarray:
        ids = df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most_rows)
        rows = measured(df.join(F.broadcast(ids), key, "left_semi"), key, text).select("x").toPandas()["x"]
        x = np.array([*rows], np.float64).reshape(len(rows), N_FEATURES)
        return x[np.lexsort(x.T)]  # the order rows arrive in doesn't matter

    xp, xu = sample(positives), sample(unlabelled)
    if not len(xp) or not len(xu):
        return Model(None, None, 0.5)
    basis = Basis(np.concatenate([xp, xu]))
    p, u = basis(xp), basis(xu)
    # scores for the prior come from models that haven't seen their rows, else positives only look apart
    folds = [np.arange(len(x)) % 2 for x in (p, u)]
    firsts = [fit_nnpu(p[folds[0] != k], u[folds[1] != k], 0.5) for k in (0, 1)] if min(len(p), len(u)) > 1 else []
    held = lambda x, fold: np.concatenate([sigmoid(x[fold == k] @ w) for k, w in enumerate(firsts)]) if firsts else np.zeros(0)
    prior = estimate_prior(held(p, folds[0]), held(u, folds[1]))
    return Model(basis, fit_nnpu(p, u, prior), prior)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the model's probability that each whole text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, column)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column(text)).astype(float))], [*columns, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Positives are documents labelled 1, unlabelled ones are any documents; held-out ids (crc32 mod 5 = 0) are in neither."""
    docs = docs.select("doc_id", "text").where(crc_mod("doc_id", 5) != 0)
    good = labels.where((F.col("quality") == 1) & (crc_mod("doc_id", 5) != 0)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return fit(docs.join(F.broadcast(good), "doc_id", "left_semi"), docs, most_rows=most_rows)


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from labels whose ids aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
