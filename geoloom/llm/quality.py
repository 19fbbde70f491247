"""Quality scores by regularised quadratic discriminant analysis.

Statistics of whole texts are transformed to be roughly normal; each class has
its mean and a covariance shrunk towards a diagonal.  The score is the
posterior of label 1 from the difference of the Mahalanobis log-densities,
with each class's Cholesky factor computed once.  Fitting uses class counts,
sums and sums of products over all labelled rows, added up by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, utf8

FEATURES = ("words", "shout", "exclaim", "pipe", "symbol", "stutter", "fresh", "length", "point", "digit", "lines", "letters")
#: Share of the diagonal target in each class covariance.
SHRINKAGE = 0.1
#: Least standard deviation of a transformed statistic in a class.
LEAST_SD = 0.15
THRESHOLD = 0.7

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_SYMBOLS = b"#$%&*^~=<>{}[]\\_`"
_DIGITS = b"0123456789"


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; an empty one has them too."""
    words = text.split()
    n = len(words)
    size = len(text) or 1
    share = lambda count, of: count / of if of else 0.0
    root = lambda x: min(x, 4.0) ** 0.5
    count = lambda chars: len(text) - len(text.translate(None, chars))
    upper = count(_UPPER)
    letters = upper + count(_LOWER)
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)),
        root(share(upper, letters)),
        root(share(text.count(b"!"), n)),
        root(share(text.count(b"|"), n)),
        root(share(count(_SYMBOLS), n)),
        root(share(stutter, n)),
        share(len(set(words)), n),
        float(np.log1p(share(size, n))),
        root(share(text.count(b".") + text.count(b","), n)),
        root(share(count(_DIGITS), n)),
        root(share(text.count(b"\n"), n)),
        root(share(letters, size)),
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``stats`` (array of doubles) of every row; null text is empty."""
    schema = docs.select(*keep).schema
    names = schema.names[:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t) for t in utf8(batch.column(len(keep)))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], names=[*names, "stats"])

    return bounded_batches(docs).select(*keep, F.col("text").alias("_whole_text")).mapInArrow(run, schema.add("stats", T.ArrayType(T.DoubleType())))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class: rows, sum of statistics, sum of outer products.

    ``rows``: label, stats.  A few numbers per task reach the second stage.
    """
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                sums[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        for c in (0, 1):
            k = sums.shape[1]
            yield pa.record_batch([pa.array(np.full(k, c), pa.int32()), pa.array(np.arange(k), pa.int32()), pa.array(sums[c])], names=["label", "i", "x"])

    added = rows.select(F.col("label").cast("int"), "stats").mapInArrow(run, "label int, i int, x double").groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    out = {}
    for c in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in added:
            if r["label"] == c:
                v[r["i"]] = r["x"]
        out[c] = (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


@dataclass(frozen=True)
class Model:
    """Per class 0, 1: log prior, mean, inverse Cholesky factor, log determinant."""

    prior: tuple[float, float]
    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            logs.append(self.prior[c] - 0.5 * (z * z).sum(1) - self.logdet[c])
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame) -> Model:
    """Fit on labelled rows (label, stats).

    With one class only, every score is that class; without any row it is 1:
    nothing speaks against a text.
    """
    found = moments(rows)
    d = len(FEATURES)
    n = [found[c][0] for c in (0, 1)]
    if not all(n):
        return Model((0.0, 0.0), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0 if n[0] else 1.0)
    means, factors, logdets = [], [], []
    for c in (0, 1):
        mean = found[c][1] / n[c]
        cov = found[c][2] / n[c] - np.outer(mean, mean)
        diagonal = np.diag(np.maximum(np.diag(cov), LEAST_SD**2))
        lower = np.linalg.cholesky((1 - SHRINKAGE) * cov + SHRINKAGE * diagonal + 0.25 * LEAST_SD**2 * np.eye(d))
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        logdets.append(np.log(np.diag(lower)).sum())
    prior = tuple(float(np.log(k / sum(n))) for k in n)
    return Model(prior, np.array(means), np.array(factors), np.array(logdets))


def training_rows(stats: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """(label, stats) of labelled documents; conflicting or repeated labels of an id count once, the lower one."""
    wanted = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("label"))
    return stats.where(learn_from).join(wanted, F.col("doc_id") == F.col("_id")).select("label", "stats")


def with_scores(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score`` and ``predicted`` in place of the statistics."""
    rest = [c for c in stats.columns if c != "stats"]
    return _scored(stats.select(*rest, "stats"), model, lambda column: column.to_pylist())


def with_text_scores(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every row; null text is empty.

    One Python worker a task takes the statistics and the score, where
    ``with_statistics`` and ``with_scores`` in a row hold two at once.
    """
    rows = bounded_batches(docs).select(*keep, F.col("text").alias("_whole_text"))
    return _scored(rows, model, lambda column: [statistics(t) for t in utf8(column)])


def _scored(rows: DataFrame, model: Model, features) -> DataFrame:
    """The last column of ``rows``, which ``features`` makes statistics, gives way to ``score`` and ``predicted``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*rows.columns[:-1]).schema
    names = schema.names[:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(features(batch.column(len(names))), float).reshape(-1, len(FEATURES))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype("i4"))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, schema.add("score", "double").add("predicted", "integer"))
