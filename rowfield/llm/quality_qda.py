"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics are counts of the whole text (the same pass as the quality rules'), turned into logarithms and smoothed
log-odds. Each class has a mean and a covariance, from sums over all labelled rows that may be learnt from; covariances
are shrunk towards their own diagonal and a part of their mean variance. A score is the logistic of the difference of
the two Gaussian log densities and the prior log-odds; Mahalanobis distances come from the inverse Cholesky factors,
which are worked out once and stand in the scoring expression as numbers.

Defined cases: empty and null texts have counts of zero and are scored like any other; a null id is not held out and
has no label; repeated label rows count as often as they occur; with labels of one class only, or none, all scores are
that class's share (0.5 for none); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfield.llm import host_rules
from rowfield.llm.common import written

#: Labels of rows whose crc32(id as text) has this remainder are held out.
FOLDS, HELD_OUT = 3, 1
SHRINKAGE = 0.1
#: Part of the mean variance that is added to the diagonal.
RIDGE = 0.01


def _log(x: str) -> Column:
    return F.log1p(F.col(x).cast("double"))


def _log_odds(part: str, whole: str) -> Column:
    p, n = F.col(part).cast("double"), F.greatest(F.col(whole), F.col(part)).cast("double")
    return F.log((p + 0.5) / (n - p + 0.5))


def transformed() -> dict[str, Column]:
    """The inputs of a score, from the counts of `host_rules.features`."""
    return {
        "words": _log("n_words"),
        "word_length": F.log((F.col("word_chars") + 4.0) / (F.col("n_words") + 1.0)),
        "symbols": _log_odds("n_symbols", "word_chars"),
        "upper": _log_odds("n_upper", "word_chars"),
        "repeats": _log_odds("n_repeat_words", "n_words"),
        "dup_lines": _log_odds("n_dup_lines", "n_lines"),
        "words_a_line": F.log((F.col("n_words") + 1.0) / (F.col("n_lines") + 1.0)),
    }


@dataclass(frozen=True)
class Gaussian:
    share: float
    mean: np.ndarray
    factor: np.ndarray  # the inverse of the covariance's Cholesky factor
    log_det: float  # of the covariance


def _gaussian(n: float, total: float, sums: np.ndarray, products: np.ndarray, shrinkage: float) -> Gaussian:
    mean = sums / n
    covariance = products / n - np.outer(mean, mean)
    diagonal = np.diag(np.maximum(np.diag(covariance), 0))
    ridge = RIDGE * max(np.trace(diagonal) / len(mean), 1e-6)
    covariance = (1 - shrinkage) * covariance + shrinkage * diagonal + ridge * np.eye(len(mean))
    lower = np.linalg.cholesky(covariance)
    return Gaussian(n / total, mean, np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum()))


def fit(rows: DataFrame, inputs: list[str], label: str, shrinkage: float = SHRINKAGE) -> dict[int, Gaussian]:
    """Classes from sums, sums of products and counts over all rows; only these sums reach the driver."""
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(inputs)]
    products = [F.sum(F.col(inputs[i]) * F.col(inputs[j])).alias(f"p{i}_{j}") for i, j in pairs]
    found = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()
    total, out = sum(r["n"] for r in found), {}
    for r in found:
        square = np.zeros((len(inputs), len(inputs)))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"p{i}_{j}"]
        out[r[label]] = _gaussian(r["n"], total, np.array([r[f"s{i}"] for i in range(len(inputs))]), square, shrinkage)
    return out


def _log_density(g: Gaussian, inputs: list[str]) -> Column:
    distance = F.lit(0.0)
    for row in g.factor:
        z = F.lit(0.0)
        for weight, mean, c in zip(row.tolist(), g.mean.tolist(), inputs, strict=True):
            if weight:
                z = z + (F.col(c) - mean) * weight
        distance = distance + z * z
    return distance * -0.5 - 0.5 * g.log_det


def score(model: dict[int, Gaussian], inputs: list[str]) -> Column:
    if len(model) < 2:
        return F.lit(float(next(iter(model), 0.5)))
    odds = _log_density(model[1], inputs) - _log_density(model[0], inputs) + float(np.log(model[1].share / model[0].share))
    return 1.0 / (1.0 + F.exp(F.greatest(F.least(-odds, F.lit(700.0)), F.lit(-700.0))))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted of every row of docs, from a model of the labels that aren't held out."""
    counted = host_rules.features(docs, [key], text)
    inputs = transformed()
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows, _ = written(counted.select(key, held.alias("held_out"), *[c.alias(n) for n, c in inputs.items()]), "statistics")
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col("_label").isNotNull())
    model = fit(rows.where(~F.col("held_out")).join(known, rows[key] == known["_key"]), list(inputs), "_label")
    scored = rows.select(key, "held_out", score(model, list(inputs)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
