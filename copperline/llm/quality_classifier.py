"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and its
diagonal. A score compares the two log densities by Mahalanobis distances, computed with the cached
inverse Cholesky factors. Sums for means and covariances are one aggregate over all labelled rows;
only two small matrices reach the driver.

Defined cases: a null or empty text has all statistics zero and is scored like any other; rows with
a null label teach nothing, and a text with several labels counts once for each; with labels of one
class only, or none, the score is the share of label 1 (0.5 without labels); other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from copperline.llm.quality_rules import repeated_words

FEATURES = (
    "log_words", "log_word_bytes", "symbols", "upper", "exclamation", "bars", "digits", "punctuation", "distinct_words",
    "repeated_lines", "repeated_windows", "log_line_words", "entropy", "beyond_ascii",
)
#: Weight of the pooled covariance, then of its diagonal, in a class covariance; and the smallest variance.
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.1, 0.05, 1e-4
THRESHOLD = 0.7


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_MASKS = np.stack([
    _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(b"!"), _mask(b"|"), _mask(b"0123456789"), _mask(b".,;:?'\"()-"),
    _mask(bytes(range(128, 256))), _mask(bytes(range(97, 123))), _mask(b" \t\n\v\f\r"),
])


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, upper, exclaim, bars, digits, punct, beyond, lower, spaces = _MASKS @ counts
    inked = len(raw) - spaces
    lines = [line for line in raw.split(b"\n") if line.strip()]
    p = counts[counts > 0] / len(raw)
    return [
        float(np.log1p(len(words))), float(np.log1p(inked / len(words))), float(np.sqrt(symbols / inked)),
        float(np.sqrt(upper / max(upper + lower, 1))), float(np.sqrt(exclaim / inked)), float(np.sqrt(bars / inked)),
        float(np.sqrt(digits / inked)), float(np.sqrt(punct / inked)), len(set(words)) / len(words),
        1 - len(set(lines)) / len(lines), repeated_words(words) / len(words), float(np.log1p(len(words) / len(lines))),
        float(-(p * np.log(p)).sum()), float(np.sqrt(beyond / inked)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t if isinstance(t, str) else None) for t in texts])


@dataclass
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor and log of prior over root determinant; or a constant score."""

    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        logs = [
            offset - 0.5 * (((rows - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, offset in zip(self.means, self.inverse_factors, self.offsets)
        ]
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(logs[0] - logs[1]))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``statistics`` in place of the text: what training and scoring read instead of it."""
    kept = [c for c in docs.columns if c not in (text_col, "statistics")]
    return docs.select(*kept, _statistics(F.col(text_col)).alias("statistics"))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from measured rows joined with ``labels``; the caller leaves out what must not be learnt from.

    Only ids and statistics are shuffled to the labels, never texts.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    seen = measured.select(F.col(id_col).alias("_id"), F.col("statistics").alias("x")).join(known, "_id").select("_label", "x")
    d = len(FEATURES)
    columns = [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(d)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)] + [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)
    ]
    found = seen.select("_label", *columns).groupBy("_label").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    per_class = {r["_label"]: r for r in found}
    total = sum(r["n"] for r in found)
    if len(per_class) < 2:
        share = per_class[1]["n"] / total if 1 in per_class else 0.0 if per_class else 0.5
        return Model([], [], [], float(share))
    means, covariances = [], []
    for c in (0, 1):
        r = per_class[c]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    pooled = sum(per_class[c]["n"] * covariances[c] for c in (0, 1)) / total
    factors, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - SHRINK_POOLED) * covariances[c] + SHRINK_POOLED * pooled
        shrunk = (1 - SHRINK_DIAGONAL) * shrunk + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(per_class[c]["n"] / total) - np.log(np.diag(lower)).sum()))
    return Model(means, factors, offsets)


def score(measured: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Measured rows with score and predicted; columns of these names are replaced."""
    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(rows.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    kept = [c for c in measured.columns if c not in ("score", "predicted")]
    return measured.select(*kept, scored(F.col("statistics")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
