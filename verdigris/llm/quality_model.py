"""Quality classifier: regularised quadratic discriminant over document statistics.

The statistics describe language and layout (variety of words and lines, lengths, punctuation, capitals,
digits, symbols), brought to a common form by square roots and logs.
For each class the mean and the covariance come from sums over all labelled rows, gathered by one
aggregate; the covariance is shrunk towards its diagonal and given a small ridge, and factored once
by Cholesky. A document's score is the logistic function of the difference of the two log densities,
computed with the cached factors as one column expression.

Defined results: a null or empty text has the statistics of no characters; where no label of one
class is known the score is the share of good labels (0.5 without any); labels that repeat for an id
count for each of its rows; no rows give no rows. Columns beyond id, text and label are not read and
keep their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, bind, read, staged

SHRINK, RIDGE, ACCEPT = 0.2, 0.02, 0.3


def statistics(text: Column) -> Column:
    """The SIZE transformed statistics of a text, as an array. Rates have a few plain characters or words added, so that they mean little in a short text. Words and lines are split once."""
    text = F.coalesce(text, F.lit(""))

    def of(x: Column) -> Column:
        count = lambda pattern: F.regexp_count(x["text"], F.lit(pattern))
        words, chars = F.size(x["words"]) + 5, F.length(x["text"])
        return F.array(
            F.ln(F.size(F.array_distinct(x["words"])) + 5.0) / F.ln(words),
            F.ln((F.size(F.array_distinct(x["lines"])) + 3.0) / (F.size(x["lines"]) + 3.0)),
            F.ln((chars + 25) / words),
            F.sqrt(count(r"[.,;:]") / words),
            F.sqrt(count(r"[!?]") / words),
            F.sqrt(count(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()-]") / words),
            F.sqrt(count(r"\p{Lu}") / (chars + 40)),
            F.sqrt(count(r"[0-9]") / (chars + 40)),
        )

    return bind(F.struct(text.alias("text"), F.split(text, BLANK + "+").alias("words"), F.split(text, "\n").alias("lines")), of)


SIZE = 8


class Discriminant:
    """Means, Cholesky factors and log determinants of two Gaussian classes, and their log prior ratio."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE):
        counts = {c: sums[c][0] for c in sums if sums[c][0]}
        n = sum(counts.values())
        self.constant = None if len(counts) == 2 else (counts.get(1, 0) / n if n else 0.5)
        if self.constant is not None:
            return
        self.classes = {}
        for c in (0, 1):
            k, first, second = sums[c]
            mean = first / k
            cov = second / k - np.outer(mean, mean)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * ridge * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.classes[c] = (mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), math.log(k / n))

    def _log_density(self, c: int, values: list[Column]) -> Column:
        """Up to a constant: half of log prior squared, less log determinant and Mahalanobis distance, the squared length of the centred statistics under the inverse factor."""
        mean, inverse, log_det, prior = self.classes[c]
        distance = F.lit(0.0)
        for i in range(len(values)):
            y = F.lit(0.0)
            for j in range(i + 1):
                y = y + float(inverse[i, j]) * (values[j] - float(mean[j]))
            distance = distance + F.pow(y, 2)
        return (2 * prior - log_det - distance) / 2

    def score(self, values: Column) -> Column:
        """A score from 0 to 1 from a column that holds the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        each = [values[i] for i in range(SIZE)]
        ratio = self._log_density(1, each) - self._log_density(0, each)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), ratio))))

    def score_text(self, text: Column) -> Column:
        """A score from 0 to 1, with each statistic computed once a row: the optimizer would copy them into every term."""
        return bind(statistics(text), self.score)


def fit(rows: DataFrame, labels: DataFrame, *, label_col: str = "quality") -> Discriminant:
    """rows: doc_id and stats. All labelled rows count; the driver gets 45 sums a class."""
    labels = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    joined = rows.join(labels, F.col("doc_id") == F.col("id"))
    pairs = [(i, j) for i in range(SIZE) for j in range(i + 1)]
    x = [F.col("stats")[i] for i in range(SIZE)]
    got = joined.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs))
    sums = {0: (0, None, None), 1: (0, None, None)}
    for r in got.collect():  # two rows
        second = np.zeros((SIZE, SIZE))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"s{i}_{j}"]
        sums[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(SIZE)]), second)
    return Discriminant(sums)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows whose score reaches the threshold, with docs' columns. For the fit, the statistics (not the texts) are joined with the labels; then every row's are computed again where its text is, so no text is shuffled."""
    model = fit(docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("stats")), labels)
    return docs.where(model.score_text(F.col(text_col)) >= threshold)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(read(spark, sf_dir, "documents").select("doc_id", statistics(F.col("text")).alias("stats")), "quality-statistics")
    model = fit(rows, training_labels(read(spark, sf_dir, "labels")))
    score = model.score(F.col("stats"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))
