"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.sampling import bounded_sample
from fareloom.llm.text import as_bytes, parts
from fareloom.staging import stage

#: Weight of the class's own variances against its full covariance, and of one common variance.
SHRINK_DIAGONAL = 0.1
SHRINK_COMMON = 0.02

#: Labelled documents of each class that set the threshold at most.
PER_CLASS = 3000
#: The score at which a document counts as good; the calibration puts the threshold there.
CUT = 0.3

STATISTICS = (
    "log_chars", "symbols", "capitals", "letters", "stops", "vocabulary", "word_length", "line_ends",
    "distinct_lines", "echoes", "digits",
)


def statistics_of(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: roots of shares, logs of sizes. All 0 for an empty text."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = int(counts[:128].sum() + counts[192:].sum())
    if not chars:
        return [0.0] * len(STATISTICS)
    words = text.split()
    lines = text.split(b"\n")
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    digits, blanks = int(counts[48:58].sum()), int(counts[9:14].sum() + counts[32])
    stops = int(counts[46] + counts[44])
    wide = int(counts[192:].sum())
    symbols = chars - upper - lower - wide - digits - blanks - stops
    n = len(words)
    vocabulary = np.log1p(len(set(words))) / np.log1p(n) if n else 0.0
    echoes = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    return [
        float(np.log1p(chars)),
        (symbols / chars) ** 0.5,
        (upper / chars) ** 0.5,
        (upper + lower + wide) / chars,
        (stops / chars) ** 0.5,
        float(vocabulary),
        float(np.log1p((chars - blanks) / max(1, n))),
        (int(counts[10]) / chars) ** 0.5,
        len(set(lines)) / len(lines),
        echoes**0.5,
        (digits / chars) ** 0.5,
    ]


def statistics(text: Column) -> Column:
    """array<double> of ``statistics_of``; null text counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            yield pa.array([statistics_of(t) for t in as_bytes(texts)], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(text)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and their log prior odds.

    A class without rows leaves ``known`` false; every score is then ``prior``.
    """

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    known: bool = True
    prior: float = 0.5
    threshold: float = float(np.log(CUT / (1 - CUT)))

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Difference of the classes' log densities, from their Mahalanobis distances, plus the prior odds."""
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            logs.append(-0.5 * (self.log_dets[c] + (z * z).sum(axis=1)))
        return logs[1] - logs[0] + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        """A chance of class 1 that is CUT exactly at the threshold."""
        if not self.known:
            return np.full(len(x), self.prior)
        z = self.log_ratio(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def calibrate(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Put the threshold where the weighted errors are fewest, in the middle of the best gap."""
        ratio = self.log_ratio(x)
        order = np.argsort(ratio)
        z, y, w = ratio[order], labels[order], weights[order]
        lost = np.concatenate(([0.0], np.cumsum(w * y)))
        wrong = (w * (1 - y)).sum() - np.concatenate(([0.0], np.cumsum(w * (1 - y))))
        best = np.flatnonzero(lost + wrong <= (lost + wrong).min() + 1e-9)
        edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
        k = best[len(best) // 2]
        self.threshold = float((edges[k] + edges[k + 1]) / 2)


def moments(rows: DataFrame, features: str, label: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of all rows by label 0 or 1, as one aggregate."""
    d = len(STATISTICS)
    x = [F.col(features)[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(v) for v in x)).alias("first"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("second"),
    )
    out = {}
    for row in sums.collect():
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, row["second"]):
            second[i, j] = second[j, i] = v
        out[row["label"]] = (row["n"], np.array(row["first"]), second)
    return out


def fit(found: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """Shrinkage covariances: part of the way to their diagonal, and a little to one common variance."""
    d = len(STATISTICS)
    n = [found[c][0] if c in found else 0 for c in (0, 1)]
    if not all(n):
        prior = 0.5 if n[0] == n[1] else float(n[1] > 0)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, False, prior)
    means, factors, dets = [], [], []
    for c in (0, 1):
        count, first, second = found[c]
        mean = first / count
        cov = second / count - np.outer(mean, mean)
        spread = np.diag(np.maximum(np.diag(cov), 0))
        cov = (1 - SHRINK_DIAGONAL - SHRINK_COMMON) * cov + SHRINK_DIAGONAL * spread
        cov += SHRINK_COMMON * max(np.trace(spread) / d, 1e-6) * np.eye(d) * 0.01 + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(np.stack(means), np.stack(factors), np.array(dets), float(np.log(n[1] / n[0])))


def scored(features: Column, model: Discriminant) -> Column:
    """The model's score of an array of statistics."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            yield pa.array(model.score(x) if len(rows) else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")(features)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
) -> DataFrame:
    """(doc_id, score), a row per row of ``docs``; higher means label 1 is likelier.

    The model learns from the labelled documents for which ``learn_from``, a
    condition on ``doc_id``, holds: from the sums of all of them, and a bounded
    sample sets the threshold. A document
    with several labels counts with the largest; null ids and labels other
    than 0 and 1 teach nothing. Null and empty texts are scored like others.
    If a class has no row, every score is 1 where only label 1 occurs, 0 where
    only label 0, else one half. An empty table gives no rows.
    """
    rows = stage(
        docs.select(F.col(doc_id).alias("doc_id"), statistics(F.col(text)).alias("statistics")), "quality-statistics"
    )
    # Labels of any type count by their number; what is neither 0 nor 1 goes before the largest is taken.
    number = F.col(label).try_cast("double")
    marks = labels.select(F.col(doc_id).alias("doc_id"), number.alias("label")).where(learn_from)
    marks = marks.where(F.col("label").isin(0.0, 1.0)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    labelled = rows.join(marks, "doc_id")
    found = moments(labelled, "statistics", "label")
    model = fit(found)
    if model.known:
        sample = bounded_sample(labelled, "label", "doc_id", PER_CLASS).select("label", "statistics").collect()
        y = np.array([r["label"] for r in sample])
        share = np.array([found[c][0] / max(1, (y == c).sum()) for c in (0, 1)])
        model.calibrate(np.array([r["statistics"] for r in sample]), y, share[y])
    return rows.select("doc_id", scored(F.col("statistics"), model).alias("score"))
