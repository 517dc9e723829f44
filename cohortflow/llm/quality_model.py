"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 5)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.measures import MEASURES, measure
from cohortflow.llm.texts import map_texts

# Labelled rows that a fit reads at most; they are those of the smallest hash of doc_id.
FIT_ROWS = 20_000

FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "repeated_lines",
    "repeats",
    "variety",
    "capitals",
    "digits",
    "exclaims",
    "pipes",
    "stops",
    "words_a_line",
)


def features(measured: np.ndarray) -> np.ndarray:
    """FEATURES of rows of MEASURES; a ratio over nothing is 0."""
    m = {n: measured[:, i].astype(float) for i, n in enumerate(MEASURES)}

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)

    words, chars = m["n_words"], m["word_chars"]
    return np.column_stack(
        [
            np.log1p(words),
            ratio(chars, words),
            ratio(m["n_symbols"], chars),
            ratio(m["n_dup_lines"], m["n_lines"]),
            ratio(m["n_repeat_words"], words),
            ratio(m["n_distinct_words"], words),
            ratio(m["n_upper"], m["n_upper"] + m["n_lower"]),
            ratio(m["n_digits"], chars),
            ratio(m["n_exclaims"], words),
            ratio(m["n_pipes"], words),
            ratio(m["n_stops"], words),
            ratio(words, m["n_lines"]),
        ]
    )


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: a row per tree, a column per node in level order."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows step down all trees at once, one level at a time."""
        total = np.full(len(x), self.start)
        if self.leaf.size and len(x):
            trees = np.arange(len(self.leaf))
            rows = np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(self.depth):
                right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            total = total + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    smooth: float = 1.0,
    least: int = 5,
) -> Trees:
    """Boost trees on the logistic loss; splits are sought on histograms of binned features.

    With no row, or one label only, the score is a constant that leans to the label.
    """
    n, width = x.shape
    share = (float(y.sum()) + 1.0) / (n + 2.0)
    start = float(np.log(share / (1.0 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, 0)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    feature = np.zeros((n_trees, inner), int)
    threshold = np.full((n_trees, inner), np.inf)
    leaf = np.zeros((n_trees, leaves))
    margin = np.full(n, start)
    for t in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, weight = y - p, p * (1.0 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(count)
            for f in range(width):
                size = len(edges[f]) + 1
                key = at * size + binned[:, f]

                def histogram(w: np.ndarray | None) -> np.ndarray:
                    return np.bincount(key, w, count * size).reshape(count, size).cumsum(axis=1)

                g, h, k = histogram(gradient), histogram(weight), histogram(None)
                gl, hl, kl = g[:, :-1], h[:, :-1], k[:, :-1]
                gr, hr, kr = g[:, -1:] - gl, h[:, -1:] - hl, k[:, -1:] - kl
                gain = (
                    gl**2 / (hl + smooth) + gr**2 / (hr + smooth)
                    - g[:, -1:] ** 2 / (h[:, -1:] + smooth)
                )
                gain = np.where((kl >= least) & (kr >= least), gain, 0.0)
                if not gain.shape[1]:
                    continue
                where = gain.argmax(axis=1)
                top = gain[np.arange(count), where]
                for i in np.flatnonzero(top > best + 1e-12):
                    best[i] = top[i]
                    feature[t, first + i] = f
                    threshold[t, first + i] = edges[f][where[i]]
            node = 2 * node + 1 + (
                x[np.arange(n), feature[t, node]] > threshold[t, node]
            )
        at = node - inner
        g = np.bincount(at, gradient, leaves)
        h = np.bincount(at, weight, leaves)
        leaf[t] = rate * g / (h + smooth)
        margin = margin + leaf[t, at]
    return Trees(start, feature, threshold, leaf)


def measured_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    def make():
        def run(texts: list) -> list:
            return list(zip(*map(measure, texts)))

        return run

    return map_texts(docs, make, [T.StructField(m, T.LongType()) for m in MEASURES], keep)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Fit on at most ``fit_rows`` labelled documents.

    ``labels`` (doc_id, quality) holds the rows that may be learnt from; rows
    with a null are left out, repeated ones count once, and of two labels of
    one document both count.  The sample, of proven size, is what the documents
    are joined with; its measurements come to the driver.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("double").alias("quality"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(fit_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (
        measured_texts(found, ["doc_id", "quality"])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *MEASURES)
        .limit(fit_rows)
        .toPandas()
    )
    return fit(
        features(rows[list(MEASURES)].to_numpy(dtype=np.int64).reshape(len(rows), len(MEASURES))),
        rows["quality"].to_numpy(dtype=float),
    )


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts are scored by their measurements, which are all 0.  A
    repeated row gives a repeated result, a null doc_id stays null, an empty
    table gives no row, other columns are not read.
    """

    def make():
        def run(texts: list) -> list:
            x = features(np.array([measure(t) for t in texts], dtype=np.int64))
            return [np.clip(trees.score(x), 0.0, 1.0)]

        return run

    scored = map_texts(docs, make, [T.StructField("score", T.DoubleType())])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
