"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w x): one weight vector is shared by all ordered thresholds. The severity of a
text is its expected grade. The fit uses a bounded sample of labelled rows; scoring covers every text in full.

Null and empty texts have no features and get the severity of the thresholds alone; texts of any length are read whole;
repeated rows are scored alike; an empty table of labels gives a model that grades everything 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import chunks, texts, widened

#: Labelled rows that the fit reads, chosen by the hash of their id.
FIT_ROWS = 12_000
#: Words that may carry a weight; those that tell grades apart best.
VOCABULARY = 2_000
#: From which correlation with the label on (z by the root of the rows) a word marks a text as strongly toxic.
STRONG = 0.15
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class OrdinalModel:
    """Shared word weights and ordered thresholds; ``levels`` grades from 0."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, words: set[str]) -> float:
        """Expected grade: the sum over thresholds of P(grade > k)."""
        x = sum(self.weights[f] for f in features_of(Counter(words)) if f in self.weights)
        return float(sum(1 / (1 + np.exp(np.clip(t - x, -50, 50))) for t in self.thresholds))


#: Lengths of the word beginnings that count as features besides whole words: inflected forms share them.
STEMS = (4, 5)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(counts: Counter) -> Counter:
    """Counts of the words and, marked by a star, of their beginnings."""
    found = Counter(counts)
    for word, n in counts.items():
        for k in STEMS:
            if len(word) > k:
                found[word[:k] + "*"] += n
    return found


def _word_counts(docs: DataFrame) -> DataFrame:
    """(row, word, n, total) for each distinct word of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows, grades, words, counts, totals = [], [], [], [], []
            for i, g, text in zip(batch.column("row").to_pylist(), batch.column("grade").to_pylist(),
                                  texts(batch.column("text")), strict=True):
                plain = Counter(words_of(text))
                found = features_of(plain)
                rows += [i] * len(found)
                grades += [g] * len(found)
                totals += [plain.total()] * len(found)
                words += found
                counts += found.values()
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array(grades, pa.int32()), pa.array(words, pa.string()),
                pa.array(counts, pa.int64()), pa.array(totals, pa.int64())], ["row", "grade", "word", "n", "total"])
    return docs.select("row", "grade", "text").mapInArrow(run, "row long, grade int, word string, n long, total long")


def _marked_words(counts: DataFrame, low: float, high: float, least: float, limit: int) -> dict[str, float]:
    """At most ``limit`` words by the z score of their share in rows of grade > 0 against those of grade 0."""
    p, n = F.col("hi") / high + 0.0, (F.col("hi") + F.col("lo")) / (high + low)
    z = (p - F.col("lo") / low) / F.sqrt(n * (1 - n) * (1 / high + 1 / low) + 1e-12)
    top = (counts.groupBy("word").agg(F.sum((F.col("grade") > 0).cast("int")).alias("hi"),
                                      F.sum((F.col("grade") == 0).cast("int")).alias("lo"))
           .where("hi + lo >= 3").withColumn("z", z).where(F.abs("z") >= least)
           .orderBy(F.abs("z").desc(), "word").limit(limit))
    return {r["word"]: r["z"] for r in top.select("word", "z").collect()}


def sample_rows(docs: DataFrame, labels: DataFrame, grade: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows (row, grade, text): labels by the hash of doc_id, joined to their documents.

    Labels without a grade, an id or a document are left out; of labels that conflict the highest grade counts; rows that repeat
    a doc_id are one document here. The ids are bounded by ``rows``, so they can be broadcast.
    """
    chosen = (labels.where(F.expr(grade).isNotNull()).select("doc_id", F.expr(grade).cast("int").alias("grade"))
              .groupBy("doc_id").agg(F.max("grade").alias("grade")).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.col("doc_id").alias("row"), "grade", "text")


def severity_grades(marked: np.ndarray, words: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Grades of labelled rows from 0/1 labels and counts of marked words and all words: 0 if not toxic, else 1 to 3 by
    their share.

    The labels at hand say only whether a text is toxic; how much of it is sets the order within the toxic ones.
    """
    share = marked / words
    return np.where(label > 0, 1 + (share >= 0.01) + (share >= 0.03), 0)


def fit_ordinal(x: list[np.ndarray], y: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch gradient steps (Adam) on the log-likelihood; rows list features."""
    levels = int(y.max(initial=0)) + 1
    if levels < 2:
        return np.zeros(width), np.full(1, 50.0)
    cell, row = np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(x)), [len(v) for v in x])
    share = np.array([(y <= k).mean() for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    at = np.arange(len(y))
    for step in range(1, steps + 1):
        w, gaps = params[:width], np.exp(params[width + 1:])
        cuts = params[width] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, w[cell], minlength=len(y))
        cum = np.concatenate([np.zeros((len(y), 1)), sigmoid(cuts[None, :] - score[:, None]), np.ones((len(y), 1))], axis=1)
        hi, lo = cum[at, y + 1], cum[at, y]
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gscore = -(dhi - dlo)
        gcut = np.zeros(levels + 1)
        np.add.at(gcut, y + 1, dhi)
        np.add.at(gcut, y, -dlo)
        gcut = gcut[1:levels]
        grad = np.concatenate([np.bincount(cell, gscore[row], minlength=width), [gcut.sum()],
                               np.cumsum(gcut[::-1])[::-1][1:] * gaps]) / len(y)
        grad[:width] -= ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate(([0.0], np.cumsum(np.exp(params[width + 1:]))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, vocabulary: int = VOCABULARY) -> OrdinalModel:
    """Model from ``labels(doc_id, toxic)``: at most ``rows`` rows and ``vocabulary`` words reach the driver."""
    counts = _word_counts(sample_rows(docs, labels, "toxic", rows)).persist()
    sizes = {r["grade"] > 0: r["n"] for r in counts.groupBy((F.col("grade") > 0).cast("int").alias("grade")).agg(
        F.countDistinct("row").alias("n")).collect()}
    if len(sizes) < 2:
        counts.unpersist()
        return OrdinalModel({}, (50.0,))
    chosen = _marked_words(counts, float(sizes[False]), float(sizes[True]), 4.0, vocabulary)
    place = {w: k for k, w in enumerate(chosen)}
    rows_at = {r["row"]: (k, r["grade"]) for k, r in enumerate(counts.select("row", "grade").distinct().collect())}
    # What is fetched is bounded by the sampled rows and the vocabulary, and comes in columns.
    found = counts.where(F.col("word").isin(*chosen)).select("row", "word", "n", "total").toArrow()
    counts.unpersist()
    row = np.array([rows_at[r][0] for r in found.column("row").to_pylist()], dtype=np.int64)
    cell = np.array([place[w] for w in found.column("word").to_pylist()], dtype=np.int64)
    n, total = (found.column(c).to_numpy().astype(np.int64) for c in ("n", "total"))
    # z grows with the root of the sample; divided by it, it says how strong a mark is, whatever was sampled.
    strong = np.array([z >= STRONG * np.sqrt(len(rows_at)) for z in chosen.values()], dtype=bool)
    marked = np.bincount(row, n * strong[cell], minlength=len(rows_at)) if len(row) else np.zeros(len(rows_at))
    words_in = np.ones(len(rows_at), dtype=np.int64)
    words_in[row] = np.maximum(total, 1)
    label = np.array([g for _, g in rows_at.values()])
    y = severity_grades(marked, words_in, label)
    order = np.argsort(row, kind="stable")
    x = np.split(cell[order], np.cumsum(np.bincount(row, minlength=len(rows_at)))[:-1])
    _, y = np.unique(y, return_inverse=True)  # grades that occur, in order
    weights, cuts = fit_ordinal(x, y, len(place))
    return OrdinalModel({w: float(weights[k]) for w, k in place.items()}, tuple(float(c) for c in cuts))


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with ``severity`` (expected grade); a column of that name is replaced. No shuffle; the model is bounded."""
    docs = docs.drop("severity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [model.severity(set(words_of(t))) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=[*batch.schema.names, "severity"])
    return docs.mapInArrow(run, widened(docs.schema, "severity", "double"))


def reject_toxic(docs: DataFrame, labels: DataFrame, severity: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """The documents whose expected severity is below ``severity``, with their columns."""
    return score_toxicity(docs, fit_toxicity(docs, labels, rows)).where(F.col("severity") < severity).select(docs.columns)
