"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds, and the
result is the expected severity, the sum over k >= 1 of P(grade >= k).

Labels tell toxic from clean only. Grade 0 is clean; toxic training texts get grades 1 to 3 by thirds of
the weight of their marker features, those the training labels themselves show to mark toxic texts.
(Thirds of density instead would set long and short texts against each other under one weight vector.)
Features are words and word beginnings (4 and 6 letters), lower-cased, each weighed by log(1 + count).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_texts, forget, written

GRADES = 3
#: The bound on labelled rows used to fit (taken by hash), and the features kept.
MAX_TRAIN_ROWS, FEATURES, MIN_TOXIC_DOCS = 20_000, 4_096, 3
#: A feature is kept if its smoothed odds of toxic against clean texts exceed this.
MIN_LOG_ODDS = 2.0
STEPS, RATE, PENALTY = 400, 0.1, 1e-4
#: Labels of documents in this fold (crc32 of the doc_id's digits, modulo 4) are never read.
FOLDS, HELD_OUT = 4, 2
FLAG_AT = 0.5

_WORD = regex.compile(r"[\p{L}\p{M}]+")
PREFIXES = (4, 6)


def features(text: str | None) -> tuple[Counter, int]:
    """(feature -> count, number of words) of a whole text."""
    words = Counter(_WORD.findall((text or "").lower()))
    found: Counter = Counter()
    for w, n in words.items():
        found[w] += n
        for k in PREFIXES:
            if len(w) > k:
                found[w[:k] + "*"] += n
    return found, sum(words.values())


def _sample(labels: DataFrame, max_rows: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    return known.where(fold != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def _vocabulary(train: DataFrame) -> dict[str, float]:
    """feature -> log odds, the FEATURES that mark toxic texts most, from document counts summed in each batch first."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                x = big.slice(at, 1000)
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                for t, y in zip(x.column("text").to_pylist(), x.column("toxic").to_pylist()):
                    counts[y].update(features(t)[0].keys())
                names = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], schema=schema)

    totals = train.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = int(totals[0] or 0), int(totals[1]) - int(totals[0] or 0)
    if not toxic or not clean:
        return {}
    by = train.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    kept = by.where(F.col("t") >= MIN_TOXIC_DOCS).withColumn("odds", odds).where(F.col("odds") > MIN_LOG_ODDS)
    # Rank by odds times the root of support: frequent markers first.
    rows = kept.orderBy((F.col("odds") * F.sqrt("t")).desc(), "feature").limit(FEATURES).collect()
    return {r["feature"]: r["odds"] for r in rows}


class OrdinalModel:
    """theta (ascending), weights by feature."""

    def __init__(self, names: list[str], weights: np.ndarray, theta: np.ndarray):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights, self.theta = weights, theta

    def linear(self, text: str | None) -> float:
        found, index = features(text)[0], self.index
        return sum(self.weights[index[f]] * math.log1p(n) for f, n in found.items() if f in index)

    def at_least(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES, a column each."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - eta[:, None], -500, 500)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered whatever raw is: theta_k = raw_1 + sum of exp(raw_j), j = 2 .. k."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def loss_and_gradient(w: np.ndarray, raw: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades plus half the penalty on w, and its gradient by (w, raw)."""
    n, k = len(grade), len(raw)
    bounds = np.concatenate([[-np.inf], thresholds(raw), [np.inf]])
    eta = np.bincount(rows, weights=w[cols] * vals, minlength=n)
    up, low = 1 / (1 + np.exp(-np.clip(bounds[grade + 1] - eta, -40, 40))), 1 / (1 + np.exp(-np.clip(bounds[grade] - eta, -40, 40)))
    up[grade == k], low[grade == 0] = 1.0, 0.0
    p = np.maximum(up - low, 1e-12)
    d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
    g_eta = d_up - d_low  # of the negative log likelihood by eta
    g_theta = np.zeros(k)
    np.add.at(g_theta, grade[grade < k], -d_up[grade < k])
    np.add.at(g_theta, grade[grade > 0] - 1, d_low[grade > 0])
    g_raw = np.cumsum(g_theta[::-1])[::-1].copy()
    g_raw[1:] *= np.exp(raw[1:])
    by_w = np.bincount(cols, weights=g_eta[rows] * vals, minlength=len(w)) / n + PENALTY * w
    return float(-np.log(p).mean() + PENALTY / 2 * (w**2).sum()), np.concatenate([by_w, g_raw / n])


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, features: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights >= 0, theta) by Adam on the penalised log likelihood; (rows, cols, vals) are x's entries.

    Thresholds stay ordered as theta_k = theta_1 + sums of exponentials. All features mark toxicity, so
    weights are held at zero or above.
    """
    w, raw = np.full(features, 0.5), np.concatenate([[2.0], np.zeros(GRADES - 1)])
    m, v = np.zeros(features + GRADES), np.zeros(features + GRADES)
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(w, raw, rows, cols, vals, grade)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = np.maximum(w - move[:features], 0), raw - move[features:]
    return w, thresholds(raw)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> OrdinalModel | None:
    """Fit on at most max_rows labelled documents; None if there are not both kinds, or no marker."""
    known = F.broadcast(_sample(labels, max_rows))  # bounded by max_rows
    train = written(doc_texts(docs).join(known, "doc_id"), "toxic-train")
    odds = _vocabulary(train)
    if not odds:
        forget(train)
        return None
    names = list(odds)
    index = {f: i for i, f in enumerate(names)}
    schema = pa.schema([("cols", pa.list_(pa.int32())), ("vals", pa.list_(pa.float64())), ("mass", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t in x.column("text").to_pylist():
                found = features(t)[0]
                hit = {index[f]: c for f, c in found.items() if f in index}
                out[0].append(list(hit))
                out[1].append([math.log1p(c) for c in hit.values()])
                out[2].append(sum(out[1][-1]))
            yield pa.RecordBatch.from_arrays([pa.array(o, schema.field(i).type) for i, o in enumerate(out)] + [x.column("toxic")], schema=schema)

    # At most max_rows rows of a few features each.
    got = train.select("text", "toxic").mapInArrow(run, "cols array<int>, vals array<double>, mass double, toxic int").toArrow()
    forget(train)
    sizes = np.array([len(c) for c in got.column("cols").to_pylist()])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cols = np.asarray(got.column("cols").combine_chunks().flatten()).astype(np.int64)
    vals = np.asarray(got.column("vals").combine_chunks().flatten()).astype(float)
    mass, toxic = np.asarray(got.column("mass")), np.asarray(got.column("toxic"))
    cuts = np.quantile(mass[toxic == 1], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, mass, side="right"), 0)
    weights, theta = fit_cumulative_link(rows, cols, vals, grade, len(names))
    return OrdinalModel(names, weights, theta)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, severity (expected grade, 0 to 3), p_toxic (P(grade >= 1)), toxic (1 if p_toxic >= 0.5, else 0).

    Null and empty texts have no features and get the severity of a text without markers. Repeated rows
    and null doc_ids get a row each; labels that are null or neither 0 nor 1 are ignored; without toxic
    and clean labels, or without any marker, all severities are 0. Other columns are ignored.
    """
    model = fit(docs, labels, max_rows)
    own = doc_texts(docs)
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("toxic"))
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p = model.at_least(np.array([model.linear(t.as_py()) for t in x.column("text")], float))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p[:, 0] >= FLAG_AT).astype(np.int32))], schema=schema)

    return own.mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic int")
