"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

A text becomes a short vector of statistics, standardised on the training rows; random Fourier features
approximate a Gaussian kernel on them. Each partition sums its own normal equations, the sums are added
by row of the matrix, and one small system is solved on the driver. The ridge score is calibrated by
isotonic regression over a fixed number of bins, on a fold that the ridge fit has not seen.
Only text reaches a score: labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_texts, forget, written

STATISTICS = (
    "log_words", "log_bytes", "word_length", "long_words", "short_words", "distinct_words", "top_word",
    "upper", "digits", "symbols", "other_punctuation", "exclamations", "bars", "high_bytes",
    "words_per_line", "repeated_lines", "repeated_pairs", "sentence_ends",
)
#: Random features, ridge penalty per row, bandwidth in standard deviations times sqrt(statistics).
FEATURES, PENALTY, BANDWIDTH, SEED = 256, 1e-4, 1.0, 20
#: Calibration bins, and the bound on labelled rows used to fit (taken by hash, the same on reruns).
BINS, MAX_TRAIN_ROWS = 2048, 1_000_000
THRESHOLD = 0.7
#: crc32 of the doc_id's digits, modulo 4: 2 is held out, 3 calibrates, the others fit the ridge.
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3


def _class_of_byte() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for i in range(256):
        c = chr(i)
        kind[i] = 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in "#*$%&<>@^~=+\\" else 4 if c == "!" else 5 if c == "|" else 6 if c in ".,;:?'\"()-_/[]{}`" else 7 if i >= 128 else 0
    return kind


_KIND = _class_of_byte()


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; a null, empty or blank text has all zeros but its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0, float(np.log1p(size))] + [0.0] * (len(STATISTICS) - 2)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = n - 1
    ends = sum(w[-1:] in b".?!" for w in words)
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), float((lengths > 12).mean()), float((lengths <= 3).mean()),
        len(counts) / n, max(counts.values()) / n,
        *(float(x) for x in kinds[[1, 2, 3, 6, 4, 5, 7]]),
        float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:]))) / pairs if pairs else 0.0, ends / n,
    ]


def document_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, stats array<double>) of every document, and the columns (double) named besides."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64())), *((c, pa.float64()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array([statistics(t.as_py()) for t in x.column("text")], type=schema.field(1).type), *map(x.column, more)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return own.mapInArrow(run, ", ".join(["doc_id long", "stats array<double>", *(f"{c} double" for c in more)]))


class FourierMap:
    """Standardises, then maps to cos(xW + b): inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / (BANDWIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) * self.scale, -8, 8)
        phi = np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([phi, np.ones((len(z), 1))])


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def normal_equations(train: DataFrame, features: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """(A, c) with A = sum of phi phi', c = sum of phi y, summed in each partition before the shuffle."""
    d = features.w.shape[1] + 1
    schema = pa.schema([("i", pa.int32()), ("part", pa.list_(pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for x in batches:
            stats, y = _stack(x.column("stats")), np.asarray(x.column("y"))
            for k in range(0, len(y), 4096):
                phi = features(stats[k : k + 4096])
                total += phi.T @ np.hstack([phi, y[k : k + 4096, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), type=schema.field(1).type)], schema=schema)

    def add(x: pa.Table) -> pa.Table:
        total = sum(_stack(c.column("part")).sum(0) for c in x.to_batches())
        return pa.Table.from_arrays([x.column("i")[:1], pa.array([total], type=schema.field(1).type)], schema=schema)

    rows = train.select("stats", "y").mapInArrow(part, "i int, part array<double>").groupBy("i").applyInArrow(add, "i int, part array<double>").collect()
    total = np.zeros((d, d + 1))
    for r in rows:  # d rows, whatever the input
        total[r["i"]] = r["part"]
    return total[:, :d], total[:, d]


def isotonic(sums: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: (positions, means) of the blocks, both increasing."""
    blocks: list[list[float]] = []
    for s, n, x in zip(sums, counts, at):
        blocks.append([s, n, x * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class QualityModel:
    """Fitted map from statistics to a calibrated score."""

    def __init__(self, features: FourierMap, weights: np.ndarray, xs: np.ndarray, ys: np.ndarray):
        self.features, self.weights, self.xs, self.ys = features, weights, xs, ys

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # A hair of the raw score keeps order inside flat calibrated blocks.
        return np.clip(np.interp(raw, self.xs, self.ys) * (1 - 1e-3) + 1e-3 * np.clip(raw, 0, 1), 0, 1)


def fit(train: DataFrame) -> QualityModel | None:
    """Fit on rows (doc_id, stats, y in {0, 1}); None if there are none.

    With no row for calibration, the ridge's own rows calibrate.
    """
    if train.isEmpty():
        return None
    train = train.withColumn("fold", _fold())
    k = len(STATISTICS)
    moments = train.agg(*(F.avg(F.col("stats")[i]) for i in range(k)), *(F.stddev_pop(F.col("stats")[i]) for i in range(k))).first()
    features = FourierMap(np.array(moments[:k], float), np.array(moments[k:], float))
    a, c = normal_equations(train.where(F.col("fold") != CALIBRATION), features)
    rows = max(a[-1, -1], 1.0)
    weights = np.linalg.solve(a + PENALTY * rows * np.eye(len(a)), c)
    model = QualityModel(features, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    tune = train.where(F.col("fold") == CALIBRATION)
    binned = _bins(tune, model) or _bins(train, model)
    model.xs, model.ys = isotonic(*(np.array(x, float) for x in zip(*((r["s"], r["n"], r["x"]) for r in binned))))
    return model


def _bins(rows: DataFrame, model: QualityModel) -> list:
    schema = pa.schema([("raw", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stack(x.column("stats")))), x.column("y")], schema=schema)

    raw = rows.select("stats", "y").mapInArrow(run, "raw double, y double")
    bin_ = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (BINS / 2))
    return raw.groupBy(bin_.alias("bin")).agg(F.sum("y").alias("s"), F.count("*").alias("n"), F.avg("raw").alias("x")).orderBy("bin").collect()


def scores(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, score) of rows (doc_id, stats); 0.5 for all if no label was there to learn from."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(model.score(_stack(x.column("stats"))))], schema=schema)

    return stats.mapInArrow(run, "doc_id long, score double")


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


def training_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from: not held out, 0 or 1, each once; beyond max_rows about
    as many, those with the lowest hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.where(F.col("y").isin(0.0, 1.0) & (_fold() != HELD_OUT)).distinct()
    n = known.count()
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n)) if n > max_rows else known


def _fitted(train: DataFrame) -> QualityModel | None:
    train = written(train, "train")
    model = fit(train)
    forget(train)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7, else 0).

    Labels of held-out documents (crc32 of the doc_id's text modulo 4 is 2) are never read. Labels that
    are null or neither 0 nor 1 are ignored, repeated ones count once. Null and empty texts are scored
    from all-zero statistics. A null doc_id is scored, never trained on and not held out. An empty table
    gives no rows; without any label every score is 0.5. Other columns are ignored.
    """
    stats = written(document_statistics(docs), "statistics")
    model = _fitted(training_labels(labels, max_rows).join(stats, "doc_id").select("doc_id", "stats", "y"))
    held_out = F.coalesce(_fold() == HELD_OUT, F.lit(False))
    return scores(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept, in one pass without a shuffle.

    The model is fitted as in quality_scores, from the statistics of the labelled texts alone: their labels
    are broadcast (at most about max_rows), so no text is shuffled. Without any label every row stays.
    """
    known = F.broadcast(training_labels(labels, max_rows))
    model = _fitted(document_statistics(doc_texts(docs).join(known, "doc_id"), "y"))
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                score = model.score(np.array([statistics(t.as_py()) for t in x.column("text")]))
                yield x.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
