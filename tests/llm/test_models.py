"""The fitted models against plain Python and closed forms."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import quality, toxicity


def plain_statistics(text):
    raw = text.encode()
    words = [w.encode() for w in re.findall("[^ \t\n\v\f\r]+", text)]
    n = len(words)
    if not n:
        return {"log_words": 0.0, "log_bytes": math.log1p(len(raw))}
    rows = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    pairs = list(zip(words, words[1:]))
    share = lambda chars: sum(b in chars for b in raw) / len(raw)
    return {
        "log_words": math.log1p(n), "log_bytes": math.log1p(len(raw)), "word_length": sum(map(len, words)) / n, "long_words": sum(len(w) > 12 for w in words) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n, "distinct_words": len(set(words)) / n, "top_word": max(map(words.count, words)) / n,
        "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share(b"0123456789"), "symbols": share(b"#*$%&<>@^~=+\\"), "exclamations": share(b"!"), "bars": share(b"|"),
        "high_bytes": sum(b >= 128 for b in raw) / len(raw), "words_per_line": math.log1p(n / len(rows)), "repeated_lines": 1 - len(set(rows)) / len(rows),
        "repeated_pairs": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0, "sentence_ends": sum(w[-1:] in (b".", b"?", b"!") for w in words) / n,
    }


@settings(max_examples=80, deadline=None)
@given(st.text("abcAB1 !|#.\n\té", max_size=60))
def test_statistics(text):
    got = dict(zip(quality.STATISTICS, quality.statistics(text)))
    assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in plain_statistics(text).items())


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, len(quality.STATISTICS)))
    phi = quality.FourierMap(np.zeros(x.shape[1]), np.ones(x.shape[1]), features=40_000)(x)[:, :-1]
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(phi @ phi.T - np.exp(-d2 / (2 * x.shape[1] * quality.BANDWIDTH**2))).max() < 0.04


def test_normal_equations_and_ridge(spark):
    """Partition sums equal the whole matrix product; the fit is the ridge solution on rows of its folds."""
    rng = np.random.default_rng(1)
    stats = rng.standard_normal((300, len(quality.STATISTICS)))
    y = (stats[:, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    rows = spark.createDataFrame([(i, s.tolist(), float(t)) for i, (s, t) in enumerate(zip(stats, y))], "doc_id long, stats array<double>, y double").repartition(7)
    model = quality.fit(rows)
    fold = np.array([__import__("zlib").crc32(str(i).encode()) % 4 for i in range(300)])
    own = fold != quality.CALIBRATION
    assert np.allclose(model.features.mean, stats.mean(0)) and np.allclose(1 / model.features.scale, stats.std(0))
    phi = model.features(stats[own])
    a, c = quality.normal_equations(rows.where("pmod(crc32(string(doc_id)), 4) != 3"), model.features)
    assert np.allclose(a, phi.T @ phi) and np.allclose(c, phi.T @ y[own])
    weights = np.linalg.solve(phi.T @ phi + quality.PENALTY * own.sum() * np.eye(phi.shape[1]), phi.T @ y[own])
    assert np.allclose(model.weights, weights)
    order = np.argsort(model.raw(stats))
    score = model.score(stats)[order]
    assert (np.diff(score) >= -1e-12).all() and 0 <= score.min() and score.max() <= 1


def plain_isotonic(values):
    """Least squares under order: the mean of each value's block is the max over starts of the min over ends of means."""
    n = len(values)
    return [max(min(sum(values[i : j + 1]) / (j + 1 - i) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12))
def test_isotonic_is_the_least_squares_fit(values):
    xs, ys = quality.isotonic(np.array(values, float), np.ones(len(values)), np.arange(len(values), dtype=float))
    want = plain_isotonic(values)
    assert np.allclose(sorted(set(np.round(ys, 9))), sorted(set(np.round(want, 9))))


def test_held_out_labels_are_not_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    plain = lambda t: sorted((r["doc_id"], round(r["score"], 9)) for r in quality.quality_scores(docs, t).collect())
    assert plain(labels) == plain(turned)
    kept = {r["doc_id"] for r in quality.accepted(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_gradient_of_the_ordinal_likelihood(seed):
    rng = np.random.default_rng(seed)
    n, features = 30, 6
    x = rng.random((n, features)) * (rng.random((n, features)) < 0.4)
    rows, cols = np.nonzero(x)
    grade = rng.integers(0, toxicity.GRADES + 1, n)
    w, raw = rng.random(features), rng.standard_normal(toxicity.GRADES)
    loss, grad = toxicity.loss_and_gradient(w, raw, rows, cols, x[rows, cols], grade)
    theta, eta = toxicity.thresholds(raw), x @ w
    below = lambda k, e: 0.0 if k < 0 else 1.0 if k >= toxicity.GRADES else 1 / (1 + math.exp(e - theta[k]))
    plain = -sum(math.log(below(g, e) - below(g - 1, e)) for g, e in zip(grade, eta)) / n + toxicity.PENALTY / 2 * (w**2).sum()
    assert math.isclose(loss, plain, rel_tol=1e-9)
    both = np.concatenate([w, raw])
    for i in range(len(both)):
        step = np.zeros(len(both))
        step[i] = 1e-6
        up, down = (toxicity.loss_and_gradient((both + s)[:features], (both + s)[features:], rows, cols, x[rows, cols], grade)[0] for s in (step, -step))
        assert math.isclose((up - down) / 2e-6, grad[i], rel_tol=1e-4, abs_tol=1e-7)


def test_expected_severity_grows_with_markers(spark):
    """Texts with more markers get a higher expected grade, never a lower one."""
    rng = np.random.default_rng(2)
    words = lambda k: [f"plain{i}" for i in rng.integers(0, 50, k)]
    rows = [(i, " ".join(words(20) + ["vile"] * (i % 10) + ["awful"] * (i % 10)), int(i % 10 > 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()}
    by = [np.mean([got[i]["severity"] for i, *_ in rows if i % 10 == k]) for k in range(10)]
    assert by == sorted(by) and by[0] < 0.5 and by[9] > 2 and all(got[i]["toxic"] == t for i, _, t in rows)
