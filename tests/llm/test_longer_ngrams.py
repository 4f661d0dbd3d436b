"""Stupid backoff of order 3 and 4 against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from quern.llm import ngram_lm


@pytest.mark.parametrize("order", [3, 4])
def test_longer_contexts(spark, order):
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 40)).clip(max=9))) for i in range(60)]
    texts = [t.split() for _, t in rows]
    counts = Counter(tuple(t[i - m : i]) for t in texts for m in range(1, order + 1) for i in range(m, len(t) + 1))
    total = sum(map(len, texts))

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= 2:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(0.4) + score(gram[1:])

    got = {r["doc_id"]: r["log_score"] for r in ngram_lm.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], sum(score(tuple(t[max(0, k - order + 1) : k + 1])) for k in range(len(t))), rel_tol=1e-9, abs_tol=1e-9)
