"""Repeated windows whatever their hashes, and EM against rates that are known."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import weak_rules


def repeat_words(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    return len({k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)})


@pytest.mark.parametrize("hash_of", ["xxhash64({w}[i], {w}[i + 1], {w}[i + 2])", "0L", "length({w}[i])", "shiftleft(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), 58)"])
def test_repeated_windows_whatever_the_hash(spark, hash_of):
    rng = np.random.default_rng(3)
    texts = ["", "a", "a b c", "a b c a b c", "a a a a", "x y z q x y z q x y z"] + [" ".join("w" * int(k) for k in rng.integers(1, 5, rng.integers(0, 60))) for _ in range(60)]
    made = weak_rules._repeat_words("w", hash_of)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.expr(f"transform(array(regexp_extract_all(text, '([^ ]+)', 1)), w -> {made})[0]").alias("n")).collect()
    assert {r["text"]: r["n"] for r in rows} == {t: repeat_words(t) for t in texts}


@pytest.mark.parametrize("total", [2_000, 200_000])
def test_em_finds_the_rates(total):
    """Rules of known accuracy, one of which finds nearly all bad texts: no cap holds its rate down."""
    rng = np.random.default_rng(5)
    bad = rng.random(total) < 0.2
    on_good, on_bad = np.array([0.02, 0.05, 0.01, 0.03]), np.array([0.95, 0.6, 0.3, 0.5])
    votes_bad = rng.random((total, 4)) < np.where(bad[:, None], on_bad, on_good)
    abstains = rng.random((total, 4)) < 0.1
    patterns = Counter("".join("-" if a else "0" if v else "1" for a, v in zip(x, y)) for x, y in zip(abstains, votes_bad))
    found = weak_rules.estimate(sorted(patterns.items()), 4)
    lean = lambda r, start: (r + weak_rules.PRIOR_SHARE * start) / (1 + weak_rules.PRIOR_SHARE)
    assert abs(found.good - 0.8) < 0.03
    assert np.allclose(found.bad_on_bad, lean(on_bad, weak_rules.START_BAD_ON_BAD), atol=0.08) and found.bad_on_bad[0] > 0.85
    assert np.allclose(found.bad_on_good, lean(on_good, weak_rules.START_BAD_ON_GOOD), atol=0.03)
    verdict = np.array([found.posterior("".join("-" if a else "0" if v else "1" for a, v in zip(x, y))) < 0.5 for x, y in zip(abstains[:2000], votes_bad[:2000])])
    assert (verdict == bad[:2000]).mean() > 0.95
