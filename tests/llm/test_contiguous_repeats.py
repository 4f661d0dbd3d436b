"""Only what repeats one earlier place in one piece is removed, and all of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import blocks, substring


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n)]


def pieces(text):
    held = blocks.Texts.of(pa.chunked_array([[text]]))
    return [bytes(held.data[a : a + n]) for a, n, _ in zip(*substring.chunks(held))]


def spans_of(spark, rows):
    return {r["doc_id"]: r for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_pieces_of_many_places_are_no_run(spark):
    """Every chunk of the last text is in an earlier one, but no 18 words of it are in one of them."""
    rng = np.random.default_rng(4)
    clean = words(rng, 90)
    rows = [(k, " ".join(words(rng, 30) + clean[k : k + 15] + words(rng, 30))) for k in range(0, 78, 3)]
    rows.append((1000, " ".join(clean)))
    got = spans_of(spark, rows)
    assert not any(r["spans"] for r in got.values())


def test_passages_go_whole(spark):
    """Copies of 18 words and more go to the last chunk, though single chunks of them are in still earlier texts."""
    rng = np.random.default_rng(6)
    rows = []
    for n in range(18, 60):
        passage = words(rng, n)
        rows += [(n, " ".join(words(rng, 5) + passage[4:12] + words(rng, 5))), (100 + n, " ".join(passage)), (200 + n, " ".join(passage))]
    long = words(rng, 60)
    rows += [(300, " ".join(words(rng, 40) + long[20:40])), (301, " ".join(words(rng, 40) + long + words(rng, 40))), (302, " ".join(words(rng, 40) + long + words(rng, 40)))]
    got = spans_of(spark, rows)
    assert all(got[200 + n]["kept_chars"] == 0 and not got[100 + n]["spans"] for n in range(18, 60))
    text = dict(rows)
    shared = set(pieces(text[301])) & set(pieces(text[302]))
    assert len(got[302]["spans"]) == 1 and got[302]["removed_chunks"] == len(shared)


@pytest.mark.parametrize("documents", [500, 2000, 6000])
def test_texts_that_share_no_window_stay_whole_at_any_size(spark, documents):
    """A language of 400 words in which every chunk soon has been seen, but no 18 words twice in a row."""
    rng = np.random.default_rng(documents)
    vocabulary = np.array(words(rng, 400))
    follows = rng.integers(0, 400, (400, 6))
    at, steps = rng.integers(0, 400, documents), []
    for _ in range(400):
        steps.append(at)
        at = follows[at, (rng.random(documents) ** 2 * 6).astype(int)]
    ids = np.stack(steps, axis=1)
    key = np.zeros((documents, 400 - 17), np.uint64)
    for k in range(18):
        key = key * np.uint64(1_000_003) + ids[:, k : k + 400 - 17].astype(np.uint64) + np.uint64(1)
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = (times[which.reshape(key.shape)] > 1).any(1)
    docs = spark.createDataFrame([(i, " ".join(vocabulary[x])) for i, x in enumerate(ids)], "doc_id long, text string")
    got = {r["doc_id"] for r in substring.repeated_spans(docs).where("has_repeats").collect()}
    assert got <= set(np.flatnonzero(shared).tolist()) and shared.mean() < 0.1
