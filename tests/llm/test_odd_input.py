"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import licenses, mixing, ngram_lm, permutation_index, quality, sampling, simhash, substring, toxicity, weak_rules

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("_batch", T.StringType()), T.StructField("size", T.StringType()), T.StructField("fp", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("score", T.StringType()), T.StructField("copies", T.StringType()),
])
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [
    (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, None, None, None), (3, "", "en", "b"),
    (4, " \t\n ", "en", "b"), (5, LONG, "en", "b"), (None, "no id here at all", "en", "c"), (None, None, None, None), (6, "é" * 40 + " \x00 ▁ \U0001f600", "fr", "a"),
    (7, "same same same same same same", None, "a"), (8, "Released under the MIT License.", "en", None),
]
ROWS = [(i, t, lang, s, None, "x", "y", "z", "t", "s", "c") for i, t, lang, s in TEXTS]

PER_DOCUMENT = {
    "quality": lambda d, lab: quality.quality_scores(d, lab),
    "toxicity": lambda d, lab: toxicity.toxicity(d, lab),
    "rules": lambda d, lab: weak_rules.quality_rules(d),
    "substring": lambda d, lab: substring.repeated_spans(d),
    "lm": lambda d, lab: ngram_lm.backoff_scores(d),
    "mix": lambda d, lab: mixing.mix_plan(d),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "license": lambda d, lab: licenses.license_scan(d),
}
STAGES = {
    "accepted": lambda d, lab: quality.accepted(d, lab),
    "first_of_group": lambda d, lab: simhash.first_of_group(d),
    "without_repeats": lambda d, lab: substring.without_repeats(d),
    "mixed": lambda d, lab: mixing.mixed(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (7, 7, 7), (8, None, 1), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(odd, labels, name):
    got = PER_DOCUMENT[name](odd, labels).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((t[0] for t in TEXTS), key=key)


@pytest.mark.parametrize("name", PER_DOCUMENT | STAGES)
def test_empty_tables(spark, odd, labels, name):
    run = (PER_DOCUMENT | STAGES)[name]
    assert run(odd.limit(0), labels).count() == 0
    if name in ("quality", "toxicity", "accepted"):
        assert run(odd, labels.limit(0)).count() == len(TEXTS)


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(odd, labels, name):
    got = STAGES[name](odd, labels)
    assert got.columns == odd.columns and got.count() >= 0


def test_without_labels_scores_are_even(odd, labels):
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["severity"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_segmentations(odd):
    got = sampling.encode(odd).collect()
    assert all(r["round_trip"] for r in got)
    assert {r["doc_id"] for r in got} == {t[0] for t in TEXTS}
    assert sampling.encode(odd.limit(0)).count() == 0
    back = sampling.decode(sampling.encode(odd)).where("sample = 1").select("doc_id", "text").collect()
    assert sorted(r["text"] for r in back) == sorted(t[1] or "" for t in TEXTS)


def test_empty_text_is_fingerprint_zero(odd):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(2, "0" * 16, 2), (3, "0" * 16, 2), (4, "0" * 16, 2), (None, "0" * 16, 2)} <= got


def test_license_found(odd):
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(odd).collect()}
    assert got[8] == "MIT" and got[5] is None


def test_vectors(spark):
    v = [1.0, 2.0]
    rows = [(i, v, 0) for i in range(0, 30)] + [(100, None, 0), (200, [0.0, 0.0], 0), (300, [None, 1.0], 0), (400, [float("nan"), 1.0], 0), (None, v, 0), (500, [1.0], 0), (0, v, 9)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = permutation_index.nearest_neighbours(t).orderBy("query_id", "rank").collect()
    # The row that repeats vec_id 0 is a candidate as any other.
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(0, k + 1, k, 0.0) for k in range(10)]
    few = permutation_index.nearest_neighbours(t.where("vec_id < 4 and label = 0")).collect()
    assert len(few) == 3
    assert permutation_index.nearest_neighbours(t.limit(0)).count() == 0
