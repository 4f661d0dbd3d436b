"""The pipeline stage by stage against plain Python, and on odd tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import mixing, quality, sampling, substring
from tests.llm.test_mix import plain
from tests.llm.test_near import first_of_exact_groups
from tests.llm.test_odd_input import ROWS, SCHEMA

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages and junk; labels for two thirds of them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(90):
        words = [word() for _ in range(rng.randint(60, 120))]
        text = ". ".join([" ".join(words), "The end"])
        if i % 9 == 0:
            text += " " + passage
        if i % 10 == 7:
            text = " ".join(["#$% !!! 123"] * 40)
        if i % 15 == 4 and rows:
            old = rows[i - 3][1].split()
            text = " ".join([*old[:-1], "changed"] if i % 2 else old)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("#$%" not in t)) for i, t, *_ in rows if i % 3], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    kept = STAGE["quality"](spark, docs, tables)
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("score >= 0.7").collect()}
    assert rows_of(kept) == rows_of(docs.where(F.col("doc_id").isin(list(good)))) and 60 < len(good) < 90
    alone = STAGE["near_duplicates"](spark, kept, tables)
    assert rows_of(alone) == rows_of(kept.where(F.col("doc_id").isin(list(first_of_exact_groups([(r["doc_id"], r["text"]) for r in kept.collect()])))))
    cut = STAGE["repeated_passages"](spark, alone, tables)
    text = {r["doc_id"]: r["text"] for r in alone.collect()}
    spans = {r["doc_id"]: r["spans"] for r in substring.repeated_spans(alone).collect()}
    assert any(spans.values())
    for r in cut.collect():
        left, at = "", 0
        for s in spans[r["doc_id"]]:
            left, at = left + text[r["doc_id"]][at : s["start"]].rstrip(), s["stop"]
        assert r["text"] == (left + text[r["doc_id"]][at:]).strip() if spans[r["doc_id"]] else r["text"] == text[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    mixed = STAGE["mix"](spark, cut, tables)
    _, taken = plain([tuple(r)[:2] + (r["source"],) for r in cut.collect()])
    assert Counter({k: v for k, v in taken.items() if v}) == Counter({k: v for k, v in Counter(("=" + r["source"], r["doc_id"]) for r in mixed.collect() for _ in r["text"].split()).items()})
    encoded = STAGE["segmentations"](spark, mixed, tables)
    back = Counter((r["doc_id"], r["text"]) for r in sampling.decode(encoded).collect())
    assert back == Counter({(r["doc_id"], r["text"]): 0 for r in mixed.collect()}) + Counter((r["doc_id"], r["text"]) for r in mixed.collect() for _ in range(sampling.SAMPLES))
    assert max(Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()).values()) == 1
    whole = corpus_pipeline.run(spark, tables)
    assert rows_of(whole.select("doc_id", "sample", F.xxhash64("ids"))) == rows_of(encoded.select("doc_id", "sample", F.xxhash64("ids")))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeats, a very long text, other columns with names the stages might use."""
    extra = {c: F.lit(f"my {c}") for c in ("row", "h", "k", "n", "src", "batch", "node", "component_id", "_gone", "_again", "bands", "part", "y", "stats")}
    return spark.createDataFrame(ROWS + ROWS[:3], SCHEMA).withColumns(extra)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, odd, tables, name):
    got = STAGE[name](spark, odd, tables)
    if name != "segmentations":
        assert got.columns == odd.columns
        assert all(r[c] == f"my {c}" for r in got.collect() for c in ("row", "h", "n", "y", "stats"))
    assert got.count() > 0
    empty = STAGE[name](spark, odd.limit(0), tables)
    assert empty.columns == got.columns and empty.count() == 0


def test_whole_pipeline_on_odd_tables(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["round_trip"] for r in got)
    # Documents without words are never mixed in; the copies of a near-duplicate group are gone.
    assert not {2, 3, 4} & {r["doc_id"] for r in got}


def test_no_labels_keep_all_and_ties_go_to_the_smaller_id(spark, tables):
    docs = spark.createDataFrame([(5, "a b c d e f g h", None, None, None), (3, "a b c d e f g h", "x", None, 1), (3, "a b c d e f g h", "x", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.accepted(docs, none).count() == 3
    assert [r["doc_id"] for r in STAGE["near_duplicates"](spark, docs, tables).collect()] == [3]
    assert mixing.mixed(docs.limit(0)).count() == 0
