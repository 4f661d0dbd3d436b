"""The packed exchange: whatever way the keys take, and whatever the table holds besides."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import blocks, ngram_lm, substring


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(1, 4)))
    passage = " ".join(word() + word() for _ in range(50))
    rows = [(i, " ".join(word() for _ in range(120)) + (" " + passage if i % 9 == 0 else "")) for i in range(150)]
    rows += [(None, passage)] * 3 + [(7, rows[9][1]), (3, None), (4, "")] + [(500, rows[18][1])] * 5
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture()
def small(spark, monkeypatch):
    """Many batches and partitions over a small table, and tasks that are not put together."""
    monkeypatch.setattr(blocks, "BATCH_BYTES", 3000)
    monkeypatch.setattr(blocks, "PARTITION_BYTES", 600)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(df):
    return sorted(map(str, df.collect()))


def test_relays_give_the_same_answers(docs, small):
    for run in (ngram_lm.backoff_scores, substring.repeated_spans):
        one = rows(run(docs, one_hop_bits=40))
        assert rows(run(docs, one_hop_bits=0)) == one and rows(run(docs, one_hop_bits=40)) == one


def test_batches_do_not_change_results(docs, monkeypatch):
    one = rows(ngram_lm.backoff_scores(docs).select("doc_id", F.round("log_score", 6))), rows(substring.repeated_spans(docs).groupBy("doc_id").agg(F.sum("kept_chars")))
    monkeypatch.setattr(blocks, "BATCH_BYTES", 3000)
    monkeypatch.setattr(blocks, "PARTITION_BYTES", 600)
    assert one == (rows(ngram_lm.backoff_scores(docs).select("doc_id", F.round("log_score", 6))), rows(substring.repeated_spans(docs).groupBy("doc_id").agg(F.sum("kept_chars"))))


def test_of_rows_without_doc_id_one_passage_stays(docs, small):
    """The first place is the same one for every window of a passage, though doc_ids do not tell the rows apart."""
    rng = np.random.default_rng(1)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400))
    own = docs.sparkSession.createDataFrame([(None, f"{passage} x{i}") for i in range(6)], "doc_id long, text string").repartition(6)
    kept = sorted(r["kept_chars"] for r in substring.repeated_spans(own).collect())
    assert kept[-1] == len(passage) + 3 and all(k < 30 for k in kept[:-1])


def test_rows_of_requests_hold_many_keys_at_any_size():
    """Keys of a batch over the rows it sends: 0.1 GB to 256 TB. Quarter of a million distinct keys a batch."""
    keys = 250_000
    for power in range(27, 49):
        bits = blocks.partition_bits(1 << power)
        zone = blocks.zone_bits(bits)
        first, then = (1 << zone, 1 << (bits - zone)) if zone else (1 << bits, 1)
        assert keys / first > 30 and keys / then > 30


def test_own_columns_do_not_clash(docs, small):
    clashing = docs.withColumns({c: F.lit("mine") for c in ("batch", "row", "from", "part", "keys", "_quern_batch", "relay", "a.b")})
    got = substring.without_repeats(clashing)
    assert got.columns == clashing.columns
    assert {tuple(r)[2:] for r in got.collect()} == {("mine",) * 8}
