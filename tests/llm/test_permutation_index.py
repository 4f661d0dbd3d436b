"""The index against exact search: recall where nothing but the index decides, work saved, ties, repeats, any partitioning."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from quern.llm import permutation_index as pi

SCHEMA = "vec_id long, embedding array<float>"


def gaussian(n, d, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def exact(v, q, k=10):
    d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
    d[q] = np.inf
    return set(np.argsort(d, kind="stable")[:k].tolist())


@pytest.mark.parametrize("n, d", [(12_000, 64), (12_000, 256)])
def test_recall_and_work(n, d):
    """One full shard: 0.9 of the exact neighbours and more, for less work than measuring all distances."""
    v = gaussian(n, d).astype(float)
    pivots = pi.pivots_of(v[: pi.SAMPLE], pi.PIVOTS)
    prefix, share = pi.fitted(v[: pi.SAMPLE], pivots, 10)
    shard = pi.Shard(np.arange(n), np.ones(n, np.int64), v, pivots, prefix)
    asked = np.arange(0, n, 100)
    hit = 0
    for q, order in zip(asked, pi.orders(v[asked], pivots, prefix)):
        hit += len(exact(v, q) & {i for _, i in shard.nearest(int(q), v[q], order, 10, share)})
    assert hit >= 0.9 * 10 * len(asked)
    # A distance takes d steps, a posting one.
    work, all_distances = shard.postings + d * shard.distances, d * n * len(asked)
    print(f"{n} x {d}: recall {hit / 10 / len(asked):.3f}, prefix {prefix}, share {share:.3f}, work {work / all_distances:.3f} of exact")
    assert work < 0.75 * all_distances


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("d", [64, 256])
def test_recall_of_the_query(spark, d):
    """Many shards of a clustered and a plain half; the same answer under any partitioning."""
    v = np.vstack([gaussian(5_000, d, 1), (gaussian(40, d, 2)[np.arange(5_000) % 40] + 0.05 * gaussian(5_000, d, 3))]).astype(np.float32)
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA).cache()
    got = found(pi.nearest_neighbours(t.repartition(7)))
    assert got == found(pi.nearest_neighbours(t.repartition(2)))
    hit = sum(len(exact(v, q) & {i for *_, i in x}) for q, x in got.items())
    assert set(got) == set(range(0, 10_000, 100)) and hit >= 0.9 * 10 * len(got)
    whole = found(pi.nearest_neighbours(t, every=1000, share=1.0))
    assert all({i for *_, i in whole[q]} == exact(v, q) for q in whole)
    t.unpersist()


def test_rows_that_repeat_and_tie(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(i, [1.0, 0.0]) for i in range(5, 9)] + [(7, [1.0, 0.0])] * 2 + [(20, [0.0, 1.0]), (0, [0.5, 0.5])]
    got = pi.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["rank"], r["score"])):
        by[r["query_id"]].append(r["vec_id"])
    first = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["score"] == 0.0]
    assert first == [0, 0, 5, 6, 7, 7, 7, 8]
    # Two queries have id 0: one for each of its vectors.
    assert len(got) == 20 and set(by) == {0}


def test_lengths_are_searched_apart(spark):
    rows = [(100 * i, [float(i + 1), 1.0]) for i in range(4)] + [(100 * i + 1000, [float(i + 1), 1.0, 2.0]) for i in range(3)] + [(5000, [1.0])]
    got = found(pi.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)))
    assert {q: sorted(i for *_, i in x) for q, x in got.items()} == {q: [i for i, v in rows if i != q and len(v) == len(dict(rows)[q])] for q, w in rows if len(w) > 1}
