"""The mix against plain Python: hot rows, ties, sources of one document, clashing columns."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def words(n):
    return " ".join(["w"] * n)


def plain(rows, weights=(3, 1, 2), percent=150, most=2, seed="mix-1"):
    """Words taken of each source, and of all."""
    docs = [(i, "" if s is None else "=" + s, len((t or "").split()), hashlib.md5(f"{seed}:{i if i is not None else hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()) for i, t, s, *_ in rows]
    size = Counter()
    for _, s, n, _ in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s == "", s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, target, open_ = percent / 100 * sum(size.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(most * size[s]) for s in full}
        open_ -= full
    queue = []
    for s in order:
        upto = 0
        for i, _, n, k in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[2])):
            upto += n
            queue += [((c * size[s] + upto) / target[s], k, c, s, i, n) for c in range(most) if n and target[s]]
    taken, total = Counter(), 0
    for *_, s, i, n in sorted(queue, key=lambda q: q[:4]):
        if 100 * (total + n) > percent * sum(size.values()):
            break
        total += n
        taken[s, i] += n
    return {s: (size[s], target[s]) for s in order}, taken


CASES = {
    "ordinary": [(i, words(1 + i * 7 % 23), f"s{i % 4}", i) for i in range(200)],
    "a hot row": [(5, words(3), "a", 1)] * 70 + [(i, words(2 + i % 5), f"s{i % 3}", 0) for i in range(100, 160)],
    "rows without doc_id": [(None, words(4), "b", 2)] * 40 + [(None, words(2), None, 0)] * 30 + [(None, None, "b", 0)] * 5 + [(i, words(5), "a", 0) for i in range(20)],
    "sources of one document": [(i, words(6), f"src{i:03}", 0) for i in range(90)],
    "one doc_id in many sources": [(1, words(2), f"src{i % 30:03}", 0) for i in range(60)],
    "no words": [(i, None if i % 2 else " ", "a", 0) for i in range(6)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("small", [False, True])
def test_against_plain_python(spark, monkeypatch, name, small):
    if small:
        for k, v in (("RANGE_ROWS", 2), ("PART_ROWS", 7), ("SORTED_ROWS", 5), ("BUCKETS", 4)):
            monkeypatch.setattr(mixing, k, v)
    rows = CASES[name]
    docs = spark.createDataFrame(rows, SCHEMA)
    goal, taken = plain(rows)
    got = mixing.mix_plan(docs).collect()
    src = lambda r: "" if r["source"] is None else "=" + r["source"]
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == goal[src(r)][0] and abs(r["target"] - goal[src(r)][1]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    mine = defaultdict(int)
    for r in got:
        mine[src(r), r["doc_id"]] += r["taken"]
    assert {k: v for k, v in mine.items() if v} == {k: v for k, v in taken.items() if v}
    out = mixing.mixed(docs).collect()
    assert sum(len((r["text"] or "").split()) for r in out) == sum(taken.values())
    there = Counter(map(tuple, rows))
    assert all(n <= 2 * there[r] for r, n in Counter(map(tuple, out)).items())


def test_own_columns_stay(spark):
    names = ("_words", "_copy", "_doc", "k", "h", "n", "size", "src", "copies", "row", "i", "part", "finish", "a.b")
    docs = spark.createDataFrame(CASES["a hot row"], SCHEMA).withColumns({c: F.lit(f"my {c}") for c in names}).withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == f"my {c}" for r in rows for c in names) and rows[0]["m"] == {"x": 1}
