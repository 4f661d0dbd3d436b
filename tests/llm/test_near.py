"""The pipeline's near-duplicate stage against exact Jaccard similarity of five-word shingles."""

from __future__ import annotations

from itertools import combinations

import numpy as np

import corpus_pipeline
from quern.llm import near
from quern.llm.components import components
from quern.llm.simhash import BKTree


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def first_of_exact_groups(rows):
    sets = {i: grams(t) for i, t in rows}
    comp = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    return set(comp.values())


def test_stage_reaches_similarity_of_four_fifths(spark):
    """Texts with one to four words changed: those at 0.8 and over go, those below stay."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        words = [f"w{rng.integers(1 << 30)}" for _ in range(100)]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 6):
            changed = list(words)
            for at in rng.choice(100, k, replace=False):
                changed[at] = f"x{rng.integers(1 << 30)}"
            rows.append((10 * g + k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == first_of_exact_groups(rows) and len(kept) < len(rows) - 60


def test_large_groups_are_checked_in_blocks(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(rng.integers(0, 120, 90))]
    rows += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(3))) for i in range(20)] + [(2000, ""), (2001, None), (2002, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs, block=16).collect()}
    assert {c for i, c in got.items() if i < 1000 or i == 2002} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(20)) and got[2001] == got[2000] == 2000


def test_fingerprints_are_majorities_of_the_shingles_hashes():
    """Every word of a fingerprint against plain Python, for texts of 1 to 900 shingles with repeats; none without shingles."""
    rng = np.random.default_rng(10)
    text = np.sort(np.concatenate([np.repeat([0, 2, 3, 5, 6], [1, 4, 255, 256, 900])]))
    key = rng.integers(0, 1 << 63, len(text), np.uint64)
    key[-40:] = key[-80:-40]
    owners, got = near.fingerprints(*near.distinct_shingles(key, text), 3, 4)
    assert owners.tolist() == [0, 2, 3, 5, 6]
    for t, row in zip(owners, got):
        own = {int(k) for k in key[text == t]}
        for w, word in enumerate(row.tolist()):
            hashes = [int(near.mixed64(np.array([(k + (w + 4) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) for k in own]
            assert word == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(own))


def test_trees_as_arrays_find_what_a_bk_tree_finds():
    rng = np.random.default_rng(11)
    items = rng.integers(0, 1 << 63, 150, np.uint64)
    items = np.unique(np.concatenate([items, items ^ np.uint64(7), items ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))]))
    for held in (items, items[:1], items[:2]):
        plain, trees = BKTree(held.tolist()), near.Trees(held)
        for radius in (0, 3, near.RADIUS, 30, 64):
            query, item = trees.within(items, radius)
            assert sorted(zip(query.tolist(), item.tolist())) == sorted((i, y) for i, x in enumerate(items.tolist()) for y in plain.within(x, radius))


def test_candidates_are_all_that_the_searches_link(spark):
    """Shards in one or several blocks: the groups are those of all pairs that share a key and whose next words are near."""
    rng = np.random.default_rng(12)
    words, rows = 3, []
    for i in range(120):
        fp = rng.integers(-(1 << 63), 1 << 63, 3 + 2 * (i % 4 == 0))
        if i % 3:
            fp = np.array(rows[i - i % 3][1][:3]) ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 64, (9, 3)), axis=0)
        rows.append((i, fp.tolist()))
    rows.append((500, []))

    def linked(x, y):
        for w in range(min(len(x), len(y))):
            after = (w + 1) % words if w < words else words + (w - words + 1) % 2
            same = any((x[w] >> 6 * t) % 64 == (y[w] >> 6 * t) % 64 for t in range(2))
            if same and ((x[after] ^ y[after]) % (1 << 64)).bit_count() <= near.RADIUS:
                return True
        return False

    comp = {i: i for i, _ in rows}
    for (a, x), (b, y) in combinations(rows, 2):
        if linked(x, y) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    nodes = spark.createDataFrame(rows, "node long, fp array<bigint>")
    for shard_block in (2, 4096):
        found = components(near.candidates(nodes, 6, 2, words, shard_block)).collect()
        assert {r["node"]: r["root"] for r in found} == {i: c for i, c in comp.items() if i != c}
    assert 20 < len(found) < 100


def pairs_at_four_fifths(rng, n):
    """Texts of 4 to 180 shingles, and for each another one at similarity 0.8 exactly: by further words, or by changed ones."""
    for i in range(n):
        k = int(rng.integers(1, 10))
        if i % 3:
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, 4 * k + 4)]
            yield words, words + [f"x{x}" for x in rng.integers(0, 1 << 40, k)]
        else:
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, 45 * k + 4)]
            yield words, [f"x{rng.integers(1 << 40)}" if x % 45 == 20 else w for x, w in enumerate(words)]


def test_searches_find_pairs_at_four_fifths_whatever_their_size(spark):
    """With shards cut small: keys of several bits, texts of 4 and 5 shingles too; no link of 1,500 is lost."""
    rng, rows = np.random.default_rng(13), []
    for i, (a, b) in enumerate(pairs_at_four_fifths(rng, 1500)):
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    sets = [grams(t) for _, t in rows]
    assert all(5 * len(a & b) == 4 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    assert near.layout(len(rows), 32)[0] == 7
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs, shard=32, shard_block=128).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_stage_has_its_candidates_from_the_searches_alone(spark, monkeypatch):
    """Without what the SimHash searches find, only texts of equal words go."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(words).upper()), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 4}
    monkeypatch.setattr(near, "candidates", lambda *_, **__: spark.createDataFrame([], "a long, b long"))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 2, 4}
