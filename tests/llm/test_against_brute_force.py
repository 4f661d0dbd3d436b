"""Operators against plain Python over small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quern.llm import blocks, components, hot, licenses, mixing, permutation_index, quality, sampling, simhash, substring, toxicity, weak_rules
from quern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    theirs = c.sql(ORACLE_SQL[name])
    at = [theirs.columns.index(x) for x in cols]
    assert sorted(str([r[x] for x in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in theirs.fetchall())


def plain_fingerprint(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, texts, spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    assert {i: r["component_id"] for i, r in got.items()} == comp
    kept = {r["doc_id"] for r in simhash.first_of_group(docs).collect()}
    assert kept == set(comp.values())


def test_links_with_hot_shards(spark):
    """All fingerprints in one shard of many blocks: no link is lost."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1, 1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(10, rng.integers(0, 6), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(1, 1 << 62, 50)}
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius=1, block=16)).collect()
    root = {f: f for f in fps} | {r["node"]: r["root"] for r in found}
    comp = {f: f for f in fps}
    for _ in range(20):
        for a, b in combinations(sorted(fps), 2):
            if (a ^ b).bit_count() <= 1:
                comp[a] = comp[b] = min(comp[a], comp[b])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(root) == groups(comp)


@pytest.mark.parametrize("seed", range(4))
def test_links_in_blocks(spark, seed):
    """Groups of all sizes with one, several or no large component: components equal those of all pairs, and what is compared stays near linear."""
    rng = np.random.default_rng(seed)
    rows, compared = [], spark.sparkContext.accumulator(0)
    for key, (n, kinds) in enumerate([(3, 2), (40, 1), (90, 3), (60, 60), (200, 2), (1, 1)]):
        rows += [(key, 1000 * key + int(i), float(rng.integers(0, kinds)) * 10 + (rng.random() if i % 11 else 500.0 + i)) for i in range(n)]
    near = lambda x, y: abs(x["at"] - y["at"]) < 1.5

    def search(left, right):
        compared.add(len(left) * len(left if right is None else right))
        return [(x["node"], y["node"]) for x in left for y in (left if right is None else right) if x["node"] != y["node"] and near(x, y)]

    members = spark.createDataFrame(rows, "key int, node long, at double").selectExpr("key", "struct(node, at) as member").repartition(5)
    found = components.components(hot.block_links(members, lambda m: m["node"], search, 16, "test")).collect()
    root = {n: n for _, n, _ in rows} | {r["node"]: r["root"] for r in found}
    comp = {n: n for _, n, _ in rows}
    for _ in range(3):
        for (k, a, x), (j, b, y) in combinations(rows, 2):
            if k == j and abs(x - y) < 1.5 and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(root) == groups(comp)


def test_a_group_of_copies_is_compared_in_proportion_to_its_size(spark):
    work = []
    for n in (400, 800):
        compared = spark.sparkContext.accumulator(0)

        def search(left, right):
            compared.add(len(left) * len(left if right is None else right))
            return [(x, (left if right is None else right)[0]) for x in left]

        members = spark.createDataFrame([(1, i) for i in range(n)], "key int, member long")
        assert components.components(hot.block_links(members, lambda m: m, search, 20, "test")).count() == n - 1
        work.append(compared.value)
    assert work[1] < 2.5 * work[0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60), st.integers(0, 255), st.integers(0, 8))
def test_bk_tree(items, x, radius):
    assert sorted(simhash.BKTree(items).within(x, radius)) == sorted({i for i in items if (i ^ x).bit_count() <= radius})


def test_shard_keys_hold_every_link():
    for n in (10, 10**6, 10**9):
        b = simhash.shard_blocks(n, 4)
        assert 5 <= b <= 8


@pytest.mark.parametrize("hot_node", [0, 3, 1000])
def test_components(spark, monkeypatch, hot_node):
    monkeypatch.setattr(components, "HOT_NODE", hot_node)
    stars = [(1000, i) for i in range(900, 940)] + [(2000, i) for i in range(2001, 2040)] + [(2039, 930)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: 900 for i in [*range(901, 940), 1000, *range(2000, 2040)]}
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}


def test_rule_figures(docs, texts):
    got = {r["doc_id"]: r for r in weak_rules.quality_rules(docs).collect()}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        windows = list(zip(w, w[1:], w[2:]))
        n = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
        rows = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(rows) - len(set(rows)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    patterns = Counter(r["votes"] for r in got.values())
    found = weak_rules.estimate(sorted(patterns.items()))
    assert all(math.isclose(r["posterior"], found.posterior(r["votes"]), rel_tol=1e-9) for r in got.values())


def test_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = weak_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) > 0.95 * len(got)


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.select("doc_id", "held_out").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.9 * len(rows)


def test_isotonic():
    rng = np.random.default_rng(0)
    y = rng.random(200) + np.linspace(0, 2, 200)
    xs, ys = quality.isotonic(y, np.ones(200), np.arange(200.0))
    assert (np.diff(ys) > 0).all() and (np.diff(xs) > 0).all()
    assert math.isclose(np.interp(199, xs, ys), y.max(), rel_tol=1) and math.isclose(y.sum(), y.mean() * 200)


def test_toxicity_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = [(r["p_toxic"], r["toxic"], r["y"], r["severity"]) for r in toxicity.toxicity(docs, labels).join(labels.selectExpr("doc_id", "toxic as y"), "doc_id").where("crc32(string(doc_id)) % 4 = 2").collect()]
    assert sum(t == y for _, t, y, _ in rows) > 0.97 * len(rows)
    assert all(0 <= s <= 3 for *_, s in rows)


def test_cumulative_link_thresholds_are_ordered():
    rows, cols = np.arange(60), np.arange(60) % 3
    grade = cols + (np.arange(60) % 7 == 0)
    w, theta = toxicity.fit_cumulative_link(rows, cols, np.ones(60), np.minimum(grade, 3), 3)
    assert (np.diff(theta) > 0).all() and w[2] > w[0]


def test_mix_targets(docs):
    rows = mixing.mix_plan(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    for own in by.values():
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert math.isclose(sum(own[0]["target"] for own in by.values()), 1.5 * total, rel_tol=1e-12)
    assert sum(r["taken"] for r in rows) <= 1.5 * total
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, rows))


def test_recall(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in t.collect()}
    got = permutation_index.nearest_neighbours(t, every=20).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["score"], r["vec_id"]))
    hit = 0
    for q, near in found.items():
        exact = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        hit += len({i for _, i in exact} & {i for _, i in near})
        assert near == sorted(near) and len(near) == 10
    assert set(found) == {i for i in rows if i % 20 == 0} and hit >= 0.9 * 10 * len(found)


def test_repeated_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(30)]
    rows += [(100 + i, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30))) for i in range(10)]
    rows += [(200, rows[3][1])]
    got = {r["doc_id"]: r for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert not any(got[i]["spans"] for i in [*range(30), 100])
    for i in range(101, 110):
        (span,) = got[i]["spans"]
        assert text[i][span["start"] : span["stop"]] in passage and got[i]["removed_words"] >= 40
    assert got[200]["kept_chars"] == 0
    clean = {r["doc_id"]: r["text"] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[200] == "" and clean[5] == text[5] and len(clean[105].split()) <= 80


def test_chunks_cover_texts_and_resist_insertions():
    column = lambda *ts: __import__("pyarrow").chunked_array([list(ts)])
    rng = np.random.default_rng(9)
    a = "".join(rng.choice(list("abcdefgh "), 5000))
    texts = blocks.Texts.of(column(a, "", "xx" + a, "z" * 3000))
    start, length, document = substring.chunks(texts)
    assert np.array_equal(start[1:], (start + length)[:-1]) and length.sum() == len(texts.data) and length.max() <= substring.MAX_CHUNK
    held = [{bytes(texts.data[s : s + n]) for s, n, d in zip(start, length, document) if d == k} for k in (0, 2)]
    assert len(held[0] & held[1]) > 0.95 * len(held[0])


def test_words_of_batches():
    texts = blocks.Texts.of(__import__("pyarrow").chunked_array([["ab  c", "d", "", None, "é\x0bf "]]))
    start, length, document = texts.words()
    assert [bytes(texts.data[s : s + n]).decode() for s, n in zip(start, length)] == ["ab", "c", "d", "é", "f"]
    assert document.tolist() == [0, 0, 1, 4, 4]


@pytest.fixture(scope="module")
def vocabulary():
    return sampling.Vocabulary.load(sampling.MODEL)


def every_path(lat, node):
    if not lat.count[node]:
        return [((), 0.0)]
    out = []
    for e in range(lat.first[node], lat.first[node] + lat.count[node]):
        out += [((int(lat.piece[e]), *p), lat.logp[e] + s) for p, s in every_path(lat, lat.target[e])]
    return out


def test_lattice_is_whole_and_normalised(vocabulary):
    unit = "▁banana"
    lat = sampling.Lattices(vocabulary)
    paths = every_path(lat, lat.starts(["▁other", unit])[1][0])
    assert math.isclose(sum(math.exp(s) for _, s in paths), 1, rel_tol=1e-9)
    assert {"".join(vocabulary.text_of[i].decode() for i in p) for p, _ in paths} == {" banana"}
    pieces = {t.decode() for t in vocabulary.text_of.values() if len(t) > 0 and not t[0] & 0x80}
    assert len(paths) == len({p for p, _ in paths}) > 10 and all(vocabulary.text_of[i].decode() in pieces for p, _ in paths for i in p)


def test_samples_follow_the_lattice(vocabulary, monkeypatch):
    """First samples are draws from the paths' probabilities; second ones from what is left."""
    flat = sampling.Vocabulary.load(sampling.MODEL)
    flat.score = flat.score * 0.1
    flat.byte_score *= 0.1
    text, n = sampling._shown("aba"), 6000
    lat = sampling.Lattices(flat)
    p = {path: math.exp(s) for path, s in every_path(lat, lat.starts([text])[0][0])}
    got = sampling.sample_segmentations(flat, [text] * n, np.arange(n, dtype=np.uint64) * np.uint64(104729), 2)
    assert all(len(g) == 2 and g[0][0] != g[1][0] and g[0][2] >= g[1][2] for g in got)
    first, second = (Counter(tuple(g[k][0]) for g in got) for k in range(2))
    for path, q in p.items():
        assert abs(first[path] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
        then = sum(r * q / (1 - r) for other, r in p.items() if other != path)
        assert abs(second[path] / n - then) < 4 * math.sqrt(then * (1 - then) / n) + 1e-3


def test_samples_do_not_depend_on_the_batch(vocabulary):
    texts = [sampling._shown(t) for t in ("the quick brown fox", "jumps over\nthe lazy dog", "", "é▁ \x00")]
    seeds = np.arange(4, dtype=np.uint64)
    together = sampling.sample_segmentations(vocabulary, texts, seeds, 3)
    alone = [sampling.sample_segmentations(vocabulary, [t], seeds[i : i + 1], 3)[0] for i, t in enumerate(texts)]
    for a, b in zip(together, alone):
        assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
    for most in (0, 40, 1 << 20):  # kept lattices, whether or not they are thrown away in between
        lat = sampling.Lattices(vocabulary, most)
        for _ in range(2):
            kept = [[(p.tolist(), *rest) for p, *rest in sampling.sample_paths(vocabulary, [t], seeds[i : i + 1], 3, lat)[0]] for i, t in enumerate(texts)]
            assert kept == alone


def test_pieces_of_blanks_are_in_the_lattice(vocabulary):
    lat = sampling.Lattices(vocabulary)
    seen = {sum(c.isspace() for c in vocabulary.text_of[i].decode()) for p, _ in every_path(lat, lat.starts([sampling._shown("      x")])[0][0]) for i in p}
    assert seen >= {1, 2, 3, 4}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n▁é", max_size=12), max_size=4))
def test_units(texts):
    shown = [sampling._shown(t) for t in texts]
    code, firsts, cuts = sampling.units_of(shown)
    whole = "".join(shown)
    got = [[whole[a:b] for a, b in zip(firsts[i:j], [*firsts[i + 1 :], len(whole)])] for i, j in zip(cuts, cuts[1:])]
    assert got == [sampling._UNIT.findall(t) for t in shown]
    assert "".join(map(chr, code)) == whole


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 63, 20_000, np.uint64))
    table = sampling._Table()
    for part in np.array_split(rng.permutation(keys), 7):
        assert (table.get(part) == -1).all()
        table.put(part, part.astype(np.int64) % 1000)
    assert np.array_equal(table.get(keys), keys.astype(np.int64) % 1000) and (table.get(keys + np.uint64(1 << 63)) == -1).all()


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_round_trip(text):
    v = _vocabulary()
    for pieces, *_ in sampling.sample_segmentations(v, [sampling._shown(text)], np.zeros(1, np.uint64), 3)[0]:
        assert sampling.decoded(sampling.piece_ids(pieces, v), v) == text


def test_copies_get_samples_of_their_own(spark):
    rows = [(1, "one fine text")] * 3 + [(2, "another text")] + [(None, "banana republic")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in sampling.encode(docs, by_copies=True).collect():
        got[r["doc_id"]].append((r["sample"], tuple(r["ids"])))
    assert {i: sorted(k for k, _ in x) for i, x in got.items()} == {1: [*range(1, 7)], 2: [1, 2], None: [*range(1, 41)]}
    assert len({p for _, p in got[1]}) == 6 and all(len({p for k, p in got[None] if a < k <= a + 16}) == min(16, 40 - a) for a in (0, 16, 32))
    plain = {(r["doc_id"], r["sample"], tuple(r["ids"])) for r in sampling.encode(docs).collect()}
    assert plain <= {(i, k, p) for i, x in got.items() for k, p in x}


def test_units_of_one_hash(vocabulary, monkeypatch):
    """Texts that do not come out as they were get lattices of their own."""
    monkeypatch.setattr(sampling, "mixed64", lambda x, f=sampling.mixed64: f(x) if len(x) != 3 else np.full(3, 5, np.uint64))
    (batch,) = sampling._Encoder(vocabulary, 2, 0).encoded([(1, "ab", 1, 0), (2, "cde", 1, 0), (3, "f", 1, 0)])
    assert all(batch.column("round_trip").to_pylist())


def _vocabulary(made=[]):
    if not made:
        made.append(sampling.Vocabulary.load(sampling.MODEL))
    return made[0]


def test_license_windows():
    s = licenses.Scanner()
    assert s.scan("Some prose.\nReleased under the MIT License.\nMore of it, and a lot of it too.")[0] == "MIT"
    assert s.scan("Permission is granted to nobody.") == (None, 0.0, 0, 0)
    for name, text in licenses.TEMPLATES:
        assert s.scan(text)[:2] == (name, 1.0)
        inside = "Here, in a line of prose, " + text.replace(". ", ".\n\n") + " Some more words after it."
        assert s.scan(inside)[:2] == (name, 1.0)
    assert s.scan("This project is released under the MIT License.")[0] == "MIT"
    for n in range(2, 200):
        near = [s.templates[k][0] for k in s.candidates(n)]
        assert near == [m for m in s.sizes if 2 * min(m, n) / (m + n) >= licenses.THRESHOLD - 1e-9]


def plain_windows(scanner, words):
    found, pairs = set(), list(zip(words, words[1:]))
    for size, i, name, bag in scanner.templates:
        for x, p in enumerate(pairs):
            window = pairs[x : x + size]
            dice = 2 * sum((Counter(window) & bag).values()) / (len(window) + size)
            if p in bag and dice >= scanner.threshold:
                found.add((round(dice, 9), i, name, x))
    return found


def test_windows_against_all_windows():
    """Templates with words changed, dropped or doubled, in a stream of their own words: every window is found."""
    rng = np.random.default_rng(10)
    s = licenses.Scanner()
    hits = 0
    for _ in range(60):
        words = []
        for k in rng.integers(0, len(licenses.TEMPLATES), 3):
            own = licenses.normalised(licenses.TEMPLATES[k][1])
            for w in own:
                words += [[w], [w], [w, w], [], [f"x{rng.integers(9)}"]][min(4, int(rng.exponential(0.5)))]
            words += list(rng.choice(own, 5))
        got = {(round(d, 9), i, name, x) for d, i, name, x in s.windows(words)}
        assert got == plain_windows(s, words)
        hits += len(got)
    assert hits > 100


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["round_trip"] for r in rows)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(250, 260), max_size=30))
def test_counts_travel_whole(values):
    for pack, unpack in (blocks.COUNTS, blocks.NUMBERS):
        assert unpack(pack(np.array(values, np.int64)), len(values)).tolist() == values


def test_keys_of_a_partition_stay_apart():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2))
    for bits in (0, 3, 8):
        t = blocks.requests(1, keys, np.arange(len(keys)), bits, blocks.COUNTS[0])
        got = [len(np.unique(blocks.unpack(b))) for b in t.column("keys").to_pylist()]
        assert sum(got) == len(keys) and len(got) == 2**bits
        t = blocks.requests(1, keys, np.arange(len(keys)), bits, blocks.COUNTS[0], blocks.RELAY_KEY_BYTES)
        parts = zip(t.column("part").to_pylist(), t.column("keys").to_pylist())
        back = [(blocks.unpack(b, blocks.RELAY_KEY_BYTES) >> np.uint64(bits)) | np.uint64(p << (64 - bits) if bits else 0) for p, b in parts]
        assert np.array_equal(np.concatenate(back), keys)
