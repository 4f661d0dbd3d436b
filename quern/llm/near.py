"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and BK-trees find candidates, every link is checked.

Texts of Jaccard similarity 0.8 have shingle sets of cosine 8/9 or more, so each bit of their SimHash fingerprints
differs with probability 0.15 (WORST, at the sizes where ties weigh most). That is too much for one word of 64 bits
and a radius of a few, so a fingerprint has as many words as it takes: in each word, TABLES runs of bits are shard
keys, and a shard's BK-tree over the next word (64 bits that the key does not hold) is searched by RADIUS. Keys grow
with the number of texts, which keeps shards at SHARD members, and words with the keys (`layout`), which keeps the
share of pairs at exactly 0.8 that no search finds at MISSED (less above 0.8). Texts of up to SHORT shingles, whose
bits differ more often, have more words.

Texts that a search links, directly or over others, make a candidate group; in a group every pair that
other links do not connect already is checked by its exact shingle sets, in blocks (hot.py); nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import Texts, mixed64
from quern.llm.common import doc_texts, written
from quern.llm.components import components
from quern.llm.hot import block_links
from quern.llm.ngram_lm import ngram_keys
from quern.llm.simhash import keep_least

WIDTH, SIMILARITY, BLOCK = 5, 0.8, 256
#: Members of a shard (as expected) and of a block of shards; tables a word; bits within which a BK-tree is searched.
SHARD, SHARD_BLOCK, TABLES, RADIUS = 1024, 4096, 4, 13
#: Pairs at similarity 0.8 that no search may find; the most that a bit of theirs differs: in any, in one of SHORT shingles.
MISSED, WORST, SHORT, WORST_SHORT = 1e-5, 0.1612, 5, 0.1875
#: A text of a block counts as one, or as so many as it has this many bytes.
BLOCK_BYTES = 32 << 10
#: Bytes of text that are sketched at a time.
SLICE = 1 << 20
#: BK-tree steps that are taken at once.
STEPS = 1 << 17


def normal(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, one blank between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def text_node(words: bytes) -> int:
    """A signed long that names the words; 0 if there is none."""
    n = xxhash.xxh64_intdigest(words, 5) if words else 0
    return n - (1 << 64) if n >> 63 else n


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every shingle, in order; a text of fewer words than width is one shingle."""
    held = Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    keys, place = ngram_keys(held, width)
    document = held.words()[2]
    last = np.append(np.diff(document) != 0, True) if len(document) else np.zeros(0, bool)
    ends = np.flatnonzero((place >= width - 1) | last)
    order = np.minimum(place[ends], width - 1)
    return np.stack(keys)[order, ends], document[ends]


def distinct_shingles(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) without repeats, by text and key."""
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.append(True, (np.diff(key) != 0) | (np.diff(text) != 0))[: len(key)]
    return key[new], text[new]


def layout(texts: int, shard: int = SHARD) -> tuple[int, int, int, int]:
    """(bits of a shard key, tables a word, words of a fingerprint, words of a short text's) for that many texts."""
    bits = max(0, ceil(log2(max(texts, 1) / shard)))
    tables = min(TABLES, 64 // bits) if bits else 1

    def words(differ: float) -> int:
        within = sum(comb(64, i) * differ**i * (1 - differ) ** (64 - i) for i in range(RADIUS + 1))
        return max(2, ceil(log(MISSED) / log(1 - within * (1 - (1 - (1 - differ) ** bits) ** tables))))

    return bits, tables, words(WORST), words(WORST_SHORT)


def fingerprints(key: np.ndarray, text: np.ndarray, first: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles (distinct, by text), and the words from `first` on of each one's SimHash fingerprint.

    A bit is set if it is set in over half of the text's hashes.
    """
    at = np.flatnonzero(np.diff(text, prepend=-1))
    out = np.empty((len(at), words), np.uint64)
    if len(at):
        size = np.diff(np.append(at, len(text)))
        # Sums of 255 shingles fit a byte, and eight of them a word.
        pieces = -(-size // 255)
        piece_at = np.cumsum(pieces) - pieces
        starts = np.repeat(at - 255 * piece_at, pieces) + 255 * np.arange(int(pieces.sum()))
        for w in range(words):
            h = mixed64(key + np.uint64((first + w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            eight = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
            part = np.add.reduceat(eight, starts, axis=0).view(np.uint8)
            total = np.add.reduceat(part, piece_at, axis=0, dtype=np.int32)
            out[:, w] = np.packbits(2 * total > size[:, None], bitorder="little").view(np.uint64)
    return text[at], out


def sketches(docs: DataFrame, words: int, words_short: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, fp: the fingerprint's words, none without shingles) of each row of docs; equal words give equal nodes."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fp", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            normals = [normal(t) for t in x.column("text").to_pylist()]
            which = np.cumsum([len(t) for t in normals]) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1), len(normals)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                key, text = distinct_shingles(*shingles(normals[i:j], width))
                size = np.bincount(text, minlength=j - i)
                fps, held = np.zeros((j - i, words_short), np.uint64), np.where(size > 0, words, 0)
                has, fp = fingerprints(key, text, 0, words)
                fps[has, :words] = fp
                few = size[text] <= SHORT
                has, fp = fingerprints(key[few], text[few], words, words_short - words)
                fps[has, words:] = fp
                held[has] = words_short
                ends = pa.array(np.append(0, np.cumsum(held)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(fps[np.arange(words_short) < held[:, None]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([x.column("doc_id").slice(i, j - i), pa.array([text_node(t) for t in normals[i:j]], pa.int64()), lists], schema=schema)

    return doc_texts(docs).mapInArrow(run, "doc_id long, node long, fp array<bigint>")


class Trees:
    """A BK-tree of distinct 64-bit words (as simhash.BKTree), held and searched as arrays, level by level."""

    def __init__(self, items: np.ndarray):
        # A node's slot is its parent * 65 + its distance to the parent; slots ascend, as levels do.
        left, slot, nodes, slots, n = items, np.full(len(items), -1), [], [], 0
        while len(left):
            taken, first, of = np.unique(slot, return_index=True, return_inverse=True)
            nodes.append(left[first])
            slots.append(taken)
            rest = np.ones(len(left), bool)
            rest[first] = False
            slot = ((n + of) * 65 + np.bitwise_count(left ^ left[first][of]))[rest]
            left, n = left[rest], n + len(first)
        self.items = np.concatenate(nodes) if nodes else items
        # child[s] is the first node whose slot is s or more.
        in_slot = np.bincount(np.concatenate(slots)[1:] if nodes else [], minlength=65 * n + 1).astype(np.int32)
        self.child = np.append(np.int32(1), 1 + np.cumsum(in_slot, dtype=np.int32))
        self.inner = in_slot[: 65 * n].reshape(n, 65).any(axis=1)

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of asked, item) of all pairs at most radius bits apart."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        step = max(1, STEPS // max(1, len(self.items)))
        for at in range(0, len(asked) if len(self.items) else 0, step):
            query = np.arange(at, min(at + step, len(asked)), dtype=np.int32)
            node = np.zeros(len(query), np.int32)
            while len(query):
                item = self.items[node]
                d = np.bitwise_count(item ^ asked[query])
                hit = np.flatnonzero(d <= radius)
                found.append((query[hit], item[hit]))
                inner = np.flatnonzero(self.inner[node])
                query, slot = query[inner], node[inner] * np.int32(65)
                d = d[inner].astype(np.int32)
                low = self.child[slot + np.maximum(d - radius, 0)]
                n = self.child[slot + np.minimum(d + (radius + 1), 65)] - low
                query = np.repeat(query, n)
                node = np.repeat(low - np.cumsum(n, dtype=np.int32) + n, n) + np.arange(len(query), dtype=np.int32)
        return tuple(map(np.concatenate, zip(*found)))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n reaches over edges (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        was = least.copy()
        np.minimum.at(least, was[a], low)
        np.minimum.at(least, was[b], low)
        while (least[least] != least).any():
            least = least[least]
        if (least == was).all():
            return least


def shard_links(left: list[dict], right: list[dict] | None) -> list[tuple[int, int]]:
    """Edges that connect the members (node, fp) which a search of left's BK-tree links, inside left or from right."""
    both = sorted({(m["node"], m["fp"]) for m in left + (right or [])})
    nodes, fps = np.array(both, np.int64).T
    items, of = np.unique(fps.view(np.uint64), return_inverse=True)
    words = lambda rows: np.unique(np.array([m["fp"] for m in rows], np.int64).view(np.uint64))
    asked = words(left if right is None else right)
    query, item = Trees(words(left)).within(asked, RADIUS)
    label = joined(len(items), np.searchsorted(items, asked)[query], np.searchsorted(items, item))[of]
    # Nodes ascend, so the first of a label is its smallest.
    _, first, group = np.unique(label, return_index=True, return_inverse=True)
    root = nodes[first][group]
    return list(zip(nodes[nodes != root].tolist(), root[nodes != root].tolist()))


def candidates(nodes: DataFrame, bits: int, tables: int, words: int, shard_block: int = SHARD_BLOCK) -> DataFrame:
    """(a, b): edges over nodes (node, fp) that connect all whose next words differ by RADIUS bits or less, in a table where they share a key.

    The next word goes round within the first `words`, and within those that only short texts have.
    """
    after = f"if(w < {words}, (w + 1) % {words}, {words} + (w - {words} + 1) % (size(fp) - {words}))"
    key = f"(w * {tables} + t) * {1 << 32}L + (shiftrightunsigned(fp[w], t * {bits}) & {(1 << min(bits, 32)) - 1}L)"
    table = f"transform(sequence(0, {tables} - 1), t -> struct({key} as key, struct(node, fp[{after}] as fp) as member))"
    shards = nodes.where("size(fp) > 0").select(F.explode(F.expr(f"flatten(transform(sequence(0, size(fp) - 1), w -> {table}))")).alias("s")).select("s.key", "s.member")
    return block_links(shards, lambda member: member["node"], shard_links, shard_block, "shards")


def group_links(left: list[dict], right: list[dict] | None, width: int, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect all members (node, text) inside left, or between left and right, of that Jaccard similarity."""
    members = {}
    for side, rows in enumerate((left, right or [])):
        for r in rows:
            words = normal(r["text"])
            if text_node(words) == r["node"]:  # a doc_id that other texts share brings those along
                members[r["node"]] = (side, words)
    nodes = list(members)
    key, owner = shingles([members[n][1] for n in nodes], width)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.append(True, (np.diff(key) != 0) | (np.diff(owner) != 0))
    key, owner = key[new], owner[new]
    size = np.bincount(owner, minlength=len(nodes))
    at = np.concatenate([[0], np.cumsum(size)])
    _, ids = np.unique(key, return_inverse=True)
    side = np.array([members[n][0] for n in nodes])
    # Posting lists of the left members, by shingle.
    of_left = side[owner] == 0
    by = np.argsort(ids[of_left], kind="stable")
    posted = owner[of_left][by]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids[of_left], minlength=ids.max() + 1))])
    group, found = np.arange(len(nodes)), []
    for x in np.flatnonzero(side == (0 if right is None else 1)):
        if (group[side == 0] == group[x]).all():
            continue
        own = ids[at[x] : at[x + 1]]
        n = starts[own + 1] - starts[own]
        places = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(posted[places], minlength=len(nodes))
        near = (both > 0) & (both >= similarity * (size + size[x] - both) - 1e-9)
        for y in np.flatnonzero(near):
            if group[y] != group[x]:
                found.append((nodes[x], nodes[y]))
                group[group == group[y]] = group[x]
    return found


def links(nodes: DataFrame, docs: DataFrame, found: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): edges over nodes (node, least), connecting all of at least that similarity that the edges found connect."""
    coarse = components(found)
    coarse = coarse.union(coarse.select("root", "root").distinct())
    wanted = coarse.join(nodes.select("node", "least"), "node")
    texts = doc_texts(docs).join(wanted, F.col("doc_id") == F.col("least")).select(F.col("root").alias("key"), F.struct("node", "text").alias("member"))
    weight = lambda member: F.greatest(F.lit(1.0), F.octet_length(member["text"]) / BLOCK_BYTES)
    return block_links(texts, lambda member: member["node"], lambda left, right: group_links(left, right, width, similarity), block, "near", weight)


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, block: int = BLOCK, shard: int = SHARD, shard_block: int = SHARD_BLOCK) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id; component_id is the smallest doc_id reachable over links.

    Texts without words are linked to each other. Rows without doc_id take no part; other columns are ignored.
    MISSED, hence what the searches find, holds for a similarity of 0.8 or more.
    """
    named = docs.where("doc_id is not null")
    bits, tables, words, words_short = layout(named.count(), shard)
    made = written(sketches(named, words, words_short, width), "sketches")
    nodes = written(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("fp").alias("fp")), "nodes")
    roots = components(links(nodes, named, candidates(nodes, bits, tables, words, shard_block), width, similarity, block))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # Written, so that the join's two sides are plain shuffles, which adaptive execution can split at a hot root.
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return made.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def first_of_group(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates, as simhash.first_of_group, by similarity of shingles."""
    return keep_least(docs, written(near_duplicates(docs, **options), "groups"))
