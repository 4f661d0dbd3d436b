"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over pigeonhole shards, components.

Fingerprints within `radius` bits are linked. Cutting the 64 bits into b blocks, two fingerprints that
differ in at most r bits agree on some b - r blocks whole, so all links lie inside shards keyed by the
bits of b - r blocks; b grows with the number of distinct fingerprints, which keeps the expected shard
small at any size, and no b loses a link. Inside a shard a BK-tree (children keyed by their integer
Hamming distance to the parent) is searched along edges within the radius of the query's own distance.
Shards over `block` members are searched in blocks (hot.py), so a hot shard never meets in one task and
nothing is capped. The trees travel with the shard's rows to the searching tasks, which holds for any
number of shards; a broadcast of all of them would have no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_texts, written
from quern.llm.components import components
from quern.llm.hot import block_links

SHINGLE, RADIUS, BLOCK, SHARD = 4, 4, 2048, 64


def simhash64(text: str | None, width: int = SHINGLE, seed: int = 42) -> int:
    """Fingerprint of a whole text, unsigned; 0 if it has no word.

    A-Z are lower-cased; shingles count as often as they occur; a bit is set if it is set in over half
    of the shingles' XXH64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends[: len(words) - width]]
    total, n = np.zeros(64, np.int64), len(starts)
    spans = zip(starts, ends[width - 1 :])
    while True:
        part = np.fromiter((digest(joined[s : e - 1], seed) for (s, e), _ in zip(spans, range(1 << 15))), np.uint64)
        if not len(part):
            break
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long. A null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = np.fromiter((simhash64(t.as_py(), width) for t in x.column("text")), np.uint64, x.num_rows)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(fps.view(np.int64))], schema=schema)

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A tree over integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self, items: list[int]):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in items:
            self.add(x)

    def add(self, x: int) -> None:
        at, new = 0, len(self.items)
        while new:
            d = (self.items[at] ^ x).bit_count()
            if not d:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                break
            at = nxt
        self.items.append(x)
        self.children.append({})

    def within(self, x: int, radius: int) -> list[int]:
        """All items at most radius bits from x."""
        found, todo, items, children = [], [0] if self.items else [], self.items, self.children
        while todo:
            at = todo.pop()
            d = (items[at] ^ x).bit_count()
            if d <= radius:
                found.append(items[at])
            if below := children[at]:
                for edge in range(d - radius, d + radius + 1):
                    if (c := below.get(edge)) is not None:
                        todo.append(c)
        return found


def shard_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links inside left (right None) or between left and right, as edges to the smallest of each group.

    The groups are those that the links make, so no connection is lost though not every pair is listed.
    Fingerprints are signed longs, as in columns.
    """
    unsigned = lambda v: v & 0xFFFFFFFFFFFFFFFF
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    tree = BKTree(list(map(unsigned, left)))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for x in map(unsigned, left if right is None else right):
        for y in tree.within(x, radius):
            if x != y and (a := root(x)) != (b := root(y)):
                parent[max(a, b)] = min(a, b)
    return [(signed(x), signed(r)) for x in list(parent) if (r := root(x)) != x]


def shard_blocks(distinct: int, radius: int, shard: int = SHARD) -> int:
    """Blocks to cut the bits into, so that a shard of evenly spread fingerprints has about `shard` members."""
    b = radius + 1
    while b < 2 * radius and distinct > shard * 2 ** (64 * (b - radius) // b):
        b += 1
    return b


def _keys(fp: Column, radius: int, blocks: int) -> Column:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for same in combinations(range(blocks), blocks - radius):
        bits = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in same)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))


def links(distinct_fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges over the distinct values of column fp, connecting all that `radius` bits link."""
    n = distinct_fps.count()
    keyed = distinct_fps.select(F.explode(_keys(F.col("fp"), radius, shard_blocks(n, radius))).alias("key"), F.col("fp").alias("member"))
    return block_links(keyed, lambda member: member, lambda left, right: shard_links(left, right, radius), block, "shards")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: (doc_id, fingerprint as 16 hex digits, component_id).

    component_id is the smallest doc_id reachable over links of at most `radius` bits. Defined for odd
    input: a null or empty text has fingerprint zero and is linked like any other; repeated rows come
    back as often as they occur; a null doc_id keeps its row and never becomes a component_id (null only if the whole
    component has no doc_id); an empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    roots = components(links(distinct.select("fp"), radius, block)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the join's two sides are plain shuffles, which adaptive execution can split at a hot root.
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: the smallest doc_id of each component stays, all columns kept.

    Repeated rows of that doc_id: one stays. Rows without doc_id stay (they cannot be named).
    """
    return keep_least(docs, written(near_duplicates(docs, **options).where("doc_id is not null").select("doc_id", "component_id"), "groups"))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs of which found (doc_id, component_id) says that they are the first of their component."""
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == again["_again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
