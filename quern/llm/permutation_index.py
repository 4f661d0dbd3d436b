"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order (a prefix of its permutation of them). Each shard of the table (dealt by hash, the
same under any partitioning) posts its vectors in inverted files, one per pivot, with the pivot's place in
the vector's order. A query adds up, over the files of its own nearest pivots, what each shared pivot takes
off the footrule distance between the two orders (places missing from an order count as its length), takes
the share of the shard with the smallest footrule, and reranks it by exact Euclidean distance.

How large that share must be depends on the data, not on the table's size: for each of PREFIXES it is measured
on the sample that gives the pivots, as what RECALL of the sample's own nearest neighbours needs, and the
prefix that makes least work (postings read, and components of reranked vectors) is taken. Queries go to the
shards by a shuffle and stream past an index that is built once; no vector moves more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.common import written

PIVOTS, PREFIXES, NEIGHBOURS = 256, (16, 32, 64, 128), 10
#: Rows that pivots, prefix and reranked share are fitted on, probes among them, and the recall they must reach.
SAMPLE, PROBES, RECALL = 4_096, 128, 0.95
#: Vectors of a shard: 64 times the root of their number, between these bounds.
LEAST_SHARD, MOST_SHARD = 8_192, 262_144


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, n) of the rows that take part, n how often vec_id and vector occur together.

    Null, empty and all-zero vectors, those with a null or non-finite component and rows without vec_id do not.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    return own.where(fine).groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """The first distinct rows, `count` or a quarter of the sample, one at least: the sample comes in hash order."""
    _, first = np.unique(sample, axis=0, return_index=True)
    return sample[np.sort(first)][: max(1, min(count, len(sample) // 4))]


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first (ties to the lower pivot)."""
    d = (pivots**2).sum(1) - 2 * (vectors @ pivots.T)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class Shard:
    """Inverted files over one shard's distinct vectors."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        # Of equal vectors, the smallest ids are the nearest.
        by = np.lexsort((ids, group.ravel()))
        self.ids, self.counts = ids[by], counts[by]
        self.cuts = np.searchsorted(group.ravel()[by], np.arange(len(self.vectors) + 1))
        self.pivots, self.prefix = pivots, min(prefix, len(pivots))
        flat = orders(self.vectors, pivots, self.prefix).ravel()
        post = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[post], np.arange(len(pivots) + 1))
        rows, places = (post // self.prefix).astype(np.int32), (post % self.prefix).astype(np.int32)
        self.files = [(rows[a:b], places[a:b]) for a, b in zip(cuts, cuts[1:])]
        #: Postings read and distances measured so far.
        self.postings = self.distances = 0

    def saved(self, order: np.ndarray) -> np.ndarray:
        """What each vector's order shares with this one, in footrule distance; the footrule is a constant less this."""
        found = [self.files[p] for p in order]
        rows, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        own = np.repeat(np.arange(len(order)), [len(f[0]) for f in found])
        self.postings += len(rows)
        return np.bincount(rows, weights=2.0 * (self.prefix - np.maximum(own, places)), minlength=len(self.vectors))

    def nearest(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float) -> list[tuple[float, int]]:
        """(distance, vec_id) of the k nearest found: every row counts, but for one of the query's own id and vector."""
        n = len(self.vectors)
        take = min(n, max(k + 1, int(np.ceil(share * n))))
        some = np.arange(n)
        if take < n:
            some = np.argpartition(-self.saved(order), take - 1)[:take]
        self.distances += take
        exact = np.sqrt(((self.vectors[some] - query) ** 2).sum(1))
        found: list[tuple[float, int]] = []
        for at in np.argsort(exact, kind="stable"):
            if len(found) >= k and exact[at] > found[k - 1][0]:
                break
            a, b = self.cuts[some[at]], self.cuts[some[at] + 1]
            left = k + 1
            for i, c in zip(self.ids[a : min(b, a + k + 1)].tolist(), self.counts[a : min(b, a + k + 1)].tolist()):
                c -= i == query_id and exact[at] == 0
                found += [(float(exact[at]), i)] * min(c, left)
            found.sort()
        return found[:k]


def fitted(sample: np.ndarray, pivots: np.ndarray, k: int, prefixes: tuple[int, ...] = PREFIXES, recall: float = RECALL, probes: int = PROBES) -> tuple[int, float]:
    """(prefix, share): the least work by which `recall` of the probes' k nearest in the sample are reranked; share 1 if the sample is too small to tell."""
    n, best = len(sample), (np.inf, prefixes[0], 1.0)
    if n <= k + 1:
        return best[1:]
    for prefix in prefixes:
        shard = Shard(np.arange(n), np.ones(n, np.int64), sample, pivots, prefix)
        base, ranks = shard.vectors, []
        asked = np.unique(np.linspace(0, len(base) - 1, probes).astype(int))
        for q, order in zip(asked, orders(base[asked], pivots, shard.prefix)):
            saved, d = shard.saved(order), ((base - base[q]) ** 2).sum(1)
            saved[q], d[q] = -1.0, np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(base) - 1)]
            ranks += [int((saved >= saved[i]).sum()) for i in near]
        share = min(1.0, float(np.quantile(ranks, recall)) / len(base)) if ranks else 1.0
        work = shard.postings / len(asked) / len(base) + share * sample.shape[1]
        best = min(best, (work, prefix, share))
    return best[1:]


def shards_of(rows: int) -> int:
    size = min(MOST_SHARD, max(LEAST_SHARD, int(64 * rows**0.5)))
    return max(1, -(-rows // size))


_FOUND = "query_id long, asked long, vec_id long, score double"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _found(vectors: DataFrame, queries: DataFrame, k: int, pivots: int, prefix: int | None, share: float | None) -> DataFrame:
    """search() for vectors of one length; the best of every shard, not yet put together."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "v", F.lit(11)), "vec_id").limit(SAMPLE).select("v").collect()
    rows = np.array([r["v"] for r in sample])
    chosen = pivots_of(rows, pivots)
    prefix, tuned = fitted(rows, chosen, k, (prefix,) if prefix else PREFIXES)
    share = tuned if share is None else share
    shards = shards_of(vectors.count())
    key = F.xxhash64("vec_id", "v").alias("asked")
    mine = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "vec_id", "n", "v", key)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "vec_id", "n", "v", key)
    together = mine.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, now = [], None, None

        for x in batches:
            shard, query = np.asarray(x.column("shard")), x.column("query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = x.slice(a, b - a)
                ids, v = np.asarray(part.column("vec_id")), np.asarray(part.column("v").flatten()).reshape(b - a, -1)
                if shard[a] != now:
                    held, index, now = [], None, shard[a]
                if not query[a]:
                    held.append((ids, np.asarray(part.column("n")), v))
                elif held or index:
                    if index is None:
                        index, held = Shard(*(np.concatenate(h) for h in zip(*held)), chosen, prefix), []
                    got = [(k_, s, i) for k_, q, vec, o in zip(range(b - a), ids.tolist(), v, orders(v, chosen, index.prefix)) for s, i in index.nearest(q, vec, o, k, share)]
                    at, score, found = (np.array(c) for c in zip(*got)) if got else (np.zeros(0, int),) * 3
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.asarray(part.column("asked"))[at]), pa.array(found, pa.int64()), pa.array(score, pa.float64())], schema=_FOUND_SCHEMA)

    return together.mapInArrow(run, _FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, pivots: int = PIVOTS, prefix: int | None = None, share: float | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k nearest found, ties to the smaller vec_id.

    vectors, queries: (vec_id, v, n) as usable() gives them. Every row is a candidate (rows that repeat each
    count) but for one row of the query's own vec_id and vector; rows that repeat vec_id and vector are one
    query. Vectors of different lengths have no distance: each length is searched on its own. With k or
    fewer candidates all are returned; without queries or vectors there are no rows. Pivots, and the prefix
    and the share that is reranked unless they are given, are fitted on the SAMPLE rows of lowest hash; every
    row is indexed; share=1 gives the exact answer.
    """
    found = vectors.sparkSession.createDataFrame([], _FOUND)
    for row in queries.select(F.size("v").alias("size")).distinct().join(vectors.select(F.size("v").alias("size")).distinct(), "size").orderBy("size").collect():
        same = F.size("v") == row["size"]
        found = found.union(_found(vectors.where(same), queries.where(same), k, pivots, prefix, share))
    order = W.partitionBy("query_id", "asked").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(table: DataFrame, every: int = 100, k: int = NEIGHBOURS, **options) -> DataFrame:
    """search() with the rows whose vec_id is divisible by `every` as queries, against all rows."""
    vectors = written(usable(table), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0)
    return search(vectors, queries, k, **options)
