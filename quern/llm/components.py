"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, written


#: A node with more edges than this is hot: its edges are then joined to their least neighbour from written
#: tables, so that both sides are plain shuffles and adaptive execution can split the join at that node.
HOT_NODE = 1_000


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.where("a > b").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the smallest of each node and its neighbours, pre-aggregated."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node points all its larger neighbours at the smallest node of its neighbourhood."""
    return _distinct_edges(_both(edges).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours, and itself, at the smallest of them."""
    return _distinct_edges(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def _round(now: DataFrame) -> DataFrame:
    degree = now.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").count().agg(F.max("count")).first()[0] or 0
    if degree <= HOT_NODE:
        far = _large_star(now, _least(_both(now)))
        return written(_small_star(far, _least(far)), "edges")
    least = written(_least(_both(now)), "least")
    far = written(_large_star(now, least), "edges")
    forget(least)
    least = written(_least(far), "least")
    done = written(_small_star(far, least), "edges")
    forget(least)
    forget(far)
    return done


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long, any order, repeats allowed) -> (node, root), root the smallest node reachable.

    Only nodes that have an edge to another node are returned; the root itself is not. An edge with a
    null end or equal ends is ignored; no edges give no rows. Every round is written to the shared
    folder, so the lineage stays short and a lost executor repeats one round at most. Rounds grow as
    the logarithm of the longest chain; per-node minima are pre-aggregated, and where a node is hot the
    join back is split by adaptive skew handling.
    """
    now = written(_distinct_edges(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")), "edges")
    was = _digest(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        before, now = now, _round(now)
        forget(before)
        is_now = _digest(now)
        if is_now == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
