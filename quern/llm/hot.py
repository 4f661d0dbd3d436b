"""Links inside groups of any size, by blocks: what is connected already is not compared again.

Groups of one block are searched whole. A larger group is dealt into blocks; each block is searched on its
own and against the group's first block, so a group of copies becomes one component after a number of
comparisons that grows with its size. Only members outside of the group's largest component (stragglers)
are then compared with every block. Nothing is capped, and no group ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.components import components

Edges = list[tuple[int, int]]
_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def block_links(members: DataFrame, node: Callable[[Column], Column], search: Callable[[list, list | None], Edges], block: float, name: str, weight: Callable[[Column], Column] = lambda m: F.lit(1.0)) -> DataFrame:
    """members (key, member) -> (a, b): edges of nodes that connect all that any group's members link.

    node gives a member's node (long), which tells the members of a group apart. search(left, right) gives
    edges that connect what is linked inside left (right None), or between left and right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found: Edges = []
            for left, right in zip(x.column("left"), x.column("right")):
                found += search(left.as_py(), right.as_py())
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_SCHEMA)

    searched = lambda rows: rows.select("left", "right").mapInArrow(run, "a long, b long")
    hot = members.groupBy("key").agg(F.ceil(F.sum(weight(F.col("member"))) / block).cast("int").alias("nb")).where("nb > 1")
    dealt = members.join(hot, "key", "left").select("key", "member", F.coalesce("nb", F.lit(1)).alias("nb"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(node(F.col("member")), F.lit(7)), F.col("nb")).cast("int"))
    # Dealt by block: a partitioning by key alone would do for the grouping, and bring a whole group to one task.
    groups = dealt.repartition("key", "block").groupBy("key", "nb", "block").agg(F.collect_list("member").alias("left"))
    none = F.lit(None).cast(groups.schema["left"].dataType).alias("right")
    groups = written(groups.where("nb > 1 or size(left) > 1"), f"{name}-groups")
    cold = searched(groups.where("nb = 1").select("left", none))
    many = groups.where("nb > 1")
    if many.isEmpty():
        return cold
    # The first block of each group (hashes may leave some block empty) goes to the others, one row for each.
    heads = many.groupBy("key").agg(F.min("block").alias("head"))
    head = many.join(heads, "key").where("block = head and head + 1 < nb").select("key", F.col("left").alias("right"), F.explode(F.sequence(F.col("head") + 1, F.col("nb") - 1)).alias("block"))
    first = written(searched(many.select("left", none).union(many.join(head, ["key", "block"]).select("left", "right"))), f"{name}-first")
    member = many.select("key", "nb", F.explode("left").alias("member")).select("key", "nb", "member", node(F.col("member")).alias("node"))
    label = member.select("key", "node").join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    label = written(label, f"{name}-labels")
    sizes = label.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    others = label.join(largest, "key").where("label != largest").select("key", "node")
    left_over = member.join(others, ["key", "node"])
    left_over = left_over.join(left_over.groupBy("key").agg(F.ceil(F.sum(weight(F.col("member"))) / block).cast("int").alias("sb")), "key")
    left_over = left_over.withColumn("part", F.pmod(F.xxhash64("node", F.lit(8)), F.col("sb"))).repartition("key", "part")
    left_over = left_over.groupBy("key", "nb", "part").agg(F.collect_list("member").alias("right"))
    again = left_over.select("key", "right", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    return cold.union(first).union(searched(many.join(again, ["key", "block"])))
