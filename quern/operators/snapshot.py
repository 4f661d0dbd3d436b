"""Incremental indexing: snapshot differences and the application of changes (the index that keeps them: plans/index.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import hidden_component, hidden_name


def new_or_modified(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of disk that the index lacks, has without a time, or has with an older one."""
    known = index.groupBy("path").agg(F.max("modified_ns").alias("_indexed_ns"))
    joined = disk.join(known, "path", "left")
    stale = F.col("_indexed_ns").isNull() | F.col("modified_ns").isNull() | (F.col("modified_ns") > F.col("_indexed_ns"))
    return joined.where(stale).drop("_indexed_ns")


def deleted(index: DataFrame, existing: DataFrame, unverified: DataFrame | None = None) -> DataFrame:
    """Distinct indexed paths that no longer exist. Paths that could not be looked at stay."""
    gone = index.select("path").distinct().join(existing.select("path"), "path", "left_anti")
    return gone.join(unverified.select("path"), "path", "left_anti") if unverified is not None else gone


def scan_counts(disk: DataFrame, index: DataFrame) -> DataFrame:
    """One row: processed, changed, deleted."""
    changed = new_or_modified(disk, index).agg(F.count("*").alias("changed"))
    gone = deleted(index, disk).agg(F.count("*").alias("deleted"))
    return disk.agg(F.count("*").alias("processed")).crossJoin(changed).crossJoin(gone)


def unverifiable(paths: DataFrame) -> DataFrame:
    """One row: how many, and the first of them."""
    return paths.agg(F.count("*").alias("unverifiable"), F.min("path").alias("sample"))


def skipped(path: Column, index_dir: str | None = None) -> Column:
    """Below a hidden directory, or in the index's own."""
    own = F.lit(False) if not index_dir else (path == index_dir) | path.startswith(index_dir.rstrip("/") + "/")
    return hidden_component(path) | own


def directory_skipped(path: Column, index_dir: str | None = None) -> Column:
    return skipped(path, index_dir) | hidden_name(path)


def parents(path: Column) -> Column:
    """a/b/c -> [a, a/b]: a prefix test becomes an equi-join on these."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def surviving_adds(changes: DataFrame) -> DataFrame:
    """(path, seq) of the paths whose last Modified comes after every Deleted of them and DeletedDir above them.

    changes: seq, kind, path. Directory deletes meet paths by equality on the path's parents, so there is
    no range join; per-key maxima are pre-aggregated.
    """
    last = changes.where("kind = 'Modified'").groupBy("path").agg(F.max("seq").alias("seq"))
    gone = changes.where("kind = 'Deleted'").groupBy("path").agg(F.max("seq").alias("gone"))
    dirs = changes.where("kind = 'DeletedDir'").groupBy(F.col("path").alias("above")).agg(F.max("seq").alias("cut"))
    below = last.select("path", F.explode(parents(F.col("path"))).alias("above")).join(dirs, "above").groupBy("path").agg(F.max("cut").alias("cut"))
    kept = last.join(gone, "path", "left").join(below, "path", "left")
    return kept.where("(gone is null or seq > gone) and (cut is null or seq > cut)").select("path", "seq")


def apply_changes(docs: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """docs after changes, in order of seq. fresh: the current document of each path that still can be read.

    Deleted removes a path, DeletedDir all below it, Modified replaces the path by fresh's row (or removes
    it, if fresh has none: the file is gone again).
    """
    touched = changes.where("kind in ('Deleted', 'Modified')").select("path").distinct()
    dirs = changes.where("kind = 'DeletedDir'").select(F.col("path").alias("above")).distinct()
    below = docs.select("path", F.explode(parents(F.col("path"))).alias("above")).join(dirs, "above", "left_semi").select("path")
    kept = docs.join(touched.union(below).distinct(), "path", "left_anti")
    added = fresh.join(surviving_adds(changes).select("path"), "path", "left_semi")
    return kept.unionByName(added.select(*docs.columns))
