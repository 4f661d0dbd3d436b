"""The live index: a stream of file events becomes changes, waits out bursts, and is committed to the index in batches."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.snapshot import deleted, new_or_modified
from quern.plans.index import IndexStore
from quern.schema import CHANGES
from quern.sources import fileindex
from quern.streaming.changes import event_changes, visible

QUIET, TICK, CAPACITY, BATCH_SIZE, BATCH_MS, ATTEMPTS = 1.0, 0.1, 1_000, 500, 1_000, 2
log = logging.getLogger("quern.live")


class Debouncer:
    """Modified paths that wait until they have been quiet: each is due once, `quiet` seconds after its last change."""

    def __init__(self, quiet: float = QUIET, clock: Callable[[], float] = time.monotonic):
        self.quiet, self.clock, self.waiting = quiet, clock, {}

    def add(self, path: str) -> None:
        self.waiting.pop(path, None)
        self.waiting[path] = self.clock()  # the last ones stand last

    def drop(self, path: str) -> None:
        self.waiting.pop(path, None)

    def due(self) -> list[str]:
        now, out = self.clock(), []
        for path, at in self.waiting.items():
            if now - at < self.quiet:
                break
            out.append(path)
        for path in out:
            del self.waiting[path]
        return out

    def flush(self) -> list[str]:
        out = list(self.waiting)
        self.waiting.clear()
        return out


class Indexer:
    """Applies changes to an index.

    Deletes and rescans do not wait; modified paths go through the debouncer. What is due is buffered and
    committed once it counts batch_size items (a modified path is two, its removal and its addition) or
    batch_ms have passed. At most `capacity` changes wait on the driver: a stream batch with more is applied
    as it is, without waiting, and the stream stands still while a commit runs. A commit is tried `attempts`
    times, then its changes are dropped and counted. on_commit runs after each one.
    """

    def __init__(
        self, store: IndexStore, read_paths: Callable[[DataFrame], DataFrame], listing: Callable[[], DataFrame], quiet: float = QUIET, capacity: int = CAPACITY,
        batch_size: int = BATCH_SIZE, batch_ms: int = BATCH_MS, attempts: int = ATTEMPTS, on_commit: Callable[[], None] = lambda: None, clock: Callable[[], float] = time.monotonic,
    ):
        self.store, self.read_paths, self.listing = store, read_paths, listing
        self.capacity, self.batch_size, self.batch_ms, self.attempts, self.on_commit, self.clock = capacity, batch_size, batch_ms, attempts, on_commit, clock
        self.debouncer, self.buffer, self.dropped = Debouncer(quiet, clock), [], 0
        self.committed_at, self._lock = clock(), threading.RLock()

    def feed(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A micro-batch of changes (seq, part, kind, path): the foreachBatch function."""
        with self._lock:
            rows = batch.orderBy("seq", "part").limit(self.capacity + 1).collect()
            if len(rows) + len(self.debouncer.waiting) > self.capacity:
                self.flush()
                if len(rows) > self.capacity:
                    held = batch.select(F.struct("seq", "part").alias("seq"), "kind", "path").persist()
                    try:
                        if not held.where("kind = 'Rescan'").isEmpty():
                            self.rescan()
                        else:
                            self._commit(held, held.count())
                    finally:
                        held.unpersist()
                    return
            for r in rows:
                if r["kind"] == "Modified":
                    self.debouncer.add(r["path"])
                    continue
                if r["kind"] == "Rescan":
                    self.rescan()
                    continue
                if r["kind"] == "Deleted":
                    self.debouncer.drop(r["path"])
                self._buffer(r["kind"], r["path"])
            self.tick()

    def _buffer(self, kind: str, path: str) -> None:
        self.buffer.append((kind, path))
        if sum(2 if k == "Modified" else 1 for k, _ in self.buffer) >= self.batch_size:
            self.commit()

    def tick(self) -> None:
        """Take what is due; commit if it is time."""
        with self._lock:
            for path in self.debouncer.due():
                self._buffer("Modified", path)
            if self.buffer and self.clock() - self.committed_at >= self.batch_ms / 1000:
                self.commit()

    def flush(self) -> None:
        """Commit all that waits, due or not."""
        with self._lock:
            for path in self.debouncer.flush():
                self._buffer("Modified", path)
            self.commit()

    def commit(self) -> None:
        with self._lock:
            held, self.buffer = self.buffer, []
            if held:
                rows = [(i, None, kind, path) for i, (kind, path) in enumerate(held)]
                self._commit(self.store.spark.createDataFrame(rows, CHANGES), len(rows))

    def _commit(self, changes: DataFrame, n: int) -> None:
        for attempt in range(1, self.attempts + 1):
            try:
                fresh = self.read_paths(changes.where("kind = 'Modified'").select("path"))
                if self.store.apply(changes, fresh):
                    self.on_commit()
                break
            except Exception:
                log.exception("commit failed, attempt %d of %d", attempt, self.attempts)
                if attempt == self.attempts:
                    self.dropped += n
        self.committed_at = self.clock()

    def rescan(self) -> dict[str, int]:
        """Compare the whole tree with the index and commit the differences; counts of files seen, changed and deleted."""
        with self._lock:
            self.flush()
            disk, known = self.listing(), self.store.docs.select("path", "modified_ns")
            changed, gone = new_or_modified(disk, known).select("path"), deleted(known, disk)
            counts = {"processed": disk.count(), "changed": changed.count(), "deleted": gone.count()}
            if counts["changed"] or counts["deleted"]:
                kinds = [(gone, "Deleted"), (changed, "Modified")]
                rows = [d.select(F.lit(k).cast("long").alias("seq"), F.lit(kind).alias("kind"), "path") for k, (d, kind) in enumerate(kinds)]
                self._commit(rows[0].union(rows[1]), counts["changed"] + counts["deleted"])
            return counts


def start(spark: SparkSession, directory: str, indexer: Indexer, checkpoint: str, state_dir: str, extensions: list[str] | None = None, index_dir: str | None = None, every_ms: int = BATCH_MS) -> StreamingQuery:
    """Watch the directory from now on: events -> changes -> what is visible -> the indexer."""
    spark.dataSource.register(fileindex.FileIndexSource)
    reader = spark.readStream.format("fileindex").option("path", directory).option("events", "true").option("statedir", state_dir).option("from", "now")
    if extensions:
        reader = reader.option("extensions", ",".join(extensions))
    if index_dir:
        reader = reader.option("indexdir", index_dir)
    changes = visible(event_changes(reader.load()))
    return changes.writeStream.foreachBatch(indexer.feed).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_ms} milliseconds").start()


def ticking(indexer: Indexer, stopped: threading.Event, every: float = TICK) -> threading.Thread:
    """A thread that ticks until it is stopped, then flushes."""

    def run() -> None:
        while not stopped.wait(every):
            indexer.tick()
        indexer.flush()

    thread = threading.Thread(target=run, name="quern-tick", daemon=True)
    thread.start()
    return thread
