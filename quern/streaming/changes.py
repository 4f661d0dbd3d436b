"""The change stream: OS events to changes, debouncing by session windows, supervision (live.py applies it)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.snapshot import skipped

QUIET = "1 second"
#: Starts, and the wait between them: 5 s, doubled each time, up to 300 s.
MAX_STARTS, FIRST_WAIT, LONGEST_WAIT = 7, 5, 300


def _change(kind: str, path: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), path.alias("path"))


def event_changes(events: DataFrame) -> DataFrame:
    """OS events -> changes (seq, ts, kind, path), in order within an event by `part`.

    events: seq, ts, event, paths, is_dir, need_rescan. A lost-events flag replaces all by one Rescan. A
    created directory is given with the files found in it as the paths after the first. Renames with
    both ends give, pair by pair, Deleted and DeletedDir of the old and Modified of the new name; an odd
    last path counts as modified.
    """
    each = lambda kind: F.transform("paths", lambda p: _change(kind, p))
    both = lambda: F.flatten(F.transform("paths", lambda p: F.array(_change("Deleted", p), _change("DeletedDir", p))))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("paths") / 2).cast("int") - 1, F.lit(0))), lambda k: F.when(
        F.size("paths") > 1, F.array(_change("Deleted", F.get("paths", 2 * k)), _change("DeletedDir", F.get("paths", 2 * k)), _change("Modified", F.get("paths", 2 * k + 1)))
    ).otherwise(F.array().cast("array<struct<kind:string,path:string>>"))))
    odd = F.when(F.size("paths") % 2 == 1, F.array(_change("Modified", F.element_at("paths", -1)))).otherwise(F.array().cast("array<struct<kind:string,path:string>>"))
    none = F.array().cast("array<struct<kind:string,path:string>>")
    made = (
        F.when(F.col("need_rescan"), F.array(_change("Rescan", F.lit(None).cast("string"))))
        .when((F.col("event") == "Create") & F.col("is_dir"), F.transform(F.slice("paths", 2, F.greatest(F.size("paths") - 1, F.lit(0))), lambda p: _change("Modified", p)))
        .when(F.col("event") == "Create", each("Modified"))
        .when(F.col("event") == "Modify", F.when(F.col("is_dir"), none).otherwise(each("Modified")))
        .when(F.col("event").isin("RemoveFolder", "RemoveOther"), each("DeletedDir"))
        .when(F.col("event") == "RemoveFile", each("Deleted"))
        .when(F.col("event") == "RenameBoth", F.concat(pairs, odd))
        .when(F.col("event") == "RenameFrom", both())
        .when(F.col("event") == "RenameTo", each("Modified"))
        .otherwise(none)
    )
    return events.select("seq", "ts", F.posexplode(made).alias("part", "c")).select("seq", "part", "ts", "c.kind", "c.path")


def visible(changes: DataFrame, index_dir: str | None = None) -> DataFrame:
    """Without changes below hidden directories or in the index's own; a Rescan has no path and stays."""
    return changes.where(F.col("path").isNull() | ~skipped(F.col("path"), index_dir))


def debounced(changes: DataFrame, quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """One Modified per path and burst; a burst ends after `quiet` without another (at `quiet` exactly, too).

    Works on batches and, with `late` (how long to wait for late rows), on streams: the session closes
    when the watermark passes it.
    """
    rows = changes.where("kind = 'Modified'")
    if late is not None:
        rows = rows.withWatermark("ts", late)
    # Sessions meet if one starts where another ends, so the gap is a microsecond short of the quiet time.
    bursts = rows.groupBy("path", F.session_window("ts", f"{quiet} -1 microseconds")).agg(F.max("ts").alias("ts"), F.count("*").alias("merged"))
    return bursts.select("path", F.lit("Modified").alias("kind"), "ts", "merged")


def immediate(changes: DataFrame) -> DataFrame:
    """Deletes and rescans, which never wait."""
    return changes.where("kind in ('Deleted', 'DeletedDir', 'Rescan')")


def supervise(run: Callable[[], None], stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep, max_starts: int = MAX_STARTS) -> int:
    """Run until it ends without an error, is stopped, or has failed max_starts times; returns the starts made."""
    for n in range(1, max_starts + 1):
        if stopped():
            return n - 1
        try:
            run()
            return n
        except Exception:
            if n == max_starts:
                return n
            left = min(FIRST_WAIT << (n - 1), LONGEST_WAIT)
            while left > 0 and not stopped():
                sleep(min(1, left))
                left -= 1
    return max_starts
