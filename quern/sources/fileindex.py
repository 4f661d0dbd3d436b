"""Files below a directory with exact metadata: as a data source "fileindex" (batch and event stream), or listed by tasks.

Spark's own file sources leave out names with a leading dot or underscore and round times to milliseconds;
these keep dotfiles (hidden directories are pruned) and nanoseconds.

    spark.dataSource.register(FileIndexSource)
    spark.read.format("fileindex").option("path", d).option("extensions", "md,rs").option("content", "true").load()
    spark.readStream.format("fileindex").option("path", d).option("events", "true").option("statedir", s).load()

The batch source lists on the driver and suits a directory of one machine. `list_tree` lists a shared one
with a task per slice of directories, level by level; `read_paths` reads given files on the executors.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from quern.functions import formats, text
from quern.schema import DOCS
from quern.session import written

FILES_PER_PARTITION = 2_000
SCHEMA = "path string, filename string, dir string, size bigint, modified timestamp, modified_ns bigint, extension string, content binary"
EVENT_SCHEMA = "seq bigint, ts timestamp, event string, paths array<string>, is_dir boolean, need_rescan boolean"


def _entries(base: str, here: str, skip: str | None) -> Iterator[tuple[str, bool, os.stat_result]]:
    """(relative path, is a directory to go into, stat) of what lies in one directory; raises if it can't be read."""
    with os.scandir(os.path.join(base, here) if here else base) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            rel = f"{here}/{e.name}" if here else e.name
            try:
                rel.encode("utf-8")
                is_dir, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
            except (UnicodeEncodeError, OSError):
                continue
            if is_dir and not e.name.startswith(".") and os.path.realpath(e.path) != skip:
                yield rel, True, e.stat(follow_symlinks=False)
            elif is_file:
                yield rel, False, e.stat(follow_symlinks=False)


def walk(base: str, index_dir: str | None = None, dirs: bool = False) -> Iterator[tuple[str, os.stat_result]]:
    """(relative path, stat) of regular files (with dirs: of directories, too); links are not followed, hidden
    directories and index_dir are pruned, names that are not UTF-8 skipped. A directory that can't be read fails the scan."""
    skip = os.path.realpath(index_dir) if index_dir else None
    todo = [""]
    while todo:
        for rel, is_dir, stat in _entries(base, todo.pop(), skip):
            if is_dir:
                todo.append(rel)
            if dirs or not is_dir:
                yield rel, stat


def list_tree(spark: SparkSession, base: str, extensions: list[str] | None = None, index_dir: str | None = None, dirs_per_task: int = 200) -> DataFrame:
    """(path, size, modified_ns) of the files below base, which all executors must see. Each level of directories
    is listed by tasks and written to the shared folder, so no list of names ever meets on the driver."""
    wanted, skip = sorted(set(text.normalise_extensions(extensions or [])) or set(text.FORMATS)), os.path.realpath(index_dir) if index_dir else None

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for here in f["path"]:
                rows = [(rel, is_dir, s.st_size, s.st_mtime_ns) for rel, is_dir, s in _entries(base, here, skip)]
                yield pd.DataFrame(rows, columns=["path", "is_dir", "size", "modified_ns"])

    schema = "path string, is_dir boolean, size bigint, modified_ns bigint"
    level, found = spark.createDataFrame([("",)], "path string"), spark.createDataFrame([], schema)
    n = 1
    while n:
        got = written(level.repartition(max(1, -(-n // dirs_per_task)), "path").mapInPandas(entries, schema), "listing")
        found = found.union(got.where(~F.col("is_dir") & text.extension(F.col("path")).isin(wanted)))
        level = got.where("is_dir").select("path")
        n = level.count()
    return found.select("path", "size", "modified_ns")


def _extension(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def _wanted(options: dict) -> set[str]:
    return set(text.normalise_extensions(options.get("extensions", "").split(","))) or set(text.FORMATS)


def _file_row(base: str, rel: str, with_content: bool, limit: int) -> tuple | None:
    """A file's row; None if it is no regular file any more. No content if it is larger than the limit, or can't be read."""
    try:
        found = os.lstat(os.path.join(base, rel))
        if not stat.S_ISREG(found.st_mode):
            return None
        content = None
        if with_content and found.st_size <= limit:
            with open(os.path.join(base, rel), "rb") as f:
                content = f.read(limit + 1)
    except (FileNotFoundError, NotADirectoryError):
        return None
    except OSError:
        content = None
    return _row(rel, found.st_size, found.st_mtime_ns, content if content is None or len(content) <= limit else None)


def _row(rel: str, size: int, ns: int, content: bytes | None) -> tuple:
    name = rel.rsplit("/", 1)[-1]
    when = dt.datetime.fromtimestamp(ns // 10**9, dt.timezone.utc) + dt.timedelta(microseconds=ns % 10**9 // 1000)
    return rel, name, rel[: -len(name) - 1] if "/" in rel else "", size, when, ns, _extension(name), content


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.options = options["path"], options

    def partitions(self) -> list[InputPartition]:
        wanted = _wanted(self.options)
        found = [(p, s.st_size, s.st_mtime_ns) for p, s in walk(self.base, self.options.get("indexdir")) if _extension(p.rsplit("/", 1)[-1]) in wanted]
        step = int(self.options.get("filesperpartition", FILES_PER_PARTITION))
        return [_Slice(found[i : i + step]) for i in range(0, len(found), step)] or [_Slice([])]

    def read(self, part: _Slice) -> Iterator[tuple]:
        with_content = self.options.get("content", "false").lower() == "true"
        limit = int(self.options.get("maxbytes", 20_000_000))
        for rel, size, ns in part.files:
            if not with_content:
                yield _row(rel, size, ns, None)
            elif (row := _file_row(self.base, rel, True, limit)) is not None:
                yield row


class _Events(SimpleDataSourceStreamReader):
    """Polls the tree and emits the differences from the last poll as the events a watcher would give.

    A file that keeps its inode and time under another path is renamed; of a new directory one event names
    it and the files in it, of a removed one the directory alone. A tree that can't be listed asks for a
    rescan. What a poll saw is kept in a file of `statedir`; offsets only name it.
    """

    def __init__(self, options: dict):
        self.base, self.options, self.states = options["path"], options, options["statedir"]
        os.makedirs(self.states, exist_ok=True)

    def _file(self, seq: int) -> str:
        return os.path.join(self.states, f"seen-{seq:012d}.json")

    def _seen(self) -> dict[str, list]:
        """path -> [inode, is a directory, mtime]."""
        wanted, out = _wanted(self.options), {}
        for rel, s in walk(self.base, self.options.get("indexdir"), dirs=True):
            is_dir = stat.S_ISDIR(s.st_mode)
            if is_dir or _extension(rel.rsplit("/", 1)[-1]) in wanted:
                out[rel] = [f"{s.st_dev}:{s.st_ino}", is_dir, 0 if is_dir else s.st_mtime_ns]
        return out

    def _load(self, seq: int) -> dict[str, list]:
        try:
            with open(self._file(seq), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _save(self, seq: int, seen: dict) -> None:
        with open(self._file(seq) + ".new", "w", encoding="utf-8") as f:
            json.dump(seen, f)
        os.replace(self._file(seq) + ".new", self._file(seq))

    def initialOffset(self) -> dict:
        if self.options.get("from", "start") == "now":
            self._save(0, self._seen())
        return {"seq": 0}

    @staticmethod
    def _difference(was: dict[str, list], now: dict[str, list]) -> list[tuple[str, list[str], bool]]:
        """(event, paths, is a directory), removals before what appears."""
        inside = lambda p, dirs: any(p.startswith(d + "/") for d in dirs)
        tops = lambda dirs: [d for d in dirs if not inside(d, dirs)]
        gone, new = sorted(was.keys() - now.keys()), sorted(now.keys() - was.keys())
        # A renamed file keeps its inode and time; an inode alone may have been given to a new file.
        by_inode = {tuple(was[p]): p for p in gone}
        moved = {p: old for p in new if (old := by_inode.get(tuple(now[p]))) is not None and not now[p][1]}
        gone_dirs, new_dirs = tops([p for p in gone if was[p][1]]), tops([p for p in new if now[p][1]])
        out: list[tuple[str, list[str], bool]] = [("RemoveFolder", [d], True) for d in gone_dirs]
        out += [("RenameBoth", [old, p], False) for p, old in moved.items()]
        out += [("RemoveFile", [p], False) for p in gone if not was[p][1] and p not in moved.values() and not inside(p, gone_dirs)]
        out += [("Create", [d, *(p for p in new if not now[p][1] and p.startswith(d + "/") and p not in moved)], True) for d in new_dirs]
        out += [("Create", [p], False) for p in new if not now[p][1] and p not in moved and not inside(p, new_dirs)]
        return out + [("Modify", [p], False) for p in sorted(now.keys() & was.keys()) if was[p] != now[p] and not now[p][1]]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seq, at = start["seq"], dt.datetime.now(dt.timezone.utc)
        was = self._load(seq)
        try:
            now = self._seen()
        except OSError:
            now, found = was, [("Other", [], False, True)]
        else:
            found = [(*e, False) for e in self._difference(was, now)]
        if not found:
            return iter([]), start
        self._save(seq + len(found), now)
        return iter([(seq + i, at, *e) for i, e in enumerate(found)]), {"seq": seq + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch read again: the same differences, or a rescan if one of its polls is no longer there."""
        at, seq = dt.datetime.now(dt.timezone.utc), start["seq"]
        if seq and not os.path.exists(self._file(seq)) or not os.path.exists(self._file(end["seq"])):
            return iter([(seq, at, "Other", [], False, True)])
        found = self._difference(self._load(seq), self._load(end["seq"])) or [("Other", [], False)]
        return iter([(seq + i, at, *e, e[0] == "Other") for i, e in enumerate(found)])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.states):
            if name.startswith("seen-") and name < os.path.basename(self._file(end["seq"])):
                os.remove(os.path.join(self.states, name))


class FileIndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fileindex"

    def schema(self) -> str:
        return EVENT_SCHEMA if self.options.get("events", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Events(dict(self.options))


def read_files(spark: SparkSession, directory: str, extensions: list[str] | None = None, content: bool = False, max_bytes: int = 20_000_000, index_dir: str | None = None) -> DataFrame:
    spark.dataSource.register(FileIndexSource)
    r = spark.read.format("fileindex").option("path", directory).option("content", str(content).lower()).option("maxbytes", str(max_bytes))
    if extensions:
        r = r.option("extensions", ",".join(extensions))
    if index_dir:
        r = r.option("indexdir", index_dir)
    return r.load()


def read_documents(spark: SparkSession, directory: str, extensions: list[str] | None = None, max_bytes: int = 20_000_000, index_dir: str | None = None) -> DataFrame:
    """Files as documents: normalised text, or null (has_content false) where it is too large or not convertible."""
    return _documents(read_files(spark, directory, extensions, True, max_bytes, index_dir), max_bytes)


def read_paths(paths: DataFrame, directory: str, extensions: list[str] | None = None, max_bytes: int = 20_000_000) -> DataFrame:
    """The documents at these paths (path), as they are now; paths without a regular file of a wanted kind give none."""
    wanted = sorted(set(text.normalise_extensions(extensions or [])) or set(text.FORMATS))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 100):
                rows = [r for p in f["path"][at : at + 100] if (r := _file_row(directory, p, True, max_bytes)) is not None]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    some = paths.where(text.extension(F.col("path")).isin(wanted)).select("path").distinct()
    return _documents(some.mapInPandas(read, SCHEMA), max_bytes)


def _documents(files: DataFrame, max_bytes: int) -> DataFrame:
    made = files.withColumn("text", formats.normalised_text(F.col("content"), text.file_format(F.col("path")), max_bytes))
    return made.withColumn("has_content", F.col("text").isNotNull()).select(*DOCS.fieldNames())


def images(files: DataFrame, max_bytes: int) -> DataFrame:
    """(path, mime, data in base64) of the image files among files with content."""
    mime = text.mime_type(F.col("path"))
    return files.where(mime.isNotNull() & (F.col("size") <= max_bytes)).select("path", mime.alias("mime"), F.base64("content").alias("data"))
