"""Schemas of the data model: documents, changes, OS events, headings, postings."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _t, _b, _i = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType(), T.IntegerType()

DOCS = T.StructType([
    T.StructField("path", _s, False), T.StructField("filename", _s), T.StructField("dir", _s), T.StructField("text", _s),
    T.StructField("size", _l), T.StructField("modified", _t), T.StructField("modified_ns", _l), T.StructField("extension", _s), T.StructField("has_content", _b),
])

#: kind: Modified, Deleted, DeletedDir or Rescan; path is null for Rescan only.
CHANGES = T.StructType([T.StructField("seq", _l), T.StructField("ts", _t), T.StructField("kind", _s), T.StructField("path", _s)])

#: event: Create, Modify, RemoveFile, RemoveFolder, RemoveOther, RenameBoth, RenameFrom, RenameTo, Access or Other.
OS_EVENTS = T.StructType([
    T.StructField("seq", _l), T.StructField("ts", _t), T.StructField("event", _s), T.StructField("paths", T.ArrayType(_s)),
    T.StructField("is_dir", _b), T.StructField("need_rescan", _b),
])

HEADING = T.StructType([T.StructField("level", _i), T.StructField("text", _s), T.StructField("start_line", _i), T.StructField("end_line", _i)])
OUTLINE = T.ArrayType(HEADING)
POSTINGS = T.StructType([T.StructField("field", _s), T.StructField("term", _s), T.StructField("path", _s), T.StructField("positions", T.ArrayType(_i))])
