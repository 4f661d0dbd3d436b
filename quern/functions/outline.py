"""Outlines: Markdown and plain text with Catalyst alone, Python and Rust by a line scanner in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from quern.functions.batches import by_rows
from quern.functions.text import bound, lines
from quern.schema import OUTLINE


def markdown_headings(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, level, text, start_line, end_line), a row per heading, computed inside each document's row.

    A line whose trimmed text starts with three backticks opens or closes a fence. A heading ends where
    the next one starts, whatever their levels; the last one with the text. No shuffle is needed.
    """
    blank = F.lit(" \t\r\n\x0b\x0c")
    heading = "array<struct<level:int,text:string,start_line:int>>"
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast(heading).alias("found"))

    def marks(rows: Column) -> Column:
        """The lines that open, close or head something; the others never reach the fold below."""
        numbered = F.transform(rows, lambda x, i: F.struct(F.btrim(x, blank).alias("x"), (i + 1).alias("n")))
        return F.filter(numbered, lambda r: r["x"].startswith("#") | r["x"].startswith("```"))

    def step(state: Column, row: Column) -> Column:
        fence = row["x"].startswith("```")
        level = F.least(F.length(F.regexp_extract(row["x"], "^#*", 0)), F.lit(6))
        title = F.btrim(F.substr(row["x"], level + 1), blank)
        made = F.array(F.struct(level.cast("int").alias("level"), title.alias("text"), row["n"].cast("int").alias("start_line")))
        found = F.when(fence | state["fenced"] | (title == ""), state["found"]).otherwise(F.concat(state["found"], made))
        return F.struct((state["fenced"] != fence).alias("fenced"), found.alias("found"))

    whole = bound(lines(F.col(text)), lambda rows: F.struct(F.size(rows).alias("total"), F.aggregate(marks(rows), start, step)["found"].alias("found")))
    found = docs.select(F.col(key), whole.alias("o")).select(key, "o.total", "o.found")
    rows = found.select(key, "total", "found", F.posexplode("found").alias("i", "h"))
    end = F.coalesce(F.get("found", F.col("i") + 1)["start_line"] - 1, F.col("total"))
    return rows.select(key, "h.level", "h.text", "h.start_line", end.cast("int").alias("end_line"))


def markdown_headings_windowed(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """The same over exploded lines with window functions: for texts of so many lines that a row's array is a burden."""
    blank = F.lit(" \t\r\n\x0b\x0c")
    rows = docs.select(F.col(key), lines(F.col(text)).alias("rows")).select(key, F.size("rows").alias("total"), F.posexplode("rows").alias("i", "x"))
    rows = rows.withColumn("x", F.btrim("x", blank)).withColumn("fence", F.col("x").startswith("```"))
    order = W.partitionBy(key).orderBy("i")
    open_fence = F.sum(F.col("fence").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) % 2 == 1
    level = F.least(F.length(F.regexp_extract("x", "^#*", 0)), F.lit(6))
    heads = rows.withColumn("open", open_fence).withColumn("level", level).withColumn("title", F.btrim(F.substr("x", F.col("level") + 1), blank))
    heads = heads.where("not fence and not open and level > 0 and title != ''")
    end = F.coalesce(F.lead("i").over(order), F.col("total"))
    return heads.select(key, F.col("level").cast("int"), F.col("title").alias("text"), (F.col("i") + 1).cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def _ranged(found: list[tuple[int, str, int]], total: int) -> list[dict]:
    ends = [f[2] - 1 for f in found[1:]] + [total]
    return [{"level": lv, "text": name, "start_line": at, "end_line": end} for (lv, name, at), end in zip(found, ends)]


def split_lines(text: str) -> list[str]:
    *ended, last = text.split("\n")
    return [p[:-1] if p.endswith("\r") else p for p in ended] + ([last] if last else [])


_PY_ITEM = re.compile(r"([ \t]*)(class|(?:async\s+)?def)\s+([^(#]*)")


def python_headings(text: str) -> list[dict]:
    """Classes and functions; a column depth is four blanks or one tab."""
    rows = split_lines(text)
    found, around = [], []
    for n, row in enumerate(rows, 1):
        m = _PY_ITEM.match(row)
        name = m[3].strip().rstrip(":").strip() if m else ""
        if not name:
            continue
        depth = (m[1].count(" ") + 4 * m[1].count("\t")) // 4
        around = [a for a in around if a[0] < depth]
        is_class = m[2] == "class"
        found.append((len(around) + 1 if is_class else 2 + sum(not c for _, c in around), name, n))
        around.append((depth, is_class))
    return _ranged(found, len(rows))


_RS_ITEM = re.compile(r"(?:(?:pub(?:\s*\([^)]*\))?|async|const|unsafe|extern\s*\"[^\"]*\")\s+)*(mod|struct|trait|impl|fn)\b(.*)")
#: What a brace can hide in, then the braces: line comment, block comment, string, character, odd character.
_RS_MARK = re.compile(r"""//.*|(/\*)|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\u\{[^}]*\}|\\.|[^\\'])'|'[^\x00-\x7f].*|([{}])""")


def _braces(row: str, in_comment: bool) -> tuple[int, int, bool]:
    """(opened, closed, whether a block comment is still open) of one line."""
    at, opened, closed = 0, 0, 0
    while True:
        if in_comment:
            at = row.find("*/", at) + 2
            if at < 2:
                return opened, closed, True
            in_comment = False
        m = _RS_MARK.search(row, at)
        if not m:
            return opened, closed, False
        at, in_comment = m.end(), bool(m[1])
        opened, closed = opened + (m[2] == "{"), closed + (m[2] == "}")


def brace_delta(row: str, in_comment: bool = False) -> int:
    opened, closed, _ = _braces(row, in_comment)
    return opened - closed


def rust_headings(text: str) -> list[dict]:
    """Modules, structs, traits, impls and functions; levels count what an item stands in."""
    rows = split_lines(text)
    found: list[tuple[int, str, int]] = []
    around: list[tuple[str, int]] = []  # kind and the depth outside its block
    depth, in_comment, waiting = 0, False, None
    for n, row in enumerate(rows, 1):
        m = None if in_comment else _RS_ITEM.match(" ".join(row.split()))
        opened, closed, in_comment = _braces(row, in_comment)
        if m:
            kind = m[1]
            if kind == "impl":
                name = row.strip()[row.strip().find("impl") :]
            else:
                name = m[2].split("(")[0].split("//")[0].replace("{", "").replace("}", "").strip()
            if name:
                kinds = [k for k, _ in around]
                held = sum(k in ("struct", "trait") for k in kinds)
                in_type = held or "impl" in kinds
                level = {"mod": 1, "impl": 2}.get(kind) or (2 + held if kind != "fn" else (3 if in_type else 2) + kinds.count("fn"))
                found.append((level, name, n))
                waiting = (kind, depth)
        if waiting and opened:
            if opened > closed:
                around.append(waiting)
            waiting = None
        depth += opened - closed
        around = [a for a in around if a[1] < depth]
        if waiting and depth < waiting[1]:
            waiting = None
    return _ranged(found, len(rows))


_OUTLINE = to_arrow_type(OUTLINE)


@F.arrow_udf(OUTLINE)
def python_outline(text: pa.Array) -> pa.Array:
    return by_rows(lambda t: python_headings(t or ""), _OUTLINE, text)


@F.arrow_udf(OUTLINE)
def rust_outline(text: pa.Array) -> pa.Array:
    return by_rows(lambda t: rust_headings(t or ""), _OUTLINE, text)
