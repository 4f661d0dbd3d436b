"""Ranked search as DataFrame plans: BM25 over matched clauses, filters, sort orders, totals, snippets.

Two ways lead to the same frame of term frequencies: `IndexStore.measure` reads the query's postings alone;
`scan` counts the query's terms inside each document's row, for documents without an index. Either way
the text is read only for the top rows, for their snippets.
"""

from __future__ import annotations

import html
import math
import re
import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions.text import rfc3339, tokens
from quern.plans import query as Q

K1, B = 1.2, 0.75
DEFAULT_HTTP, DEFAULT_MCP, MOST = 50, 10, 100
SNIPPET_CHARS = 150


@dataclass(frozen=True)
class SearchParams:
    q: str = ""
    search_content: bool = True
    ext: str | None = None
    path: str | None = None
    max_results: int = DEFAULT_HTTP
    sort_by: str = "score"  # score, modified, size or path; others count as score
    sort_order: str = "desc"  # asc or desc; others count as desc; score is always descending
    score_filters: bool = True

    @property
    def limit(self) -> int:
        return min(max(self.max_results, 1), MOST)


def query_tree(p: SearchParams) -> Q.Node:
    """The whole request as one tree: fields of the name, or content; extension and path as musts."""
    must: list[Q.Node] = []
    groups: list[Q.Node] = []
    if p.q != "":
        groups = [Q.lenient(p.q, ("path", "filename"))] + ([Q.lenient(p.q, ("content",))] if p.search_content else [])
        must.append(Q.Bool(should=tuple(groups)))
    if p.ext is not None:
        must.append(Q.Leaf("extension", (p.ext.lower(),)))
    if p.path is not None:
        must.append(Q.lenient(p.path, ("path",)))
    return Q.Bool(must=tuple(must)) if must else Q.All()


def _field(name: str) -> Column:
    return F.coalesce(F.col({"content": "text", "path_exact": "path"}.get(name, name)), F.lit(""))


def _frequency(w: Column, leaf: Q.Leaf) -> Column:
    if len(leaf.terms) == 1:
        return F.size(F.filter(w, lambda x: x == leaf.terms[0]))
    n, first, rest = len(leaf.terms), leaf.terms[0], leaf.terms[1:]
    places = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))

    def hit(i: Column) -> Column:
        ok = F.get(w, i) == first
        for k, t in enumerate(rest, 1):
            # With slop, the other terms may stand anywhere in the window after the first.
            ok = ok & ((F.get(w, i + k) == t) if not leaf.slop else F.array_contains(F.slice(w, i + 2, n - 1 + leaf.slop), t))
        return ok

    return F.size(F.filter(places, hit))


def _with_parts(leaves: list[Q.Leaf]) -> list[Q.Leaf]:
    """Distinct leaves, with the single terms of phrases (their rarity is the phrase's)."""
    return list(dict.fromkeys([*leaves, *(Q.Leaf(x.field, (t,)) for x in leaves if len(x.terms) > 1 for t in x.terms)]))


@dataclass(frozen=True)
class Measured:
    """rows: path, dl_<field>, tf_<i> and the sort keys; n, total length by field, document frequency by leaf.

    keys: the sort keys by path, where rows have the path alone.
    """

    rows: DataFrame
    leaves: list[Q.Leaf]
    n: int
    lengths: dict[str, int]
    df: dict[Q.Leaf, int]
    keys: DataFrame | None = None

    def tf(self, leaf: Q.Leaf) -> Column:
        return F.col(f"tf_{self.leaves.index(leaf)}")

    def idf(self, leaf: Q.Leaf) -> float:
        if len(leaf.terms) > 1:
            return sum(self.idf(Q.Leaf(leaf.field, (t,))) for t in leaf.terms)
        k = self.df.get(leaf, 0)
        return math.log(1 + (self.n - k + 0.5) / (k + 0.5))

    def match(self, node: Q.Node) -> Column:
        if isinstance(node, Q.Leaf):
            return self.tf(node) > 0
        if isinstance(node, Q.Boost):
            return self.match(node.clause)
        if isinstance(node, Q.Range):
            plain = node.field not in (*Q.NUMBER_FIELDS, *Q.DATE_FIELDS)
            c = _field(node.field) if plain else F.col("modified_ns" if node.field in Q.DATE_FIELDS else node.field)
            value = (lambda x: x) if plain else (lambda x: Q.number(node.field, x))
            out = F.lit(True)
            if node.low is not None:
                out = out & ((c > value(node.low)) if node.low_open else (c >= value(node.low)))
            if node.high is not None:
                out = out & ((c < value(node.high)) if node.high_open else (c <= value(node.high)))
            return out
        if isinstance(node, Q.Bool):
            out = F.lit(bool(node.must or node.should))
            for c in node.must:
                out = out & self.match(c)
            if node.should and not node.must:
                some = F.lit(False)
                for c in node.should:
                    some = some | self.match(c)
                out = out & some
            for c in node.must_not:
                out = out & ~self.match(c)
            return out
        return F.lit(isinstance(node, Q.All))

    def score(self, node: Q.Node) -> Column:
        """Sum over the clauses that match."""
        if isinstance(node, Q.Leaf):
            tf = self.tf(node)
            if node.field in Q.RAW_FIELDS:
                norm = F.lit(1.0)
            else:
                mean = max(self.lengths.get(node.field, 0) / max(self.n, 1), 1e-9)
                norm = 1 - B + B * F.col(f"dl_{node.field}") / F.lit(mean)
            return F.when(tf > 0, F.lit(self.idf(node)) * tf * (K1 + 1) / (tf + K1 * norm)).otherwise(F.lit(0.0))
        if isinstance(node, Q.Boost):
            return self.score(node.clause) * node.by
        if isinstance(node, Q.Bool):
            parts = [F.when(self.match(c), self.score(c)).otherwise(F.lit(0.0)) for c in (*node.must, *node.should)]
            total = F.lit(0.0)
            for s in parts:
                total = total + s
            return total
        return F.when(self.match(node), F.lit(1.0)).otherwise(F.lit(0.0)) if isinstance(node, Q.All | Q.Range) else F.lit(0.0)


def _counted(own: list[tuple[int, Q.Leaf]]):
    return lambda w: F.struct(F.size(w).alias("dl"), *(_frequency(w, x).alias(f"tf_{i}") for i, x in own))


KEYS = ("path", "filename", "dir", "size", "modified", "modified_ns", "extension", "has_content")


def scan(docs: DataFrame, tree: Q.Node) -> Measured:
    """Counts by one pass over docs, and one aggregate of them."""
    leaves = _with_parts(Q.leaves(tree))
    cols: list[Column] = []
    for f in dict.fromkeys(x.field for x in leaves):
        own = [(i, x) for i, x in enumerate(leaves) if x.field == f]
        if f in Q.RAW_FIELDS:
            cols += [(_field(f) == x.terms[0]).cast("int").alias(f"tf_{i}") for i, x in own]
        else:
            # The tokens are bound to a lambda variable, so they are made once per row and field.
            bound = F.transform(F.array(tokens(_field(f))), _counted(own))
            cols.append(F.element_at(bound, 1).alias(f"m_{f}"))
    rows = docs.select(*(F.col(k) for k in KEYS), *cols)
    texts = [f for f in dict.fromkeys(x.field for x in leaves) if f not in Q.RAW_FIELDS]
    rows = rows.select(
        *KEYS, *(F.col(f"tf_{i}") for i, x in enumerate(leaves) if x.field in Q.RAW_FIELDS),
        *(F.col(f"m_{x.field}")[f"tf_{i}"].alias(f"tf_{i}") for i, x in enumerate(leaves) if x.field not in Q.RAW_FIELDS),
        *(F.col(f"m_{f}")["dl"].alias(f"dl_{f}") for f in texts),
    )
    if not leaves:
        return Measured(rows, leaves, 0, {}, {})
    got = rows.agg(F.count("*").alias("n"), *(F.sum(f"dl_{f}").alias(f"dl_{f}") for f in texts), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(leaves)))).first()
    return Measured(rows, leaves, got["n"], {f: got[f"dl_{f}"] or 0 for f in texts}, {x: got[f"df_{i}"] for i, x in enumerate(leaves)})


def _matched(docs: DataFrame, p: SearchParams, measure) -> tuple[DataFrame, DataFrame | None]:
    """(the matching documents with their score, the sort keys where those lack them)."""
    tree = query_tree(p)
    m = measure(docs, tree)
    scored = tree if p.score_filters or not isinstance(tree, Q.Bool) else Q.Bool(must=tree.must[: 1 if p.q != "" else 0])
    score = (m.score(scored) if isinstance(tree, Q.Bool) else F.lit(1.0)) if _by_score(p) else F.lit(0.0)
    return m.rows.where(m.match(tree)).select(*(KEYS if m.keys is None else ["path"]), score.cast("double").alias("score")), m.keys


def hits(docs: DataFrame, p: SearchParams, measure=scan) -> DataFrame:
    """All matching documents with their score; not sorted. score is 0 unless sorting by score."""
    found, keys = _matched(docs, p, measure)
    return found if keys is None else keys.join(found, "path")


def _by_score(p: SearchParams) -> bool:
    return p.sort_by not in ("modified", "size", "path")


def top(found: DataFrame, p: SearchParams) -> DataFrame:
    """The first rows in the order asked for; ties by path."""
    if _by_score(p):
        order = [F.desc("score"), F.asc("path")]
    else:
        key = {"modified": "modified_ns"}.get(p.sort_by, p.sort_by)
        order = [F.asc(key) if p.sort_order == "asc" else F.desc(key), F.asc("path")]
    return found.orderBy(*order).limit(p.limit)


def first(docs: DataFrame, p: SearchParams, measure=scan, total: Observation | None = None) -> list[dict]:
    """The first rows in order, with sort keys and score: at most MOST of them. total counts all matches in the same pass."""
    found, keys = _matched(docs, p, measure)
    if keys is not None and not _by_score(p):
        found, keys = keys.join(found, "path"), None
    if total is not None:
        found = found.observe(total, F.count(F.lit(1)).alias("n"))
    rows = [r.asDict() for r in top(found, p).collect()]
    if keys is None:
        return rows
    known = {r["path"]: r.asDict() for r in keys.where(F.col("path").isin([r["path"] for r in rows])).collect()} if rows else {}
    return [known[r["path"]] | r for r in rows]


_RESULT = "path string, filename string, dir string, size long, modified timestamp, extension string, has_content boolean, score double"


def search(docs: DataFrame, p: SearchParams, as_html: bool = False, measure=scan, total: Observation | None = None) -> DataFrame:
    """path, filename, dir, size, modified (RFC 3339), extension, has_content, score, snippet; in order."""
    rows = first(docs, p, measure, total)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    best = docs.sparkSession.createDataFrame([(k, *(r[c] for c in names)) for k, r in enumerate(rows)], f"place int, {_RESULT}")
    best = best.withColumn("modified", rfc3339(F.col("modified")))
    terms = sorted({t for x in Q.leaves(Q.lenient(p.q, ("content",))) for t in x.terms}) if p.q != "" else []
    if not terms:
        return best.orderBy("place").drop("place").withColumn("snippet", F.lit(""))
    # At most MOST paths: their texts alone are read.
    texts = docs.where(F.col("path").isin([r["path"] for r in rows])).select("path", "text")
    made = snippet_udf(terms, as_html)
    with_text = best.join(texts, "path", "left").withColumn("snippet", F.when(F.col("has_content"), made("text")).otherwise(""))
    return with_text.orderBy("place").select(*names, "snippet")


def response(docs: DataFrame, p: SearchParams, as_html: bool = False, measure=scan) -> dict:
    """The result rows with total, elapsed time and the limit used."""
    began, total = time.time(), Observation()
    rows = [r.asDict() for r in search(docs, p, as_html, measure, total).collect()]  # at most MOST rows
    return {"results": rows, "total": total.get["n"], "search_time_ms": int(1000 * (time.time() - began)), "limit_applied": p.limit}


def best_fragment(text: str, terms: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The window of at most SNIPPET_CHARS characters with most distinct, then most, of the terms; and their spans in it."""
    wanted = set(terms)
    spans = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in wanted]
    best, at, end = None, 0, 0
    for a, (start, _, _) in enumerate(spans):
        end = max(end, a)
        while end < len(spans) and spans[end][1] - start <= SNIPPET_CHARS:
            end += 1
        inside = spans[a:end]
        rank = (len({s[2] for s in inside}), len(inside))
        if best is None or rank > best:
            best, at = rank, a
    if best is None or not best[1]:
        return "", []
    start, last = spans[at][0], spans[at + best[1] - 1][1]
    room = SNIPPET_CHARS - (last - start)
    low = max(0, start - room // 2)
    high = min(len(text), low + SNIPPET_CHARS)
    low = max(0, min(low, high - SNIPPET_CHARS))
    # Not inside a word at either end.
    while low < start and low and text[low - 1].isalnum() and text[low].isalnum():
        low += 1
    while high > last and high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
        high -= 1
    return text[low:high], [(s - low, e - low) for s, e, _ in spans if low <= s and e <= high]


def snippet(text: str | None, terms: list[str], as_html: bool = False) -> str:
    fragment, spans = best_fragment(text or "", terms)
    if not as_html:
        return fragment
    out, at = [], 0
    for s, e in spans:
        out += [html.escape(fragment[at:s]), "<mark>", html.escape(fragment[s:e]), "</mark>"]
        at = e
    return "".join([*out, html.escape(fragment[at:])])


def snippet_udf(terms: list[str], as_html: bool):
    @F.pandas_udf("string")
    def made(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t, terms, as_html))

    return made
