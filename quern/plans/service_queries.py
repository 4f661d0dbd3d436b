"""The index, the service and what they answer as queries over the driver's tables, with SQL for what must come out."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern import config, serve
from quern.operators import snapshot
from quern.plans import search
from quern.plans.index import IndexStore
from quern.plans.queries import _DOCS, _PAIR, _bm25_sql, _hits, _search, _snapshots, _tokens, corpus, indexed, os_events, query
from quern.plans.search import SearchParams
from quern.session import forget_at_exit, shared_dir
from quern.streaming import changes

_ALL_FIELDS = lambda *terms: [(f, list(terms)) for f in ("path", "filename", "content")]

# --- the grammar ---------------------------------------------------------------------------------------


@query("search_boost", f"with {_DOCS}, {_bm25_sql([('content', ['the', 'que'])])}, parts as (select *, case when tf_content_0 > 0 then ln(1 + (n - df_content_0 + 0.5) / (df_content_0 + 0.5)) * tf_content_0 * 2.2 / (tf_content_0 + 1.2 * (0.25 + 0.75 * dl_content / avg_content)) else 0 end as first from scored, s) select path, round(score + 1.5 * first, 6) as score from parts order by score + 1.5 * first desc, path limit 30")
def search_boost(spark, sf_dir):
    return _search(spark, sf_dir, SearchParams(q="content:the^2.5 content:que", max_results=30, search_content=False))


@query("search_set", f"with {_DOCS} select path from docs where list_has_any({_tokens('text')}, ['les', 'der', 'nothing'])")
def search_set(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q="content: IN [les der nothing]")).select("path")


@query("search_slop", f"""with {_DOCS}, w as (select path, {_tokens('text')} as w from docs), p as (select path, w, unnest(w) as t, generate_subscripts(w, 1) as i from w)
select distinct path from p where t = 'the' and list_contains(w[i + 1:i + 4], 'that')""")
def search_slop(spark, sf_dir):
    """The second word within four places after the first."""
    return _hits(spark, sf_dir, SearchParams(q='content:"the that"~3')).select("path")


@query("search_modified_range", f"with {_DOCS} select path from docs where modified >= timestamp '2024-01-01 03:00:00' and modified < timestamp '2024-01-01 09:30:00.5' and extension <> 'md'")
def search_modified_range(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q="modified:[2024-01-01T03:00:00Z TO 2024-01-01T10:30:00.500000000+01:00} -extension:md")).select("path")


@query("search_nested", f"with {_DOCS}, t as (select path, extension, {_tokens('text')} as c from docs) select path from t where ((list_contains(c, 'les') or list_contains(c, 'und')) and not list_contains(c, 'et')) or (list_contains(c, 'the') and extension = 'rst')")
def search_nested(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q="((content:les OR content:und) AND NOT content:et) OR (content:the AND extension:rst)", search_content=False)).select("path")


# --- results, snippets ---------------------------------------------------------------------------------

_TOP = f"with {_DOCS}, {_bm25_sql(_ALL_FIELDS('the'))}, best as (select * from scored order by score desc, path limit 20)"


@query("search_result_fields", f"{_TOP} select path, filename, dir, size, strftime(modified, '%Y-%m-%dT%H:%M:%S') || '+00:00' as modified, extension, true as has_content, round(score, 6) as score from best")
def search_result_fields(spark, sf_dir):
    store = indexed(spark, sf_dir)
    return search.search(store.docs, SearchParams(q="the", max_results=20), measure=store.measure).drop("snippet").withColumn("score", F.round("score", 6))


_SNIPPET = rf"""{_TOP}, pieces as (
  select path, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') as ps from best join docs using (path)
), places as (
  select path, len(text) as size, generate_subscripts(ps, 1) as k, unnest(ps) as p from pieces
), spans as (
  select *, upto - len(p) as start, lower(p) = 'the' as hit from (select *, sum(len(p)) over (partition by path order by k) as upto from places)
), terms as (
  select * from spans where hit
), windows as (
  select a.path, a.size, a.start, max(b.upto) as last, count(*) as n from terms a join terms b on b.path = a.path and b.start >= a.start and b.upto - a.start <= 150 group by all
), chosen as (
  select path, size, start, last, greatest(0, least(greatest(0, start - (150 - (last - start)) // 2), least(size, greatest(0, start - (150 - (last - start)) // 2) + 150) - 150)) as low,
         least(size, greatest(0, start - (150 - (last - start)) // 2) + 150) as high
  from windows qualify row_number() over (partition by path order by n desc, start) = 1
), cut as (
  -- a word that the window's edge would cut is left out
  select c.path, coalesce(any_value(s.upto) filter (s.start < low and s.upto > low and s.k_is_word), any_value(low)) as low,
         coalesce(any_value(e.start) filter (e.start < high and e.upto > high and e.k_is_word), any_value(high)) as high
  from chosen c left join (select *, regexp_matches(p, '^[\p{{L}}\p{{N}}]') as k_is_word from spans) s on s.path = c.path and s.start < c.low and s.upto > c.low
       left join (select *, regexp_matches(p, '^[\p{{L}}\p{{N}}]') as k_is_word from spans) e on e.path = c.path and e.start < c.high and e.upto > c.high group by c.path
), shown as (
  select s.path, k, hit and start >= low and upto <= high as mark, p[greatest(low - start, 0) + 1:least(upto, high) - start] as p from spans s join cut c on c.path = s.path and s.upto > c.low and s.start < c.high
), escaped as (
  select path, k, mark, replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as p from shown
)
select path, string_agg(case when mark then '<mark>' || p || '</mark>' else p end, '' order by k) as snippet from escaped group by path"""


@query("snippet_html", _SNIPPET)
def snippet_html(spark, sf_dir):
    """The best fragments of the first documents' texts, with the words found in marks."""
    store = indexed(spark, sf_dir)
    return search.search(store.docs, SearchParams(q="the", max_results=20), as_html=True, measure=store.measure).select("path", "snippet")


# --- the index under changes -----------------------------------------------------------------------------

_EDITED = f"""{_DOCS}, c as (select path, doc_id, case when doc_id % 7 = 0 then 'Deleted' when doc_id % 5 = 1 then 'Modified' end as kind, dir like 'src1/%' as cut from docs),
after as (select d.path, case when c.kind = 'Modified' and doc_id % 10 <> 1 then 'new words of ' || d.text else d.text end as text, d.doc_id
  from docs d join c using (path, doc_id) where (c.kind is distinct from 'Deleted') and not (c.kind = 'Modified' and doc_id % 10 = 1) and not (cut and c.kind is distinct from 'Modified'))"""
_EDITED_STORES: dict[tuple[str, str], IndexStore] = {}


def edited(spark: SparkSession, sf_dir: str) -> IndexStore:
    """An index of the corpus after batches that delete paths, a directory, and modify paths (some of which are gone again)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EDITED_STORES:
        root = f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex}"
        docs = corpus(spark, sf_dir)
        store = IndexStore.build(docs, root)
        forget_at_exit(spark, root)
        fresh = docs.where("doc_id % 10 <> 1").withColumn("text", F.concat(F.lit("new words of "), "text"))
        every = lambda kind, where: docs.where(where).select(F.col("doc_id").alias("seq"), F.lit(kind).alias("kind"), "path")
        store.apply(every("Deleted", "doc_id % 7 = 0"), fresh)
        store.apply(spark.createDataFrame([(0, "DeletedDir", "src1")], "seq long, kind string, path string"), fresh)
        store.apply(every("Modified", "doc_id % 5 = 1 and doc_id % 7 <> 0"), fresh)
        _EDITED_STORES[key] = store
    return _EDITED_STORES[key]


@query("index_after_changes", f"with {_EDITED} select path, octet_length(encode(text))::bigint as bytes, md5(text) as digest from after")
def index_after_changes(spark, sf_dir):
    return edited(spark, sf_dir).docs.select("path", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("digest"))


@query("postings_after_changes", f"with {_EDITED}, t as (select path, unnest({_tokens('text')}) as term from after), n as (select path, term, count(*) as tf from t group by all) select term, count(*) as df, sum(tf)::bigint as cf from n group by term")
def postings_after_changes(spark, sf_dir):
    """The postings are kept up with the documents, not made anew."""
    return edited(spark, sf_dir).live("postings").where("field = 'content'").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


@query("index_counts_after_changes", f"with {_EDITED} select count(*) as docs, sum(len({_tokens('text')}))::bigint as content, sum(len({_tokens('path')}))::bigint as paths from after")
def index_counts_after_changes(spark, sf_dir):
    """What the manifest says, without a look at the documents."""
    m = edited(spark, sf_dir).manifest()
    return spark.createDataFrame([(m.docs, m.lengths["content"], m.lengths["path"])], "docs long, content long, paths long")


@query("search_after_changes", f"with {_EDITED.replace('after as (', 'after_all as (')}, docs2 as (select d.* replace (a.text as text) from after_all a join docs d using (path)), {_bm25_sql([('content', ['new', 'der'])]).replace('from docs)', 'from docs2)')} select path, round(score, 6) as score from scored order by score desc, path limit 40")
def search_after_changes(spark, sf_dir):
    store = edited(spark, sf_dir)
    rows = search.first(store.docs, SearchParams(q="content:new content:der", max_results=40, search_content=False), store.measure)
    return spark.createDataFrame([(r["path"], r["score"]) for r in rows], "path string, score double").withColumn("score", F.round("score", 6))


@query("rescan_changes", f"with {_PAIR} select 'Modified' as kind, d.path from disk d left join idx i on d.path = i.path where i.modified_ns is null or d.modified_ns > i.modified_ns union all select 'Deleted', path from idx where path not in (select path from disk)")
def rescan_changes(spark, sf_dir):
    """A rescan as changes: what the disk has newer, and what it no longer has."""
    disk, idx = _snapshots(spark, sf_dir)
    gone, new = snapshot.deleted(idx, disk), snapshot.new_or_modified(disk, idx)
    return new.select(F.lit("Modified").alias("kind"), "path").union(gone.select(F.lit("Deleted").alias("kind"), "path"))


@query("unverifiable_paths", f"with {_PAIR} select count(*) as unverifiable, min(path) as sample from idx where path not in (select path from disk)")
def unverifiable_paths(spark, sf_dir):
    disk, idx = _snapshots(spark, sf_dir)
    return snapshot.unverifiable(snapshot.deleted(idx, disk))


@query("deleted_but_unverified", f"with {_PAIR} select path from idx where path not in (select path from disk) and path not like 'src2/%'")
def deleted_but_unverified(spark, sf_dir):
    """Paths that could not be looked at stay in the index."""
    disk, idx = _snapshots(spark, sf_dir)
    return snapshot.deleted(idx, disk, idx.where("path like 'src2/%'").select("path"))


@query("stream_changes", """with e as (select *, case when user_id % 3 = 0 then '.git/' else 'a/' end || 'u' || user_id || '.txt' as p, 'a/n' || user_id || '.txt' as n from events), made as (
  select event_id as seq, ts, unnest(case
    when event_id % 97 = 0 then [struct_pack(kind := 'Rescan', path := null::varchar)]
    when event_type = 'view' and user_id % 4 = 0 then []
    when event_type = 'view' then [struct_pack(kind := 'Modified', path := p)]
    when event_type = 'click' then [struct_pack(kind := 'Deleted', path := p), struct_pack(kind := 'DeletedDir', path := p), struct_pack(kind := 'Modified', path := n)]
       || case when event_id % 3 = 0 then [struct_pack(kind := 'Modified', path := n)] else [] end
    when event_type = 'signup' then [struct_pack(kind := 'DeletedDir', path := p)]
    when event_type = 'purchase' then [struct_pack(kind := 'Deleted', path := p), struct_pack(kind := 'DeletedDir', path := p)]
    else [struct_pack(kind := 'Deleted', path := p)] end) as c from e
), seen as (select seq, ts, c.kind as kind, c.path as path from made where c.path is null or c.path not like '.git/%'),
m as (select *, case when ts - lag(ts) over (partition by path order by ts) < interval 6 hours then 0 else 1 end as fresh from (select distinct path, ts from seen where kind = 'Modified')),
g as (select *, sum(fresh) over (partition by path order by ts rows unbounded preceding) as burst from m)
select kind, path, ts from seen where kind <> 'Modified' union all select 'Modified', path, max(ts) from g group by path, burst""")
def stream_changes(spark, sf_dir):
    """The way of the stream: events to changes, hidden paths out, bursts merged, the others at once."""
    hidden = lambda p: p.startswith("u") & (F.regexp_extract(p, "[0-9]+", 0).cast("int") % 3 == 0)
    events = os_events(spark, sf_dir).withColumn("paths", F.transform("paths", lambda p: F.concat(F.when(hidden(p), F.lit(".git/")).otherwise(F.lit("a/")), p)))
    seen = changes.visible(changes.event_changes(events), ".quern")
    later = changes.debounced(seen, "6 hours").select("kind", "path", "ts")
    return changes.immediate(seen).select("kind", "path", "ts").union(later).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- the service -----------------------------------------------------------------------------------------


def service(spark: SparkSession, sf_dir: str) -> serve.Service:
    return serve.Service(spark, indexed(spark, sf_dir), config.Config("/"))


def _answer(spark: SparkSession, sf_dir: str, target: str) -> tuple[int, str, str]:
    return serve.respond(service(spark, sf_dir), target)


@query("http_search", f"with {_DOCS}, {_bm25_sql(_ALL_FIELDS('les'))}, total as (select count(*) as total from scored) select 200 as status, total, 7 as limit_applied, path, size, round(score, 6) as score from scored, total order by scored.score desc, path limit 7")
def http_search(spark, sf_dir):
    status, _, body = _answer(spark, sf_dir, "/search?q=les&max_results=7&sort_by=nothing")
    reply = json.loads(body)
    rows = [(status, reply["total"], reply["limit_applied"], r["path"], r["size"], r["score"]) for r in reply["results"]]
    return spark.createDataFrame(rows, "status int, total long, limit_applied int, path string, size long, score double").withColumn("score", F.round("score", 6))


@query("http_search_filtered", f"with {_DOCS}, found as (select * from docs where extension = 'md' and list_contains({_tokens('path')}, 'src1')) select path, size, (select count(*) from found) as total from found order by size, path limit 15")
def http_search_filtered(spark, sf_dir):
    reply = json.loads(_answer(spark, sf_dir, f"/search?ext=MD&path={quote('src1')}&sort_by=size&sort_order=asc&max_results=15")[2])
    return spark.createDataFrame([(r["path"], r["size"], reply["total"]) for r in reply["results"]], "path string, size long, total long")


@query("http_stats", "select 200 as status, 'application/json' as type, (select count(*) from documents) as total_files_indexed")
def http_stats(spark, sf_dir):
    status, kind, body = _answer(spark, sf_dir, "/stats")
    return spark.createDataFrame([(status, kind, json.loads(body)["total_files_indexed"])], "status int, type string, total_files_indexed long")


@query("http_statuses", "select * from (values ('/', 200, 'text/html; charset=utf-8'), ('/nowhere', 404, 'application/json'), ('/file?path=..%2Fx', 403, 'application/json'), ('/file?path=no%2Fsuch.md', 404, 'application/json'), ('/file', 404, 'application/json'), ('/structure?path=/etc', 403, 'application/json'), ('/mcp', 200, 'text/event-stream')) t(target, status, type)")
def http_statuses(spark, sf_dir):
    targets = ["/", "/nowhere", "/file?path=..%2Fx", "/file?path=no%2Fsuch.md", "/file", "/structure?path=/etc", "/mcp"]
    return spark.createDataFrame([(t, *_answer(spark, sf_dir, t)[:2]) for t in targets], "target string, status int, type string")


@query("tool_search", f"with {_DOCS}, {_bm25_sql(_ALL_FIELDS('und'))}, best as (select path, score, row_number() over (order by score desc, path) as n from scored order by score desc, path limit 10) select n, path, format('{{:.3f}}', score) as score from best")
def tool_search(spark, sf_dir):
    """The tool's text, taken apart again: a numbered line for each result, and its snippet below."""
    reply = serve.json_rpc(service(spark, sf_dir), json.dumps({"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "docs_search", "arguments": {"query": " und "}}}))
    lines = spark.createDataFrame([(x,) for x in reply["result"]["content"][0]["text"].split("\n") if not x.startswith("   ")], "line string")
    part = lambda k: F.regexp_extract("line", r"^(\d+)\. (.*) \(score: ([0-9.]+)\)$", k)
    return lines.where(part(1) != "").select(part(1).try_cast("long").alias("n"), part(2).alias("path"), part(3).alias("score"))


_CALLS = [
    ("{", -32700), ("[1]", -32600), ('{"id": 1}', -32600), ('{"jsonrpc": "2.0", "id": 1, "method": "nope"}', -32601), ('{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "none"}}', -32602),
    ('{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "docs_get"}}', -32602), ('{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}', 0), ('{"jsonrpc": "2.0", "id": 1, "method": "initialize"}', 0),
    ('{"jsonrpc": "2.0", "id": 1, "method": "server/discover"}', 0), ('{"jsonrpc": "2.0", "method": "tools/list"}', None), ('{"jsonrpc": "2.0", "id": 1, "result": {}}', None),
]


@query("json_rpc_codes", "select * from (values " + ", ".join(f"('{m}', {'null' if code is None else code}::int)" for m, code in _CALLS) + ") t(message, code)")
def json_rpc_codes(spark, sf_dir):
    """The error code of each message, 0 for a result, null for no reply."""
    replies = [(m, serve.json_rpc(service(spark, sf_dir), m)) for m, _ in _CALLS]
    return spark.createDataFrame([(m, None if r is None else r["error"]["code"] if "error" in r else 0) for m, r in replies], "message string, code int")


@query("request_log", "select page_id, ' (path=' || case when octet_length(encode(url)) <= 128 then url else url[1:128] || '…' end || ', start_line=' || page_id || ', all=true)' as line from (select page_id, url || repeat('/x', (page_id % 100)::int) as url from pages)")
def request_log(spark, sf_dir):
    """Arguments as the log shows them: long strings cut, lists left out."""

    @F.pandas_udf("string")
    def line(url: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([serve.compact({"path": u, "start_line": int(k), "all": True, "more": [1]}) for u, k in zip(url, n)])

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", line(F.concat("url", F.repeat(F.lit("/x"), (F.col("page_id") % 100).cast("int"))), "page_id").alias("line"))
