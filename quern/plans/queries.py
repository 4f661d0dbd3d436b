"""The reference operators as queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import formats, outline, text
from quern.operators import snapshot
from quern.plans import index, search
from quern.plans.index import IndexStore
from quern.plans.search import SearchParams
from quern.session import forget_at_exit, shared_dir
from quern.streaming import changes

GAP = "6 hours"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, limit: int = 20_000_000) -> DataFrame:
    """The documents table in the index's shape: extension, name and times derive from doc_id."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "rst", "html"))), (F.col("doc_id") % 4 + 1).cast("int"))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"), F.lit(0))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    folder = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    when = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).cast("timestamp")
    size = F.octet_length("text").cast("long")
    return d.select(
        F.concat(folder, F.lit("/"), name).alias("path"), name.alias("filename"), folder.alias("dir"), "text", size.alias("size"),
        when.alias("modified"), (F.unix_micros(when) * 1000).alias("modified_ns"), ext.alias("extension"), (size <= limit).alias("has_content"), "doc_id",
    )


_STORES: dict[tuple[str, str], IndexStore] = {}


def indexed(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The index of the corpus, built once per application and folder, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        root = f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex}"
        _STORES[key] = IndexStore.build(corpus(spark, sf_dir), root)
        forget_at_exit(spark, root)
    return _STORES[key]


# --- SQL pieces --------------------------------------------------------------------------------------

_DOCS = r"""docs as (
  select source || '/' || lang || '/doc_' || doc_id || '.' || ext as path, 'doc_' || doc_id || '.' || ext as filename, source || '/' || lang as dir, text,
         octet_length(encode(text))::bigint as size, timestamp '2024-01-01' + to_minutes(doc_id) as modified, ext as extension, doc_id
  from (select *, (['md', 'txt', 'rst', 'html'])[doc_id % 4 + 1] as ext from documents)
)"""


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' and octet_length(encode(t)) <= 40)"


def _bm25_sql(terms_by_field: list[tuple[str, list[str]]], where: str = "true") -> str:
    """(path, score): sum of BM25 over (field, terms); a document needs one of them at least, and `where`."""
    column = {"content": "text"}
    fields = [f for f, _ in terms_by_field]
    toks = ", ".join(f"{_tokens(column.get(f, f))} as w_{f}" for f in fields)
    tfs = [(f, i, t) for f, ts in terms_by_field for i, t in enumerate(ts)]
    tf = ", ".join(f"len(list_filter(w_{f}, lambda t: t = '{t}')) as tf_{f}_{i}" for f, i, t in tfs)
    dl = ", ".join(f"len(w_{f}) as dl_{f}" for f in fields)
    stats = ", ".join(["count(*)::double as n", *(f"avg(dl_{f}) as avg_{f}" for f in fields), *(f"count(*) filter (tf_{f}_{i} > 0) as df_{f}_{i}" for f, i, _ in tfs)])
    one = lambda f, i: f"case when tf_{f}_{i} > 0 then ln(1 + (n - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * tf_{f}_{i} * 2.2 / (tf_{f}_{i} + 1.2 * (0.25 + 0.75 * dl_{f} / avg_{f})) else 0 end"
    some = " or ".join(f"tf_{f}_{i} > 0" for f, i, _ in tfs)
    return f"""toks as (select *, {toks} from docs), m as (select * exclude (text), {tf}, {dl} from toks), s as (select {stats} from m),
scored as (select m.*, ({' + '.join(one(f, i) for f, i, _ in tfs)})::double as score from m, s where ({some}) and {where})"""


def _top(frame: DataFrame) -> DataFrame:
    return frame.withColumn("score", F.round("score", 6))


# --- queries -----------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


@query("bm25_content_topk", f"with {_DOCS}, {_bm25_sql([('content', ['the', 'que'])])} select path, round(score, 6) as score from scored order by score desc, path limit 10")
def bm25_content_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ranked search for two words of the content, from their postings."""
    return _content_topk(search.Q.parse("content:the content:que", ("content",)), indexed(spark, sf_dir))


def _content_topk(tree: search.Q.Node, store: IndexStore | None, docs: DataFrame | None = None) -> DataFrame:
    m = store.measure(None, tree) if store else search.scan(docs, tree)
    found = m.rows.where(m.match(tree)).select("path", m.score(tree).alias("score"))
    return _top(search.top(found, SearchParams(max_results=10))).select("path", "score")


@query("bm25_scan", ORACLE_SQL["bm25_content_topk"])
def bm25_scan(spark, sf_dir):
    """The same without an index: terms are counted inside the documents' rows."""
    return _content_topk(search.Q.parse("content:the content:que", ("content",)), None, corpus(spark, sf_dir))


def _search(spark: SparkSession, sf_dir: str, p: SearchParams) -> DataFrame:
    """The first rows of a search by the index."""
    store = indexed(spark, sf_dir)
    rows = search.first(store.docs, p, store.measure)
    return _top(spark.createDataFrame([(r["path"], r["score"]) for r in rows], "path string, score double"))


def _hits(spark: SparkSession, sf_dir: str, p: SearchParams) -> DataFrame:
    store = indexed(spark, sf_dir)
    return search.hits(store.docs, p, store.measure)


@query("bm25_multi_field", f"with {_DOCS}, {_bm25_sql([('path', ['src3', 'the']), ('filename', ['src3', 'the']), ('content', ['src3', 'the'])])} select path, round(score, 6) as score from scored order by score desc, path limit 50")
def bm25_multi_field(spark, sf_dir):
    return _search(spark, sf_dir, SearchParams(q="src3 the"))


@query("search_ext_filter", f"with {_DOCS}, {_bm25_sql([('path', ['the']), ('filename', ['the']), ('content', ['the'])], "extension = 'md'")} select path, round(score, 6) as score from scored order by score desc, path limit 20")
def search_ext_filter(spark, sf_dir):
    return _search(spark, sf_dir, SearchParams(q="the", ext="MD", max_results=20, score_filters=False))


@query("search_path_filter", f"with {_DOCS}, {_bm25_sql([('path', ['the']), ('filename', ['the']), ('content', ['the'])], "list_has_any(w_path, ['src1', 'src2'])")} select path, round(score, 6) as score from scored order by score desc, path limit 20")
def search_path_filter(spark, sf_dir):
    return _search(spark, sf_dir, SearchParams(q="the", path="src1 src2", max_results=20, score_filters=False))


@query("search_ext_filter_scored", f"with {_DOCS}, {_bm25_sql([('path', ['the']), ('filename', ['the']), ('content', ['the'])], "extension = 'md'")}, e as (select ln(1 + (count(*) - count(*) filter (extension = 'md') + 0.5) / (count(*) filter (extension = 'md') + 0.5)) as idf from docs) select path, round(score + idf, 6) as score from scored, e order by scored.score desc, path limit 20")
def search_ext_filter_scored(spark, sf_dir):
    return _search(spark, sf_dir, SearchParams(q="the", ext="md", max_results=20))


_MATCH = "with {docs} select path, size, 0.0::double as score from docs order by {order} limit {n}"


def _match_all(by: str, order: str, n: int) -> Query:
    def run(spark, sf_dir):
        p = SearchParams(sort_by=by, sort_order=order, max_results=n)
        return search.top(_hits(spark, sf_dir, p), p).select("path", "size", "score")

    return run


for _by, _order, _n, _sql in (("size", "desc", 100, "size desc, path"), ("modified", "asc", 50, "modified, path"), ("path", "desc", 100, "path desc")):
    query(f"match_all_sort_{_by}", _MATCH.format(docs=_DOCS, order=_sql, n=_n))(_match_all(_by, _order, _n))


@query("search_limit_clamp", _MATCH.format(docs=_DOCS, order="path", n=100))
def search_limit_clamp(spark, sf_dir):
    return _match_all("path", "asc", 5000)(spark, sf_dir)


@query("search_total_hits", f"with {_DOCS}, toks as (select {_tokens('text')} as w, {_tokens('path')} as p from docs) select count(*) as total from toks where list_contains(w, 'les') or list_contains(p, 'les')")
def search_total_hits(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q="les")).agg(F.count("*").alias("total"))


@query("term_fallback_query", f"with {_DOCS}, {_bm25_sql([('path', ['the', 'unmatched']), ('filename', ['the', 'unmatched']), ('content', ['the', 'unmatched'])])} select path, round(score, 6) as score from scored order by score desc, path limit 50")
def term_fallback_query(spark, sf_dir):
    """Does not parse (an open bracket), so its bare terms are looked for."""
    return _search(spark, sf_dir, SearchParams(q="the [unmatched"))


@query("search_boolean", f"with {_DOCS}, t as (select path, {_tokens('text')} as c, {_tokens('path')} as p, {_tokens('filename')} as f from docs) select path from t where (list_contains(c, 'the') and list_contains(c, 'is') and not list_contains(c, 'was')) or ((list_contains(p, 'the') or list_contains(f, 'the')) and (list_contains(p, 'is') or list_contains(f, 'is')) and not (list_contains(p, 'was') or list_contains(f, 'was')))")
def search_boolean(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q="+the +is -was")).select("path")


@query("search_phrase", f"with {_DOCS}, t as (select path, ' ' || array_to_string({_tokens('text')}, ' ') || ' ' as c from docs) select path from t where c like '% of the %'")
def search_phrase(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q='content:"of the"')).select("path")


@query("search_size_range", f"with {_DOCS} select path, size from docs where size >= 1000 and size < 2000 and extension = 'txt'")
def search_size_range(spark, sf_dir):
    return _hits(spark, sf_dir, SearchParams(q="size:[1000 TO 2000}", ext="txt")).select("path", "size")


@query("term_stats", f"with {_DOCS}, t as (select path, unnest({_tokens('text')}) as term from docs), c as (select path, term, count(*) as tf from t group by all) select term, count(*) as df, sum(tf)::bigint as cf from c group by term")
def term_stats(spark, sf_dir):
    return index.term_stats(corpus(spark, sf_dir))


@query("postings_positions", f"with {_DOCS}, f as (select path, 'content' as field, {_tokens('text')} as w from docs union all select path, 'path', {_tokens('path')} from docs union all select path, 'filename', {_tokens('filename')} from docs union all select path, 'dir', {_tokens('dir')} from docs), e as (select field, path, unnest(w) as term, generate_subscripts(w, 1) - 1 as p from f) select field, term, path, count(*) as tf, min(p)::bigint as first_position from e group by all")
def postings_positions(spark, sf_dir):
    made = index.postings(corpus(spark, sf_dir))
    return made.select("field", "term", "path", F.size("positions").cast("long").alias("tf"), F.get("positions", F.lit(0)).cast("long").alias("first_position"))


@query("doc_lengths", f"with {_DOCS} select path, len({_tokens('path')})::bigint as dl_path, len({_tokens('filename')})::bigint as dl_filename, len({_tokens('text')})::bigint as dl_content from docs")
def doc_lengths(spark, sf_dir):
    return index.lengths(corpus(spark, sf_dir)).select("path", *(F.col(f"dl_{f}").cast("long").alias(f"dl_{f}") for f in ("path", "filename", "content")))


@query("index_stats", f"with {_DOCS} select count(*) as total_files_indexed, sum(size)::bigint as total_bytes from docs")
def index_stats(spark, sf_dir):
    return corpus(spark, sf_dir).agg(F.count("*").alias("total_files_indexed"), F.sum("size").alias("total_bytes"))


@query("ext_histogram", f"with {_DOCS} select extension, count(*) as files, max(modified) as newest from docs group by extension")
def ext_histogram(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("files"), F.max("modified").cast("timestamp_ntz").alias("newest"))


_LINES = r"case when text = '' then [] when right(text, 1) = chr(10) then list_transform(string_split(text, chr(10))[:-2], lambda l: regexp_replace(l, '\r$', '')) else list_transform(string_split(text, chr(10))[:-2], lambda l: regexp_replace(l, '\r$', '')) || string_split(text, chr(10))[-1:] end"


@query("line_count", f"with {_DOCS} select path, len({_LINES})::int as line_count from docs")
def line_count(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", text.line_count(F.col("text")).alias("line_count"))


@query("line_slice", f"with {_DOCS} select path, coalesce(array_to_string(({_LINES})[2:4], chr(10)), '') as body from docs")
def line_slice(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", text.line_slice(F.col("text"), 2, 4).alias("body"))


_LONG = "array_to_string(list_transform(generate_series(1, 90 + (doc_id % 30)::int), lambda k: 'line ' || k), chr(10))"


@query("auto_truncate", rf"""with {_DOCS}, long as (select path, {_LONG} as t, 90 + doc_id % 30 as n from docs)
select path, case when n > 100 then '[Truncated: showing lines 1-100 of ' || n || '. Continue with /file?path=' || path || '&start_line=101]' || chr(10) || array_to_string(string_split(t, chr(10))[1:100], chr(10)) || chr(10) || '[' || n || ' lines in total]' else t end as body from long""")
def auto_truncate(spark, sf_dir):
    long = F.array_join(F.transform(F.sequence(F.lit(1), (90 + F.col("doc_id") % 30).cast("int")), lambda k: F.concat(F.lit("line "), k.cast("string"))), "\n")
    return corpus(spark, sf_dir).withColumn("t", long).select("path", text.auto_truncate(F.col("path"), F.col("t")).alias("body"))


def synthetic_markdown(d: DataFrame) -> DataFrame:
    """Fences and headings put into the documents' lines (they have none of their own)."""

    def mark(x: Column, i: Column) -> Column:
        n = i + 1
        return F.when((n % 7).isin(3, 5), F.lit("```")).when(n % 4 == 1, F.concat(F.lit("# "), x)).when(n % 4 == 2, F.concat(F.lit("## "), x)).otherwise(x)

    return d.withColumn("text", F.array_join(F.transform(text.lines(F.col("text")), mark), "\n"))


_MD = rf"""with {_DOCS}, raw as (select path, {_LINES} as ls from docs), rows as (
  select path, len(ls) as total, generate_subscripts(ls, 1) as n, unnest(ls) as l from raw
), marked as (
  select path, total, n, trim(case when n % 7 in (3, 5) then '```' when n % 4 = 1 then '# ' || l when n % 4 = 2 then '## ' || l else l end, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as x from rows
), fenced as (
  select *, x like '```%' as fence, sum((x like '```%')::int) over (partition by path order by n) % 2 as open, len(regexp_extract(x, '^#*')) as hashes from marked
), heads as (
  select path, total, n, least(hashes, 6) as level, trim(substr(x, least(hashes, 6) + 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text from fenced where not fence and open = 0 and hashes > 0
)
select path, level::int as level, text, n::int as start_line, coalesce(lead(n) over (partition by path order by n) - 1, total)::int as end_line from heads where text <> ''"""


@query("md_outline", _MD)
def md_outline(spark, sf_dir):
    return outline.markdown_headings(synthetic_markdown(corpus(spark, sf_dir)))


@query("md_outline_windowed", _MD)
def md_outline_windowed(spark, sf_dir):
    return outline.markdown_headings_windowed(synthetic_markdown(corpus(spark, sf_dir)))


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with hidden directories and names, upper case and missing extensions."""
    hidden = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("."), "dir")).otherwise(F.col("dir"))
    name = F.when(F.col("doc_id") % 13 == 0, F.lit(".env")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit(".n"), F.upper("filename"))).when(F.col("doc_id") % 17 == 0, F.lit("README")).otherwise(F.col("filename"))
    return corpus(spark, sf_dir).select(F.concat(hidden, F.lit("/"), name).alias("path"), "doc_id")


_ODD = f"{_DOCS}, odd as (select case when doc_id % 10 = 0 then '.' || dir else dir end || '/' || case when doc_id % 13 = 0 then '.env' when doc_id % 7 = 0 then '.n' || upper(filename) when doc_id % 17 = 0 then 'README' else filename end as path, doc_id from docs)"


@query("path_parts", rf"with {_ODD} select doc_id, path, regexp_extract(path, '([^/]*)$', 1) as filename, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) as extension from odd")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return odd_paths(spark, sf_dir).select("doc_id", "path", text.filename(p).alias("filename"), text.parent(p).alias("dir"), text.extension(p).alias("extension"))


@query("hidden_filter", rf"with {_ODD} select doc_id, path from odd where not regexp_matches(path, '(^|/)\.[^/]*/')")
def hidden_filter(spark, sf_dir):
    return odd_paths(spark, sf_dir).where(~snapshot.skipped(F.col("path"))).select("doc_id", "path")


@query("format_detect", rf"with {_ODD} select format, count(*) as files from (select case lower(regexp_extract(path, '[^/.][^/]*\.([^./]*)$', 1)) when 'md' then 'Markdown' when 'txt' then 'Text' when 'rst' then 'Rst' when 'html' then 'Html' end as format from odd) group by format")
def format_detect(spark, sf_dir):
    return odd_paths(spark, sf_dir).groupBy(text.file_format(F.col("path")).alias("format")).agg(F.count("*").alias("files"))


@query("should_index", rf"with {_ODD} select doc_id from odd where lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) in ('md', 'rst')")
def should_index(spark, sf_dir):
    return odd_paths(spark, sf_dir).where(text.should_index(F.col("path"), [".MD", " rst ", "md"])).select("doc_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = corpus(spark, sf_dir).select("path", "modified_ns", "doc_id")
    bumped = F.col("modified_ns") + F.when(F.col("doc_id") % 5 == 0, F.lit(10**9)).otherwise(F.lit(0))
    return d.where("doc_id % 11 <> 0").withColumn("modified_ns", bumped).drop("doc_id"), d.where("doc_id % 7 <> 0").drop("doc_id")


_PAIR = f"{_DOCS}, t as (select path, epoch_ns(modified) as ns, doc_id from docs), disk as (select path, ns + case when doc_id % 5 = 0 then 1000000000 else 0 end as modified_ns from t where doc_id % 11 <> 0), idx as (select path, ns as modified_ns from t where doc_id % 7 <> 0)"


@query("snapshot_new_modified", f"with {_PAIR} select d.path, d.modified_ns from disk d left join idx i on d.path = i.path where i.modified_ns is null or d.modified_ns > i.modified_ns")
def snapshot_new_modified(spark, sf_dir):
    disk, idx = _snapshots(spark, sf_dir)
    return snapshot.new_or_modified(disk, idx)


@query("snapshot_deleted", f"with {_PAIR} select path from idx where path not in (select path from disk)")
def snapshot_deleted(spark, sf_dir):
    disk, idx = _snapshots(spark, sf_dir)
    return snapshot.deleted(idx, disk)


@query("snapshot_counts", f"with {_PAIR} select (select count(*) from disk) as processed, (select count(*) from disk d left join idx i on d.path = i.path where i.modified_ns is null or d.modified_ns > i.modified_ns) as changed, (select count(*) from idx where path not in (select path from disk)) as deleted")
def snapshot_counts(spark, sf_dir):
    disk, idx = _snapshots(spark, sf_dir)
    return snapshot.scan_counts(disk, idx)


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as changes: purchases delete a file, errors its directory, others modify it."""
    e = table(spark, sf_dir, "events")
    folder = F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "Deleted").when(F.col("event_type") == "error", "DeletedDir").otherwise("Modified")
    path = F.when(F.col("event_type") == "error", folder).otherwise(F.concat(folder, F.lit("/u"), F.col("user_id").cast("string"), F.lit(".txt")))
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), path.alias("path"))


_CHANGES = "changes as (select event_id as seq, ts, case event_type when 'purchase' then 'Deleted' when 'error' then 'DeletedDir' else 'Modified' end as kind, 'd' || (user_id % 10) || case when event_type = 'error' then '' else '/u' || user_id || '.txt' end as path from events)"


@query("debounce_sessions", f"""with {_CHANGES}, m as (select *, case when ts - lag(ts) over (partition by path order by ts) < interval 6 hours then 0 else 1 end as fresh from changes where kind = 'Modified'),
g as (select *, sum(fresh) over (partition by path order by ts rows unbounded preceding) as burst from m) select path, 'Modified' as kind, max(ts) as ts, count(*) as merged from g group by path, burst""")
def debounce_sessions(spark, sf_dir):
    return changes.debounced(change_rows(spark, sf_dir), GAP).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("change_apply_lww", f"""with {_CHANGES}, adds as (select path, max(seq) as seq from changes where kind = 'Modified' group by path), dels as (select path, max(seq) as seq from changes where kind = 'Deleted' group by path), dirs as (select path, max(seq) as seq from changes where kind = 'DeletedDir' group by path)
select a.path, a.seq from adds a where not exists (select 1 from dels d where d.path = a.path and d.seq > a.seq) and not exists (select 1 from dirs d where starts_with(a.path, d.path || '/') and d.seq > a.seq)""")
def change_apply_lww(spark, sf_dir):
    return snapshot.surviving_adds(change_rows(spark, sf_dir))


@query("immediate_changes", f"with {_CHANGES} select kind, count(*) as changes from changes where kind <> 'Modified' group by kind")
def immediate_changes(spark, sf_dir):
    return changes.immediate(change_rows(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("changes"))


@query("url_component", r"select page_id, replace(url_encode(url), '%2F', '/') as encoded from pages")
def url_component(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_component(F.col("url")).alias("encoded"))


@query("utf8_truncate", r"""with d as (select doc_id, text, list_transform(generate_series(1, least(len(text), 30)), lambda k: octet_length(encode(text[1:k]))) as cuts from documents)
select doc_id, case when octet_length(encode(text)) <= 25 then text else text[1:len(list_filter(cuts, lambda c: c <= 25))] || '...' end as cut from d""")
def utf8_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ellipsis(F.col("text"), 25).alias("cut"))


@query("mime_map", "select i as id, case i % 11 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/jpeg' when 3 then 'image/gif' when 4 then 'image/webp' when 5 then 'image/bmp' when 6 then 'image/tiff' when 7 then 'image/tiff' when 8 then 'image/x-icon' when 9 then 'image/svg+xml' end as mime from range(33) t(i)")
def mime_map(spark, sf_dir):
    names = ["png", "JPG", "jpeg", "gif", "webp", "bmp", "tif", "TIFF", "ico", "svg", "txt"]
    path = F.concat(F.lit("a.b/img."), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 11 + 1).cast("int")))
    return spark.range(33).select("id", text.mime_type(path).alias("mime"))


@query("virtual_archive", "select i as id, case when i % 3 = 0 then 'd/book' || i || '.EPUB' end as archive, case when i % 3 = 0 then 'images/p' || i || '.png' end as inner_path from range(30) t(i)")
def virtual_archive(spark, sf_dir):
    s = F.col("id").cast("string")
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("d/book"), s, F.lit(".EPUB/images/p"), s, F.lit(".png"))).when(F.col("id") % 3 == 1, F.concat(F.lit("/d/book.epub/x"), s)).otherwise(F.concat(F.lit("d/"), s, F.lit(".epub")))
    v = text.virtual_archive(path)
    return spark.range(30).select("id", v["archive"].alias("archive"), v["inner"].alias("inner_path"))


@query("rfc3339_modified", f"with {_DOCS} select path, strftime(modified, '%Y-%m-%dT%H:%M:%S') || '+00:00' as modified from docs")
def rfc3339_modified(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", text.rfc3339(F.col("modified")).alias("modified"))


@query("max_mtime_per_path", f"with {_DOCS} select dir as path, epoch_ns(max(modified)) as modified_ns from docs group by dir")
def max_mtime_per_path(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy(F.col("dir").alias("path")).agg(F.max("modified_ns").alias("modified_ns"))


@query("distinct_paths", f"with {_DOCS} select distinct dir from docs")
def distinct_paths(spark, sf_dir):
    return corpus(spark, sf_dir).select("dir").distinct()


@query("collapse_blanks", r"select doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^$', '') as flat from documents")
def collapse_blanks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_blanks(F.col("text")).alias("flat"))


@query("xml_unescape", "select page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') as plain from pages")
def xml_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.xml_unescape(F.col("html")).alias("plain"))


@query("result_text", f"with {_DOCS} select doc_id, (doc_id + 1) || '. ' || path || ' (score: ' || format('{{:.3f}}', doc_id / 8.0) || ')' || chr(10) || '   hit' as line from docs")
def result_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.result_text(F.col("doc_id") + 1, F.col("path"), F.col("doc_id") / 8, F.lit("hit")).alias("line"))


def os_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as OS notifications: renames with both ends, removals, creations and lost events."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".txt"))
    new = F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit(".txt"))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in _EVENT.items() for x in kv)), F.col("event_type"))
    paths = F.when(kind == "RenameBoth", F.when(F.col("event_id") % 3 == 0, F.array(path, new, new)).otherwise(F.array(path, new))).otherwise(F.array(path))
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), paths.alias("paths"),
        (F.col("user_id") % 4 == 0).alias("is_dir"), (F.col("event_id") % 97 == 0).alias("need_rescan"),
    )


_EVENT = {"view": "Modify", "click": "RenameBoth", "signup": "RemoveFolder", "purchase": "RenameFrom", "error": "RemoveFile"}


@query("event_changes", """with e as (select *, 'u' || user_id || '.txt' as p, 'n' || user_id || '.txt' as n from events), made as (
  select event_id as seq, unnest(case
    when event_id % 97 = 0 then [struct_pack(kind := 'Rescan', path := null::varchar)]
    when event_type = 'view' and user_id % 4 = 0 then []
    when event_type = 'view' then [struct_pack(kind := 'Modified', path := p)]
    when event_type = 'click' then [struct_pack(kind := 'Deleted', path := p), struct_pack(kind := 'DeletedDir', path := p), struct_pack(kind := 'Modified', path := n)]
       || case when event_id % 3 = 0 then [struct_pack(kind := 'Modified', path := n)] else [] end
    when event_type = 'signup' then [struct_pack(kind := 'DeletedDir', path := p)]
    when event_type = 'purchase' then [struct_pack(kind := 'Deleted', path := p), struct_pack(kind := 'DeletedDir', path := p)]
    else [struct_pack(kind := 'Deleted', path := p)] end) as c from e)
select seq, c.kind as kind, c.path as path from made""")
def event_changes(spark, sf_dir):
    return changes.event_changes(os_events(spark, sf_dir)).select("seq", "kind", "path")


@query("change_apply", f"""with {_CHANGES}, users as (select distinct user_id, 'd' || (user_id % 10) || '/u' || user_id || '.txt' as path from events),
adds as (select path, max(seq) as seq from changes where kind = 'Modified' group by path), alive as (
  select a.path from adds a where not exists (select 1 from changes d where d.kind = 'Deleted' and d.path = a.path and d.seq > a.seq)
     and not exists (select 1 from changes d where d.kind = 'DeletedDir' and starts_with(a.path, d.path || '/') and d.seq > a.seq)),
old as (select path, 0 as version from users where user_id % 2 = 0 union all select 'keep/' || path, 0 from users),
fresh as (select path, 1 as version from users where user_id % 3 <> 0)
select path, version from old o where not exists (select 1 from changes c where (c.kind in ('Deleted', 'Modified') and c.path = o.path) or (c.kind = 'DeletedDir' and starts_with(o.path, c.path || '/')))
union all select path, version from fresh where path in (select path from alive)""")
def change_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    users = e.select("user_id", F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string"), F.lit("/u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path"))
    old = users.where("user_id % 2 = 0").select("path", F.lit(0).alias("version")).union(users.select(F.concat(F.lit("keep/"), "path"), F.lit(0)))
    fresh = users.where("user_id % 3 <> 0").select("path", F.lit(1).alias("version"))
    return snapshot.apply_changes(old, change_rows(spark, sf_dir), fresh)


@query("directory_walk_filter", rf"with {_ODD} select doc_id from odd where not regexp_matches(path, '(^|/)\.')")
def directory_walk_filter(spark, sf_dir):
    """Paths taken as directories: neither they nor what they are in is hidden."""
    return odd_paths(spark, sf_dir).where(~snapshot.directory_skipped(F.col("path"), ".quern")).select("doc_id")


@query("content_types", rf"with {_ODD} select type, count(*) as files from (select case lower(regexp_extract(path, '[^/.][^/]*\.([^./]*)$', 1)) when 'md' then 'text/markdown; charset=utf-8' when 'rst' then 'text/markdown; charset=utf-8' when 'html' then 'text/markdown; charset=utf-8' when 'txt' then 'text/plain; charset=utf-8' end as type from odd) group by type")
def content_types(spark, sf_dir):
    return odd_paths(spark, sf_dir).groupBy(text.content_type(F.col("path")).alias("type")).agg(F.count("*").alias("files"))


@query("base64_images", "select page_id, base64(encode(url)) as data from pages")
def base64_images(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.base64_line(F.encode("url", "UTF-8")).alias("data"))


@query("outline_text", _MD.replace("select path, level::int", ", o as (select path, level::int", 1) + r""")
select d.path, d.path || ' (' || any_value(r.n) || ' lines)' || coalesce(chr(10) || string_agg(repeat('  ', o.level - 1) || o.text || ' [L' || o.start_line || '-L' || o.end_line || ']', chr(10) order by o.start_line), '') as body
from docs d join (select path, len(ls) as n from raw) r on r.path = d.path left join o on o.path = d.path group by d.path""")
def outline_text(spark, sf_dir):
    d = synthetic_markdown(corpus(spark, sf_dir))
    heads = outline.markdown_headings(d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "level", "text", "end_line"))).alias("headings"))
    rows = d.select("path", text.line_count(F.col("text")).alias("n")).join(heads, "path", "left")
    none = F.array().cast("array<struct<start_line:int,level:int,text:string,end_line:int>>")
    return rows.select("path", text.outline_text(F.col("path"), F.col("n"), F.coalesce("headings", none)).alias("body"))
