"""Search semantics, the grammar, the index, and snippets."""

from __future__ import annotations

import datetime as dt

import pytest

from quern.plans import query as Q
from quern.plans import search
from quern.plans.index import IndexStore
from quern.plans.search import SearchParams
from quern.schema import DOCS

FILES = {
    "code/ahoy.rs": 'fn ahoy() { print!("Ahoy"); }', "code/sails.rs": "fn sails() {}", "GUIDE.md": "# Harbour guide",
    "docs/a.txt": "an early tall ship left near the quiet pier", "docs/b.txt": "early pier, quiet ship & <tags>", "docs/c.bin": None,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for n, (p, t) in enumerate(FILES.items()):
        d, _, name = p.rpartition("/")
        rows.append((p, name, d, t, len(t or ""), dt.datetime(2024, 1, 1, 0, n), n * 10**9, name.rsplit(".", 1)[1], t is not None))
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return IndexStore.build(docs, f"file://{tmp_path_factory.mktemp('index')}")


def found(docs, **p):
    return [r["path"] for r in search.search(docs, SearchParams(**p)).collect()]


def test_content_and_names(docs):
    assert found(docs, q="Ahoy") == ["code/ahoy.rs"]
    assert found(docs, q="sails", search_content=False) == ["code/sails.rs"]
    assert found(docs, q="GUIDE") == ["GUIDE.md"]
    assert found(docs, q="nothing_like_it") == [] and len(found(docs)) == len(FILES)


def test_filters_and_orders(docs):
    assert sorted(found(docs, ext="RS")) == ["code/ahoy.rs", "code/sails.rs"]
    assert sorted(found(docs, path="docs")) == ["docs/a.txt", "docs/b.txt", "docs/c.bin"]
    assert found(docs, ext="") == [] and found(docs, q="ship", ext="txt", path="code") == []
    assert found(docs, sort_by="path", sort_order="asc") == sorted(FILES)
    assert found(docs, sort_by="path") == sorted(FILES, reverse=True)
    assert found(docs, sort_by="modified", sort_order="asc") == list(FILES)
    assert found(docs, sort_by="size")[0] == "docs/a.txt"
    assert found(docs, sort_by="bogus", q="ship") == found(docs, q="ship")
    assert len(found(docs, max_results=0)) == 1 and SearchParams(max_results=1000).limit == 100


def test_scores(docs):
    rows = search.search(docs, SearchParams(q="ship")).collect()
    assert [r["path"] for r in rows] == ["docs/b.txt", "docs/a.txt"] and rows[0]["score"] > rows[1]["score"] > 0
    assert {r["score"] for r in search.search(docs, SearchParams(q="ship", sort_by="size")).collect()} == {0.0}
    with_filter = search.search(docs, SearchParams(q="ship", ext="txt")).collect()
    assert [r["path"] for r in with_filter] == [r["path"] for r in rows] and with_filter[0]["score"] > rows[0]["score"]


def test_snippets(docs):
    got = {r["path"]: r["snippet"] for r in search.search(docs, SearchParams(q="ahoy ship"), as_html=True).collect()}
    assert "<mark>Ahoy</mark>" in got["code/ahoy.rs"] and "&quot;" in got["code/ahoy.rs"]
    assert "<mark>ship</mark> &amp; &lt;tags&gt;" in got["docs/b.txt"]
    assert {r["snippet"] for r in search.search(docs, SearchParams(q="guide", ext="md", search_content=True)).collect()} == {"# Harbour guide"}
    assert {r["snippet"] for r in search.search(docs, SearchParams()).collect()} == {""}
    assert search.snippet("x" * 500 + " needle " + "y" * 500, ["needle"]).strip() and len(search.snippet("word " * 200 + "needle", ["needle"])) <= 150


def test_response(docs):
    got = search.response(docs, SearchParams(q="ship", max_results=1))
    assert got["total"] == 2 and len(got["results"]) == 1 and got["limit_applied"] == 1
    assert got["results"][0]["modified"] == "2024-01-01T00:04:00+00:00"


QUERIES = {
    "early pier": {"docs/a.txt", "docs/b.txt"}, "early AND tall": {"docs/a.txt"}, "+ship -tall": {"docs/b.txt"}, "ship NOT tags": {"docs/a.txt"},
    '"early tall"': {"docs/a.txt"}, '"early ship"': set(), '"early ship"~2': {"docs/a.txt", "docs/b.txt"}, "(ahoy OR sails) AND fn": {"code/ahoy.rs", "code/sails.rs"},
    "filename:ahoy": {"code/ahoy.rs"}, "extension:md": {"GUIDE.md"}, "dir:docs": {"docs/a.txt", "docs/b.txt", "docs/c.bin"}, "size:[14 TO 16]": {"GUIDE.md"},
    "modified:[1970-01-01T00:00:01Z TO 1970-01-01T01:00:02+01:00]": {"code/sails.rs", "GUIDE.md"}, "modified:{1970-01-01T00:00:04Z TO *]": {"docs/c.bin"},
    'modified:"1970-01-01T00:00:03.000000000Z"': {"docs/a.txt"}, "modified:[soon TO *]": set(), "has_content:true": set(), "content:IN [quiet guide]": {"docs/a.txt", "docs/b.txt", "GUIDE.md"}, "ship^2 ahoy": {"docs/a.txt", "docs/b.txt", "code/ahoy.rs"}, "*": set(FILES),
    "`sea::chart`": set(), "ahoy [unclosed": {"code/ahoy.rs"}, "nofield:ahoy": {"code/ahoy.rs"}, "-ship": {"docs/a.txt", "docs/b.txt"}, "   ": set(), "!!!": set(), '"': set(),
}


@pytest.mark.parametrize("q", QUERIES)
def test_grammar(docs, index, q):
    assert set(found(docs, q=q)) == QUERIES[q]
    by_index = search.search(index.docs, SearchParams(q=q), measure=index.measure).collect()
    by_scan = search.search(docs, SearchParams(q=q)).collect()
    if "~" not in q:
        assert [(r["path"], round(r["score"], 9)) for r in by_index] == [(r["path"], round(r["score"], 9)) for r in by_scan]


def test_parse_errors_fall_back():
    for bad in ("(a", "a)", "a AND", "x:y", "^2", "a ]"):
        with pytest.raises(Q.QueryError):
            Q.parse(bad, ("content",))
    assert Q.fallback("A-b [c", ("f",)) == Q.Bool(should=(Q.Leaf("f", ("a",)), Q.Leaf("f", ("b",)), Q.Leaf("f", ("c",))))
    assert Q.fallback("--", ("f",)) == Q.Nothing()


def test_index_reads_its_own_terms(index):
    plan = index.read_postings([Q.Leaf("content", ("ship",))])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,ship)]" in plan


def test_a_ranked_query_reads_nothing_but_postings(index):
    m = index.measure(None, Q.parse("content:quiet filename:guide", ("content",)))
    plan = m.rows._jdf.queryExecution().toString()
    assert "/postings" in plan and "/docs" not in plan and m.keys is not None
    joined = index.measure(None, Q.parse("content:quiet AND size:[1 TO 100]", ("content",)))
    scans = [x for x in joined.rows._jdf.queryExecution().executedPlan().toString().split("\n") if "/docs" in x]
    assert joined.keys is None and scans and all("ReadSchema" in x and "text:string" not in x for x in scans)
