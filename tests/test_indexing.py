"""Files to documents, differences, changes, streams, configuration, and the façade."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import shutil
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from quern import config, serve
from quern.app import App
from quern.operators import snapshot
from quern.plans.index import IndexStore
from quern.plans.search import SearchParams
from quern.schema import CHANGES, OS_EVENTS
from quern.sources import fileindex
from quern.streaming import changes, live


@pytest.fixture()
def tree(tmp_path):
    files = {
        "greeting.txt": "Good morning, harbour!\nBooks are in the library", "GUIDE.md": "# Guide\n\n## Rules\n\ntext\n", ".env.txt": "secret", ".git/config.txt": "no", "src/.env.local.txt": "deep",
        "src/main.rs": "fn main() {}\n", "src/app.py": "class A:\n    pass\n", "page.html": "<h1>Big</h1><p>text <b>bold</b></p>", "doc.pdf": "x", "notes.rst": "T\n=\n\nbody\n",
        "image.PNG": "png", "noext": "x", "_under.txt": "u", "long.txt": "\n".join(f"line {i}" for i in range(1, 151)), "odd.xyz": "?",
    }
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    os.symlink(tmp_path / "greeting.txt", tmp_path / "link.txt")
    os.utime(tmp_path / "greeting.txt", ns=(1, 1_700_000_000_123_456_789))
    return tmp_path


WANT = {"greeting.txt", "GUIDE.md", ".env.txt", "src/.env.local.txt", "src/main.rs", "src/app.py", "page.html", "doc.pdf", "notes.rst", "_under.txt", "long.txt"}


def test_files(spark, tree):
    rows = {r["path"]: r for r in fileindex.read_files(spark, str(tree)).collect()}
    assert set(rows) == WANT
    assert rows["greeting.txt"]["modified_ns"] == 1_700_000_000_123_456_789 and rows["src/main.rs"]["dir"] == "src" and rows["GUIDE.md"]["extension"] == "md"
    assert {r["path"] for r in fileindex.read_files(spark, str(tree), ["PNG", ".rs"]).collect()} == {"image.PNG", "src/main.rs"}
    image = fileindex.images(fileindex.read_files(spark, str(tree), ["png"], content=True), 100).first()
    assert (image["mime"], image["data"]) == ("image/png", "cG5n")
    with pytest.raises(Exception):
        fileindex.read_files(spark, str(tree / "missing")).count()


def test_documents(spark, tree):
    rows = {r["path"]: r for r in fileindex.read_documents(spark, str(tree), max_bytes=500).collect()}
    assert rows["page.html"]["text"].startswith("# Big") and rows["notes.rst"]["text"] == "# T\n\nbody\n"
    assert not rows["doc.pdf"]["has_content"] and not rows["long.txt"]["has_content"] and rows["long.txt"]["size"] > 500


def test_differences(spark):
    disk = spark.createDataFrame([("a", 2), ("b", 1), ("c", 5), ("n", None)], "path string, modified_ns long")
    index = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), ("x", 1), ("y", 1), ("n", 3)], "path string, modified_ns long")
    assert {r["path"] for r in snapshot.new_or_modified(disk, index).collect()} == {"b", "c", "n"}
    assert {r["path"] for r in snapshot.deleted(index, disk).collect()} == {"x", "y"}
    assert {r["path"] for r in snapshot.deleted(index, disk, index.where("path = 'y'")).collect()} == {"x"}
    assert snapshot.scan_counts(disk, index).first().asDict() == {"processed": 4, "changed": 3, "deleted": 2}
    assert snapshot.unverifiable(index).first()["sample"] == "a"


T0 = dt.datetime(2024, 1, 1)


def change(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), k, p) for i, (s, k, p) in enumerate(rows)], CHANGES)


def test_apply_in_order(spark):
    docs = spark.createDataFrame([(p, 0) for p in ("a/x", "a/y", "ab/z", "keep", "gone")], "path string, v int")
    fresh = spark.createDataFrame([(p, 1) for p in ("a/x", "a/y", "new", "back")], "path string, v int")
    batch = change(spark, [(0, "Modified", "a/x"), (0, "DeletedDir", "a"), (0, "Modified", "a/y"), (0, "Modified", "new"), (0, "Deleted", "gone"), (0, "Deleted", "back"), (0, "Modified", "back"), (0, "Modified", "lost")])
    got = {(r["path"], r["v"]) for r in snapshot.apply_changes(docs, batch, fresh).collect()}
    assert got == {("a/y", 1), ("ab/z", 0), ("keep", 0), ("new", 1), ("back", 1)}


def events(spark, rows):
    return spark.createDataFrame([(i, T0, e, p, d, r) for i, (e, p, d, r) in enumerate(rows)], OS_EVENTS)


EVENTS = [
    (("Create", ["f"], False, False), [("Modified", "f")]), (("Create", ["d", "d/a", "d/b"], True, False), [("Modified", "d/a"), ("Modified", "d/b")]),
    (("Modify", ["f"], False, False), [("Modified", "f")]), (("Modify", ["d"], True, False), []), (("RemoveFolder", ["d"], True, False), [("DeletedDir", "d")]),
    (("RemoveOther", ["d"], False, False), [("DeletedDir", "d")]), (("RemoveFile", ["f"], False, False), [("Deleted", "f")]),
    (("RenameBoth", ["a", "b"], False, False), [("Deleted", "a"), ("DeletedDir", "a"), ("Modified", "b")]),
    (("RenameBoth", ["a", "b", "c"], False, False), [("Deleted", "a"), ("DeletedDir", "a"), ("Modified", "b"), ("Modified", "c")]),
    (("RenameBoth", ["a"], False, False), [("Modified", "a")]), (("RenameFrom", ["a"], False, False), [("Deleted", "a"), ("DeletedDir", "a")]),
    (("RenameTo", ["b"], False, False), [("Modified", "b")]), (("Access", ["f"], False, False), []), (("Other", ["f"], False, True), [("Rescan", None)]),
]


def test_event_map(spark):
    rows = changes.event_changes(events(spark, [e for e, _ in EVENTS])).orderBy("seq", "part").collect()
    for i, (event, want) in enumerate(EVENTS):
        assert [(r["kind"], r["path"]) for r in rows if r["seq"] == i] == want, event


def test_debounce(spark):
    rows = change(spark, [(0, "Modified", "a"), (0.5, "Modified", "a"), (1.4, "Modified", "a"), (2.4, "Modified", "a"), (0, "Modified", "b"), (1, "Deleted", "a"), (0, "Modified", ".h/x")])
    got = sorted((r["path"], r["merged"]) for r in changes.debounced(changes.visible(rows)).collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]
    assert [r["kind"] for r in changes.immediate(rows).collect()] == ["Deleted"]


def texts(df):
    return sorted((r["path"], r["text"]) for r in df.select("path", "text").collect())


def rebuilt(spark, tree, tmp):
    """The index made anew from the files as they are."""
    return IndexStore.build(fileindex.read_documents(spark, str(tree)), f"file://{tmp}/rebuilt")


def same_index(a, b):
    """Documents, postings, lengths and counts alike."""
    rows = lambda s, t: sorted(map(str, s.live(t).select(*sorted(s.live(t).columns)).collect()))
    m, n = a.manifest(), b.manifest()
    return all(rows(a, t) == rows(b, t) for t in ("docs", "postings", "lengths")) and (m.docs, m.lengths) == (n.docs, n.lengths)


def test_listing_by_tasks(spark, tree):
    got = {r["path"]: (r["size"], r["modified_ns"]) for r in fileindex.list_tree(spark, str(tree)).collect()}
    assert got == {r["path"]: (r["size"], r["modified_ns"]) for r in fileindex.read_files(spark, str(tree)).collect()} and set(got) == WANT
    assert {r["path"] for r in fileindex.list_tree(spark, str(tree), ["rs"], dirs_per_task=1).collect()} == {"src/main.rs"}
    with pytest.raises(Exception):
        fileindex.list_tree(spark, str(tree / "missing")).count()


def test_reading_given_paths(spark, tree):
    paths = spark.createDataFrame([(p,) for p in ("greeting.txt", "greeting.txt", "gone.txt", "src", "odd.xyz", "link.txt", "src/main.rs", "greeting.txt/x.txt")], "path string")
    whole = {r["path"]: r for r in fileindex.read_documents(spark, str(tree)).collect()}
    got = fileindex.read_paths(paths, str(tree)).collect()
    assert [whole[r["path"]] for r in got] == got and {r["path"] for r in got} == {"greeting.txt", "src/main.rs"}


def test_events_of_a_tree(spark, tree, tmp_path_factory):
    """What a watcher would say, poll by poll, and again when a batch is read again."""
    source = fileindex._Events({"path": str(tree), "statedir": str(tmp_path_factory.mktemp("seen")), "from": "now"})
    at = source.initialOffset()
    assert list(source.read(at)[0]) == [] and source.read(at)[1] == at
    (tree / "greeting.txt").write_text("changed")
    (tree / "GUIDE.md").unlink()
    os.rename(tree / "notes.rst", tree / "src/renamed.rst")
    (tree / "fresh/deep").mkdir(parents=True)
    (tree / "fresh/a.md").write_text("a")
    (tree / "fresh/deep/b.md").write_text("b")
    (tree / "lone.txt").write_text("x")
    rows, end = source.read(at)
    got = [r[2:] for r in rows]
    assert got == [
        ("RenameBoth", ["notes.rst", "src/renamed.rst"], False, False), ("RemoveFile", ["GUIDE.md"], False, False),
        ("Create", ["fresh", "fresh/a.md", "fresh/deep/b.md"], True, False), ("Create", ["lone.txt"], False, False), ("Modify", ["greeting.txt"], False, False),
    ]
    assert [r[2:] for r in source.readBetweenOffsets(at, end)] == got
    shutil.rmtree(tree / "fresh")
    os.rename(tree / "src", tree / "code")
    rows, last = source.read(end)
    assert [r[2:4] for r in rows][:2] == [("RemoveFolder", ["fresh"]), ("RemoveFolder", ["src"])]
    source.commit(last)
    assert [r[2:] for r in source.readBetweenOffsets(at, end)] == [("Other", [], False, True)]
    os.rename(tree, str(tree) + "-away")
    assert [r[2:] for r in source.read(last)[0]] == [("Other", [], False, True)]
    os.rename(str(tree) + "-away", tree)


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_debouncer_waits_for_quiet():
    clock = Clock()
    d = live.Debouncer(1.0, clock)
    d.add("a")
    d.add("b")
    clock.now = 0.75
    d.add("a")
    assert d.due() == []
    clock.now = 1.0
    assert d.due() == ["b"]
    d.add("c")
    d.drop("c")
    clock.now = 1.75
    assert d.due() == ["a"] and d.flush() == []
    d.add("x")
    assert d.flush() == ["x"]


@pytest.fixture()
def indexer(spark, tree, tmp_path_factory):
    clock = Clock()
    out = tmp_path_factory.mktemp("index")
    made = live.Indexer(
        IndexStore(spark, f"file://{out}/i"), lambda p: fileindex.read_paths(p, str(tree)), lambda: fileindex.list_tree(spark, str(tree)), clock=clock, capacity=6, batch_size=6,
    )
    made.rescan()
    return made


def feed(spark, indexer, *rows):
    indexer.feed(spark.createDataFrame([(i, 0, k, p) for i, (k, p) in enumerate(rows)], "seq long, part int, kind string, path string"))


def test_a_batch_costs_what_it_changes(spark, tree, indexer, tmp_path_factory):
    """Only touched paths are read and written; docs, postings and counts equal a rebuild."""
    assert indexer.rescan() == {"processed": len(WANT), "changed": 0, "deleted": 0}
    read = []
    before = indexer.read_paths
    indexer.read_paths = lambda p: (read.extend(r[0] for r in p.collect()), before(p))[1]
    (tree / "greeting.txt").write_text("changed words")
    (tree / "src/main.rs").unlink()
    feed(spark, indexer, ("Modified", "greeting.txt"), ("Deleted", "src/main.rs"))
    assert indexer.store.manifest().number == 1, "it is not time yet"
    indexer.clock.now = 1.5
    indexer.tick()
    assert read == ["greeting.txt"] and indexer.store.manifest().segments[-1][1] == 1
    assert same_index(indexer.store, rebuilt(spark, tree, tmp_path_factory.mktemp("r")))
    shutil.rmtree(tree / "src")
    feed(spark, indexer, ("DeletedDir", "src"))
    indexer.flush()
    assert same_index(indexer.store, rebuilt(spark, tree, tmp_path_factory.mktemp("r")))
    number = indexer.store.manifest().number
    feed(spark, indexer, ("Deleted", "never.there"))
    indexer.flush()
    assert indexer.store.manifest().number == number, "nothing to commit"


def test_a_full_buffer_is_committed_and_a_flood_does_not_wait(spark, tree, indexer):
    for i in range(3):
        (tree / f"n{i}.md").write_text(f"new {i}")
    feed(spark, indexer, *[("Modified", f"n{i}.md") for i in range(3)])
    indexer.clock.now = 1.0
    indexer.batch_ms = 10**9
    indexer.tick()  # three modified paths are six items
    assert indexer.buffer == [] and {r["path"] for r in indexer.store.docs.collect()} >= {"n0.md", "n1.md", "n2.md"}
    for i in range(9):
        (tree / f"m{i}.md").write_text(f"more {i}")
    feed(spark, indexer, ("Modified", "n0.md"))
    feed(spark, indexer, *[("Modified", f"m{i}.md") for i in range(9)])
    assert {r["path"] for r in indexer.store.docs.collect()} >= {f"m{i}.md" for i in range(9)} and not indexer.debouncer.waiting


def test_a_commit_is_tried_twice_then_dropped(spark, tree, indexer):
    calls = []

    def fails(changes, fresh):
        calls.append(1)
        raise OSError

    indexer.store.apply = fails
    feed(spark, indexer, ("Deleted", "greeting.txt"), ("Deleted", "GUIDE.md"))
    indexer.flush()
    assert len(calls) == 2 and indexer.dropped == 2
    del indexer.store.apply
    indexer.rescan()
    assert indexer.store.manifest().docs == len(WANT)


def test_rescan_compares_all(spark, tree, indexer, tmp_path_factory):
    (tree / "notes.rst").unlink()
    (tree / "more.md").write_text("# new")
    feed(spark, indexer, ("Rescan", None))
    assert same_index(indexer.store, rebuilt(spark, tree, tmp_path_factory.mktemp("r")))


def test_segments_are_merged_and_old_files_go(spark, tree, tmp_path):
    docs = fileindex.read_documents(spark, str(tree)).cache()
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.add(docs.where("path = 'greeting.txt'"))
    names = sorted(WANT - {"greeting.txt"})
    for i, p in enumerate(names[:8]):
        rows = change(spark, [(0, "Modified", p), (0, "Deleted", names[i - 1] if i % 3 == 2 else "none")])
        store.apply(rows, docs.where(F.col("path") == p))
    gone = {names[i - 1] for i in range(8) if i % 3 == 2}
    m = store.manifest()
    assert len(m.segments) < 8 and m.docs == 9 - len(gone)
    assert same_index(store, IndexStore.build(docs.where(F.col("path").isin(["greeting.txt", *(set(names[:8]) - gone)])), f"file://{tmp_path}/r"))
    assert len(store.versions()) == 2
    (tmp_path / "i" / "seg-00000099").mkdir()  # a write that never was committed
    assert store.manifest().number == m.number
    docs.unpersist()


def test_stream_and_server_follow_the_directory(spark, tree, tmp_path_factory):
    """The whole program: events, debouncing, commits, cache and searches, until it is closed."""
    conf = config.load(None, directory=str(tree), index_path=f"{tmp_path_factory.mktemp('app')}/index/i", batch_timeout_ms=100)
    conf.port = 0
    app = App(spark, conf, quiet=0.3)
    app.start()
    base = f"http://127.0.0.1:{app.server.server_port}"
    get = lambda q: json.load(urllib.request.urlopen(base + q))

    def until(check, seconds=60):
        end = time.monotonic() + seconds
        while not check():
            assert time.monotonic() < end
            time.sleep(0.2)

    try:
        until(lambda: app.scanned.is_set() and get("/stats")["total_files_indexed"] == len(WANT))
        assert [r["path"] for r in get("/search?q=library")["results"]] == ["greeting.txt"]
        urllib.request.urlopen(f"{base}/file?path=greeting.txt").read()
        assert app.service.cache.weight
        (tree / "greeting.txt").write_text("nothing here")
        (tree / "later").mkdir()
        (tree / "later/x.md").write_text("about a library")
        (tree / "src/main.rs").unlink()
        until(lambda: [r["path"] for r in get("/search?q=library")["results"]] == ["later/x.md"])
        until(lambda: get("/search?q=main.rs&search_content=false")["total"] == 0)
        assert app.service.cache.get(os.path.realpath(tree / "greeting.txt")) is None
        app.indexer.debouncer.quiet = 1000  # what waits is committed at the end all the same
        (tree / "last.md").write_text("the very end")
        until(lambda: "last.md" in app.indexer.debouncer.waiting)
    finally:
        app.close()
    assert same_index(app.store, rebuilt(spark, tree, tmp_path_factory.mktemp("r")))


def test_supervisor():
    waits, fails = [], iter([1, 1, 0])

    def run():
        if next(fails):
            raise RuntimeError

    assert changes.supervise(run, sleep=waits.append) == 3 and sum(waits) == 15
    waits.clear()
    assert changes.supervise(lambda: 1 / 0, sleep=waits.append) == 7 and sum(waits) == 5 + 10 + 20 + 40 + 80 + 160
    assert changes.supervise(lambda: 1 / 0, stopped=lambda: True) == 0


def test_config(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text(f'directory = "{tmp_path}"\nport = 9\nextensions = [".MD", "md", "rs"]\n')
    c = config.load(str(file), port=10)
    assert (c.port, c.extensions, c.max_bytes, c.batch_size) == (10, ["md", "rs"], 20_000_000, 500) and c.index_path == f"{tmp_path}/.quern/index"
    file.write_text("unknown = 1\n")
    assert config.load(str(file), directory=str(tmp_path)).port == 8080
    for bad in ({}, {"directory": str(tmp_path / "x")}, {"directory": str(tmp_path), "batch_size": 0}):
        with pytest.raises(config.ConfigError):
            config.load(None, **bad)


def test_path_guard(tree):
    assert config.guarded(str(tree), "src/main.rs") == os.path.realpath(tree / "src/main.rs")
    os.symlink("/etc", tree / "etc")
    for p, error in (("", config.NotFound), ("nope", config.NotFound), ("../x", config.OutsideDirectory), ("/etc/passwd", config.OutsideDirectory), ("etc/passwd", config.OutsideDirectory)):
        with pytest.raises(error):
            config.guarded(str(tree), p)


@pytest.fixture()
def service(spark, tree):
    return serve.Service(spark, fileindex.read_documents(spark, str(tree)).cache(), config.load(None, directory=str(tree)))


@pytest.fixture()
def by_index(spark, tree, tmp_path_factory):
    return serve.Service(spark, rebuilt(spark, tree, tmp_path_factory.mktemp("s")), config.load(None, directory=str(tree)))


def test_service_by_index(service, by_index):
    for q in ("q=library", "q=text&sort_by=size&sort_order=asc", "ext=md", "q=line&path=long", "q=nothing", ""):
        one, two = (json.loads(serve.respond(s, f"/search?{q}")[2]) for s in (service, by_index))
        assert one["total"] == two["total"] and one["results"] == two["results"]
    assert serve.respond(by_index, "/stats") == serve.respond(service, "/stats")


def test_text_cache():
    c = serve.TextCache(20)
    c.put("a", ("Text", "x" * 9))
    c.put("b", ("Text", "é" * 4))
    assert c.get("a") and c.weight == 19
    c.put("c", ("Text", ""))  # an empty text counts, too
    assert c.weight == 20 and c.get("b")
    c.put("d", ("Text", ""))
    assert c.get("a") is None and c.get("b") and c.get("c")
    c.put("big", ("Text", "x" * 20))
    assert c.get("big") is None and c.get("d")
    c.put("b", ("Text", "z"))
    assert c.weight == 2 + 1 + 1
    c.clear()
    assert c.weight == 0 and c.get("b") is None


def test_cached_texts_and_request_log(service, tree, caplog):
    assert service.load("greeting.txt") == service.load("greeting.txt")
    (tree / "greeting.txt").write_text("other")
    assert service.load("greeting.txt")[1].startswith("Good")
    service.cache.clear()
    assert service.load("greeting.txt")[1] == "other"
    with caplog.at_level("INFO", "quern.serve"):
        serve.json_rpc(service, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "docs_get", "arguments": {"path": "é" * 100, "start_line": 3, "x": [1], "all": True}}}))
    assert caplog.messages == [f"[http] tools/call docs_get (path={'é' * 64}…, start_line=3, all=true)"]
    assert serve.compact(None) == "" and serve.compact({}) == " ()"


def test_http(service):
    get = lambda target: serve.respond(service, target)
    status, kind, body = get("/search?q=library&max_results=bogus")
    assert status == 200 and kind == "application/json" and json.loads(body)["results"][0]["snippet"].endswith("<mark>library</mark>")
    assert get("/file?path=page.html")[1].startswith("text/markdown") and get("/file?path=src/app.py")[1].startswith("text/plain")
    assert json.loads(get("/structure?path=GUIDE.md")[2]) == {"headers": [{"level": 1, "text": "Guide", "start_line": 1, "end_line": 2}, {"level": 2, "text": "Rules", "start_line": 3, "end_line": 5}], "totalLines": 5}
    assert json.loads(get("/stats")[2]) == {"total_files_indexed": len(WANT)}
    for target, want in (("/file?path=x.txt", 404), ("/file?path=../x", 403), ("/file?path=src", 400), ("/file?path=odd.xyz", 415), ("/file?path=doc.pdf", 500), ("/none", 404)):
        assert get(target)[0] == want
    service.conf.max_file_size_mb = 0
    assert get("/file?path=greeting.txt")[0] == 413


def test_tools(service):
    call = lambda name, **a: serve.call_tool(service, name, a)
    assert call("docs_search", query="  ") == {"content": [{"type": "text", "text": "Search query is empty"}], "isError": True}
    assert call("docs_search", query="library")["content"][0]["text"].startswith("1. greeting.txt (score: ")
    assert call("docs_headings", path="GUIDE.md")["content"][0]["text"] == "GUIDE.md (5 lines)\nGuide [L1-L2]\n  Rules [L3-L5]"
    assert call("docs_get", path="long.txt", start_line=2, end_line=3)["content"][0]["text"] == "long.txt\n\nline 2\nline 3"
    assert "150 lines" in call("docs_get", path="long.txt")["content"][0]["text"] and "line 101\n" not in call("docs_get", path="long.txt")["content"][0]["text"]
    assert call("docs_get", path="image.PNG")["content"][0] == {"type": "image", "data": "cG5n", "mimeType": "image/png"}
    assert call("docs_get", path="../x")["isError"]


def test_json_rpc(service):
    rpc = lambda **m: serve.json_rpc(service, json.dumps({"jsonrpc": "2.0", **m}))
    assert serve.json_rpc(service, "{")["error"]["code"] == -32700 and serve.json_rpc(service, "[1]")["error"]["code"] == -32600
    assert rpc(method="tools/list", id=None)["id"] is None and rpc(method="tools/list") is None and rpc(id=1, result={}) is None
    assert rpc(method="nope", id=1)["error"]["code"] == -32601 and rpc(id=1)["error"]["code"] == -32600
    assert rpc(method="tools/call", id=1, params={"name": "docs_get"})["error"]["code"] == -32602
    old, new = rpc(method="initialize", id=1)["result"], rpc(method="server/discover", id=1)["result"]
    assert old["serverInfo"] == new["serverInfo"] == {"name": "quern", "version": "0.1"} and old["capabilities"] == new["serverCapabilities"] == {"tools": {}}
    assert old["protocolVersion"] in new["supportedVersions"] and new["protocolVersion"] == new["supportedVersions"][0]
    out = io.StringIO()
    serve.stdio(service, io.BytesIO(b'\n\xff\xfe\n{"jsonrpc":"2.0","id":5,"method":"tools/list"}\n'), out)
    assert json.loads(out.getvalue())["id"] == 5


def test_server(service):
    server = serve.http_server(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(f"{base}/file?path=greeting.txt") as r:
        assert r.read().startswith(b"Good") and r.headers["X-Content-Type-Options"] == "nosniff"
    request = urllib.request.Request(f"{base}/mcp", b'{"jsonrpc":"2.0","method":"x"}')
    with urllib.request.urlopen(request) as r:
        assert r.status == 202
    server.shutdown()


def test_byte_cuts():
    assert [serve.cut_bytes("aé😀", n) for n in range(8)] == ["", "a", "a", "aé", "aé", "aé", "aé", "aé😀"]
    assert serve.with_dots("x" * 201) == "x" * 200 + "..." and SearchParams().limit == 50
    assert F is not None


def corpus_of(spark, n, text):
    docs = spark.range(n).select(F.format_string("d/%05d.txt", "id").alias("path"), F.format_string("%05d.txt", "id").alias("filename"), F.lit("d").alias("dir"), text.alias("text"))
    return docs.select("*", F.lit(1).cast("long").alias("size"), F.timestamp_seconds(F.lit(0)).alias("modified"), F.lit(0).cast("long").alias("modified_ns"), F.lit("txt").alias("extension"), F.lit(True).alias("has_content"))


def test_sorted_partitions_follow_the_index(spark, tmp_path):
    """Twice the text takes more partitions, whatever the session's settings: no sort grows with the index."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000)), lambda k: F.concat(F.lit("w"), (k * 7 + F.col("id")).cast("string"))), " ")
    files = {}
    for n in (2_000, 6_000):
        IndexStore.build(corpus_of(spark, n, words), f"{tmp_path}/{n}")
        files[n] = {t: len(list((tmp_path / str(n)).glob(f"seg-*/{t}/*.parquet"))) for t in ("docs", "postings/field=content")}
    assert files[6_000]["postings/field=content"] >= 5 and files[6_000]["postings/field=content"] > files[2_000]["postings/field=content"]


def test_removals_shuffle_no_text(spark, tmp_path, monkeypatch):
    """A batch that adds nothing, or little, does not send the texts that it could take from."""
    docs = corpus_of(spark, 2_000, F.repeat(F.sha2(F.col("id").cast("string"), 512), 20))
    docs.write.parquet(f"{tmp_path}/docs")
    fresh = spark.read.parquet(f"{tmp_path}/docs")
    store = IndexStore.build(docs.where("path < 'd/00010'"), f"{tmp_path}/i")
    plans, write = [], IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, d, removed: (plans.append(d._jdf.queryExecution().executedPlan().toString()), write(self, d, removed))[1])
    schema = "seq long, kind string, path string"
    changed = [(1, "Deleted", "d/00001.txt"), (2, "Modified", "d/00002.txt"), (3, "Deleted", "d/00002.txt"), (4, "Modified", "d/00500.txt")]
    for k, rows in enumerate((changed[:3], changed[3:])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/changes-{k}")
        store.apply(spark.read.parquet(f"{tmp_path}/changes-{k}"), fresh)
    assert "Scan parquet" not in plans[0] and "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]
    assert sorted(r[0] for r in store.docs.select("path").collect()) == [f"d/{i:05d}.txt" for i in [0, *range(3, 10), 500]]
