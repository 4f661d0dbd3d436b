"""Thin façade over the engine: HTTP JSON, and JSON-RPC tools over HTTP or stdio. Standard library only.

`Service` holds the operations; the transports below only decode requests and encode answers.
"""

from __future__ import annotations

import base64
import json
import logging
import os
import sys
import threading
import time
from collections import OrderedDict
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from quern import config
from quern.functions import formats, outline, text
from quern.plans import search
from quern.plans.index import IndexStore
from quern.plans.search import DEFAULT_MCP, SearchParams

#: Protocol versions, routes, and (below) tool names and error codes that clients know.
VERSIONS = ("2026-07-28", "2025-11-25")
ROUTES = ["/", "/search", "/file", "/structure", "/stats", "/mcp"]
LOG_BYTES, CACHE_BYTES = 128, 256 << 20
log = logging.getLogger("quern.serve")


class ApiError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.status = config.STATUS[kind]


def cut_bytes(s: str, n: int) -> str:
    """The longest prefix of at most n UTF-8 bytes."""
    return s.encode("utf-8")[:n].decode("utf-8", "ignore")


def with_dots(s: str, n: int = text.SNIPPET_BYTES) -> str:
    return s if len(s.encode("utf-8")) <= n else cut_bytes(s, n) + "..."


def compact(arguments: object) -> str:
    """Arguments for the log, ` (name=value, ...)`: plain values alone, long strings cut; '' for anything but an object."""
    if not isinstance(arguments, dict):
        return ""
    shown = lambda v: json.dumps(v) if isinstance(v, bool | int | float) else v if len(v.encode("utf-8")) <= LOG_BYTES else cut_bytes(v, LOG_BYTES) + "…"
    return f" ({', '.join(f'{k}={shown(v)}' for k, v in arguments.items() if isinstance(v, bool | int | float | str))})"


class TextCache:
    """Texts by path, the least recently used thrown out beyond a budget of bytes (and one more for each entry)."""

    def __init__(self, budget: int = CACHE_BYTES):
        self.budget, self.weight, self.held, self._lock = budget, 0, OrderedDict(), threading.Lock()

    def get(self, path: str) -> tuple[str, str] | None:
        with self._lock:
            if path in self.held:
                self.held.move_to_end(path)
                return self.held[path][0]
        return None

    def put(self, path: str, value: tuple[str, str]) -> None:
        size = len(value[1].encode("utf-8", "surrogatepass")) + 1
        with self._lock:
            self.weight -= self.held.pop(path, (None, 0))[1]
            if size > self.budget:
                return
            self.held[path] = (value, size)
            self.weight += size
            while self.weight > self.budget:
                self.weight -= self.held.popitem(last=False)[1][1]

    def clear(self) -> None:
        with self._lock:
            self.held.clear()
            self.weight = 0


def _slice(body: str, start: int | None, end: int | None) -> str:
    rows = outline.split_lines(body)
    first = max(start or 1, 1)
    return "\n".join(rows[first - 1 : len(rows) if end is None else max(end, 0)])


@dataclass
class Service:
    """Search and reading over documents (an index, or a frame without one) and the directory they come from."""

    spark: SparkSession
    source: IndexStore | DataFrame
    conf: config.Config
    cache: TextCache = field(default_factory=TextCache)

    @property
    def docs(self) -> DataFrame:
        return self.source.docs if isinstance(self.source, IndexStore) else self.source

    def search(self, p: SearchParams, as_html: bool) -> dict:
        return search.response(self.docs, p, as_html, self.source.measure if isinstance(self.source, IndexStore) else search.scan)

    def load(self, path: str) -> tuple[str, str]:
        """(format, normalised text) of one file: from the cache, or checked, read and converted."""
        real = self._real(path)
        if (held := self.cache.get(real)) is not None:
            return held
        kind = text.FORMATS.get(os.path.splitext(real)[1][1:].lower())
        if kind is None:
            raise ApiError("UnsupportedFormat", f"{path}: unsupported format")
        try:
            made = kind, formats.CONVERTERS[kind](self._bytes(real, path))
        except (ValueError, KeyError, NotImplementedError, OSError) as e:
            raise ApiError("Conversion", f"{path}: {e}") from e
        self.cache.put(real, made)
        return made

    def _real(self, path: str) -> str:
        try:
            real = config.guarded(self.conf.directory, path)
        except config.OutsideDirectory as e:
            raise ApiError("OutsideDirectory", f"{path} is outside of the directory") from e
        except config.NotFound as e:
            raise ApiError("NotFound", f"{path} not found") from e
        if not os.path.isfile(real):
            raise ApiError("NotAFile", f"{path} is not a file")
        return real

    def _bytes(self, real: str, path: str) -> bytes:
        if os.path.getsize(real) > self.conf.max_bytes:
            raise ApiError("TooLarge", f"{path} is too large")
        with open(real, "rb") as f:
            return f.read()

    def structure(self, path: str) -> dict:
        kind, body = self.load(path)
        if kind == "Python":
            found = outline.python_headings(body)
        elif kind == "Rust":
            found = outline.rust_headings(body)
        elif kind == "Text":
            found = []
        else:
            one = self.spark.createDataFrame([(path, body)], "path string, text string")
            found = [r.asDict() for r in outline.markdown_headings(one).drop("path").orderBy("start_line").collect()]
        return {"headers": found, "totalLines": len(outline.split_lines(body))}

    def stats(self) -> dict:
        return {"total_files_indexed": self.source.manifest().docs if isinstance(self.source, IndexStore) else self.docs.count()}

    # --- tools -----------------------------------------------------------------------------------

    def docs_search(self, query: str, max_results: int = DEFAULT_MCP) -> str:
        query = query.strip()
        if not query:
            raise ApiError("Internal", "Search query is empty")
        got = self.search(SearchParams(q=query, max_results=max_results), False)
        if not got["results"]:
            return "No results found."
        rows = []
        for n, r in enumerate(got["results"], 1):
            rows.append(f"{n}. {r['path']} (score: {r['score']:.3f})" + (f"\n   {with_dots(r['snippet'])}" if r["snippet"] else ""))
        return "\n".join(rows)

    def docs_headings(self, path: str) -> str:
        s = self.structure(path)
        rows = [f"{path} ({s['totalLines']} lines)"]
        return "\n".join(rows + [f"{'  ' * (h['level'] - 1)}{h['text']} [L{h['start_line']}-L{h['end_line']}]" for h in s["headers"]])

    def docs_get(self, path: str, start_line: int | None = None, end_line: int | None = None) -> list[dict]:
        """Content blocks: an image inside an archive, an image, or text (a range, or cut after 100 lines)."""
        archive, dot, inner = path.lower().partition(".epub/")
        if dot and inner and not path.startswith("/"):
            outer, inner = path[: len(archive) + 5], path[len(archive) + 6 :]
            try:
                real = self._real(outer)
            except ApiError:
                real = None
            if real:
                return [self._image(inner, formats.read_archive_entry(real, inner, self.conf.max_bytes))]
        real = self._real(path)
        if os.path.splitext(path)[1][1:].lower() in text.MIME:
            return [self._image(path, self._bytes(real, path))]
        body = self.load(path)[1]
        if start_line is not None or end_line is not None:
            body = _slice(body, start_line, end_line)
        else:
            n = len(outline.split_lines(body))
            if n > text.MAX_LINES:
                link = quote(path, safe="/-_.~")
                body = f"[Truncated: showing lines 1-{text.MAX_LINES} of {n}. Continue with /file?path={link}&start_line={text.MAX_LINES + 1}]\n{_slice(body, 1, text.MAX_LINES)}\n[{n} lines in total]"
        return [{"type": "text", "text": f"{path}\n\n{body}"}]

    def _image(self, name: str, data: bytes) -> dict:
        mime = text.MIME.get(os.path.splitext(name)[1][1:].lower())
        if mime is None:
            raise ApiError("UnsupportedFormat", f"{name}: not an image")
        return {"type": "image", "data": base64.b64encode(data).decode("ascii"), "mimeType": mime}


TOOLS = [
    {"name": "docs_search", "description": "Ranked full-text search.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "max_results": {"type": "integer"}}, "required": ["query"]}},
    {"name": "docs_headings", "description": "Headings of a document with line ranges.", "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}}, "required": ["path"]}},
    {"name": "docs_get", "description": "Text of a document, whole or by lines, or an image.", "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}, "start_line": {"type": "integer"}, "end_line": {"type": "integer"}}, "required": ["path"]}},
]


def call_tool(service: Service, name: str, arguments: dict) -> dict:
    try:
        if name == "docs_search":
            content = [{"type": "text", "text": service.docs_search(arguments["query"], int(arguments.get("max_results") or DEFAULT_MCP))}]
        elif name == "docs_headings":
            content = [{"type": "text", "text": service.docs_headings(arguments["path"])}]
        else:
            content = service.docs_get(arguments["path"], arguments.get("start_line"), arguments.get("end_line"))
        return {"content": content, "isError": False}
    except (ApiError, OSError, ValueError) as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}


def _server() -> dict:
    return {"name": "quern", "version": "0.1"}


def json_rpc(service: Service, raw: str | bytes, transport: str = "http") -> dict | None:
    """The reply to one message; None for notifications and responses."""
    fail = lambda id_, code, message: {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
    try:
        m = json.loads(raw)
    except ValueError:
        return fail(None, -32700, "Parse error")
    if not isinstance(m, dict):
        return fail(None, -32600, "Invalid Request")
    if "method" not in m:
        return None if "result" in m or "error" in m else fail(m.get("id"), -32600, "Invalid Request")
    if "id" not in m:
        return None
    method, params = m["method"], m.get("params") or {}
    call = f" {params.get('name', '?')}{compact(params.get('arguments'))}" if method == "tools/call" and isinstance(params, dict) else ""
    log.info("[%s] %s%s", transport, method, call)
    if method == "initialize":
        result = {"protocolVersion": VERSIONS[1], "capabilities": {"tools": {}}, "serverInfo": _server()}
    elif method == "server/discover":
        result = {"protocolVersion": VERSIONS[0], "serverCapabilities": {"tools": {}}, "serverInfo": _server(), "supportedVersions": list(VERSIONS)}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        tool = next((t for t in TOOLS if t["name"] == params.get("name")), None)
        if tool is None:
            return fail(m["id"], -32602, f"Unknown tool: {params.get('name')}")
        arguments = params.get("arguments") or {}
        for need in tool["inputSchema"]["required"]:
            if not isinstance(arguments.get(need), str):
                return fail(m["id"], -32602, f"Missing parameter: {need}")
        result = call_tool(service, tool["name"], arguments)
    else:
        return fail(m["id"], -32601, f"Method not found: {method}")
    return {"jsonrpc": "2.0", "id": m["id"], "result": result}


def stdio(service: Service, source=None, sink=None) -> None:
    """One message a line until the input ends; blank lines and lines that are not UTF-8 are passed over."""
    source, sink = source or sys.stdin.buffer, sink or sys.stdout
    for raw in source:
        try:
            line = raw.decode("utf-8").strip()
        except UnicodeDecodeError:
            continue
        if line and (reply := json_rpc(service, line, "stdio")) is not None:
            try:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
            except BrokenPipeError:
                return


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>Search</title><style>
body { font: 16px/1.5 system-ui, sans-serif; max-width: 60rem; margin: 2rem auto; padding: 0 1rem }
form, fieldset { display: flex; flex-wrap: wrap; gap: .5rem; border: 0; padding: 0 }
input[name=q] { flex: 1 1 20rem } article { margin: 1rem 0 } article a { font-weight: 600 } small { color: #666 } pre { white-space: pre-wrap; background: #f6f6f6; padding: 1rem }
@media (prefers-color-scheme: dark) { body { background: #161616; color: #ddd } a { color: #8ab4f8 } pre { background: #222 } }
</style></head><body>
<form id="ask"><input name="q" placeholder="Words, &quot;a phrase&quot;, field:word, +must -not" autofocus><button>Search</button>
<fieldset><input name="ext" size="6" placeholder="extension"><input name="path" placeholder="path words">
<select name="sort_by"><option>score<option>modified<option>size<option>path</select><select name="sort_order"><option>desc<option>asc</select>
<label><input type="checkbox" name="names_only"> names only</label></fieldset></form>
<p id="facts"></p><main id="found"></main><aside id="shown"></aside>
<script>
const at = id => document.getElementById(id), make = (tag, text) => Object.assign(document.createElement(tag), { textContent: text });
async function ask(event) {
  event?.preventDefault();
  const form = new FormData(at("ask")), asked = new URLSearchParams();
  for (const [name, value] of form) if (value && name !== "names_only") asked.set(name, value);
  if (form.get("names_only")) asked.set("search_content", "false");
  const reply = await fetch("/search?" + asked), body = await reply.json();
  at("found").replaceChildren(); at("shown").replaceChildren();
  if (!reply.ok) return void (at("facts").textContent = body.error);
  at("facts").textContent = `${body.total} found in ${body.search_time_ms} ms`;
  for (const r of body.results) {
    const row = make("article", ""), link = Object.assign(make("a", r.path), { href: "#", onclick: e => (e.preventDefault(), show(r.path)) }), snippet = make("div", "");
    snippet.innerHTML = r.snippet;  // escaped by the server, but for its marks
    row.append(link, make("small", `  ${r.size} bytes, ${r.modified}, ${r.score.toFixed(3)}`), snippet);
    at("found").append(row);
  }
}
async function show(path) {
  const query = "path=" + encodeURIComponent(path), [text, outline] = await Promise.all([fetch("/file?" + query), fetch("/structure?" + query)]);
  const heads = outline.ok ? (await outline.json()).headers : [], list = make("ul", "");
  for (const h of heads) list.append(Object.assign(make("li", `${h.text} (${h.start_line}-${h.end_line})`), { style: `margin-left:${h.level}rem` }));
  at("shown").replaceChildren(make("h2", path), list, make("pre", await text.text()));
  at("shown").scrollIntoView();
}
at("ask").addEventListener("submit", ask);
fetch("/stats").then(r => r.json()).then(s => at("facts").textContent = `${s.total_files_indexed} files indexed`);
</script></body></html>"""


def params_of(query: dict[str, list[str]]) -> SearchParams:
    """Search parameters of a query string; values that can't be used fall back to the defaults."""
    one = lambda k, d=None: query[k][-1] if k in query else d
    number = one("max_results", "")
    return SearchParams(
        q=one("q", ""), search_content=one("search_content", "true").lower() != "false", ext=one("ext"), path=one("path"),
        max_results=int(number) if number.lstrip("-").isdigit() else search.DEFAULT_HTTP,
        sort_by=one("sort_by", "score"), sort_order=one("sort_order", "desc"),
    )


def respond(service: Service, target: str) -> tuple[int, str, str]:
    """(status, content type, body) of a GET."""
    at = urlsplit(target)
    query = parse_qs(at.query, keep_blank_values=True)
    as_json = lambda status, x: (status, "application/json", json.dumps(x, ensure_ascii=False, default=str))
    try:
        if at.path == "/":
            return 200, "text/html; charset=utf-8", PAGE
        if at.path == "/search":
            return as_json(200, service.search(params_of(query), True))
        if at.path == "/file":
            kind, body = service.load(query.get("path", [""])[-1])
            return 200, f"text/{'plain' if kind in ('Text', 'Python', 'Rust') else 'markdown'}; charset=utf-8", body
        if at.path == "/structure":
            return as_json(200, service.structure(query.get("path", [""])[-1]))
        if at.path == "/stats":
            return as_json(200, service.stats())
        if at.path == "/mcp":
            return 200, "text/event-stream", ""
    except ApiError as e:
        return as_json(e.status, {"error": str(e)})
    except Exception as e:  # a failed search is an answer, too
        return as_json(500, {"error": str(e)})
    return as_json(404, {"error": "not found", "endpoints": ROUTES})


def http_server(service: Service, bind: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: str) -> None:
            data = body.encode("utf-8")
            self.send_response(status)
            for k, v in (("Content-Type", kind), ("Content-Length", str(len(data))), ("X-Content-Type-Options", "nosniff"), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            began = time.monotonic()
            reply = respond(service, self.path)
            log.info("GET %s %d %d ms", cut_bytes(self.path, LOG_BYTES), reply[0], 1000 * (time.monotonic() - began))
            self._send(*reply)

        def do_POST(self):  # noqa: N802
            if urlsplit(self.path).path != "/mcp":
                self._send(*respond(service, self.path))
                return
            reply = json_rpc(service, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self._send(*((202, "application/json", "") if reply is None else (200, "application/json", json.dumps(reply, ensure_ascii=False))))

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((bind, port), Handler)
