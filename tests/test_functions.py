"""Text functions, outlines and converters on small inputs."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import formats, outline, text


def column(spark, values, *exprs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string").select("i", *exprs).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in rows]


LINES = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb\r": ["a", "b\r"], "\n": [""], "a\n\nb\n\n": ["a", "", "b", ""], "a\r\r\nb": ["a\r", "b"]}


def test_lines(spark):
    assert column(spark, LINES, text.lines(F.col("x"))) == list(LINES.values())
    assert [outline.split_lines(x) for x in LINES] == list(LINES.values())


def test_lines_of_any_text(spark):
    made = ["".join(p) for p in __import__("itertools").product("a\n\r", repeat=4)]
    assert column(spark, made, text.lines(F.col("x"))) == [outline.split_lines(x) for x in made]


def test_truncation(spark):
    for s in ("seven seas", "naïve façade", "漢字かな", "\U0001f422x\U0001f422", "Ωμέγα", ""):
        for n in range(0, 14):
            (got,) = column(spark, [s], text.utf8_truncate(F.col("x"), n))
            assert got == s.encode()[:n].decode("utf-8", "ignore"), (s, n)


def test_line_slice(spark):
    x = "a\nb\nc"
    slices = [(None, None, "a\nb\nc"), (0, 2, "a\nb"), (2, 2, "b"), (3, 2, ""), (2, 99, "b\nc"), (9, None, "")]
    for a, b, want in slices:
        assert column(spark, [x], text.line_slice(F.col("x"), a, b)) == [want]


def test_tokens(spark):
    assert column(spark, ["Ahoy; ÉTÉ_7 " + "z" * 41, ""], text.tokens(F.col("x"))) == [["ahoy", "été", "7"], []]


def test_paths(spark):
    p = F.col("x")
    hidden = {".cache/a": True, "lib/.old/part.py": True, "lib/part.py": False, ".profile": False, "a.b/c": False}
    assert column(spark, hidden, text.hidden_component(p)) == list(hidden.values())
    exts = {"a/B.Md": "md", ".env": "", "README": "", "x.tar.gz": "gz", ".n.txt": "txt", "a.": ""}
    assert column(spark, exts, text.extension(p)) == list(exts.values())
    kinds = {"a.rs": "Rust", "b.HTM": "Html", "c.rest": "Rst", "d.ts": None, "e": None}
    assert column(spark, kinds, text.file_format(p)) == list(kinds.values())
    assert column(spark, ["Map.GIF", "scan.TiFf", "tool.py", "bare"], text.should_index(p, ["gif", ".TIFF", "py"])) == [True, True, True, False]
    parts = {"atlas.epub/plates/7.gif": ("atlas.epub", "plates/7.gif"), "shelf/two.EPUB/m.svg": ("shelf/two.EPUB", "m.svg"), "/y.epub/n": None, "y.epub": None, "y.epub/": None, "y.md/n": None}
    assert [tuple(v) if v else None for v in column(spark, parts, text.virtual_archive(p))] == list(parts.values())
    assert text.normalise_extensions([" .MD", "md", "", "..rs"]) == ["md", "rs"]


def test_small_functions(spark):
    x = F.col("x")
    assert column(spark, ["&lt;a&gt; &amp;lt; &quot;&apos; & x"], text.xml_unescape(x)) == ["<a> &lt; \"' & x"]
    assert column(spark, [" a \u00a0\t b\n"], text.collapse_blanks(x)) == ["a b"]
    assert column(spark, ["a b/ü~*+.md"], text.url_component(x)) == ["a%20b/%C3%BC~%2A%2B.md"]
    long = "\n".join(f"l{i}" for i in range(1, 102))
    got = column(spark, [long, "short"], text.auto_truncate(F.lit("p q.md"), x))
    assert got[1] == "short" and got[0].splitlines()[1] == "l1" and "l101" not in got[0] and "101" in got[0] and "p%20q.md" in got[0]


MARKDOWN = "# Harbour\n\nquay\n\n## Tides\n\nlow\n\n### Neap\n\nmoon\n\n## Pilots\n\nrope\n"


def test_markdown_outline(spark):
    docs = spark.createDataFrame([("a", MARKDOWN), ("b", "```\n# no\n```\n#yes\n#######x\n#\n"), ("c", ""), ("d", None)], "path string, text string")
    for found in (outline.markdown_headings, outline.markdown_headings_windowed):
        rows = [tuple(r) for r in found(docs).orderBy("path", "start_line").collect()]
        assert rows == [
            ("a", 1, "Harbour", 1, 4), ("a", 2, "Tides", 5, 8), ("a", 3, "Neap", 9, 12), ("a", 2, "Pilots", 13, 15),
            ("b", 1, "yes", 4, 4), ("b", 6, "#x", 5, 6),
        ]


def plain_headings(body):
    """The rule said plainly: fences toggle, headings outside of them run to the next one."""
    fenced, found, rows = False, [], outline.split_lines(body)
    for n, row in enumerate(rows, 1):
        row = row.strip()
        if row.startswith("```"):
            fenced = not fenced
        elif not fenced and row.startswith("#"):
            level = min(len(row) - len(row.lstrip("#")), 6)
            if row[level:].strip():
                found.append((level, row[level:].strip(), n))
    return [(*f, g[2] - 1 if g else len(rows)) for f, g in zip(found, [*found[1:], None])]


def test_markdown_outline_of_any_lines(spark):
    rng = random.Random(1)
    rows = ["# one", "##two", "  ### three  ", "```", "```py", "plain", "", "#", "####### deep", "\t#tab", "text # no\r"]
    bodies = ["\n".join(rng.choices(rows, k=rng.randrange(15))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "path long, text string")
    got = {}
    for r in outline.markdown_headings(docs).orderBy("path", "start_line").collect():
        got.setdefault(r["path"], []).append(tuple(r)[1:])
    assert got == {k: v for k, v in enumerate(map(plain_headings, bodies)) if v}


def names(found):
    return [(h["text"], h["level"]) for h in found]


@pytest.mark.parametrize("source, want", [
    ("class Ship:\n    flag = 1\n    def sail(self, knots):\n        return knots\n", [("Ship", 1), ("sail", 2)]),
    ("async def load(crate):\n    def weigh(): return 2\n    weigh()\n", [("load", 2), ("weigh", 3)]),
    ("x = 1  # class No:\nclass Crew(Base, key=3): # def no():\n\tdef hire(self): ...\n", [("Crew", 1), ("hire", 2)]),
    ("class Fleet:\n    class Flag:\n        async  def raise_(self):\n            def knot(): pass\n", [("Fleet", 1), ("Flag", 2), ("raise_", 2), ("knot", 3)]),
    ("if True:\n    def late(): pass\ndef soon(): pass\n", [("late", 2), ("soon", 2)]),
    ("classes = []\ndefine(1)\n", []),
])
def test_python_outline(source, want):
    assert names(outline.python_headings(source)) == want


@pytest.mark.parametrize("source, want", [
    ("pub fn dock(at: u8) -> u8 {\n    at\n}\nfn sail() {}\n", [("dock", 2), ("sail", 2)]),
    ("pub trait Vessel {\n    fn draught(&self) -> f64;\n}\nimpl Vessel for Tug {\n    fn draught(&self) -> f64 {\n        fn deep() -> f64 { 2.0 }\n        deep()\n    }\n}\n",
     [("Vessel", 2), ("draught", 3), ("impl Vessel for Tug {", 2), ("draught", 3), ("deep", 4)]),
    ("mod charts\n{\n    pub(super) struct Map;\n    impl Map\n    {\n        pub const fn new() -> Self { Map }\n    }\n}\nfn outside() {}\n",
     [("charts", 1), ("Map;", 2), ("impl Map", 2), ("new", 3), ("outside", 2)]),
    ('fn quoted() {\n    let brace = "}}}";\n    // fn no() {\n    /* fn neither() {\n       } */\n}\nfn next() {}\n', [("quoted", 2), ("next", 2)]),
    ("unsafe extern \"C\" fn call() {}\npub async fn wait() {}\n", [("call", 2), ("wait", 2)]),
    ("static N: u8 = 4;\ntype Alias = u8;\nuse std::fmt;\n", []),
])
def test_rust_outline(source, want):
    assert names(outline.rust_headings(source)) == want


#: Parts of a line of code, and what each opens less what it closes.
PARTS = {
    "{ ": 1, "} ": -1, '"}{{" ': 0, "'{' ": 0, "'\\'' ": 0, "'\\u{7d}' ": 0, '"\\"}" ': 0, "/* }} */ ": 0, "&'sea str ": 0, "'pump: loop { ": 1, "x = y / 2; ": 0, "'\\\\' ": 0, "'ö' ": 0,
}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(sorted(PARTS)), max_size=8), st.sampled_from(["", "// }}{", "// 'quote"]))
def test_braces(parts, end):
    assert outline.brace_delta("".join(parts) + end) == sum(PARTS[p] for p in parts)


def test_braces_of_odd_lines():
    assert outline.brace_delta("a */ {", in_comment=True) == 1 and outline.brace_delta("{ never closed", in_comment=True) == 0
    assert outline.brace_delta('open "{ to the end') == 0 and outline.brace_delta("&'é {") == 0


RST = """Voyages
~~~~~~~

The *log* of ``barque_7`` is kept by `its clerk <https://ships.test/clerk>`__.

=======
Harbour
=======

- ropes
* tar
    + oakum

3) hoist
#. lower

.. code-block:: rust
   :linenos:

   fn main() {
       go();
   }

.. warning:: ignored

   Low |water| at :doc:`quay <quay-page>`.

.. image:: sail.png
.. remark that nobody
   gets to read

Stores
~~~~~~

Note_ the ship_shape word.

   A saying
   of sailors.

Type:
    make sail

....

.. _clerk: https://ships.test
Last line"""
MD = """# Voyages

The *log* of `barque_7` is kept by [its clerk](https://ships.test/clerk).

## Harbour

- ropes
- tar
    - oakum

3. hoist
1. lower

```rust
fn main() {
    go();
}
```

> **Warning:**
> Low water at quay.


# Stores

Note the ship_shape word.

> A saying
> of sailors.

Type:
```
make sail
```



Last line
"""


def test_rst():
    assert formats.rst_markdown(RST) == MD
    assert formats.rst_markdown("") == "" and formats.rst_markdown("Look <mailto:a@b.test>\r\nhere\r\n") == "[Look](mailto:a@b.test)\nhere\n"


@settings(max_examples=60, deadline=None)
@given(st.text("ab-=.*`:_|<>\\ \n\t", max_size=60))
def test_converters_take_anything(x):
    formats.rst_markdown(x)
    formats.html_markdown("<p>" + x)
    outline.rust_headings(x)


@pytest.mark.parametrize("raw, want", [
    ("Žluťoučký kůň".encode(), "Žluťoučký kůň"),
    (b"<meta charset=windows-1250>" + "Žluťoučký kůň".encode("cp1250"), "Žluťoučký kůň"),
    (b"<META content='text/html;charset=KOI8-R'>" + "Привет".encode("koi8-r"), "Привет"),
    (b"<meta charset='latin1'>" + "déjà “vu”".encode("cp1252"), "déjà “vu”"),
    (b"\xfe\xff" + "Ελλάδα".encode("utf-16-be"), "Ελλάδα"),
    (b"<meta charset=no-such-set>" + "naïve".encode("cp1252"), "naïve"),
    (b" " * 1024 + b"<meta charset=koi8-r>" + b"\xe9", "é"),
    (b"\x8d\xfc", "\x8dü"),
])
def test_html_charsets(raw, want):
    assert formats.decode_html(raw).endswith(want)


def test_html_markdown():
    md = formats.html_markdown("<head><title>no</title><style>p{}</style></head><h1>Fish &amp; chips</h1><p>a <b>b</b> <a href='x'>c</a><script>gone()</script><ul><li>one<li>two</ul><pre>x\n  y</pre>")
    assert "# Fish & chips" in md and "**b**" in md and "[c](x)" in md and "- one\n- two" in md and "```\nx\n  y\n```" in md
    assert not any(w in md for w in ("gone", "p{}", "title", "strong"))


def book(**entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


CONTAINER = '<container><rootfiles><rootfile full-path="pkg/book.opf" media-type="x"/></rootfiles></container>'
OPF = """<package xmlns:dc="d"><metadata><dc:title>Winds &amp; Waves</dc:title></metadata><manifest>
<item id="am" href="dawn.xhtml" media-type="application/xhtml+xml"/><item id="pm" href="in/dusk%20b.html#x" media-type="text/html"/>
<item id="i" href="plates/sun.png" media-type="image/png"/></manifest><spine><itemref idref="pm"/><itemref idref="i"/><itemref idref="none"/><itemref idref="am"/></spine></package>"""


def test_epub(tmp_path):
    raw = book(**{"META-INF__container_dot_xml": CONTAINER, "pkg__book_dot_opf": OPF, "pkg__dawn_dot_xhtml": "<h2>One</h2>", "pkg__in__dusk b_dot_html": "<h2>Two</h2>", "pkg__plates__sun_dot_png": b"png", "a__plates__b_dot_png": b"1", "b__plates__b_dot_png": b"2"})
    md = formats.epub_markdown(raw)
    assert md.startswith("# Winds & Waves\n") and md.index("Two") < md.index("One")
    with pytest.raises(ValueError):
        formats.epub_markdown(book(**{"META-INF__container_dot_xml": CONTAINER, "pkg__book_dot_opf": "<package/>"}))
    path = tmp_path / "b.epub"
    path.write_bytes(raw)
    assert formats.read_archive_entry(str(path), "plates/sun.png#fig", 100) == b"png"
    for inner, error in (("plates/none.png", FileNotFoundError), ("plates/b.png", ValueError)):
        with pytest.raises(error):
            formats.read_archive_entry(str(path), inner, 100)
    with pytest.raises(ValueError):
        formats.read_archive_entry(str(path), "plates/sun.png", 2)
