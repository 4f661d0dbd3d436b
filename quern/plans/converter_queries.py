"""Converters and outlines as queries: inputs are made from the driver's tables, whole texts of all rows, and SQL says what must come out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import formats, outline, text
from quern.plans.queries import _DOCS, _LINES, corpus, query, table

MAX_BYTES = 50_000_000
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(x: Column) -> Column:
    """The ASCII letters and digits of a line, lower-cased, as words; 'x' if there are none."""
    return F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)), " "), F.lit("")), F.lit("x"))


_WORDS = "coalesce(nullif(array_to_string(regexp_extract_all(lower(l), '[a-z0-9]+'), ' '), ''), 'x')"


def made_of_lines(spark, sf_dir: str, make: Callable[[Column, Column], Column], glue: str = "\n") -> DataFrame:
    """path and text: make(words of a line, its number from 0) of all lines of each document."""
    rows = F.transform(text.lines(F.col("text")), lambda x, i: make(_words(x), i))
    return corpus(spark, sf_dir).select("path", F.array_join(rows, glue).alias("text"))


def _made_sql(expression: str, glue: str = "chr(10)") -> str:
    """CTEs docs, rows (path, total, n, w) and made (path, body): expression over w and i = n - 1, glued."""
    return rf"""{_DOCS}, raw as (select path, {_LINES} as ls from docs), rows as (
  select path, total, n, n - 1 as i, {_WORDS} as w from (select path, len(ls) as total, generate_subscripts(ls, 1) as n, unnest(ls) as l from raw)
), made as (
  select d.path, coalesce(string_agg({expression}, {glue} order by n), '') as body from docs d left join rows r on r.path = d.path group by d.path
)"""


def converted(docs: DataFrame, kind: str, content: Column) -> DataFrame:
    return docs.select("path", formats.normalised_text(content, F.lit(kind), MAX_BYTES).alias("text"))


# --- plain text and HTML -----------------------------------------------------------------------------


@query("text_load", f"with {_DOCS} select path, text from docs")
def text_load(spark, sf_dir):
    return converted(corpus(spark, sf_dir), "Text", F.encode("text", "UTF-8"))


_HTML = r"""flat as (
  select page_id, regexp_replace(regexp_replace(html, '<!DOCTYPE[^>]*>|<head>.*?</head>|<!--.*?-->', '', 'gs'), '\s+', ' ', 'g') as h from pages
), marked as (
  select page_id, regexp_replace(h, '<li><a href="([^"]*)">(.*?)</a></li>', chr(10) || '- [\2](\1)', 'g') as h from flat
), blocks as (
  select page_id, replace(replace(replace(regexp_replace(regexp_replace(h, '</?(html|body|nav|ul|div|article|p|footer)\b[^>]*>|</h1>', chr(10) || chr(10), 'g'), '<h1>', chr(10) || chr(10) || '# '), '<b>', '**'), '</b>', '**'), '<br>', chr(10)) as h from marked
), trimmed as (
  select page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, ' +\n', chr(10), 'g'), '\n +', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as h from blocks
), converted as (
  select page_id, replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as text from trimmed
)"""


@query("html_to_md", f"with {_HTML} select page_id, text from converted")
def html_to_md(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", formats.normalised_text(F.encode("html", "UTF-8"), F.lit("Html"), MAX_BYTES).alias("text"))


def _outline_sql(ctes: str, source: str, key: str) -> str:
    """Headings of the Markdown in (key, text)."""
    lines = _LINES.replace("text", "t")
    return rf"""with {ctes}, split as (select {key}, {lines} as ls from (select {key}, text as t from {source})), lined as (
  select {key}, len(ls) as total, generate_subscripts(ls, 1) as n, trim(unnest(ls), {_BLANK}) as x from split
), fenced as (
  select *, x like '```%' as fence, sum((x like '```%')::int) over (partition by {key} order by n) % 2 as open, len(regexp_extract(x, '^#*')) as hashes from lined
), heads as (
  select {key}, total, n, least(hashes, 6) as level, trim(substr(x, least(hashes, 6) + 1), {_BLANK}) as text from fenced where not fence and open = 0 and hashes > 0
)
select {key}, level::int as level, text, n::int as start_line, coalesce(lead(n) over (partition by {key} order by n) - 1, total)::int as end_line from heads where text <> ''"""


@query("html_outline", _outline_sql(_HTML, "converted", "page_id"))
def html_outline(spark, sf_dir):
    return outline.markdown_headings(html_to_md(spark, sf_dir), key="page_id")


@query("html_charsets", "select page_id, case when page_id % 4 = 3 then regexp_replace(html, '[^\x01-\x7f]', '?', 'g') else html end as text from pages")
def html_charsets(spark, sf_dir):
    """Pages in four encodings: UTF-8, UTF-16 either way by its mark, and ASCII that names another."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: formats.decode_html(bytes(b)))

    mark = lambda h, kind: F.concat(F.unhex(F.lit(h)), F.encode("html", kind))
    raw = F.when(F.col("page_id") % 4 == 0, F.encode("html", "UTF-8")).when(F.col("page_id") % 4 == 1, mark("FFFE", "UTF-16LE")).when(F.col("page_id") % 4 == 2, mark("FEFF", "UTF-16BE"))
    plain = F.encode(F.regexp_replace("html", "[^\\x01-\\x7f]", "?"), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", decoded(raw.when(F.col("page_id") % 4 == 3, plain)).alias("text"))


# --- reStructuredText, EPUB, PDF -----------------------------------------------------------------------


def _by_turn(i: Column, kinds: list[Column]) -> Column:
    out = kinds[-1]
    for k, c in reversed(list(enumerate(kinds[:-1]))):
        out = F.when(i % len(kinds) == k, c).otherwise(out)
    return out


_RST_MD = r"""case i % 7 when 0 then '# ' || w when 1 then '- ' || w when 2 then '```text' || chr(10) || w || chr(10) || '```' when 3 then '> **Note:**' || chr(10) || '> ' || w
  when 4 then '[' || w || '](https://x.test/' || i || ')' when 5 then '## ' || w || chr(10) || chr(10) || '`' || w || '`' else '> ' || w end"""


@query("rst_to_md", f"with {_made_sql(_RST_MD, 'chr(10) || chr(10)')} select path, case when body = '' then '' else body || chr(10) end as text from made")
def rst_to_md(spark, sf_dir):
    """Every line of every document as a title, list item, code, note, link, subtitle with literal, or quote."""
    lit = F.lit

    def make(w: Column, i: Column) -> Column:
        rule = lambda c: F.repeat(lit(c), F.length(w))
        return _by_turn(i, [
            F.concat(w, lit("\n"), rule("=")), F.concat(lit("* "), w), F.concat(lit(".. code-block:: text\n\n    "), w), F.concat(lit(".. note::\n\n    "), w),
            F.concat(lit("`"), w, lit(" <https://x.test/"), i.cast("string"), lit(">`_")), F.concat(w, lit("\n"), rule("-"), lit("\n\n``"), w, lit("``")), F.concat(lit("    "), w),
        ])

    made = made_of_lines(spark, sf_dir, make, "\n\n")
    return converted(made, "Rst", F.encode("text", "UTF-8"))


@query("rst_outline", _outline_sql(_made_sql(_RST_MD, "chr(10) || chr(10)") + ", converted as (select path, case when body = '' then '' else body || chr(10) end as text from made)", "converted", "path"))
def rst_outline(spark, sf_dir):
    return outline.markdown_headings(rst_to_md(spark, sf_dir))


def _book(title: str, body: str) -> bytes:
    """A small EPUB: a chapter for every line, listed last to first in the manifest, plus what is no chapter."""
    rows = body.split("\n") if body else []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="in/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="part%20{i}.xhtml#top" media-type="application/xhtml+xml"/>' for i in reversed(range(len(rows))))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(rows)))
        z.writestr("in/b.opf", f'<package><metadata><dc:title>{title} &amp; more</dc:title></metadata><manifest><item id="p" href="p.png" media-type="image/png"/>{items}</manifest><spine><itemref idref="p"/><itemref idref="none"/>{spine}</spine></package>')
        for i, row in enumerate(rows):
            z.writestr(f"in/part {i}.xhtml", f"<html><head><title>no</title></head><body><h2>Part {i}</h2><p>{row}</p></body></html>")
    return out.getvalue()


_EPUB_MD = "'## Part ' || i || chr(10) || chr(10) || w || chr(10)"


@query("epub_to_md", f"with {_made_sql(_EPUB_MD)} select m.path, '# ' || d.filename || ' & more' || chr(10) || case when body = '' then '' else chr(10) || body end as text from made m join docs d on d.path = m.path")
def epub_to_md(spark, sf_dir):
    @F.pandas_udf("binary")
    def book(title: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([_book(t, b) for t, b in zip(title, body)])

    made = made_of_lines(spark, sf_dir, lambda w, i: w)
    return converted(made, "Epub", book(F.element_at(F.split("path", "/"), -1), "text"))


_PDF_MD = "case i % 10 when 0 then case i when 0 then '' else chr(10) end || '# P' || i || chr(10) || chr(10) else '' end || w || ' and on'"


@query("pdf_to_md", f"with {_made_sql(_PDF_MD)} select path, case when body = '' then '' else body || chr(10) end as text from made")
def pdf_to_md(spark, sf_dir):
    """A page for each document, with a heading in a larger type before every tenth line."""
    line = lambda size, w: F.concat(F.lit(f"/F {size} Tf 0 -12 Td ("), w, F.lit(") Tj\n"))
    heading = lambda i: F.when(i % 10 == 0, line(18, F.concat(F.lit("P"), i.cast("string")))).otherwise("")
    made = made_of_lines(spark, sf_dir, lambda w, i: F.concat(heading(i), line(9, F.concat(w, F.lit(" and on")))))
    body = F.concat(F.lit("BT\n"), F.col("text"), F.lit("\nET"))
    page = "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F << /Type /Font >> >> >> >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length "
    whole = F.concat(F.lit("%PDF-1.4\n" + page), F.octet_length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream\nendobj\ntrailer << /Root 1 0 R >>\n%%EOF"))
    return converted(made, "Pdf", F.encode(whole, "UTF-8"))


# --- code ----------------------------------------------------------------------------------------------


def _heads(found: DataFrame) -> DataFrame:
    return found.select("path", F.explode("headings").alias("h")).select("path", "h.level", "h.text", "h.start_line", "h.end_line")


_RANGE = "n::int as start_line, coalesce(lead(n) over (partition by path order by n) - 1, total)::int as end_line"


@query("py_outline", f"""with {_made_sql('w')} select path, case when i % 2 = 0 then i % 3 + 1 when i % 3 = 2 then 3 else 2 end::int as level, replace(w, ' ', '_') as text, {_RANGE} from rows""")
def py_outline(spark, sf_dir):
    """Classes and functions in turn, one, two and three deep."""
    made = made_of_lines(spark, sf_dir, lambda w, i: F.concat(F.repeat(F.lit("    "), (i % 3).cast("int")), F.when(i % 2 == 0, F.lit("class ")).otherwise(F.lit("async def ")), F.replace(w, F.lit(" "), F.lit("_")), F.lit("(x):")))
    return _heads(made.select("path", outline.python_outline("text").alias("headings")))


@query("rust_outline", f"""with {_made_sql('w')} select path, case i % 6 when 0 then 1 when 1 then 2 else 3 end::int as level,
  case i % 6 when 1 then 'impl ' || replace(w, ' ', '_') || ' {{' else replace(w, ' ', '_') end as text, {_RANGE} from rows where i % 6 < 3""")
def rust_outline(spark, sf_dir):
    """A module, in it an impl, in it a function with braces in a string and a comment; then all are closed."""

    def make(w: Column, i: Column) -> Column:
        name = F.replace(w, F.lit(" "), F.lit("_"))
        return _by_turn(i, [
            F.concat(F.lit("pub mod "), name, F.lit(" {")), F.concat(F.lit("  impl "), name, F.lit(" {")), F.concat(F.lit("    pub(crate) fn "), name, F.lit('() -> u8 { let s = "}{{"; // }}')),
            F.concat(F.lit("    } // fn "), name, F.lit(" {")), F.concat(F.lit("  /* struct "), name, F.lit(" { */ }")), F.lit("}"),
        ])

    return _heads(made_of_lines(spark, sf_dir, make).select("path", outline.rust_outline("text").alias("headings")))
