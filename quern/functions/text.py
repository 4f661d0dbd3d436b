"""Text and path functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recognised formats by extension.
FORMATS = {"txt": "Text", "md": "Markdown", "rs": "Rust", "py": "Python", "htm": "Html", "html": "Html", "pdf": "Pdf", "epub": "Epub", "rst": "Rst", "rest": "Rst"}
#: Image types by extension.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "ico": "image/x-icon", "svg": "image/svg+xml",
}
TOKEN_BYTES, SNIPPET_BYTES, MAX_LINES = 40, 200, 100
_BLANKS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def bound(x: Column, use) -> Column:
    """use(x) with x computed once per row, however often use names it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def lines(text: Column) -> Column:
    """Lines end at \\n or \\r\\n; no empty line after a final end; '' has none; another \\r is kept."""
    # An empty last part follows a final line end, or is all of an empty text.
    return bound(F.split(text, "\r?\n", -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(text), "[^\\p{IsAlphabetic}\\p{N}]+"), lambda x: (x != "") & (F.octet_length(x) <= TOKEN_BYTES))


def utf8_truncate(text: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    # A cut inside a character leaves up to three bytes that decode to U+FFFD; shorter cuts are tried instead.
    cut = lambda k: F.substring(F.encode(text, "UTF-8"), 1, max(k, 0))
    whole = lambda k: F.try_validate_utf8(cut(k).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(whole(n), whole(n - 1), whole(n - 2), whole(n - 3)))


def ellipsis(text: Column, n: int = SNIPPET_BYTES) -> Column:
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(utf8_truncate(text, n), F.lit("...")))


def url_component(text: Column) -> Column:
    """Percent-encodes all bytes but letters, digits and - _ . ~ /"""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def line_slice(text: Column, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """Lines start to end, from 1 and inclusive; start below 1 counts as 1, end defaults to the last."""
    col = lambda v, d: F.lit(d) if v is None else (v if isinstance(v, Column) else F.lit(v))
    first = F.greatest(col(start, 1), F.lit(1))

    def cut(all_lines: Column) -> Column:
        last = F.least(F.size(all_lines) if end is None else col(end, 0), F.size(all_lines))
        return F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")

    return bound(lines(text), cut)


def auto_truncate(path: Column, text: Column, limit: int = MAX_LINES) -> Column:
    """Texts of more than `limit` lines: a banner, the first lines, and how to read on."""

    def cut(rows: Column) -> Column:
        head = F.format_string(f"[Truncated: showing lines 1-{limit} of %d. Continue with /file?path=%s&start_line={limit + 1}]\n", F.size(rows), url_component(path))
        return F.when(F.size(rows) > limit, F.concat(head, F.array_join(F.slice(rows, 1, limit), "\n"), F.format_string("\n[%d lines in total]", F.size(rows)))).otherwise(text)

    return bound(lines(text), cut)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANKS}+|{_BLANKS}+$", ""), f"{_BLANKS}+", " ")


def base64_line(data: Column) -> Column:
    """Base64 in one line: F.base64 ends a line after 76 characters (spark.sql.chunkBase64String.enabled is true by default)."""
    return F.translate(F.base64(data), "\r\n", "")


def xml_unescape(text: Column) -> Column:
    """The five predefined entities, in one pass: what one replacement makes is not read again."""
    # Split before each ampersand, so every piece holds one entity at most.
    parts = F.split(text, "(?=&)", -1)
    out = parts
    fixed = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

    def one(x: Column) -> Column:
        found = x
        for entity, c in reversed(list(fixed.items())):
            found = F.when(x.startswith(entity), F.concat(F.lit(c), F.substr(x, F.lit(len(entity) + 1)))).otherwise(found)
        return found

    return F.array_join(F.transform(out, one), "")


def _lookup(key: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    made = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(made, key), out)


def extension(path: Column) -> Column:
    """Lower-cased text after the file name's last dot; '' if there is none, or only a leading one."""
    return F.lower(F.regexp_extract(filename(path), "^.+\\.([^.]*)$", 1))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "^$", "")


def file_format(path: Column) -> Column:
    return _lookup(extension(path), FORMATS)


def should_index(path: Column, allow: list[str] | None = None) -> Column:
    """Allowed extension, or a recognised format if the list is empty; no extension: never."""
    ext = extension(path)
    known = normalise_extensions(allow or []) or list(FORMATS)
    return (ext != "") & ext.isin(known)


def normalise_extensions(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for x in values if (v := x.strip().lstrip(".").lower())))


def normalised_extensions(values: Column) -> Column:
    bare = F.transform(values, lambda x: F.lower(F.regexp_replace(F.trim(x), "^\\.+", "")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def hidden_component(path: Column) -> Column:
    """Whether a parent component starts with a dot; the last component does not count."""
    return path.rlike("(^|/)\\.[^/]*/")


def hidden_name(path: Column) -> Column:
    return filename(path).startswith(".")


def mime_type(path: Column) -> Column:
    return _lookup(extension(path), MIME)


def content_type(path: Column) -> Column:
    """text/markdown for what is converted to Markdown, text/plain for plain text and code."""
    return F.when(file_format(path).isin("Text", "Python", "Rust"), "text/plain; charset=utf-8").when(file_format(path).isNotNull(), "text/markdown; charset=utf-8")


def virtual_archive(path: Column) -> Column:
    """struct(archive, inner) of `book.epub/inner/file`, leftmost archive; null for other or absolute paths."""
    pattern = "(?i)^((?:[^/]+/)*?[^/]*\\.epub)/+(.+)$"
    return F.when(path.rlike(pattern) & ~path.startswith("/"), F.struct(F.regexp_extract(path, pattern, 1).alias("archive"), F.regexp_extract(path, pattern, 2).alias("inner")))


def rfc3339(ts: Column) -> Column:
    """Whole seconds in UTC (the session's time zone must be UTC)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def result_text(rank: Column, path: Column, score: Column, snippet: Column) -> Column:
    head = F.format_string("%d. %s (score: %.3f)", rank, path, score)
    return F.when(F.coalesce(snippet, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n   "), ellipsis(snippet)))


def outline_text(path: Column, total_lines: Column, headings: Column) -> Column:
    """`path (n lines)`, then a heading a line, indented by level, with its line range."""
    rows = F.transform(headings, lambda h: F.concat(F.repeat(F.lit("  "), F.greatest(h["level"] - 1, F.lit(0))), h["text"], F.format_string(" [L%d-L%d]", h["start_line"], h["end_line"])))
    return F.concat_ws("\n", F.array(F.format_string("%s (%d lines)", path, total_lines)), rows)
