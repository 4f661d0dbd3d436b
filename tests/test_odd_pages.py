"""Queries over pages that the smallest tables do not hold."""

from __future__ import annotations

import base64

import __spark_entry__ as e


def pages(spark, folder, rows):
    spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_base64_of_long_addresses_is_one_line(spark, tmp_path):
    urls = ["https://a.test/" + "x" * n for n in (0, 41, 42, 43, 500)]
    found = e.queries()["base64_images"](spark, pages(spark, tmp_path, [(u, "") for u in urls])).collect()
    assert {r["page_id"]: r["data"] for r in found} == {i: base64.b64encode(u.encode()).decode() for i, u in enumerate(urls)}


def test_cut_references_stay_as_written(spark, tmp_path):
    """A title cut after so many characters can end inside a reference; the page's SQL decodes whole ones only."""
    html = '<html><body><h1>A&amp;B &lt;c&gt; &copy; d&amp</h1><p>&quot x &ampy &notit; &#65; &#65 &x; & <a href="/?a=1&copy=2&amp;b=3">l</a></p><pre>&lt &lt;</pre></body></html>'
    rows = e.queries()["html_to_md"](spark, pages(spark, tmp_path, [("u", html)])).collect()
    assert rows[0]["text"] == "# A&B <c> © d&amp\n\n&quot x &ampy &notit; A &#65 &x; & [l](/?a=1&copy=2&b=3)\n\n```\n&lt <\n```"


def test_outline_of_a_title_cut_inside_a_reference(spark, tmp_path):
    rows = e.queries()["html_outline"](spark, pages(spark, tmp_path, [("u", "<h1>a &amp; b&amp</h1><p>c</p>")])).collect()
    assert [(r["level"], r["text"]) for r in rows] == [(1, "a & b&amp")]
