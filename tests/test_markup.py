"""Tokens of markup: quotes, raw elements, missing end tags, and time that grows with the page."""

import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import extract, markup

ODD = """<html lang="de"><head><title>A <b>x</b></title><meta name="description" content="a > b"><meta name=viewport content=""><link rel="nofollow canonical" href='/c>d'></head>
<body><script>var a="<a href=/no>x</a>"</script><!-- <a href=/no2>z</a> --><h1 data-x='1>0'>Hi<br>there</h1><p>one two three four five<p>six<div>not p</div><ul><li><a href=/1 title="a>b">One<li><a title='x href="/bad"' href="/2">Two</li></ul>after <a href="/3"><img alt="pic > 1" src=i.png></a>
<svg><text>hidden</text></svg> shown &amp; <a href="tel:+1 2">call</a> a < b <img alt> <textarea>ta</textarea><a href="../z#q" rel="x nofollow">Z"""


def pages(spark, *sources):
    return spark.createDataFrame([(f"http://h.example/a/b{i}", s) for i, s in enumerate(sources)], "url string, html string")


def test_odd_markup(spark):
    f = extract.features(pages(spark, ODD)).first()
    assert (f.language, f.titles, f.descriptions, f.has_viewport, f.canonicals) == ("de", ["A x"], ["a > b"], True, ["http://h.example/c>d"])
    assert (f.h1, f.paragraph_count, f.first_paragraph, f.resources) == (["Hithere"], 2, "one two three four five", ["http://h.example/a/i.png"])
    assert (f.image_count, f.images_missing_alt, f.images_empty_alt, f.phone_links) == (2, 0, 1, ["+1 2"])
    assert "hidden" not in f.tokens and "shown" in f.tokens and "no" not in f.tokens


def test_links_without_an_end(spark):
    got = [(r.target, r.text, r.nofollow) for r in extract.anchors(pages(spark, ODD)).orderBy("pos").collect()]
    assert got == [("http://h.example/1", "One", False), ("http://h.example/2", "Two", False), ("http://h.example/3", "pic > 1", False), ("http://h.example/z", "Z", True)]
    whole = "<a href=/x><div>Card</div> more</a> rest"
    assert extract.anchors(pages(spark, whole)).first().text == "Card more"


def test_attributes(spark):
    tag = """<a one=1 TWO = "2 > '" three='3 "' four &amp;=x five="&lt;&#65;" six=a=b/c two=again>"""
    df = spark.createDataFrame([(tag,)], "tag string").select(markup.attributes(F.col("tag")).alias("a"))
    names = ["one", "two", "three", "four", "five", "six", "none"]
    assert list(df.select(*[markup.value(F.col("a"), n).alias(n) for n in names]).first()) == ["1", "2 > '", '3 "', "", "<A", "a=b/c", ""]
    assert list(df.select(markup.has(F.col("a"), "four"), markup.has(F.col("a"), "none")).first()) == [True, False]


def test_meta_and_null_pages(spark):
    told = "<meta name=author content=First><meta name=author content=Last><meta name=robots content=a><meta name=robots content=b><meta property=og:updated_time content=2024>"
    rows = extract.features(pages(spark, told, None, "", "plain text", "x" * (extract.PAGE_BYTES + 1))).orderBy("url").collect()
    assert (rows[0].meta_author, rows[0].robots, rows[0].modified) == ("Last", "b", "2024")
    assert [r.word_count for r in rows] == [0, 0, 0, 2, 0] and rows[1].titles == [] and rows[1].language == ""


HOSTILE = ["<a href=/x>y", "<", "<a ", '<a b="', "<!-- ", "<script>", "<svg>", "<p>w ", "</", "&#", "<a b='"]


@pytest.mark.parametrize("piece", [*HOSTILE, "attributes"])
def test_time_grows_with_the_page(spark, piece):
    """A megabyte of one piece; what were quadratic would take minutes."""
    source = "<a " + "x='1' " * 150_000 + ">" if piece == "attributes" else piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    extract.features(pages(spark, source)).select("word_count", "h1", "paragraph_count", "resources").collect()
    extract.anchors(pages(spark, source)).count()
    assert time.perf_counter() - began < 30
