"""Columns of a page from the tokens of its markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, has_token, is_booking, tokenize
from ..functions.urls import crawl_url, host_key, is_followed, resolve
from .markup import BLOCKS, TOKEN, attributes, decoded, elements, has, inside, let, marked, shown_text, spans, value
from .structured import with_structured

#: Largest page that is read.
PAGE_BYTES = 5 << 20
#: Elements with attributes that are read.
READ = ("html", "meta", "link", "img", "script", "source", "iframe", "video", "audio", "a")


def stripped(source) -> Column:
    """Text of markup: each tag parts words."""
    return clean_text(decoded(F.regexp_replace(source, TOKEN, " ")))


def _nonempty(c) -> Column:
    return F.filter(c, lambda x: x != "")


def _first(c) -> Column:
    return F.coalesce(F.try_element_at(_nonempty(c), F.lit(1)), F.lit(""))


def _last(c) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(""))


def _named(*names: str) -> Column:
    return F.filter("__els", lambda x: x["name"].isin(*names))


def _metas(key: str, *names: str) -> Column:
    """Contents of meta elements with one of these names, in their order."""
    wanted = F.filter(_named("meta"), lambda x: F.lower(F.trim(value(x["attributes"], key))).isin(*names))
    return F.transform(wanted, lambda x: clean_text(value(x["attributes"], "content")))


#: Facts that come from elements' attributes.
FROM_ELEMENTS = ("language", "descriptions", "description", "robots", "meta_author", "published", "modified", "has_viewport", "canonicals", "hreflang", "resources", "image_count", "images_missing_alt", "images_empty_alt", "phone_links")


def features(pages: DataFrame, *wanted: str) -> DataFrame:
    """pages (url, html, more if wanted) with one column per extracted fact, all of them or those of the given names; null html and one of more than PAGE_BYTES, which the crawl refuses, count as empty.

    References of canonicals, hreflang and resources are resolved against url. Of descriptions and titles the first that says something counts, of
    robots, authors and dates the last. metadata holds what structured data, times and author marks say, apart from meta elements."""

    def asked(*names):
        return not wanted or any(n in wanted for n in names)

    rows = marked(pages, F.coalesce(F.when(F.octet_length("html") <= PAGE_BYTES, F.col("html")), F.lit("")))
    if asked("metadata"):
        rows = with_structured(rows)
    if asked(*FROM_ELEMENTS):
        rows = rows.withColumn("__els", elements(*READ))
    if asked("tokens", "word_count", "content_hash"):
        rows = rows.withColumn("__t", F.lower(shown_text()))
    if asked("paragraph_count", "longest_paragraph", "first_paragraph"):
        rows = rows.withColumn("__paragraphs", F.transform(spans("p", ends=BLOCKS), inside))
        rows = rows.withColumn("__paragraphs", F.filter(F.transform("__paragraphs", lambda x: F.struct(x.alias("text"), F.size(tokenize(x)).alias("words"))), lambda x: x["words"] > 0))
    if asked("h1", "h2", "heading_levels"):
        rows = rows.withColumn("__headings", F.transform(spans("h1", "h2", "h3", "h4", "h5", "h6"), lambda x: F.struct(x["name"].alias("name"), inside(x).alias("text"))))
    url = F.col("url")

    def headed(name):
        return _nonempty(F.transform(F.filter("__headings", lambda x: x["name"] == name), lambda x: x["text"]))

    def linked(*rels):
        return F.filter(_named("link"), lambda x: F.arrays_overlap(F.split(F.lower(F.trim(value(x["attributes"], "rel"))), r"\s+"), F.array(*[F.lit(r) for r in rels])))

    def fetched():
        return F.filter("__els", lambda x: x["name"].isin("img", "script", "source", "iframe", "video", "audio") | ((x["name"] == "link") & F.arrays_overlap(F.split(F.lower(F.trim(value(x["attributes"], "rel"))), r"\s+"), F.array(*[F.lit(r) for r in ("stylesheet", "preload", "modulepreload")]))))

    def sources():
        return F.transform(F.transform(fetched(), lambda x: F.when(x["name"] == "link", value(x["attributes"], "href")).otherwise(value(x["attributes"], "src"))), lambda x: resolve(url, x))

    def hreflang():
        named = F.transform(linked("alternate"), lambda x: F.struct(F.lower(value(x["attributes"], "hreflang")).alias("language"), value(x["attributes"], "href").alias("href")))
        return F.transform(F.filter(named, lambda x: x["language"] != ""), lambda x: F.struct(x["language"].alias("language"), resolve(url, x["href"]).alias("url")))

    def images():
        return _named("img")

    def phones():
        return F.transform(F.filter(_named("a"), lambda x: F.lower(F.trim(value(x["attributes"], "href"))).startswith("tel:")), lambda x: F.trim(F.regexp_replace(F.trim(value(x["attributes"], "href")), "(?i)^tel:", "")))

    facts = {
        "language": lambda: F.trim(_last(F.transform(_named("html"), lambda x: value(x["attributes"], "lang")))),
        "titles": lambda: F.transform(spans("title"), inside),
        "h1": lambda: headed("h1"),
        "h2": lambda: headed("h2"),
        "heading_levels": lambda: F.transform("__headings", lambda x: F.substring(x["name"], 2, 1).cast("int")),
        "descriptions": lambda: _metas("name", "description"),
        "robots": lambda: _last(_metas("name", "robots")),
        "meta_author": lambda: _last(_metas("name", "author")),
        "published": lambda: _last(_metas("property", "article:published_time", "og:published_time")),
        "modified": lambda: _last(_metas("property", "article:modified_time", "og:updated_time")),
        "has_viewport": lambda: F.size(_metas("name", "viewport")) > 0,
        "has_main": lambda: F.array_contains("__names", "main"),
        "has_article": lambda: F.array_contains("__names", "article"),
        "canonicals": lambda: F.array_distinct(_nonempty(F.transform(F.transform(linked("canonical"), lambda x: value(x["attributes"], "href")), lambda x: resolve(url, x)))),
        "hreflang": lambda: F.filter(hreflang(), lambda x: x["url"].isNotNull()),
        "resources": lambda: F.array_distinct(_nonempty(sources())),
        "image_count": lambda: F.size(images()),
        "images_missing_alt": lambda: F.size(F.filter(images(), lambda x: ~has(x["attributes"], "alt"))),
        "images_empty_alt": lambda: F.size(F.filter(images(), lambda x: has(x["attributes"], "alt") & (F.trim(value(x["attributes"], "alt")) == ""))),
        "phone_links": lambda: F.array_distinct(_nonempty(phones())),
        "paragraph_count": lambda: F.size("__paragraphs"),
        "longest_paragraph": lambda: F.coalesce(F.array_max(F.transform("__paragraphs", lambda x: x["words"])), F.lit(0)),
        "first_paragraph": lambda: _first(F.transform(F.filter("__paragraphs", lambda x: x["words"] >= 5), lambda x: x["text"])),
        "tokens": lambda: tokenize(F.col("__t")),
        "word_count": lambda: F.size(tokenize(F.col("__t"))),
        "content_hash": lambda: F.sha2("__t", 256),
        "title": lambda: _first(F.transform(spans("title"), inside)),
        "description": lambda: _first(_metas("name", "description")),
    }
    rows = rows.withColumns({name: made() for name, made in facts.items() if asked(name)})
    return rows.drop("__source", "__tags", "__texts", "__names", "__els", "__t", "__paragraphs", "__headings")


def header_canonicals(header) -> Column:
    """URLs of Link headers with rel=canonical."""
    return F.regexp_extract_all(header, F.lit(r"(?i)<([^>]*)>\s*;[^,]*\brel=\"?canonical\b"), F.lit(1))


def canonical(html_canonicals, header) -> Column:
    """The first canonical of the markup, else of the Link headers; '' without one."""
    return F.coalesce(F.try_element_at(F.array_union(html_canonicals, header_canonicals(F.coalesce(header, F.lit("")))), F.lit(1)), F.lit(""))


def anchors(pages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per link of each page: keys, url, pos, target, text, internal, nofollow, booking. References are resolved against the page's address. A link
    that is never closed ends with the block that holds it, or where the next begins."""

    def read(span):
        names, tags = (F.slice(c, span["first"] + 2, span["last"] - span["first"] - 1) for c in ("__names", "__tags"))
        images = F.transform(F.filter(F.zip_with(names, tags, lambda n, t: F.struct(n.alias("name"), t.alias("tag"))), lambda x: x["name"] == "img"), lambda x: x["tag"])
        return let(
            attributes(F.get("__tags", span["first"])),
            lambda a: F.struct(value(a, "href").alias("href"), F.lower(value(a, "rel")).alias("rel"), clean_text(value(a, "aria-label")).alias("label"), inside(span).alias("text"), images.alias("images")),
        )

    rows = marked(pages.select(*keys, "url", "html"), F.coalesce("html", F.lit("")))
    rows = rows.withColumn("__spans", spans("a", unless_closed=("p", *BLOCKS))).select(*keys, "url", F.posexplode(F.transform("__spans", read)).alias("pos", "a"))
    rows = rows.filter(is_followed(F.col("a.href")))
    alts = F.array_join(_nonempty(F.transform("a.images", lambda t: clean_text(value(attributes(t), "alt")))), " ")
    label = F.coalesce(F.nullif(F.col("a.label"), F.lit("")), F.nullif(F.col("a.text"), F.lit("")), alts)
    rows = rows.withColumn("target", resolve(F.col("url"), F.col("a.href"))).withColumn("text", label).filter(F.col("target").rlike("(?i)^https?://") & ~F.contains(F.col("target"), F.lit("/cdn-cgi/l/email-protection")))
    internal = host_key(F.col("target")) == host_key(F.col("url"))
    return rows.select(*keys, "url", "pos", F.when(internal, crawl_url(F.col("target"))).otherwise(F.col("target")).alias("target"), "text", internal.alias("internal"), has_token(F.col("a.rel"), "nofollow").alias("nofollow"), is_booking(F.col("text"), F.col("target")).alias("booking"))
