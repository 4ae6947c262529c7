"""Markup as tokens: one linear pattern cuts a page into tags and the texts between them, and everything else is read off these two arrays.

The pattern is a state machine without backtracking: values may hold > in quotes, comments and raw elements are one token, and what is
never closed runs to the end. All of it runs on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

#: The rest of a tag: up to each = as it comes, then a value in double, single or no quotes.
_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)[^>=]*+)*+"""
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"


def _whole(names: str, unless: str = "") -> str:
    """Elements whose content is no markup, with their content."""
    return rf"<({names})(?=[\s/>]){_REST}{unless}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)"


_TAG = rf"</?[a-z]{_REST}(?:>|\z)|<[!?/][^>]*+(?:>|\z)"
TOKEN = rf"(?is){_COMMENT}|{_whole('script|style|noscript')}|{_TAG}"
#: The same, with elements that are not shown as one token each.
UNSEEN = rf"(?is){_COMMENT}|{_whole('script|style|noscript|svg|template', '(?<!/)')}|{_TAG}"
_ATTRIBUTE = r"""(?s)([^\s"'>/=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""

# Tags that end a paragraph, as browsers read markup.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "pre", "section", "summary", "table", "td", "th", "ul",
)
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Character references by number: decimal or hexadecimal.
NUMBERED = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def let(c, f) -> Column:
    """f(c) with c computed once, however often f names it: expressions are trees, so what f repeats would grow with each step."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _numbered(c) -> Column:
    """The text with numbered references in place of what they name, where there are any: what stands between them and the characters, in turn."""
    between = F.split(c, NUMBERED, -1)

    def named(x):
        n = F.when(x.rlike("(?i)^&#x"), F.conv(F.regexp_extract(x, "(?i)^&#x([0-9a-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+);", 1)).cast("int")
        good = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        # A code point as UTF-32, which becomes text.
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")

    signs = F.concat(F.transform(F.regexp_extract_all(c, F.lit(NUMBERED), F.lit(0)), named), F.array(F.lit("")))
    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.zip_with(between, signs, lambda a, b: F.concat(a, b)), "")).otherwise(c)


def _decoded(c) -> Column:
    named = c
    for name, value in ENTITIES[:-1]:
        named = F.replace(named, F.lit(name), F.lit(value))
    return F.when(F.contains(c, F.lit("&")), F.replace(let(named, _numbered), F.lit("&amp;"), F.lit("&"))).otherwise(c)


def decoded(c) -> Column:
    """The common character references and numbered ones; & comes last, so what it spells out stays text."""
    return let(c, _decoded)


def marked(pages: DataFrame, source: Column) -> DataFrame:
    """pages with __tags, the tokens of the source's markup, __names (lower-cased, / before those of end tags, '' for what is no tag) and __texts, one more:
    what stands before each token and behind the last."""
    rows = pages.withColumn("__source", source)
    rows = rows.withColumns({"__tags": F.regexp_extract_all("__source", F.lit(TOKEN), F.lit(0)), "__texts": F.split("__source", TOKEN, -1)})
    return rows.withColumn("__names", F.transform("__tags", lambda t: F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z][^\s/>]*+)", 1))))


def shown_text(source="__source", names="__names", texts="__texts") -> Column:
    """Text of what is not hidden, each piece parted from the next."""
    unseen = F.arrays_overlap(names, F.array(F.lit("svg"), F.lit("template")))
    return clean_text(decoded(F.when(unseen, F.regexp_replace(source, UNSEEN, " ")).otherwise(F.array_join(texts, " "))))


def _unquoted(raw) -> Column:
    first = F.left(raw, F.lit(1))
    quoted = (F.length(raw) >= 2) & first.isin('"', "'") & (first == F.right(raw, F.lit(1)))
    return decoded(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def attributes(tag) -> Column:
    """keys (lower-cased) and values (without quotes, character references read) of a tag's source; the first key is the tag's own name."""
    values = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)), lambda raw: F.when(F.length(raw) == 0, raw).otherwise(let(raw, _unquoted)))
    return F.struct(F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("keys"), values.alias("values"))


def has(attrs, name: str) -> Column:
    return F.array_contains(attrs["keys"], name)


def value(attrs, name: str) -> Column:
    """The first value of an attribute; '' if absent."""
    return F.coalesce(F.get(attrs["values"], (F.array_position(attrs["keys"], name) - 1).cast("int")), F.lit(""))


def elements(*wanted: str) -> Column:
    """name and attributes of each start tag of these names, in their order."""
    pairs = F.filter(F.zip_with("__names", "__tags", lambda n, t: F.struct(n.alias("name"), t.alias("tag"))), lambda x: x["name"].isin(*wanted))

    return F.transform(pairs, lambda x: F.struct(x["name"].alias("name"), attributes(x["tag"]).alias("attributes")))


def spans(*wanted: str, ends: tuple[str, ...] = (), unless_closed: tuple[str, ...] = ()) -> Column:
    """name, first and last of each element of these names: its tag is token `first`, from 0, and `last` the one that ends it. That is any
    start or end tag of the names or of `ends`, so an element that is never closed ends where the next begins, at the latest where the page does; one
    that no end tag closes ends before it at any tag of `unless_closed`."""
    names = [*wanted, *(f"/{n}" for n in wanted), *ends, *(f"/{n}" for n in ends)]
    places = F.filter(F.transform("__names", lambda n, i: F.struct(n.alias("name"), i.alias("at"))), lambda x: x["name"].isin(*names))
    pairs = F.zip_with(places, F.slice(places, 2, 1 << 30), lambda a, b: F.struct(a["name"].alias("name"), a["at"].alias("first"), F.coalesce(b["at"], F.size("__names")).alias("last"), F.startswith(F.coalesce(b["name"], F.lit("")), F.lit("/")).alias("closed")))
    out = F.filter(pairs, lambda x: x["name"].isin(*wanted))
    if not unless_closed:
        return out
    tags = [*unless_closed, *(f"/{n}" for n in unless_closed)]

    def ended(x):
        found = F.filter(F.transform(F.slice("__names", x["first"] + 2, x["last"] - x["first"] - 1), lambda n, i: F.when(n.isin(*tags), x["first"] + 1 + i)), lambda i: i.isNotNull())
        return F.struct(x["name"].alias("name"), x["first"].alias("first"), F.when(x["closed"], x["last"]).otherwise(F.coalesce(F.get(found, F.lit(0)), x["last"])).alias("last"))

    return F.transform(out, ended)


def inside(span) -> Column:
    """Text of an element, as its pieces stand."""
    return clean_text(decoded(F.array_join(F.slice("__texts", span["first"] + 2, span["last"] - span["first"]), "")))
