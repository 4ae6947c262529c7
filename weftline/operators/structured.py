"""Structured data, dates and authors of pages, from the tokens of their markup and of their JSON, all on the JVM.

JSON is checked by parsing it as a variant; then one pattern cuts the text into strings and signs, and a fold over these keeps a stack of what is open. A
key belongs to the object on top, and of objects with such a key the one that opens first counts, as a walk from the top would meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, has_token
from .markup import _REST, attributes, inside, let, spans, value

_BLOCK = rf"(?is)^<script(?=[\s/>]){_REST}>(.*?)(?:</script(?=[\s/>])[^>]*+>?)?\z"
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_SIGNS = rf"(?s){_STRING}|[{{}}\[\]:,]|[^\s{{}}\[\]:,\"]++"
#: The value of a type: a string, or a list without further lists and objects.
_TYPES = rf'(?s)"@type"\s*+:\s*+({_STRING}|\[(?:[^"\[\]{{}}]++|{_STRING})*+\])'
_KEYS = r'"(?:author|datePublished|dateModified)"\s*+:'
#: Elements that hold nothing.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _text(string) -> Column:
    """What a JSON string says, with its escapes read."""
    return clean_text(F.coalesce(F.try_variant_get(F.try_parse_json(string), "$", "string"), F.lit("")))


def _types(block) -> Column:
    return F.flatten(F.transform(F.regexp_extract_all(block, F.lit(_TYPES), F.lit(1)), lambda v: F.transform(F.regexp_extract_all(v, F.lit(f"(?s){_STRING}"), F.lit(0)), _text)))


def _said(signs) -> Column:
    """author, published, modified of a JSON text by its signs, '' where it has none.

    The stack holds, for each open object or list, where it begins, whether it is a list, and, inside an author, where the object begins that
    has the author (-1 elsewhere). What was found is held with where its object begins; a later one counts if its object begins earlier."""
    none = F.struct(F.lit(2**31 - 1).alias("of"), F.lit("").alias("text"))
    kind = "array<struct<at:int,list:boolean,owner:int>>"
    start = F.struct(F.lit("").alias("before"), F.lit("").alias("key"), F.array().cast(kind).alias("open"), none.alias("author"), none.alias("published"), none.alias("modified"))

    def step(acc, x):
        sign, top = x["sign"], F.get(acc["open"], F.lit(0))
        valued = acc["before"] == ":"
        key = F.when(valued, acc["key"]).otherwise("")
        string = F.left(sign, F.lit(1)) == '"'
        opens, closes = sign.isin("{", "["), sign.isin("}", "]")
        owner = F.when(valued & (key == '"author"'), top["at"]).when(~valued & top["list"], top["owner"]).otherwise(-1)
        pushed = F.concat(F.array(F.struct(x["at"].alias("at"), (sign == "[").alias("list"), F.coalesce(owner, F.lit(-1)).alias("owner"))), acc["open"])
        # Whose author a string is: a value itself, one of a list, or the name of an object.
        named = F.when(valued & (key == '"author"'), top["at"]).when(valued & (key == '"name"'), top["owner"]).when(~valued & top["list"], top["owner"]).otherwise(-1)

        def better(field, of, where):
            return F.when(string & where & (of >= 0) & (of < acc[field]["of"]) & (_text(sign) != ""), F.struct(of.alias("of"), _text(sign).alias("text"))).otherwise(acc[field])

        of = F.coalesce(named, F.lit(-1))
        own = F.coalesce(top["at"], F.lit(-1))
        return F.struct(
            sign.alias("before"),
            F.when(string & ~valued, sign).when(sign == ":", acc["key"]).otherwise("").alias("key"),
            F.when(opens, pushed).when(closes, F.slice(acc["open"], 2, 1 << 30)).otherwise(acc["open"]).alias("open"),
            better("author", of, F.lit(True)).alias("author"),
            better("published", own, valued & (key == '"datePublished"')).alias("published"),
            better("modified", own, valued & (key == '"dateModified"')).alias("modified"),
        )

    placed = F.transform(signs, lambda s, i: F.struct(s.alias("sign"), i.alias("at")))
    return F.aggregate(placed, start, step, lambda acc: F.struct(acc["author"]["text"].alias("author"), acc["published"]["text"].alias("published"), acc["modified"]["text"].alias("modified")))


def _first(rows, field: str) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(rows, lambda r: r[field]), lambda x: x != ""), F.lit(0)), F.lit(""))


def _marked_author() -> Column:
    """Text of the first element marked as its author that says something. A fold keeps the element that is open: where it begins and how many of its name are."""
    start = F.struct(F.lit(-1).alias("first"), F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit("").alias("text"))
    marked = F.zip_with("__names", "__tags", lambda n, t: F.struct(n.alias("name"), (~F.startswith(n, F.lit("/")) & ~n.isin(*_VOID) & t.rlike(r"(?is)\s(rel|itemprop)\s*=") & let(attributes(t), lambda a: has_token(value(a, "rel"), "author") | (F.lower(value(a, "itemprop")) == "author"))).alias("marked")))
    placed = F.transform(marked, lambda x, i: F.struct(x["name"].alias("name"), x["marked"].alias("marked"), i.alias("at")))

    def step(acc, x):
        done, open_ = acc["text"] != "", acc["first"] >= 0
        depth = acc["depth"] + F.when(x["name"] == acc["name"], 1).when(x["name"] == F.concat(F.lit("/"), acc["name"]), -1).otherwise(0)
        ends = open_ & (depth == 0)
        said = let(F.struct(acc["first"].alias("first"), x["at"].alias("last")), inside)
        begun = F.struct(x["at"].alias("first"), x["name"].alias("name"), F.lit(1).alias("depth"), F.lit("").alias("text"))
        closed = F.struct(F.lit(-1).alias("first"), F.lit("").alias("name"), F.lit(0).alias("depth"), said.alias("text"))
        on = F.struct(acc["first"].alias("first"), acc["name"].alias("name"), depth.alias("depth"), F.lit("").alias("text"))
        return F.when(done, acc).when(ends, closed).when(open_, on).when(x["marked"], begun).otherwise(acc)

    def last(acc):
        """What is never closed ends with the page."""
        rest = let(F.struct(acc["first"].alias("first"), F.size("__names").alias("last")), inside)
        return F.when((acc["text"] == "") & (acc["first"] >= 0), rest).otherwise(acc["text"])

    # Only pages that speak of an author are folded.
    return F.when(F.col("__source").rlike(r"(?is)\s(rel|itemprop)\s*=[^>]*author"), F.aggregate(placed, start, step, last)).otherwise("")


def with_structured(rows: DataFrame, name: str = "metadata") -> DataFrame:
    """Tokens of `marked` with a struct of that name: blocks of JSON-LD and how many of them are invalid, the schema types of all objects (sorted, each once), author,
    published and modified.

    The first block that says something counts; then times marked as modified or updated, as published, or inside an article; then elements marked as the author. JSON with
    a repeated key in one object counts as invalid."""
    scripts = F.filter(F.zip_with("__names", "__tags", lambda n, t: F.when(n == "script", t)), lambda t: t.isNotNull() & t.rlike(r"(?i)ld\+json"))
    blocks = F.transform(F.filter(scripts, lambda t: let(attributes(F.regexp_extract(t, rf"(?is)^<script(?=[\s/>]){_REST}>?", 0)), lambda a: F.lower(value(a, "type")) == "application/ld+json")), lambda t: F.regexp_extract(t, _BLOCK, 1))
    rows = rows.withColumn("__valid", F.transform(blocks, lambda b: F.struct(b.alias("text"), F.try_parse_json(b).isNotNull().alias("valid"))))
    said = F.transform(
        F.filter("__valid", lambda b: b["valid"]),
        lambda b: F.struct(_types(b["text"]).alias("types"), F.when(b["text"].rlike(_KEYS), _said(F.regexp_extract_all(b["text"], F.lit(_SIGNS), F.lit(0)))).alias("said")),
    )
    rows = rows.withColumn("__said", said)
    articles = F.filter(F.transform("__names", lambda n, i: F.struct(n.alias("name"), i.alias("at"))), lambda x: x["name"].isin("article", "/article"))

    def time(x):
        a = attributes(F.get("__tags", x["first"]))
        before = F.aggregate(F.col("__articles"), F.lit(0), lambda acc, y: F.when(y["at"] > x["first"], acc).otherwise(F.greatest(acc + F.when(y["name"] == "article", 1).otherwise(-1), F.lit(0))))
        return let(a, lambda a: F.struct(F.coalesce(F.nullif(clean_text(value(a, "datetime")), F.lit("")), inside(x)).alias("value"), F.lower(F.concat_ws(" ", value(a, "itemprop"), value(a, "class"), value(a, "data-testid"))).alias("signal"), (before > 0).alias("within")))

    rows = rows.withColumn("__articles", articles).withColumn("__times", F.filter(F.transform(spans("time"), time), lambda t: t["value"] != "")).withColumn("__author", _marked_author())
    changed = lambda t: F.contains(t["signal"], F.lit("modified")) | F.contains(t["signal"], F.lit("updated"))
    later = F.filter("__times", changed)
    told = F.filter("__times", lambda t: ~changed(t) & (F.contains(t["signal"], F.lit("published")) | t["within"]))
    blocks_said = F.transform("__said", lambda s: s["said"])
    filled = lambda first, second: F.coalesce(F.nullif(first, F.lit("")), second)
    out = F.struct(
        F.size("__valid").alias("blocks"),
        F.size(F.filter("__valid", lambda b: ~b["valid"])).alias("invalid"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("__said", lambda s: s["types"])), lambda t: t != ""))).alias("schema_types"),
        filled(_first(blocks_said, "author"), F.col("__author")).alias("author"),
        filled(_first(blocks_said, "published"), _first(told, "value")).alias("published"),
        filled(_first(blocks_said, "modified"), _first(later, "value")).alias("modified"),
    )
    return rows.withColumn(name, out).drop("__valid", "__said", "__articles", "__times", "__author")
