"""Lab metrics: sessions of layout shifts, blocking time, page choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_html
from ..functions.urls import path


def worst_session(entries: Column, gap: int, span: int) -> Column:
    """Largest sum of a session: entries (array of struct at, value, in order) go on while each is less than `gap` after
    the one before and less than `span` after the first. A session that begins at 0 counts as none, so the next entry opens another."""
    start = F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        on = (acc["first"] > 0) & (x["at"] - acc["last"] < gap) & (x["at"] - acc["first"] < span)
        total = F.when(on, acc["sum"] + x["value"]).otherwise(x["value"])
        return F.struct(F.when(on, acc["first"]).otherwise(x["at"]).alias("first"), x["at"].alias("last"), total.alias("sum"), F.greatest(acc["worst"], total).alias("worst"))

    return F.aggregate(entries, start, step, lambda acc: acc["worst"])


def capped_sessions(shifts: DataFrame, key: str, at: str, value: str, gap: int, span: int) -> DataFrame:
    """key, worst for each key of shifts: one sort of each key's entries, then a fold."""
    lists = shifts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value")))).alias("entries"))
    return lists.select(key, worst_session(F.col("entries"), gap, span).alias("worst"))


def blocking_time(tasks: DataFrame, key: str, least: float = 50) -> DataFrame:
    """key, tbt: what tasks that start at or after fcp take beyond `least`. tasks: key, start, duration, fcp."""
    over = F.when(F.col("start") >= F.col("fcp"), F.greatest(F.lit(0.0), F.col("duration") - least)).otherwise(0.0)
    return tasks.groupBy(key).agg(F.sum(over).alias("tbt"))


def resource_totals(requests: DataFrame, key: str) -> DataFrame:
    """Bytes by kind, requests and third parties. requests: key, type, bytes, third_party."""
    kinds = ("script", "stylesheet", "image", "font", "document")
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_if("third_party").alias("third_party"), *[F.sum(F.when(F.col("type") == k, F.col("bytes")).otherwise(0)).alias(f"{k}_bytes") for k in kinds])


def finished_requests(responses: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Responses (keys, request, at, url, type) with the bytes of the load that ended them (keys, request, at, bytes). An end takes the last response
    before it that no earlier end took; ends without one go."""
    events = responses.select(*keys, "request", "at", F.lit(0).alias("__end"), "url", "type", F.lit(None).cast("double").alias("bytes")).unionByName(ends.select(*keys, "request", "at", F.lit(1).alias("__end"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("type"), F.col("bytes").cast("double").alias("bytes")))
    by = Window.partitionBy(*keys, "request").orderBy("at", "__end")
    before = events.withColumns({"__was": F.lag("__end").over(by), "__url": F.lag("url").over(by), "__type": F.lag("type").over(by)})
    good = before.filter("__end = 1 and __was = 0")
    return good.select(*keys, "request", F.col("__url").alias("url"), F.col("__type").alias("type"), F.round("bytes").cast("long").alias("bytes"))


def largest_paint(entries: DataFrame, key: str) -> DataFrame:
    """key, lcp: the latest of its paint entries (at)."""
    return entries.groupBy(key).agg(F.max("at").alias("lcp"))


def select_pages(pages: DataFrame, limit: int = 6) -> DataFrame:
    """The root, then the shallowest page of each first path segment, larger sections first: url, rank. pages: url, status_code, content_type, indexable, depth."""
    good = pages.filter(F.col("indexable") & F.col("status_code").between(200, 299) & is_html(F.col("content_type")))
    segment = F.regexp_extract(F.regexp_replace(path(F.col("url")), "^/+|/+$", ""), "^[^/]*", 0)
    deep = F.when(F.col("depth") < 0, 2**31 - 1).otherwise(F.col("depth"))
    named = good.withColumn("segment", segment)
    sections = named.filter("segment <> ''").groupBy("segment").agg(F.count("*").alias("n"), F.min(F.struct(deep.alias("d"), F.col("url"))).alias("best"))
    root = named.filter("segment = ''").agg(F.max("url").alias("url")).filter("url is not null").select("url", F.lit(0).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("segment"))
    every = root.union(sections.select("best.url", F.lit(1), -F.col("n"), "segment"))
    return every.orderBy("kind", "size", "segment").limit(limit).select("url", "segment", (-F.col("size")).alias("pages"))


def summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("pages"), *[F.max(c).alias(f"worst_{c}") for c in ("lcp", "cls", "tbt", "ttfb", "bytes")])
