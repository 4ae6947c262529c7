"""Captured answers of a keyword and ranking provider: status checks, costs, and the rows that each kind of answer holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain

#: Fixed value: what both an answer and its first task must say.
GOOD = 20000
ENVELOPE = "struct<status_code:int,status_message:string,tasks:array<struct<status_code:int,status_message:string,cost:double,result:string>>>"
IDEAS = "array<struct<keyword:string,search_volume:int,cpc:double>>"
ORGANIC = "array<struct<items:array<struct<type:string,rank_absolute:int,domain:string,title:string,url:string>>>>"
MAPS = "array<struct<items:array<struct<type:string,rank_group:int,rank_absolute:int,domain:string,title:string,url:string,address:string,place_id:string,category:string,latitude:double,longitude:double,rating:struct<value:double,votes_count:int>>>>>"
LINKS = "array<struct<backlinks:long,referring_domains:long,referring_domains_nofollow:long,referring_pages:long,referring_ips:long,rank:int,backlinks_spam_score:int,broken_backlinks:long,broken_pages:long,referring_links_countries:map<string,int>,info:struct<target_spam_score:int>>>"


def answers(payloads: DataFrame, schema: str) -> DataFrame:
    """payloads (payload: an answer's JSON, more if wanted) with cost, error and result of its first task; the result is null where there is an error."""
    e = F.from_json("payload", ENVELOPE)
    rows = payloads.withColumn("__e", e).withColumn("__t", F.try_element_at("__e.tasks", F.lit(1))).withColumn("result", F.from_json("__t.result", schema))

    def said(c):
        return F.concat_ws(": ", F.col(f"{c}.status_code").cast("string"), F.col(f"{c}.status_message"))

    error = (
        F.when(F.col("__e.status_code").isNull(), "unreadable answer")
        .when(F.col("__e.status_code") != GOOD, said("__e"))
        .when(F.col("__t").isNull(), "no task")
        .when(F.coalesce(F.col("__t.status_code") != GOOD, F.lit(True)), said("__t"))
        .when(F.col("result").isNull() & F.col("__t.result").isNotNull() & (F.col("__t.result") != "null"), "unreadable result")
    )
    rows = rows.withColumn("error", error).withColumn("cost", F.when(F.col("__e.status_code") == GOOD, F.coalesce("__t.cost", F.lit(0.0))).otherwise(0.0))
    return rows.withColumn("result", F.when(F.col("error").isNull(), F.col("result"))).drop("payload", "__e", "__t")


def totals(rows: DataFrame) -> DataFrame:
    """Calls, their cost and those that failed, of the rows of `answers`."""
    return rows.agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("error").alias("failed"))


def ideas(payloads: DataFrame, *keys: str) -> DataFrame:
    """keys, ord (from 0, the provider's order of relevance), keyword, search_volume, cpc. Volumes of a keyword list come in the same shape."""
    return answers(payloads, IDEAS).select(*keys, F.posexplode("result").alias("ord", "r")).select(*keys, "ord", "r.*")


def organic(payloads: DataFrame, target: str, *keys: str) -> DataFrame:
    """keys, position, url: of each answer the first organic item of the target's domain; position 0 and no url without one. Answers with an error give no row."""
    items = F.col("result")[0]["items"]
    own = F.filter(items, lambda i: (i["type"] == "organic") & (domain(i["domain"]) == domain(F.lit(target))))
    first = F.try_element_at(own, F.lit(1))
    return answers(payloads, ORGANIC).filter("error is null").select(*keys, F.coalesce(first["rank_absolute"], F.lit(0)).alias("position"), F.coalesce(first["url"], F.lit("")).alias("url"))


def maps(payloads: DataFrame, place_id: str, *keys: str) -> DataFrame:
    """keys, ord, position, place_id, name, category, address, domain, url, latitude, longitude, rating, reviews, is_target of the map items of each answer.
    The position is the rank in its group, else the absolute one; ord is the item's place, from 0."""
    rows = answers(payloads, MAPS).select(*keys, F.posexplode(F.filter(F.col("result")[0]["items"], lambda i: i["type"] == "maps_search")).alias("ord", "i"))
    position = F.when(F.coalesce("i.rank_group", F.lit(0)) != 0, F.col("i.rank_group")).otherwise(F.coalesce("i.rank_absolute", F.lit(0)))
    return rows.select(
        *keys, "ord", position.alias("position"), "i.place_id", F.col("i.title").alias("name"), "i.category", "i.address", "i.domain", "i.url", "i.latitude", "i.longitude",
        F.coalesce("i.rating.value", F.lit(0.0)).alias("rating"), F.coalesce("i.rating.votes_count", F.lit(0)).alias("reviews"), F.coalesce(F.col("i.place_id") == place_id, F.lit(False)).alias("is_target"),
    )


def backlinks(payloads: DataFrame, *keys: str) -> DataFrame:
    """keys, error and the first summary of each answer: counts, rank, spam scores and countries."""
    s = F.try_element_at("result", F.lit(1))
    rows = answers(payloads, LINKS).withColumn("__s", s)
    error = F.coalesce("error", F.when(F.col("__s").isNull(), "no backlink summary"))
    numbers = ("backlinks", "referring_domains", "referring_domains_nofollow", "referring_pages", "referring_ips", "rank", "backlinks_spam_score", "broken_backlinks", "broken_pages")
    return rows.select(*keys, error.alias("error"), "cost", *[F.coalesce(f"__s.{n}", F.lit(0)).alias(n) for n in numbers], F.coalesce("__s.info.target_spam_score", F.lit(0)).alias("target_spam_score"), F.col("__s.referring_links_countries").alias("countries"))
