"""Keyword candidates, shortlists, opportunities and map-rank grids."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import comparable_page, is_excluded_page
from .site import saved

CANDIDATE = ("keyword", "url", "target_url", "position", "search_volume", "cpc", "explicit", "source", "relevance", "ord")
# Page types that don't earn keywords, and those that sell.
EXCLUDED_TYPES = ("blog", "team-about", "contact-legal-utility")


def ranked_candidates(items: DataFrame) -> DataFrame:
    """Rankings that are keyword candidates. items: keyword, url, position, search_volume, cpc, ord."""
    k = F.lower(F.trim("keyword"))
    rows = items.withColumn("keyword", k).filter((F.col("keyword") != "") & (F.col("position") >= 1) & (F.col("search_volume") >= 1) & ~T.is_informational(F.col("keyword")))
    return rows.select("keyword", "url", F.lit("").alias("target_url"), "position", "search_volume", "cpc", F.lit(False).alias("explicit"), F.lit("current-ranking").alias("source"), F.lit(0).alias("relevance"), "ord")


def existing_rankings(items: DataFrame) -> DataFrame:
    """keyword, position, url, search_volume, cpc of rows that have the first three, by position, volume and keyword."""
    rows = items.select(F.lower(F.trim("keyword")).alias("keyword"), "position", F.trim("url").alias("url"), "search_volume", "cpc")
    return rows.filter((F.col("keyword") != "") & (F.col("position") >= 1) & (F.col("url") != "")).orderBy("position", F.desc("search_volume"), "keyword")


def context_terms(pages: DataFrame, category: str, location: str) -> DataFrame:
    """Terms (term) of the category and of indexable pages that earn keywords, without those of the location. pages: url, title, h1, page_type, indexable."""
    spark = pages.sparkSession
    used = pages.filter(F.col("indexable") & ~F.coalesce(F.col("page_type").isin(*EXCLUDED_TYPES), F.lit(False)) & ~is_excluded_page(F.col("url")))
    said = used.select(F.explode(F.array_union(T.keyword_terms(F.col("url")), F.array_union(T.keyword_terms(F.col("title")), T.keyword_terms(F.array_join("h1", " "))))).alias("term"))
    own = spark.range(1).select(F.explode(T.keyword_terms(F.lit(category))).alias("term"))
    places = spark.range(1).select(F.explode(F.transform(F.split(F.lower(F.lit(location)), r"[,\s]+"), T.normalize_term)).alias("term"))
    return said.union(own).distinct().join(places, "term", "left_anti")


def site_candidates(items: DataFrame, terms: DataFrame, locality: str, brands: tuple[str, ...]) -> DataFrame:
    """Ideas for the site that speak of it: with volume, no question, no misspelled plural, no brand; with a price unless
    local; with a context term. items: keyword, search_volume, cpc, ord (1 first). An empty locality is in every keyword."""
    k = T.normalize_keyword(F.col("keyword"))
    rows = items.withColumn("keyword", k).filter((F.col("keyword") != "") & (F.col("search_volume") >= 1) & ~T.is_informational(F.col("keyword")) & ~T.is_misspelled_plural(F.col("keyword")))
    for brand in brands:
        if brand:
            rows = rows.filter(~F.contains(T.compact(F.col("keyword")), F.lit(brand)))
    rows = rows.filter((F.col("cpc") > 0) | F.contains("keyword", F.lit(locality)) | F.contains("keyword", F.lit("near me")))
    speaks = rows.select("ord", F.explode(T.all_terms(F.col("keyword"))).alias("term")).join(terms, "term", "left_semi").select("ord").distinct()
    rows = rows.join(speaks, "ord", "left_semi")
    return rows.select("keyword", F.lit("").alias("url"), F.lit("").alias("target_url"), F.lit(0).alias("position"), "search_volume", "cpc", F.lit(False).alias("explicit"), F.lit("site-discovery").alias("source"), F.col("ord").alias("relevance"), "ord")


def with_volumes(keywords: DataFrame, volumes: DataFrame, source: str) -> DataFrame:
    """keywords (keyword, ord) with the volume and price of the last row of volumes (keyword, search_volume, cpc, ord) that has the keyword."""
    last = volumes.groupBy(F.lower(F.trim("keyword")).alias("keyword")).agg(F.max_by(F.struct("search_volume", "cpc"), "ord").alias("v"))
    rows = keywords.join(last, "keyword", "left")
    return rows.select("keyword", F.lit("").alias("url"), F.lit("").alias("target_url"), F.lit(0).alias("position"), F.coalesce("v.search_volume", F.lit(0)).alias("search_volume"), F.coalesce("v.cpc", F.lit(0.0)).alias("cpc"), F.lit(source == "supplied").alias("explicit"), F.lit(source).alias("source"), (F.lit(0) if source == "supplied" else F.col("ord")).alias("relevance"), "ord")


def merge(candidates: DataFrame) -> DataFrame:
    """One row per keyword, folding its rows by ord: largest volume and price; position and url of the last with a
    position; explicit if any is, then with the last such source; first target; else the first row's values."""
    late = F.when(F.col("position") > 0, F.col("ord"))
    marked = F.when(F.col("explicit"), F.col("ord"))
    targeted = F.when(F.col("target_url") != "", F.col("ord"))
    out = candidates.groupBy("keyword").agg(
        F.max("search_volume").alias("search_volume"),
        F.max("cpc").alias("cpc"),
        F.coalesce(F.max_by("position", late), F.lit(0)).alias("position"),
        F.coalesce(F.max_by("url", late), F.min_by("url", "ord")).alias("url"),
        F.coalesce(F.min_by("target_url", targeted), F.lit("")).alias("target_url"),
        F.bool_or("explicit").alias("explicit"),
        F.max_by("source", marked).alias("marked"),
        F.min_by("source", "ord").alias("first"),
        F.min_by("relevance", "ord").alias("relevance"),
        F.min("ord").alias("ord"),
    )
    return out.withColumn("source", F.coalesce("marked", "first")).select(*CANDIDATE)


def page_key(c: str = "target_url", other: str = "url"):
    return F.coalesce(F.nullif(comparable_page(F.col(c)), F.lit("")), F.nullif(comparable_page(F.col(other)), F.lit("")))


def order_of_shortlist() -> list:
    ranked = F.when(F.col("source") == "current-ranking", F.col("position")).otherwise(0)
    relevant = F.when(F.col("source").isin("openrouter", "site-discovery"), F.col("relevance")).otherwise(0)
    return [F.desc("explicit"), T.source_priority(F.col("source")), ranked, relevant, T.importance(F.col("cpc"), F.col("search_volume")).desc(), F.desc("search_volume"), "keyword"]


def shortlist(candidates: DataFrame, limit: int) -> DataFrame:
    """Merged candidates, one per page (by source, then value for effort; explicit, ranking and pageless ones stay by themselves), in order, the first `limit`."""
    merged = merge(candidates)
    alone = F.col("explicit") | (F.col("source") == "current-ranking") | page_key().isNull()
    keyed = merged.withColumn("key", F.when(alone, F.concat(F.lit("keyword:"), "keyword")).otherwise(page_key()))
    best = Window.partitionBy("key").orderBy(T.source_priority(F.col("source")), T.ratio(F.col("cpc"), F.col("search_volume"), F.col("position")).desc(), "keyword")
    return keyed.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn", "key").orderBy(*order_of_shortlist()).limit(limit)


def assign_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """keyword, target_url: the page that shares most of a keyword's terms, ties to the smaller url; none without a shared term.
    candidates: keyword, target_url (kept if set); pages: url, title, h1, seeds.

    A keyword's terms are tried from the rarest on, a round for each: pages that have the term are scored by all of the keyword's terms. A page that has
    none of the terms tried shares at most those left, so a keyword is done once its best page shares more; and of pages that have nothing but the last,
    most frequent term, the first is known beforehand. So a term that all pages have meets no keyword, and few rows meet at all."""
    words = F.array_distinct(F.flatten(F.array(T.keyword_terms(F.col("url")), T.keyword_terms(F.col("title")), T.keyword_terms(F.array_join("h1", " ")), T.keyword_terms(F.array_join("seeds", " ")))))
    sets = saved(pages.select(F.col("url").alias("page"), words.alias("has")).groupBy("page").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has")))
    on_page = sets.select("page", F.explode("has").alias("term"))
    frequency = on_page.groupBy("term").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    asked = candidates.select("keyword", "target_url").distinct()
    wanted = asked.filter("target_url = ''").select("keyword", F.explode(T.keyword_terms(F.col("keyword"))).alias("term")).distinct()
    # A keyword's terms that some page has, rare ones first.
    todo = wanted.join(frequency, "term").groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("n", "term", "first"))).alias("terms"))
    none = F.lit(None).cast("struct<s:int,page:string>")
    todo = saved(todo.select("keyword", F.transform("terms", lambda t: t["term"]).alias("terms"), F.struct(F.lit(-1).alias("s"), F.element_at("terms", -1)["first"].alias("page")).alias("rest"), none.alias("best")))
    done = todo.limit(0)
    for k in count(1):
        left = F.size("terms") - k
        met = todo.filter(left >= 1).select("keyword", "terms", F.get("terms", F.lit(k - 1)).alias("term")).join(on_page, "term").select("keyword", "terms", "page")
        scores = met.join(sets, "page").groupBy("keyword").agg(F.min(F.struct((-F.size(F.array_intersect("terms", "has"))).alias("s"), F.col("page"))).alias("found"))
        todo = saved(todo.join(scores, "keyword", "left").withColumn("best", F.least("best", "found")).drop("found"))
        over = (left <= 1) | (F.coalesce(-F.col("best.s"), F.lit(0)) > left)
        done = done.unionByName(todo.filter(over))
        todo = todo.filter(~over)
        if todo.isEmpty():
            break
    best = done.select("keyword", F.least("best", "rest").alias("best"))
    return asked.join(best, "keyword", "left").select("keyword", F.coalesce(F.nullif("target_url", F.lit("")), "best.page", F.lit("")).alias("target_url"))


def remove_existing(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    return candidates.join(rankings.select("keyword").distinct(), "keyword", "left_anti")


def opportunities(rows: DataFrame) -> DataFrame:
    """rows (keyword, source, url, target_url, position, search_volume, cpc; maps_checked, maps_position, grid_points,
    top_three; has_page, has_booking, has_phone) with importance, effort, ratio, status, priority, evidence, actions."""
    c = F.col
    organic = (c("position") == 0) | (c("position") > 10)
    maps = c("maps_checked") & ((c("maps_position") == 0) | (c("maps_position") > 3) | ((c("grid_points") > 0) & (c("top_three") < 50)))
    important = T.importance(c("cpc"), c("search_volume"))
    status = F.when(organic & maps, "weak-organic-and-maps").when(organic, "weak-organic").when(maps, "weak-maps").otherwise("visible")
    evidence = F.concat_ws(
        "; ",
        F.when(c("position") > 0, F.concat(F.lit("organic #"), c("position").cast("string"))).otherwise("organic not found in top 100"),
        F.when(c("maps_checked"), F.when(c("maps_position") > 0, F.concat(F.lit("Maps #"), c("maps_position").cast("string"))).otherwise("Maps not found in top 20")),
        F.when(c("maps_checked") & (c("grid_points") > 0), F.concat(F.format_string("Maps top-three coverage %.1f%% across ", c("top_three")), c("grid_points").cast("string"), F.lit(" grid points"))),
    )
    actions = F.array_compact(
        F.array(
            F.when(organic & (c("target_url") != ""), "improve-target-page").when(organic & (c("url") == ""), "create-page").when(organic, "improve-ranking-page"),
            F.when(maps, "improve-profile"),
            F.when(~organic & ~maps, "protect"),
            F.when(c("has_page") & ~c("has_booking"), "add-booking"),
            F.when(c("has_page") & ~c("has_phone"), "add-phone"),
        )
    )
    return rows.withColumns({"importance": important, "effort": T.effort(c("position")), "ratio": T.ratio(c("cpc"), c("search_volume"), c("position")), "status": status, "priority": F.when(organic | maps, T.gap_priority(important)).otherwise("low"), "evidence": evidence, "actions": actions})


def opportunity_order() -> list:
    return [T.priority_weight(F.col("priority")), F.desc("ratio"), F.desc("search_volume"), "keyword"]


def grid_candidates(candidates: DataFrame, brands: tuple[str, ...], limit: int = 5) -> DataFrame:
    """The first `limit` by ord, of those with volume that are no question, brand or location code, one per page."""
    good = candidates.filter((F.col("search_volume") >= 1) & ~T.is_informational(F.col("keyword")) & ~T.is_branded(F.col("keyword"), *brands) & ~T.is_location_code(F.col("keyword")))
    keyed = good.withColumn("key", F.coalesce(page_key(), F.concat(F.lit("keyword:"), "keyword")))
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*candidates.columns), "ord").alias("c")).select("c.*")
    return first.orderBy("ord").limit(limit)


def geo_grid(centers: DataFrame, radius_km: float = 2.0) -> DataFrame:
    """Nine points around each center (key, latitude, longitude), row-major from the south-west: key, point, latitude, longitude."""
    step = F.lit(radius_km / 111.32)
    points = centers.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(8))))
    row, column = F.floor(F.col("point") / 3) - 1, F.col("point") % 3 - 1
    return points.select("key", "point", (F.col("latitude") + row * step).alias("latitude"), (F.col("longitude") + column * step / F.cos(F.col("latitude") * F.pi() / 180)).alias("longitude"))


def grid_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, position, failed) by key: checked, failed, top_three and found in percent of the checked, upper median
    position with not found as 21, told as 0."""
    good, at = ~F.col("failed"), F.when(F.col("position") > 0, F.col("position")).otherwise(21)
    agg = points.groupBy(*keys).agg(F.count_if(good).alias("checked"), F.count_if("failed").alias("failed"), F.count_if(good & F.col("position").between(1, 3)).alias("top"), F.count_if(good & (F.col("position") > 0)).alias("hit"), F.sort_array(F.collect_list(F.when(good, at))).alias("all"))

    def percent(n):
        return F.coalesce(F.round(n * 1000 / F.nullif("checked", F.lit(0))) / 10, F.lit(0.0))

    middle = F.coalesce(F.try_element_at("all", (F.floor(F.col("checked") / 2) + 1).cast("int")), F.lit(0))
    return agg.select(*keys, "checked", "failed", percent(F.col("top")).alias("top_three"), percent(F.col("hit")).alias("found"), F.when(middle == 21, 0).otherwise(middle).alias("median_position"))


def map_position(results: DataFrame, keys: list[str]) -> DataFrame:
    """Position of the target in each result list: its last place. results: keys, position, is_target."""
    return results.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("is_target"), F.col("position"))), F.lit(0)).alias("position"))


def competitors(results: DataFrame, keys: list[str], count: int = 3) -> DataFrame:
    """The first `count` places of each list that are not the target."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return results.filter(~F.col("is_target")).withColumn("rank", rank).filter(F.col("rank") <= count).select(*keys, "rank", "place", "position")


def check_limit(wanted: int | None, default: int = 8, most: int = 10) -> int:
    """How many keywords are checked: the default without a wish, never more than `most`. Fixed values."""
    return default if not wanted or wanted < 1 else min(wanted, most)


def search_place(latitude, longitude, name):
    """Where a search is made: at coordinates of seven places, unless both are 0, else by name."""
    return F.when((latitude != 0) | (longitude != 0), F.format_string("%.7f,%.7f", latitude, longitude)).otherwise(name)


def top_countries(counts: DataFrame, limit: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n"), "country").limit(limit)
