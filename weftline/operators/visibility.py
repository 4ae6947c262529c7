"""Keyword opportunities put together: pages and map results that belong to a keyword, grids, targets, and what reports show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import comparable_page
from .market import grid_candidates, opportunities, opportunity_order

#: Page types that sell, and all that a label may name. Fixed values.
COMMERCIAL = ("home", "service", "location", "service-location", "product-category")
PAGE_TYPES = (*COMMERCIAL, "blog", "team-about", "contact-legal-utility", "unknown")


def page_index(pages: DataFrame) -> DataFrame:
    """key and columns of pages (url, final_url, more), by both of its addresses; of pages with one key the last by `pos`, as later ones replace earlier ones."""
    rest = [c for c in pages.columns if c not in ("key", "pos")]
    both = pages.select("pos", F.explode(F.array(F.struct(F.lit(0).alias("way"), comparable_page(F.col("url")).alias("key")), F.struct(F.lit(1).alias("way"), comparable_page(F.col("final_url")).alias("key")))).alias("k"), *rest)
    last = both.filter("k.key <> ''").groupBy(F.col("k.key").alias("key")).agg(F.max_by(F.struct(*rest), F.struct("pos", "k.way")).alias("page"))
    return last.select("key", "page.*")


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (target_url, url, more) with page_title, has_page, has_booking, has_phone of the page at the target, else at the ranking address.
    pages: url, final_url, pos, title, booking, phone."""
    index = page_index(pages).select("key", F.struct("title", "booking", "phone").alias("page"))
    one = rows.withColumns({"__t": comparable_page(F.col("target_url")), "__u": comparable_page(F.col("url"))})
    for c in ("__t", "__u"):
        one = one.join(index.withColumnsRenamed({"key": f"{c}k", "page": f"{c}p"}), F.col(c) == F.col(f"{c}k"), "left").drop(f"{c}k", c)
    page = F.coalesce("__tp", "__up")
    out = one.withColumn("__p", page).drop("__tp", "__up")
    return out.withColumns({"page_title": F.coalesce("__p.title", F.lit("")), "has_page": F.col("__p").isNotNull(), "has_booking": F.coalesce("__p.booking", F.lit(False)), "has_phone": F.coalesce("__p.phone", F.lit(False))}).drop("__p")


def checked(candidates: DataFrame, found: DataFrame, snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """Opportunities of candidates with what the searches found for them.

    found (keyword, position, url) replaces a candidate's rank and page; candidates it lacks (the search failed) keep theirs. snapshots: keyword,
    target_position, grid_points, top_three; without one, maps were not checked. country_position is the rank that a current ranking came with."""
    rank = found.select(F.col("keyword").alias("__k"), F.col("position").alias("__position"), F.col("url").alias("__url"))
    maps = snapshots.select(F.col("keyword").alias("__m"), F.col("target_position").alias("maps_position"), "grid_points", "top_three")
    rows = candidates.withColumn("country_position", F.when(F.col("source") == "current-ranking", F.col("position")).otherwise(0))
    rows = rows.join(rank, F.col("keyword") == F.col("__k"), "left").withColumns({"position": F.coalesce("__position", "position"), "url": F.when(F.col("__k").isNotNull(), F.col("__url")).otherwise(F.col("url"))}).drop("__k", "__position", "__url")
    rows = rows.join(maps, F.col("keyword") == F.col("__m"), "left").withColumn("maps_checked", F.col("__m").isNotNull()).drop("__m")
    rows = rows.withColumns({"maps_position": F.coalesce("maps_position", F.lit(0)), "grid_points": F.coalesce("grid_points", F.lit(0)), "top_three": F.coalesce("top_three", F.lit(0.0))})
    return opportunities(with_pages(rows, pages))


def select_grids(current: DataFrame, fresh: DataFrame, brands: tuple[str, ...], snapshots: DataFrame, limit: int = 5) -> DataFrame:
    """Up to `limit` candidates for map grids, those of current rankings first, one per page; those without a snapshot are left out after the choice."""
    both = current.withColumn("__list", F.lit(0)).unionByName(fresh.withColumn("__list", F.lit(1)))
    place = F.row_number().over(Window.orderBy("__list", "ord"))  # two short lists
    chosen = grid_candidates(both.withColumn("ord", place).drop("__list"), brands, limit)
    return chosen.join(snapshots.select("keyword").distinct(), "keyword", "left_semi")


def with_grids(rows: DataFrame, grids: DataFrame, pages: DataFrame) -> DataFrame:
    """Opportunities worked out anew where a grid was measured (grids: keyword, points, top_three); the others stay as they are."""
    g = grids.select(F.col("keyword").alias("__g"), F.col("points").alias("__points"), F.col("top_three").alias("__top"))
    met = rows.join(g, F.col("keyword") == F.col("__g"), "left")
    fresh = met.filter(F.col("__g").isNotNull() & F.col("maps_checked")).withColumns({"grid_points": F.col("__points"), "top_three": F.col("__top")}).select(*rows.columns)
    rest = met.filter(F.col("__g").isNull() | ~F.col("maps_checked")).select(*rows.columns)
    made = [c for c in ("page_title", "has_page", "has_booking", "has_phone", "importance", "effort", "ratio", "status", "priority", "evidence", "actions") if c in rows.columns]
    return opportunities(with_pages(fresh.drop(*made), pages)).select(*rows.columns).unionByName(rest)


def target_keywords(found: DataFrame, pages: DataFrame) -> DataFrame:
    """url, keywords (sorted, distinct) of the priority pages that opportunities lead to, by their target, else their ranking page. pages: url, final_url, pos, priority_page."""
    index = page_index(pages.filter("priority_page"))
    asked = found.select("keyword", comparable_page(F.when(F.coalesce("target_url", F.lit("")) != "", F.col("target_url")).otherwise(F.col("url"))).alias("key"))
    return asked.join(index, "key").groupBy(index["url"]).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def keyword_count(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_distinct("keyword").alias("keywords"))


def distinct_seeds(pages: DataFrame) -> DataFrame:
    """keyword, ord: seeds of priority pages, each once, in order of pages and of a page's list. pages: pos, priority_page, keyword_seeds."""
    said = pages.filter("priority_page").select("pos", F.posexplode("keyword_seeds").alias("at", "keyword"))
    first = said.groupBy("keyword").agg(F.min(F.struct("pos", "at")).alias("first"))
    return first.select("keyword", F.col("first.pos").alias("pos"), F.col("first.at").alias("at"))


def normalized_keywords(values: Column) -> Column:
    """An array of keywords lower-cased, with single spaces, each once, in order; none empty."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(T.clean_text(v))), lambda v: v != ""))


# What reports show.


def current_view(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Current rankings in order, told in words. rows: opportunities; snapshots: keyword, grid_points, top_three, pos (the first with a grid counts)."""
    first = snapshots.filter("grid_points > 0").groupBy(F.col("keyword").alias("__k")).agg(F.min_by("top_three", "pos").alias("__top"))
    met = rows.join(first, F.col("keyword") == F.col("__k"), "left")
    organic = F.when(F.col("position") > 0, F.concat(F.lit("#"), F.col("position").cast("string"))).otherwise("not found in top 100")
    maps = F.when(~F.col("maps_checked"), "not checked").when(F.col("maps_position") > 0, F.concat(F.lit("#"), F.col("maps_position").cast("string"))).otherwise("not found in top 20")
    grid = F.when(F.col("__k").isNull(), "not run").otherwise(F.format_string("%.1f%%", F.col("__top")))
    return met.select("country_position", "keyword", "search_volume", organic.alias("organic"), maps.alias("maps"), grid.alias("grid"), "url").orderBy("country_position", "keyword")


def report_terms(rows: DataFrame, limit: int = 12) -> DataFrame:
    """Of rows (keyword, position, maps_position, search_volume, pos) the first of each keyword; the `limit` with most searches, ties by keyword."""
    first = rows.filter(F.trim("keyword") != "").groupBy("keyword").agg(F.min_by(F.struct("position", "maps_position", "search_volume"), "pos").alias("r")).select("keyword", "r.*")
    return first.orderBy(F.desc("search_volume"), "keyword").limit(limit).select("keyword", T.rank_label(F.col("position")).alias("organic"), T.rank_label(F.col("maps_position")).alias("maps"), "search_volume")


def report_opportunities(rows: DataFrame, limit: int = 8) -> DataFrame:
    return rows.orderBy(*opportunity_order()).limit(limit)


def report_rankings(rankings: DataFrame, limit: int = 10) -> DataFrame:
    return rankings.orderBy("position", F.desc("search_volume"), "keyword").limit(limit)


def priority_pages(pages: DataFrame, keywords: DataFrame, issues: DataFrame) -> DataFrame:
    """Priority pages with target keywords, those with most first: page, page_type, keywords, issues, conversion.
    pages: url, final_url, page_type, priority_page, booking, phone; keywords: of target_keywords; issues: of findings.page_issues."""
    address = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))
    met = pages.filter("priority_page").join(keywords, "url").join(issues, "url", "left")
    said = F.concat_ws(", ", *[F.concat(F.coalesce(p, F.lit(0)).cast("string"), F.lit(f" {p}")) for p in ("high", "medium", "low")])
    rows = met.select(address.alias("page"), "page_type", "keywords", said.alias("issues"), T.conversion_label(F.col("booking"), F.col("phone")).alias("conversion"))
    return rows.orderBy(F.desc(F.size("keywords")), "page")


def list_counts(rankings: DataFrame, current: DataFrame, fresh: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: how many rankings, current terms, opportunities and map checks there are."""
    named = {"existing_rankings": rankings, "current_terms": current, "opportunities": fresh, "maps_checks": snapshots}
    every = None
    for name, df in named.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        every = one if every is None else every.union(one)
    return every.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in named])


def page_counts(pages: DataFrame) -> DataFrame:
    """One row: pages, those that can be indexed, those with issues, page types. pages: indexable, issues, page_type."""
    return pages.agg(F.count("*").alias("pages"), F.count_if("indexable").alias("indexable"), F.count_if(F.col("issues") > 0).alias("with_issues"), F.count_distinct("page_type").alias("page_types"))


# Page types from outside.


def label_inputs(pages: DataFrame) -> DataFrame:
    """What a page is typed by: id, url, title, h1, schema_types, has_booking, has_phone, shortened. pages: id, url, final_url, title, h1, schema_types, booking_links, phone_links."""
    address = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))
    return pages.select("id", address.alias("url"), T.truncate(F.col("title"), 240).alias("title"), T.truncate_all(F.col("h1"), 3, 240).alias("h1"), T.truncate_all(F.sort_array("schema_types"), 10, 80).alias("schema_types"), (F.size("booking_links") > 0).alias("has_booking"), (F.size("phone_links") > 0).alias("has_phone"))


def labelled(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """inputs with page_type, reason, keyword_seeds, commercial. labels: id, type, reason, keyword_seeds, pos; of those with a known type the first of an id counts, others give 'unknown'."""
    good = labels.filter(F.col("type").isin(*PAGE_TYPES))
    first = good.groupBy("id").agg(F.min_by(F.struct("type", "reason", "keyword_seeds"), "pos").alias("l"))
    kind = F.coalesce("l.type", F.lit("unknown"))
    met = inputs.join(first, "id", "left")
    return met.withColumns({"page_type": kind, "reason": T.truncate(T.clean_text(F.coalesce("l.reason", F.lit(""))), 160), "keyword_seeds": F.coalesce(T.keyword_seeds(F.col("l.keyword_seeds")), F.array().cast("array<string>")), "commercial": kind.isin(*COMMERCIAL)}).drop("l")


def usage_totals(batches: DataFrame) -> DataFrame:
    """One row of tokens, cost and failed batches. batches: prompt_tokens, completion_tokens, cost, error."""
    return batches.agg(F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"), F.count("error").alias("failed"))
