"""The results of an audit as lines of text, for a console: one table of (place, line), put together from the result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import clean_text, rank_label
from .operators import visibility

#: Places between sections, so that lines of one stay together.
GAP = 1_000_000


def _lines(section: int, df: DataFrame, line: Column, place: Column | None = None) -> DataFrame:
    return df.select((F.lit(section * GAP) + (F.lit(0) if place is None else place)).cast("long").alias("place"), line.alias("line"))


def _numbered(df: DataFrame, *order) -> DataFrame:
    """A short list with its places; it is short as it holds groups or the first rows of a list."""
    return df.withColumn("__place", F.row_number().over(Window.orderBy(*order)))


def lines(results: dict[str, DataFrame], start_url: str) -> DataFrame:
    """place, line of the report on what `audit` gave, in order: head, performance, whether the limit was reached, issues, opportunities, backlinks, profile checks. What was not run has no lines.

    Only counts, groups and the first opportunities are listed, so the table is small however many pages there are."""
    spark = next(iter(results.values())).sparkSession
    one = spark.range(1)
    out = [_lines(0, one, F.lit(f"SEO audit: {start_url}"))]
    if "summary" in results:
        s = results["summary"]
        out.append(_lines(1, s, F.format_string("Crawled: %d URLs (%d indexable, %d non-indexable)", "pages", "indexable", "non_indexable")))
        out.append(_lines(2, s, F.format_string("Discovered: %d internal links, %d external links, %d sitemap URLs", "internal_links", "external_links", "sitemap_urls")))
        out.append(_lines(3, s, F.format_string("Actions: %d failures, %d warnings", "failures", "warnings")))
    if "perf_summary" in results:
        p = results["perf_summary"].filter("pages > 0")
        out.append(_lines(4, p, F.format_string("Performance: %d pages measured; worst LCP %.2fs, CLS %.3f, TBT %.0fms, TTFB %.0fms", "pages", F.col("worst_lcp") / 1000, "worst_cls", "worst_tbt", "worst_ttfb")))
    if "crawl" in results:
        reached = results["crawl"].filter("limit_reached").limit(1)
        out.append(_lines(5, reached, F.lit("Warning: crawl limit reached; rerun with a higher limit for complete coverage.")))
    if "issues" in results:
        groups = results["issues"]
        out.append(_lines(6, groups.limit(1), F.lit("PRIORITY\tAREA\tISSUE\tOCCURRENCES\tEXAMPLE\tFIX")))
        weight = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
        told = _numbered(groups, weight, "category", "check", "fix")
        out.append(_lines(7, told, F.concat_ws("\t", F.upper("priority"), "category", "check", F.col("n").cast("string"), clean_text(F.col("example")), clean_text(F.col("fix"))), F.col("__place")))
        none = groups.agg(F.count("*").alias("n")).filter("n = 0")
        out.append(_lines(7, none, F.lit("No deterministic issues found in the public crawl.")))
    if "opportunities" in results:
        first = _numbered(visibility.report_opportunities(results["opportunities"]), "priority", F.desc("ratio"), F.desc("search_volume"), "keyword")
        out.append(_lines(8, first, F.concat_ws("\t", F.lit("OPPORTUNITY"), "keyword", rank_label(F.col("position")), "status", "evidence"), F.col("__place")))
    if "backlinks_summary" in results:
        b = _numbered(results["backlinks_summary"], "error")
        good = F.format_string("Backlinks: %d links from %d domains | %d referring pages | rank %d | spam score %d", "backlinks", "referring_domains", "referring_pages", "rank", "backlinks_spam_score")
        out.append(_lines(9, b, F.when(F.col("error").isNotNull(), F.concat(F.lit("Backlinks: unavailable ("), F.col("error"), F.lit(")"))).otherwise(good), F.col("__place")))
    if "identity" in results:
        by = _numbered(results["identity"].groupBy("identity").agg(F.count("*").alias("n")), "identity")
        out.append(_lines(10, by, F.concat(F.lit("Business identity "), F.col("identity"), F.lit(": "), F.col("n").cast("string")), F.col("__place")))
    return reduce(DataFrame.unionByName, out).orderBy("place")
