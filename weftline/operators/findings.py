"""Rule catalogues as data: a row of features becomes the findings whose predicates hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import has_directive, is_article_type, is_html, priority_weight, skips_level

FINDING = ("category", "check", "status", "priority", "evidence")

# What to do about the finding of each check.
FIXES = {
    "Non-success response": "Return a successful response or link directly to the final valid URL.",
    "Redirect chain": "Replace multi-hop redirects with one direct redirect.",
    "Missing title": "Add one unique, descriptive title in the document head.",
    "Multiple titles": "Keep one title element in the document head.",
    "Long title": "Shorten the title if its important wording may be truncated.",
    "Short title": "Make the title more descriptive without padding it.",
    "Missing meta description": "Add a useful summary for search-result snippets.",
    "Multiple meta descriptions": "Keep one meta description.",
    "Long meta description": "Put the most useful information first and remove unnecessary wording.",
    "Short meta description": "Use the available snippet to explain the page clearly.",
    "Missing H1": "Add one clear main heading.",
    "Multiple H1s": "Use one clear main heading unless the document structure genuinely requires more.",
    "Skipped heading level": "Keep heading levels in a logical hierarchy.",
    "Missing canonical": "Add one absolute canonical for important indexable pages.",
    "Multiple canonicals": "Declare one consistent canonical.",
    "Nofollow directive": "Remove nofollow if crawlers should follow links on this page.",
    "Missing viewport": "Add a responsive viewport meta tag.",
    "Missing page language": "Set the html lang attribute.",
    "Images missing alt attribute": "Add descriptive alt text or an empty alt attribute for decorative images.",
    "Invalid JSON-LD": "Fix JSON syntax, then validate rich-result eligibility separately.",
    "Missing main landmark": "Wrap the primary content in a semantic main element.",
    "Very little visible text": "Review whether the page provides enough unique value for its purpose.",
    "Long page has no subheadings": "Break long content into descriptive sections that help readers scan and understand it.",
    "Very long paragraph": "Split the paragraph where the subject changes so the content is easier to scan.",
    "Article author not evident": "Show a real author or responsible organisation when authorship helps readers assess the content.",
    "Article date not evident": "Show a published or updated date when freshness matters to the topic.",
    "Long article has no external sources": "Review factual claims and link to useful primary sources where external evidence is appropriate.",
    "Mixed HTTP resource": "Load every resource and link target over HTTPS.",
    "Fetch failed": "Make the URL publicly reachable and return a valid response.",
    "Blocked by robots.txt": "Allow Googlebot to crawl the page if it should appear in search.",
    "Sitemap-only page": "Add a relevant internal link or remove the URL from the sitemap.",
    "Deep page": "Link important pages closer to the homepage.",
    "No internal inlinks": "Link to the page from a relevant indexable page.",
    "Non-success URL in sitemap": "Keep only successful canonical URLs in XML sitemaps.",
    "Non-indexable URL in sitemap": "Keep only canonical indexable URLs in XML sitemaps.",
    "Redirecting URL in sitemap": "Replace it with the final canonical URL.",
    "Canonical points to non-indexable URL": "Point the canonical to a successful indexable URL.",
    "URL parameters": "Confirm parameter URLs are intentional and controlled.",
    "Uppercase URL": "Use a consistent lowercase URL format.",
    "Underscore in URL": "Prefer readable hyphen-separated words for new URLs.",
    "Long URL": "Shorten the URL where this can be done safely.",
    "Broken internal link": "Update or remove the broken link.",
    "Internal link redirects": "Link directly to the final canonical URL.",
    "Nofollow internal link": "Remove nofollow unless there is a specific reason to prevent normal crawling.",
    "Empty internal anchor": "Give linked images alt text or add descriptive anchor text.",
    "Duplicate title": "Make each indexable page distinct or consolidate duplicates.",
    "Duplicate meta description": "Make each indexable page distinct or consolidate duplicates.",
    "Duplicate H1": "Make each indexable page distinct or consolidate duplicates.",
    "Exact duplicate content": "Make each indexable page distinct or consolidate duplicates.",
    "Near-duplicate content": "Consolidate the pages or make their purpose and content genuinely distinct.",
    "Hreflang target not crawled": "Use a successful canonical URL and ensure it is crawlable.",
    "Invalid hreflang target": "Point hreflang to a successful indexable canonical URL.",
    "Missing hreflang return link": "Add a reciprocal hreflang reference.",
    "Robots.txt unavailable": "Return a valid robots.txt or an intentional 404 without blocking crawlers.",
    "No XML sitemap found": "Add an XML sitemap when it would help search engines discover canonical URLs.",
    "Sitemap error": "Return valid XML sitemap files.",
    "Broken resource or external link": "Update or remove the failing URL.",
    "Large image": "Compress and resize the image, then serve a modern format where practical.",
    "Slow lab LCP": "Reduce server delay, render-blocking work, and time needed to load and paint the largest visible element.",
    "High lab CLS": "Reserve space for images and dynamic elements, and avoid inserting content above existing content.",
    "High lab TBT": "Reduce JavaScript execution and split long main-thread tasks.",
    "Slow lab TTFB": "Improve server response time, caching, redirects, and edge delivery.",
    "Heavy page transfer": "Compress and remove unnecessary scripts, styles, images, fonts, and third-party resources.",
    "Large JavaScript transfer": "Remove unused JavaScript, split bundles, and defer code that is not needed for initial rendering.",
    "Excessive page requests": "Remove unnecessary resources and consolidate requests where it improves loading.",
    "Large rendered DOM": "Simplify deeply nested or repeated markup and render nonessential interface elements only when needed.",
    "Rendered images missing dimensions": "Set explicit width and height or a stable aspect ratio so image loading does not shift content.",
    "Offscreen images not lazy-loaded": "Lazy-load below-the-fold images while loading the likely LCP image eagerly.",
    "Business status": "Confirm the listing status and correct it if the business is operating.",
    "Missing primary category": "Choose the most specific primary business category.",
    "Missing address": "Add the correct address or service area.",
    "Missing phone": "Add a customer contact number.",
    "Missing website": "Link the canonical business website.",
    "Missing hours": "Add current regular opening hours.",
    "No reviews": "Invite genuine customers to leave reviews.",
    "No photos": "Add representative business, team, and service photos.",
    "Business identity mismatch": "Confirm the selected Place ID and link the profile to the audited business website.",
}


def rule(category: str, check: str, status: str, priority, when: Column, evidence=None) -> Column:
    """A finding where `when` holds, else null."""
    priority = F.lit(priority) if isinstance(priority, str) else priority
    status = F.lit(status) if isinstance(status, str) else status
    said = F.lit("") if evidence is None else evidence.cast("string")
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(check).alias("check"), status.alias("status"), priority.alias("priority"), said.alias("evidence")))


def chain(*rules: tuple) -> Column:
    """Of rules given as (category, check, status, priority, when, evidence), the first that holds."""
    return F.coalesce(*[rule(*r) for r in rules])


def findings(rows: DataFrame, rules: list[Column], keys: list[str]) -> DataFrame:
    """One row per finding: the keys and FINDING. One scan, no shuffle, however many rules."""
    held = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select(*keys, F.inline(held))


def page_rules() -> list[Column]:
    """Checks 1 to 28 over the columns of extract.features with status_code, content_type, redirects, x_robots, indexable, final_url,
    external_links, schema_types, author (nulls count as absent)."""
    c = F.col
    ok = is_html(c("content_type"))
    title, words = F.length("title"), c("word_count")
    described = F.length("description")
    article = F.exists("schema_types", is_article_type) | urls.path(c("final_url")).rlike("(?i)^/*blog/+[^/]")
    insecure = F.filter(F.concat("resources", "external_links"), lambda u: u.startswith("http://"))
    live = c("indexable")
    html_rules = [
        chain(
            ("on-page", "Missing title", "fail", "high", ok & (c("title") == "")),
            ("on-page", "Multiple titles", "warn", "medium", ok & (F.size("titles") > 1), F.size("titles")),
            ("on-page", "Long title", "warn", "low", ok & (title > 60), title),
            ("on-page", "Short title", "warn", "low", ok & (title < 20), title),
        ),
        chain(
            ("on-page", "Missing meta description", "warn", "medium", ok & (c("description") == "")),
            ("on-page", "Multiple meta descriptions", "warn", "medium", ok & (F.size("descriptions") > 1), F.size("descriptions")),
            ("on-page", "Long meta description", "warn", "low", ok & (described > 160), described),
            ("on-page", "Short meta description", "warn", "low", ok & (described < 70), described),
        ),
        chain(("headings", "Missing H1", "fail", "high", ok & (F.size("h1") == 0)), ("headings", "Multiple H1s", "warn", "medium", ok & (F.size("h1") > 1), F.size("h1"))),
        rule("headings", "Skipped heading level", "warn", "low", ok & skips_level(c("heading_levels")), F.array_join(F.transform("heading_levels", lambda x: x.cast("string")), " ")),
        chain(("indexing", "Missing canonical", "warn", "medium", ok & (F.size("canonicals") == 0)), ("indexing", "Multiple canonicals", "fail", "high", ok & (F.size("canonicals") > 1), F.array_join("canonicals", ", "))),
        rule("indexing", "Nofollow directive", "warn", "medium", ok & (has_directive(c("robots"), "nofollow") | has_directive(c("x_robots"), "nofollow")), F.concat_ws(" ", "robots", "x_robots")),
        rule("mobile", "Missing viewport", "fail", "high", ok & ~c("has_viewport")),
        rule("accessibility", "Missing page language", "warn", "low", ok & (c("language") == "")),
        rule("images", "Images missing alt attribute", "warn", "medium", ok & (c("images_missing_alt") > 0), c("images_missing_alt")),
        rule("schema", "Invalid JSON-LD", "fail", "high", ok & (c("invalid_structured") > 0), c("invalid_structured")),
        rule("semantics", "Missing main landmark", "warn", "low", ok & ~c("has_main")),
        rule("content", "Very little visible text", "warn", "medium", ok & (words < 50) & live, words),
        rule("content-review", "Long page has no subheadings", "warn", "low", ok & live & (words >= 500) & (F.size("h2") == 0), words),
        rule("content-review", "Very long paragraph", "warn", "low", ok & live & (c("longest_paragraph") > 150), c("longest_paragraph")),
        rule("content-review", "Article author not evident", "warn", "low", ok & live & article & (c("author") == "")),
        rule("content-review", "Article date not evident", "warn", "low", ok & live & article & (c("published") == "") & (c("modified") == "")),
        rule("content-review", "Long article has no external sources", "warn", "low", ok & live & article & (words >= 500) & (F.size("external_links") == 0), words),
        rule("security", "Mixed HTTP resource", "fail", "high", ok & c("final_url").startswith("https://") & (F.size(insecure) > 0), F.try_element_at(insecure, F.lit(1))),
    ]
    status = c("status_code")
    return [
        rule("response", "Non-success response", "fail", "high", ~status.between(200, 299), status),
        rule("response", "Redirect chain", "warn", "medium", c("redirects") > 1, c("redirects")),
        *html_rules,
    ]


def url_rules(url: Column) -> list[Column]:
    """Checks 38 to 41. The length is in bytes."""
    p = urls.path(url)
    return [
        rule("url", "URL parameters", "warn", "low", urls.query(url) != "", urls.query(url)),
        rule("url", "Uppercase URL", "warn", "low", p != F.lower(p), p),
        rule("url", "Underscore in URL", "warn", "low", F.contains(p, F.lit("_")), p),
        rule("url", "Long URL", "warn", "low", F.octet_length(url) > 150, F.octet_length(url)),
    ]


def resource_rules() -> list[Column]:
    """Checks 57 and 58 over url, status, type, size, internal; a status of 0 (the request failed) says nothing."""
    c = F.col
    return [
        rule("resources", "Broken resource or external link", F.when(c("internal"), "fail").otherwise("warn"), F.when(c("internal"), "high").otherwise("low"), c("status") >= 400, c("status")),
        rule("resources", "Large image", "warn", "medium", c("internal") & c("type").startswith("image/") & (c("size") > 500 * 1024), c("size")),
    ]


def performance_rules() -> list[Column]:
    """Checks 59 to 68 over lcp, cls, tbt, ttfb, bytes, js_bytes, requests, dom_nodes, images_without_size, images_not_lazy."""
    c = F.col

    def over(name, check, least, worse):
        return rule("performance", check, "warn", F.when(c(name) > worse, "high").otherwise("medium"), c(name) > least, c(name))

    return [
        over("lcp", "Slow lab LCP", 2500, 4000),
        over("cls", "High lab CLS", 0.1, 0.25),
        over("tbt", "High lab TBT", 200, 600),
        rule("performance", "Slow lab TTFB", "warn", "medium", c("ttfb") > 800, c("ttfb")),
        rule("performance", "Heavy page transfer", "warn", "medium", c("bytes") > 2500 * 1024, c("bytes")),
        rule("performance", "Large JavaScript transfer", "warn", "low", c("js_bytes") > 500 * 1024, c("js_bytes")),
        rule("performance", "Excessive page requests", "warn", "low", c("requests") > 100, c("requests")),
        rule("performance", "Large rendered DOM", "warn", "low", c("dom_nodes") > 1500, c("dom_nodes")),
        rule("performance", "Rendered images missing dimensions", "warn", "low", c("images_without_size") > 0, c("images_without_size")),
        rule("performance", "Offscreen images not lazy-loaded", "warn", "low", c("images_not_lazy") > 0, c("images_not_lazy")),
    ]


def profile_rules() -> list[Column]:
    """Checks 69 to 76. Review and photo counts are null where the profile doesn't say, which is no finding."""
    c = F.col

    def absent(name):
        return F.coalesce(c(name), F.lit("")) == ""

    return [
        rule("profile", "Business status", "warn", "high", F.coalesce(c("business_status"), F.lit("")) != "OPERATIONAL", F.coalesce(c("business_status"), F.lit(""))),
        *[rule("profile", f"Missing {what}", "warn", "medium", absent(name)) for what, name in (("primary category", "category"), ("address", "address"), ("phone", "phone"), ("website", "website"))],
        rule("profile", "Missing hours", "warn", "medium", F.coalesce(F.size("hours"), F.lit(0)) <= 0),
        rule("profile", "No reviews", "warn", "low", F.coalesce(c("reviews") == 0, F.lit(False))),
        rule("profile", "No photos", "warn", "low", F.coalesce(c("photos") == 0, F.lit(False))),
    ]


def indexability(status, content_type, robots, x_robots, canonical, final_url) -> Column:
    """Why a page cannot be indexed, the first reason that holds; null if it can."""
    return (
        F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(~is_html(content_type), "non-HTML response")
        .when(has_directive(robots, "noindex") | has_directive(x_robots, "noindex"), "noindex directive")
        .when((canonical != "") & (urls.comparable_url(canonical) != urls.comparable_url(final_url)), "canonicalised to another URL")
    )


def other_indexability(status, x_robots) -> Column:
    """Can a response that is no HTML be indexed?"""
    return status.between(200, 299) & ~has_directive(F.coalesce(x_robots, F.lit("")), "noindex")


def identity_findings(verified: DataFrame) -> DataFrame:
    """Check 77: profiles (place_id, identity, evidence) that belong to another business."""
    rules = [rule("identity", "Business identity mismatch", "fail", "high", F.col("identity") == "mismatch", F.col("evidence"))]
    return findings(verified, rules, ["place_id"])


def with_fixes(found: DataFrame) -> DataFrame:
    """Findings with fix, what to do about their check; '' for others."""
    table = F.create_map(*[F.lit(x) for pair in FIXES.items() for x in pair])
    return found.withColumn("fix", F.coalesce(F.element_at(table, F.col("check")), F.lit("")))


def issue_groups(found: DataFrame) -> DataFrame:
    """Findings by priority, category, check and fix: how many, and address and evidence of the first in order of findings; in order of weight. found: FINDING, url."""
    said = F.trim(F.concat_ws(" ", "url", "evidence"))
    groups = with_fixes(found).groupBy("priority", "category", "check", "fix").agg(F.count("*").alias("n"), F.min_by(said, F.struct("url", "evidence")).alias("example"))
    return groups.orderBy(priority_weight(F.col("priority")), "category", "check")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(priority_weight(F.col("priority")), "check", "url", "evidence")


def page_issues(found: DataFrame) -> DataFrame:
    """Findings of each url by priority."""
    return found.groupBy("url").agg(*[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")])
