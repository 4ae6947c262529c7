"""The audit's workflows over tables: which steps there are, what each computes, and one entry that runs them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_html
from .functions.urls import comparable_url, crawl_url, host_key, path_of
from .operators import extract, findings, identity, market, performance, site, visibility
from .operators.site import saved
from .sources import payloads

# The workflows, and the bounds of a run.
STEPS = ("all", "website", "performance", "visibility", "backlinks", "profile")
LIMITS, TIMEOUTS = (1, 5000), (0.0, 120.0)
#: Marks before messages of a run, and the step that they belong to.
STAGES = {"places": "profile", **dict.fromkeys(("setup", "robots", "sitemaps", "crawl", "analysis", "resources"), "website"), "market": "visibility", **{s: s for s in ("performance", "visibility", "backlinks", "done")}}


def checked_options(steps: str = "all", limit: int | None = 50, timeout: float = 30.0) -> dict:
    """The options as they are, or an error that says which is wrong. A limit of None is none: the whole site."""
    if steps not in ("", *STEPS):
        raise ValueError(f"steps must be one of {', '.join(STEPS)}")
    if limit is not None and not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError(f"limit must be from {LIMITS[0]} to {LIMITS[1]}")
    if not TIMEOUTS[0] < timeout <= TIMEOUTS[1]:
        raise ValueError(f"timeout must be above {TIMEOUTS[0]:g} and at most {TIMEOUTS[1]:g} seconds")
    return {"steps": steps or "all", "limit": limit, "timeout": timeout}


def stage_of(message: str) -> str:
    """The step that a message of a run, '[mark] text', belongs to; '' for others."""
    m = re.match(r"\[([^\]]+)\]", message)
    return STAGES.get(m[1], "") if m else ""


class Step(NamedTuple):
    """One result of a run: the tables and results it is made of, in the order of `of`'s arguments after the options, and whether it is written once as several read it.
    Names with a ? may be absent and are None then; without one of the others there is no result."""

    needs: tuple[str, ...]
    of: Callable[..., DataFrame]
    shared: bool = False


class Options(NamedTuple):
    start_url: str = ""
    limit: int | None = 50
    place_id: str = ""
    max_checks: int | None = None
    external: bool = False
    brands: tuple[str, ...] = ()


def _told(found: DataFrame) -> DataFrame:
    return found.select("url", *findings.FINDING)


def _fetched(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Pages whose fetch did not fail: without an error, and of no more bytes than are read."""
    got = pages.join(responses.filter("error is null") if "error" in responses.columns else responses, "url")
    return got.filter(F.coalesce(F.octet_length("html"), F.lit(0)) <= extract.PAGE_BYTES)


def _facts(o: Options, pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Pages that were fetched with what their markup says, read against the address that they were found at. Markup of other content is not read."""
    none = F.lit("")
    got = _fetched(pages, responses).withColumnRenamed("url", "asked").withColumn("url", F.coalesce("final_url", "asked"))
    got = got.withColumns({"html": F.when(is_html(F.coalesce("content_type", none)), F.col("html")), "x_robots": F.coalesce("x_robots", none)})
    facts = extract.features(got).withColumns({
        "schema_types": F.col("metadata.schema_types"), "invalid_structured": F.col("metadata.invalid"), "structured_blocks": F.col("metadata.blocks"),
        "author": F.coalesce(F.nullif("meta_author", none), F.nullif("metadata.author", none), none),
        "published": F.coalesce(F.nullif("published", none), F.nullif("metadata.published", none), none),
        "modified": F.coalesce(F.nullif("modified", none), F.nullif("metadata.modified", none), none),
        "canonical": extract.canonical(F.col("canonicals"), F.col("link_header")),
    }).drop("metadata")
    html = is_html(F.coalesce("content_type", none))
    reason = findings.indexability(F.col("status_code"), F.col("content_type"), F.col("robots"), F.col("x_robots"), F.col("canonical"), F.col("final_url"))
    reason = F.when(html, reason).when(~findings.other_indexability(F.col("status_code"), F.col("x_robots")), "non-HTML response is not indexable")
    facts = facts.drop("url").withColumnRenamed("asked", "url").withColumns({"html_page": html, "indexability": reason, "key": crawl_url(F.col("url"))}).withColumn("indexable", F.col("indexability").isNull())
    return facts.drop("html")


def _links(o: Options, pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Links of fetched pages with the address that was asked for as `page`."""
    got = _fetched(pages, responses).filter(is_html(F.coalesce("content_type", F.lit(""))))
    return extract.anchors(got.select(F.col("url").alias("page"), F.coalesce("final_url", "url").alias("url"), "html"), keys=("page",))


def _crawl(o: Options, facts: DataFrame, links: DataFrame, responses: DataFrame, sitemap: DataFrame | None) -> DataFrame:
    """node, depth, rank (null: tried in vain) of the crawl from the start address, up to the limit if there is one, and limit_reached."""
    spark = facts.sparkSession
    edges = links.filter("internal").select(crawl_url(F.col("page")).alias("src"), F.col("target").alias("dst"), "pos")
    listed = sitemap.select(crawl_url(F.col("loc")).alias("node")) if sitemap is not None else spark.createDataFrame([], "node string")
    fetched = facts.select(F.col("key").alias("node"), crawl_url(F.coalesce("final_url", "url")).alias("final"), F.lit(True).alias("ok"))
    done = site.crawl_order(edges, spark.range(1).select(crawl_url(F.lit(o.start_url)).alias("node")), listed, fetched, o.limit)
    rows = done.pages.unionByName(done.failed.select("node", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("rank")))
    return rows.withColumn("limit_reached", F.lit(done.limit_reached))


def _crawled(o: Options, facts: DataFrame, crawl: DataFrame, links: DataFrame, sitemap: DataFrame | None, robots: DataFrame | None) -> DataFrame:
    """Pages of the crawl with depth, inlinks, what the sitemap lists and what Googlebot may read. robots: site, body."""
    rows = facts.join(crawl.filter("rank is not null").select(F.col("node").alias("key"), "depth", "rank", "limit_reached"), "key")
    if robots is not None:
        asked = rows.select(host_key(F.col("url")).alias("site"), F.lit("Googlebot").alias("agent"), path_of(F.col("url")).alias("path")).distinct()
        allowed = site.robots_access(site.robots_rules(robots.select("site", "body")), asked).select("site", "path", F.col("allowed").alias("robots_allowed"))
        rows = rows.withColumns({"site": host_key(F.col("url")), "path": path_of(F.col("url"))}).join(allowed, ["site", "path"], "left").drop("site", "path")
    else:
        rows = rows.withColumn("robots_allowed", F.lit(True))
    rows = rows.withColumn("robots_allowed", F.coalesce("robots_allowed", F.lit(True)))
    rows = rows.withColumns({"indexability": F.when(F.col("robots_allowed"), F.col("indexability")).otherwise("blocked by robots.txt"), "indexable": F.col("indexable") & F.col("robots_allowed")})
    listed = sitemap if sitemap is not None else rows.sparkSession.createDataFrame([], "loc string")
    rows = site.in_sitemap(rows.withColumn("final_url", F.coalesce("final_url", "url")), listed.select("loc"))
    compared = listed.select(comparable_url(F.col("loc")).alias("address"), F.lit(True).alias("in_sitemap_as_listed")).distinct()
    counted = links.filter("internal").join(rows.select(F.col("url").alias("page")), "page", "left_semi").select("page", comparable_url(F.col("target")).alias("address")).distinct().groupBy("address").agg(F.count("*").alias("inlinks"))
    rows = rows.withColumn("address", comparable_url(F.col("url"))).join(compared, "address", "left").join(counted, "address", "left")
    outer = links.filter("not internal").groupBy(F.col("page").alias("url")).agg(F.array_sort(F.collect_set("target")).alias("external_links"))
    booked = links.filter("booking").groupBy(F.col("page").alias("url")).agg(F.array_sort(F.collect_set("target")).alias("booking_links"))
    empty = F.array().cast("array<string>")
    rows = rows.join(outer, "url", "left").join(booked, "url", "left")
    return rows.withColumns({"inlinks": F.coalesce("inlinks", F.lit(0)), "in_sitemap_as_listed": F.coalesce("in_sitemap_as_listed", F.lit(False)), **{c: F.coalesce(c, empty) for c in ("external_links", "booking_links")}})


def _addresses(o: Options, crawled: DataFrame) -> DataFrame:
    """Each comparable address that a page was asked for or found at, with that page; of pages with one address the last that was fetched."""
    page = F.struct("rank", "address", "status_code", "redirects", "indexable")
    named = crawled.select(F.explode(F.array("address", comparable_url(F.col("final_url")))).alias("at"), page.alias("page"))
    return named.groupBy("at").agg(F.max("page").alias("page")).select("at", F.col("page.address").alias("key"), "page.status_code", "page.redirects", "page.indexable")


def _page_findings(o: Options, crawled: DataFrame) -> DataFrame:
    found = findings.findings(crawled, findings.page_rules(), ["url"])
    return found.unionByName(findings.findings(crawled.filter("html_page"), findings.url_rules(F.col("url")), ["url"]))


def _fetch_findings(o: Options, crawl: DataFrame, crawled: DataFrame, responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Checks 29 and 30."""
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    large = F.when(F.octet_length("html") > extract.PAGE_BYTES, f"page exceeds {extract.PAGE_BYTES} bytes")
    why = responses.join(pages.select("url", large.alias("large")), "url", "left").select(crawl_url(F.col("url")).alias("node"), F.coalesce(error, "large").alias("error")).dropDuplicates(["node"])
    lost = crawl.filter("rank is null").select("node").join(why, "node", "left").select(F.col("node").alias("url"), F.coalesce("error", F.lit("no response")).alias("error"), F.lit("").alias("path"), F.lit(True).alias("robots_allowed"))
    rows = lost.unionByName(crawled.select("url", F.lit(None).cast("string").alias("error"), path_of(F.col("url")).alias("path"), "robots_allowed"))
    return _told(findings.findings(rows, site.crawl_rules(), ["url"]))


def _structure_findings(o: Options, crawled: DataFrame) -> DataFrame:
    rows = crawled.withColumn("html", F.col("html_page"))
    found = findings.findings(rows, site.sitemap_rules(), ["url"])
    twice = site.duplicate_findings(rows).join(rows.select("key", "url"), "key")
    found = found.unionByName(twice.select("url", "category", "check", F.lit("warn").alias("status"), F.lit("medium").alias("priority"), F.concat(F.col("n").cast("string"), F.lit(" pages share it")).alias("evidence")))
    near = site.near_duplicate_findings(rows.withColumn("key", F.struct("rank", "url")))
    return found.unionByName(near.select("key.url", F.lit("content").alias("category"), F.lit("Near-duplicate content").alias("check"), F.lit("warn").alias("status"), F.lit("medium").alias("priority"), F.concat(F.col("evidence"), F.lit(" to "), F.col("other.url")).alias("evidence")))


def _link_findings(o: Options, crawled: DataFrame, addresses: DataFrame, links: DataFrame) -> DataFrame:
    own = links.filter("internal").join(crawled.select(F.col("url").alias("page")), "page", "left_semi")
    marked = own.select(F.col("page").alias("src"), comparable_url(F.col("target")).alias("dst"), "nofollow", F.col("text").alias("anchor"))
    return _told(site.link_findings(marked, addresses.select(F.col("at").alias("key"), "status_code", "redirects")).withColumnRenamed("src", "url"))


def _canonical_findings(o: Options, crawled: DataFrame, addresses: DataFrame) -> DataFrame:
    """Check 37."""
    asked = crawled.filter("indexable and canonical <> ''").select("url", "canonical", comparable_url(F.col("canonical")).alias("at"))
    bad = asked.join(addresses, "at").filter(~F.col("indexable") | ~F.col("status_code").between(200, 299))
    return bad.select("url", F.lit("canonical").alias("category"), F.lit("Canonical points to non-indexable URL").alias("check"), F.lit("fail").alias("status"), F.lit("high").alias("priority"), F.col("canonical").alias("evidence"))


def _hreflang_findings(o: Options, crawled: DataFrame, addresses: DataFrame) -> DataFrame:
    """Checks 51 to 53 between pages, whichever of their addresses is named."""
    named = crawled.select(F.col("address").alias("src"), F.explode("hreflang").alias("h")).select("src", comparable_url(F.col("h.url")).alias("at"), F.col("h.language").alias("language"))
    links = named.join(addresses.select("at", "key"), "at", "left").select("src", F.coalesce("key", "at").alias("dst"), "language")
    found = site.hreflang_findings(links, addresses.select("key", "status_code", "indexable").distinct())
    return _told(found.join(crawled.select(F.col("address").alias("src"), "url").dropDuplicates(["src"]), "src"))


def _file_findings(o: Options, robots: DataFrame | None, sitemap_errors: DataFrame | None) -> DataFrame | None:
    """Checks 54 to 56. robots: site, status; sitemap_errors: error, sources."""
    found = []
    if robots is not None:
        found.append(findings.findings(robots.select(F.concat(F.lit("https://"), F.col("site"), F.lit("/robots.txt")).alias("url"), F.col("status").alias("robots_status")), site.robots_file_rules(), ["url"]))
    if sitemap_errors is not None:
        found.append(findings.findings(sitemap_errors.withColumn("url", F.lit("")), site.sitemap_error_rules(), ["url"]))
    return reduce(DataFrame.unionByName, found) if found else None


def _resource_findings(o: Options, crawled: DataFrame, resources: DataFrame) -> DataFrame:
    """Checks 57 and 58 for what the crawled pages use. resources: url, status, type, size."""
    wanted = site.resource_targets(crawled, F.lit(o.start_url), o.external)
    rows = resources.join(wanted, "url", "left_semi").withColumn("internal", host_key(F.col("url")) == host_key(F.lit(o.start_url)))
    return findings.findings(rows, findings.resource_rules(), ["url"])


def _performance(o: Options, crawled: DataFrame, perf_samples: DataFrame) -> DataFrame:
    """Samples of the pages that are measured: the root and the largest sections'."""
    chosen = performance.select_pages(crawled.select(F.col("final_url").alias("url"), "status_code", "content_type", "indexable", "depth"))
    return perf_samples.join(chosen.select("url"), "url", "left_semi")


def _opportunities(o: Options, candidates: DataFrame, organic: DataFrame, maps: DataFrame, grid: DataFrame | None, pages_seen: DataFrame) -> DataFrame:
    """Checked candidates; where a grid was measured (keyword, position, failed), worked out anew with it."""
    short = market.shortlist(candidates, market.check_limit(o.max_checks))
    items = payloads.maps(maps, o.place_id, "keyword")
    places = items.filter("is_target").groupBy("keyword").agg(F.max_by("position", "ord").alias("target_position"))
    answered = payloads.answers(maps, payloads.MAPS).filter("error is null").select("keyword").distinct()
    snapshots = answered.join(places, "keyword", "left").select("keyword", F.coalesce("target_position", F.lit(0)).alias("target_position"), F.lit(0).alias("grid_points"), F.lit(0.0).alias("top_three"))
    rows = visibility.checked(short, payloads.organic(organic, o.start_url, "keyword"), snapshots, pages_seen)
    if grid is None:
        return rows
    chosen = visibility.select_grids(rows.filter("source = 'current-ranking'").withColumn("ord", F.col("relevance")), rows.filter("source <> 'current-ranking'").withColumn("ord", F.col("relevance")), o.brands, snapshots)
    measured = market.grid_summary(grid.join(chosen.select("keyword"), "keyword", "left_semi"), ["keyword"])
    return visibility.with_grids(rows, measured.select("keyword", F.col("checked").alias("points"), "top_three"), pages_seen)


def _profile_findings(o: Options, profiles: DataFrame) -> DataFrame:
    return findings.findings(profiles.withColumn("url", F.coalesce("website", F.lit(""))), findings.profile_rules(), ["url"])


def _identity(o: Options, profiles: DataFrame, crawled: DataFrame | None, hosts: DataFrame | None, phones: DataFrame | None) -> DataFrame | None:
    """Whether profiles belong to the audited site: by its pages' hosts and phones, else by given ones (site, host; site, phone)."""
    if crawled is not None:
        audited = identity.audited_hosts(F.lit(o.start_url), crawled)
        # All profiles are asked about the one site.
        own = profiles.withColumn("site", F.lit(0))
        return identity.verify(own, audited.select(F.lit(0).alias("site"), "host"), crawled.select(F.lit(0).alias("site"), F.explode("phone_links").alias("phone")))
    return identity.verify(profiles, hosts, phones) if hosts is not None and phones is not None else None


def _identity_findings(o: Options, profiles: DataFrame, identity: DataFrame) -> DataFrame:
    """Check 77."""
    found = findings.identity_findings(identity).join(profiles.select("place_id", F.coalesce("website", F.lit("")).alias("url")), "place_id")
    return _told(found)


#: Every result of a run by name. A run computes what its workflow asks for and what that is made of, each once.
GRAPH = {
    "facts": Step(("pages", "responses"), _facts, True),
    "links": Step(("pages", "responses"), _links, True),
    "crawl": Step(("facts", "links", "responses", "sitemap?"), _crawl, True),
    "crawled": Step(("facts", "crawl", "links", "sitemap?", "robots?"), _crawled, True),
    "addresses": Step(("crawled",), _addresses, True),
    "page_findings": Step(("crawled",), _page_findings),
    "fetch_findings": Step(("crawl", "crawled", "responses", "pages"), _fetch_findings),
    "structure_findings": Step(("crawled",), _structure_findings),
    "link_findings": Step(("crawled", "addresses", "links"), _link_findings),
    "canonical_findings": Step(("crawled", "addresses"), _canonical_findings),
    "hreflang_findings": Step(("crawled", "addresses"), _hreflang_findings),
    "file_findings": Step(("robots?", "sitemap_errors?"), _file_findings),
    "resource_findings": Step(("crawled", "resources"), _resource_findings),
    "measured": Step(("crawled", "perf_samples"), _performance, True),
    "perf_summary": Step(("measured",), lambda o, measured: performance.summary(measured)),
    "performance_findings": Step(("measured",), lambda o, measured: findings.findings(measured, findings.performance_rules(), ["url"])),
    "opportunities": Step(("candidates", "organic", "maps", "grid?", "pages_seen"), _opportunities, True),
    "target_keywords": Step(("opportunities", "pages_seen"), lambda o, found, seen: visibility.target_keywords(found, seen)),
    "backlinks_summary": Step(("backlinks",), lambda o, backlinks: payloads.backlinks(backlinks)),
    "profile_findings": Step(("profiles",), _profile_findings),
    "identity": Step(("profiles", "crawled?", "hosts?", "phones?"), _identity, True),
    "identity_findings": Step(("profiles", "identity"), _identity_findings),
}
WEBSITE = ("crawled", "links", "crawl", "page_findings", "fetch_findings", "structure_findings", "link_findings", "canonical_findings", "hreflang_findings", "file_findings", "resource_findings")
#: What each workflow gives.
WORKFLOWS = {
    "website": (*WEBSITE, "identity", "identity_findings"),
    "performance": (*WEBSITE, "perf_summary", "performance_findings"),
    "visibility": (*WEBSITE, "opportunities", "target_keywords"),
    "backlinks": ("backlinks_summary",),
    "profile": ("profile_findings", "identity", "identity_findings"),
}
WORKFLOWS["all"] = tuple(dict.fromkeys(name for results in WORKFLOWS.values() for name in results))


def audit(spark: SparkSession, tables: dict[str, DataFrame], steps: str = "all", limit: int | None = 50, start_url: str = "", place_id: str = "", max_checks: int | None = None, external: bool = False, brands: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Runs a workflow over what was collected: its results by name, findings of all kinds as `findings` (with fix, in order) and `issues` (their groups).

    limit: pages that are crawled, within LIMITS as the command line has it; None takes all there are.
    Results whose tables are missing are left out; a site without a sitemap or robots file is crawled without. Tables: pages (url, html); responses (url, final_url,
    status_code, content_type, redirects, x_robots, link_header, error if there are failures); sitemap (loc); sitemap_errors (error, sources); robots (site, body, status); resources
    (url, status, type, size); perf_samples (url, metrics); candidates, organic and maps (keyword, payload), grid (keyword, position, failed), pages_seen (url, final_url, pos, title,
    booking, phone, priority_page); backlinks (payload); profiles, hosts (site, host), phones (site, phone)."""
    steps = checked_options(steps, limit)["steps"]
    options = Options(start_url, limit, place_id, max_checks, external, brands)
    known: dict[str, DataFrame | None] = dict(tables)

    def get(name: str) -> DataFrame | None:
        wanted = name.rstrip("?")
        if wanted not in known:
            known[wanted] = None
            if step := GRAPH.get(wanted):
                parts = [get(n) for n in step.needs]
                if all(p is not None or n.endswith("?") for p, n in zip(parts, step.needs)):
                    made = step.of(options, *parts)
                    known[wanted] = saved(made) if step.shared and made is not None else made
        return known[wanted]

    if steps == "profile":
        known["crawled"] = None  # a profile alone is held against given hosts and phones
    out = {name: df for name in WORKFLOWS[steps] if (df := get(name)) is not None}
    found = [_told(out.pop(name)) for name in list(out) if name.endswith("_findings")]
    if found:
        every = reduce(DataFrame.unionByName, found)
        if "crawled" in out:
            out["pages"] = out["crawled"].orderBy("url")
        out["findings"] = findings.ordered(findings.with_fixes(every))
        out["issues"] = findings.issue_groups(every)
    if {"crawled", "findings"} <= out.keys():
        rows = out["crawled"]
        edges = out["links"].join(rows.select(F.col("url").alias("page")), "page", "left_semi").select(F.col("target").alias("dst"), "internal")
        out["summary"] = site.summary(rows, edges, out["findings"])
    return out
