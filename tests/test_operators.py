from pyspark.sql import functions as F

from weftline.operators import extract, findings, identity, market, performance, site, store
from weftline.plans.queries import QUERIES
from weftline.sources import files
from weftline.sources.tables import derived

PAGE = """<!DOCTYPE html><html lang="en-GB"><head><title>Dental implants in London | Smile Clinic</title><meta name="description" content="A useful summary">
<meta name=viewport content="width=device-width"><link rel="canonical" href="https://x.example/implants"><meta property="article:published_time" content="2026-01-02">
<script type="application/ld+json">{"@type":"Article","author":{"name":"Ann Lee"}}</script></head><body><main><article><h1>Dental implants</h1><h3>Cost</h3>
<p>One two three four five.</p><a href="/a">A &amp; b</a><a href="/book-now">Book</a><a href="tel:+44 20 7946 0123">Call</a><a href="http://y.example/z" rel="nofollow">Y</a><img src="/i.png"><img src="/j.png" alt=""></article></main></body></html>"""


def page(spark, html=PAGE):
    return spark.createDataFrame([("https://x.example/implants", html)], "url string, html string")


def test_features(spark):
    f = extract.features(page(spark)).first()
    assert f.language == "en-GB" and f.title == "Dental implants in London | Smile Clinic" and f.h1 == ["Dental implants"] and f.heading_levels == [1, 3]
    assert f.has_main and f.has_article and f.has_viewport and f.canonicals == ["https://x.example/implants"] and f.published == "2026-01-02"
    assert f.image_count == 2 and f.images_missing_alt == 1 and f.images_empty_alt == 1 and f.phone_links == ["+44 20 7946 0123"]
    assert f.paragraph_count == 1 and f.first_paragraph.startswith("One two three four five.")
    assert extract.features(page(spark, None)).first().word_count == 0


def test_links(spark):
    rows = {r.target: r for r in extract.anchors(page(spark)).collect()}
    assert rows["https://x.example/a"].text == "A & b" and rows["https://x.example/a"].internal
    assert rows["https://x.example/book-now"].booking and rows["http://y.example/z"].nofollow and not rows["http://y.example/z"].internal


def test_metadata(spark):
    m = extract.features(page(spark)).first().metadata
    assert (m.blocks, m.invalid, m.schema_types, m.author) == (1, 0, ["Article"], "Ann Lee")


def test_page_rules(spark):
    facts = extract.features(page(spark)).withColumns({"status_code": F.lit(200), "redirects": F.lit(0), "content_type": F.lit("text/html"), "indexable": F.lit(True), "x_robots": F.lit(""), "final_url": F.col("url"), "external_links": F.array(F.lit("http://y.example/z")), "schema_types": F.array(F.lit("Article")), "author": F.lit(""), "invalid_structured": F.lit(0)})
    found = {r.check for r in findings.findings(facts, findings.page_rules(), ["url"]).collect()}
    assert found == {"Short meta description", "Skipped heading level", "Images missing alt attribute", "Very little visible text", "Article author not evident", "Mixed HTTP resource"}
    pdf = facts.withColumns({"content_type": F.lit("application/pdf"), "status_code": F.lit(404), "redirects": F.lit(2)})
    assert {r.check for r in findings.findings(pdf, findings.page_rules(), ["url"]).collect()} == {"Non-success response", "Redirect chain"}


def test_indexability(spark):
    df = spark.sql("select * from values (404, 'text/html', '', ''), (200, 'a/pdf', '', ''), (200, 'text/html', 'noindex', ''), (200, 'text/html', '', 'https://x.example/b'), (200, 'text/html', '', 'https://X.example/a/') t(s, c, r, k)")
    got = [r[0] for r in df.select(findings.indexability(F.col("s"), F.col("c"), F.col("r"), F.lit(""), F.col("k"), F.lit("https://x.example/a"))).collect()]
    assert got == ["HTTP 404", "non-HTML response", "noindex directive", "canonicalised to another URL", None]


def test_robots(spark):
    def ask(body, compat=False):
        f = spark.createDataFrame([("s", body)], "site string, body string")
        q = spark.createDataFrame([("s", "GPTBot", "/"), ("s", "Googlebot", "/")], "site string, agent string, path string")
        return {r.agent: r.allowed for r in site.robots_access(site.robots_rules(f), q, compat).collect()}

    assert ask("User-agent: GPTBot\nDisallow: /\nUser-agent: *\nAllow: /") == {"GPTBot": False, "Googlebot": True}
    only = "User-agent: GPTBot\nDisallow: /"
    assert ask(only) == {"GPTBot": False, "Googlebot": True}
    assert ask(only, compat=True) == {"GPTBot": False, "Googlebot": False}


def test_near_duplicates_at_the_threshold(spark):
    base = [f"w{i}" for i in range(19)]
    rows = [(1, "a", base), (2, "b", base[:18] + ["x"]), (3, "c", base + ["y"]), (4, "d", base), (5, "a", base)]
    got = {(r.left, r.right): round(r.similarity, 6) for r in site.near_duplicates(spark.createDataFrame(rows, "key int, hash string, tokens array<string>")).collect()}
    assert got == {(1, 2): 0.9, (2, 4): 0.9, (2, 5): 0.9, (1, 3): 0.95, (3, 4): 0.95, (3, 5): 0.95, (1, 4): 1.0, (4, 5): 1.0}


def test_depths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 3)], "src long, dst long")
    assert {r.node: r.depth for r in site.depths(edges, spark.range(1).withColumnRenamed("id", "node"), 2).collect()} == {0: 0, 1: 1, 2: 2}


def test_depths_beyond_six(spark, tmp_path):
    """Pages 0 to 2499 link to three times their id and on; found by a plain search."""
    spark.range(2500).selectExpr("id page_id", "'u' url", "'' html").write.parquet(str(tmp_path / "pages.parquet"))
    links = {}
    for r in derived(spark, str(tmp_path), "site_edges").select("src", "dst").collect():
        links.setdefault(r.src, set()).add(r.dst)
    want, front, depth = {0: 0}, {0}, 0
    while front:
        depth += 1
        front = {d for s in front for d in links.get(s, ())} - set(want)
        want |= dict.fromkeys(front, depth)
    assert max(want.values()) > 6
    got = {r.node: r.depth for r in QUERIES["q_bfs_depth"](spark, str(tmp_path)).collect()}
    assert got == want


def test_grid(spark):
    points = spark.createDataFrame([("a", p, False) for p in range(1, 10)] + [("b", 1, False), ("b", 5, False), ("b", 0, False)] + [("b", 0, True)] * 6 + [("c", 0, True)], "k string, position int, failed boolean")
    got = {r.k: tuple(r)[1:] for r in market.grid_summary(points, ["k"]).collect()}
    assert got == {"a": (9, 0, 33.3, 100.0, 5), "b": (3, 6, 33.3, 66.7, 5), "c": (0, 1, 0.0, 0.0, 0)}
    grid = market.geo_grid(spark.createDataFrame([(1, 51.5, -0.1)], "key int, latitude double, longitude double")).orderBy("point").collect()
    assert len(grid) == 9 and (grid[4].latitude, grid[4].longitude) == (51.5, -0.1) and grid[0].latitude < 51.5 and grid[0].longitude < -0.1


def test_site_candidates(spark):
    items = spark.createDataFrame([("Dentist  London", 100, 0.0, 1), ("smile clinic", 50, 1.0, 2), ("how to floss", 90, 1.0, 3), ("teeth whitening", 40, 2.0, 4), ("plumber", 10, 1.0, 5), ("teeth", 10, 0.0, 6)], "keyword string, search_volume int, cpc double, ord int")
    pages = spark.createDataFrame([("https://smile.example/teeth-whitening", "Dentist", ["Teeth"], "service", True), ("https://smile.example/blog/plumber", "Plumber", ["x"], "blog", True)], "url string, title string, h1 array<string>, page_type string, indexable boolean")
    terms = market.context_terms(pages, "dentist", "London, United Kingdom")
    got = [r.keyword for r in market.site_candidates(items, terms, "london", ("smileclinic", "smile")).orderBy("relevance").collect()]
    assert got == ["dentist london", "teeth whitening"]


def test_sessions(spark):
    rows = [(1, t, 1.0) for t in (500, 1000, 1900, 2800, 3700, 4600, 5450, 5600)] + [(2, 0, 1.0), (2, 10, 2.0), (2, 2000, 2.5)]
    df = spark.createDataFrame(rows, "k int, at long, v double")
    assert {r.k: r.worst for r in performance.capped_sessions(df, "k", "at", "v", 1000, 5000).collect()} == {1: 7.0, 2: 2.5}


def test_identity(spark):
    p = spark.createDataFrame([("a", 1, "https://shop.x.example", ""), ("b", 1, "https://y.example", "020 7946 0123"), ("c", 1, "", "+44 20 7946 0123"), ("d", 1, "", "020 1111 2222"), ("e", 2, "", "020 1111 2222"), ("f", 1, "", "")], "place_id string, site int, website string, phone string")
    hosts = spark.createDataFrame([(1, "x.example")], "site int, host string")
    phones = spark.createDataFrame([(1, "020 7946 0123"), (2, "123")], "site int, phone string")
    got = {r.place_id: r.identity for r in identity.verify(p, hosts, phones).collect()}
    assert got == {"a": "matched", "b": "mismatch", "c": "matched", "d": "mismatch", "e": "unverified", "f": "unverified"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"], "v").collect()) == [(1, 1, "c"), (2, 5, "b"), (3, 1, "e")]


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("s.xml", "<urlset><url><loc> https://x.example/a?b&amp;c </loc></url></urlset>"), ("i.xml", "<sitemapindex><sitemap><loc>s.xml</loc></sitemap></sitemapindex>")], "url string, body string")
    assert sorted((r.kind, r.loc) for r in files.sitemap_urls(docs).collect()) == [("page", "https://x.example/a?b&c"), ("sitemap", "s.xml")]
    place = spark.createDataFrame([('{"id":"p","displayName":{"text":"N"},"userRatingCount":0,"addressComponents":[{"longText":"London","types":["locality"]},{"longText":"United Kingdom","types":["country"]}]}',)], "payload string")
    r = files.places(place).first()
    assert (r.place_id, r.market, r.reviews, r.photos) == ("p", "London, United Kingdom", 0, None)
    found = {x.check for x in findings.findings(files.places(place), findings.profile_rules(), ["place_id"]).collect()}
    assert found == {"Business status", "Missing primary category", "Missing address", "Missing phone", "Missing website", "Missing hours", "No reviews"}
    files.write_report(docs, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_agents(spark):
    rules = site.robots_rules(spark.createDataFrame([("s", "User-agent: *\nDisallow: /x\nUser-agent: GPTBot\nDisallow: /")], "site string, body string"))
    got = {r.agent: r.allowed for r in site.agents_access(rules, spark.createDataFrame([("s",), ("t",)], "site string"), "/a").filter("site = 's'").collect()}
    assert got == {a: a != "GPTBot" for a in site.AGENTS} and site.agents_access(rules, spark.createDataFrame([("t",)], "site string")).filter("allowed").count() == len(site.AGENTS)


def test_options():
    import pytest

    from weftline import audit

    assert audit.checked_options("", 1, 120)["steps"] == "all" and audit.STEPS[1:] == ("website", "performance", "visibility", "backlinks", "profile")
    for bad in ({"steps": "map"}, {"limit": 0}, {"limit": 5001}, {"timeout": 0}, {"timeout": 121}):
        with pytest.raises(ValueError):
            audit.checked_options(**bad)
    assert [audit.stage_of(m) for m in ("[crawl] x", "[market] y", "[places]", "[done]", "[odd] z", "crawl", "[]")] == ["website", "visibility", "profile", "done", "", "", ""]
    assert [market.check_limit(n) for n in (None, 0, 5, 50)] == [8, 8, 5, 10]


def test_links_are_resolved(spark):
    from urllib.parse import urljoin

    from weftline.functions import urls

    bases = ["https://x.example/a/b/c?q=1", "https://x.example", "https://x.example/a/"]
    refs = ["d.html", "../t", "./u/", "../../../v", "/r/../s", "?k=2", "//y.example/z", "http://w.example/", "e/../f?g=../h#i", "..", ".", "/"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u"))
    for row in df.collect():
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


def test_sitemaps_unzip(spark):
    import gzip

    body = b"<urlset><url><loc> https://x.example/?a=1&amp;b=2 </loc></url></urlset>"
    rows = [("https://x.example/s.xml.gz", gzip.compress(body), ""), ("https://x.example/t", gzip.compress(body), "application/x-GZIP"), ("https://x.example/u", body, "text/xml"), ("https://x.example/bad.gz", b"no", "")]
    docs = spark.createDataFrame(rows, "url string, raw binary, kind string").select("url", files.unpacked(F.col("raw"), F.col("url"), F.col("kind")).alias("body"))
    got = {r.source: r.loc for r in files.sitemap_urls(docs).collect()}
    assert got == {u: "https://x.example/?a=1&b=2" for u, *_ in rows[:3]}


def test_sitemaps_are_read_as_xml(spark):
    """Prefixes, comments, character data and both kinds in one document; what is no XML tells nothing and is an error."""
    bodies = [
        '<s:urlset xmlns:s="u"><!-- <s:url><s:loc>no</s:loc></s:url> --><s:url><s:loc> a?x=1&amp;y=2 </s:loc><i:image xmlns:i="v"><i:loc>img</i:loc></i:image></s:url><s:url><s:loc><![CDATA[b/<c>]]></s:loc></s:url></s:urlset>',
        "<x><url><loc>p</loc></url><url><lastmod>1</lastmod></url><sitemap><loc>q</loc></sitemap></x>", "<urlset><url><loc>cut</loc></url><url><lo", "not xml", "", None, "<urlset/>", "<urlset><url><loc>" + "y" * files.SITEMAP_BYTES + "</loc></url></urlset>",
    ]
    docs = spark.createDataFrame([(f"d{i}", b) for i, b in enumerate(bodies)], "url string, body string")
    assert {tuple(r) for r in files.sitemap_urls(docs).collect()} == {("d0", "page", "a?x=1&y=2"), ("d0", "page", "b/<c>"), ("d1", "page", "p"), ("d1", "sitemap", "q")}
    read = spark.createDataFrame([("s", f"d{i}") for i in range(9)], "site string, url string")
    assert {r.url: r.sources for r in files.sitemap_errors(read, docs).collect()} == {f"d{i}": 9 for i in (2, 3, 4, 5, 7, 8)}


def test_sitemap_walk_is_a_queue(spark):
    docs = spark.createDataFrame([(f"s{i}", f"<sitemapindex><sitemap><loc>s{i + 2}</loc></sitemap><sitemap><loc>s{i + 1}</loc></sitemap></sitemapindex>" if i < 60 else "<urlset><url><loc>p</loc></url></urlset>") for i in range(70)], "url string, body string")
    read, pages = files.sitemap_walk(docs, spark.createDataFrame([("a", "s0"), ("b", "s60")], "site string, url string"), 25)
    assert [r.url for r in read.filter("site = 'a'").orderBy("place").collect()][:6] == ["s0", "s2", "s1", "s4", "s3", "s6"]
    assert read.filter("site = 'a'").count() == 25 and [r.loc for r in pages.collect()] == ["p"]


def test_report_text(spark):
    assert files.report_text(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1,"b":null}'


def test_workflow_finds_what_the_rules_say(spark):
    from weftline import audit

    pages = spark.createDataFrame([("https://x.example/", "<title>T</title><a href=a>A</a><a href='gone.html'></a>"), ("https://x.example/a", "<title>T</title>"), ("https://x.example/gone.html", "x"), ("https://x.example/lone", "<title>Lone</title>")], "url string, html string")
    responses = pages.select("url", F.col("url").alias("final_url"), F.when(F.col("url").endswith("html"), 404).otherwise(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(0).alias("redirects"), F.lit("").alias("x_robots"), F.lit("").alias("link_header"))
    out = audit.audit(spark, {"pages": pages, "responses": responses, "sitemap": pages.select(F.col("url").alias("loc"))}, "website", 50, "https://x.example/")
    found = {(r.url.split("example")[1], r.check) for r in out["findings"].collect()}
    assert {("/", "Broken internal link"), ("/", "Empty internal anchor"), ("/", "Duplicate title"), ("/a", "Duplicate title"), ("/gone.html", "Non-success response"), ("/lone", "Sitemap-only page"), ("/gone.html", "Non-success URL in sitemap")} <= found
    assert {r.url.split("example")[1]: r.depth for r in out["crawled"].collect()} == {"/": 0, "/a": 1, "/gone.html": 1, "/lone": -1}


def test_caps_of_what_is_read(spark):
    """A robots file is read up to its bound; a page beyond its own is a failed fetch."""
    from weftline import audit

    body = "User-agent: *\nDisallow: /a\n" + "#" * site.ROBOTS_BYTES + "\nDisallow: /b\n"
    rules = site.robots_rules(spark.createDataFrame([("s", body)], "site string, body string"))
    assert [r.path for r in rules.collect()] == ["/a"]
    pages = spark.createDataFrame([("https://x.example/", "<title>T</title><a href=big>B</a>"), ("https://x.example/big", "x" * (extract.PAGE_BYTES + 1))], "url string, html string")
    responses = pages.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(0).alias("redirects"), F.lit("").alias("x_robots"), F.lit("").alias("link_header"))
    out = audit.audit(spark, {"pages": pages, "responses": responses}, "website", 50, "https://x.example/")
    assert [(r.url, r.evidence, r.fix) for r in out["findings"].filter("check = 'Fetch failed'").collect()] == [("https://x.example/big", "page exceeds 5242880 bytes", findings.FIXES["Fetch failed"])]
    assert [r.url for r in out["pages"].collect()] == ["https://x.example/"]
    told = [(findings_weight(r.priority), r.check, r.url) for r in out["findings"].collect()]
    assert told == sorted(told) and {r.check for r in out["issues"].collect()} == {t[1] for t in told}


def findings_weight(priority):
    return ("high", "medium", "low").index(priority)
