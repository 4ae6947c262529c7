"""The registered queries on the test tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import extract, findings, identity, market, markup, performance, site, store
from ..sources.tables import DERIVED, derived, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, *uses: str):
    """Registers a query; `uses` are derived relations that its SQL reads."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            names, todo = [], list(uses)
            for n in todo:
                if n not in names:
                    names.append(n)
            given = ", ".join(f"{n} as ({DERIVED[n]})" for n in names)
            head = sql.strip()
            if not given:
                SQL[f.__name__] = head
            elif head[:15].lower() == "with recursive ":
                SQL[f.__name__] = f"with recursive {given}, {head[15:]}"
            elif head[:5].lower() == "with ":
                SQL[f.__name__] = f"with {given}, {head[5:]}"
            else:
                SQL[f.__name__] = f"with {given} {head}"
        return f

    return put


# What the SQL of page queries shares: markup as DuckDB's patterns say it. Values may hold > in quotes.
_REST = """[^>=]*(?:=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]*)[^>=]*)*"""
_TAG = f"</?[a-zA-Z]{_REST}>|<[!?/][^>]*>"
_HIDDEN = f"(?is)<!--.*?-->|<(?:script|style|noscript|svg|template)(?:\\s{_REST})?>.*?</(?:script|style|noscript|svg|template)\\s*>"


def _strip(c: str, part: str = " ") -> str:
    """Text of markup, with `part` in place of tags."""
    c = f"regexp_replace({c}, '(?s){_TAG}', '{part}', 'g')"
    for a, b in markup.ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))"


def _inner(name: str, source: str = "s") -> str:
    """Texts of elements of this name."""
    return f"list_transform(regexp_extract_all({source}, '(?is)<{name}(?:\\s{_REST})?>(.*?)</{name}\\s*>', 1), lambda x: {_strip('x', '')})"


def _full(texts: str) -> str:
    return f"list_filter({texts}, lambda x: x <> '')"


_SHOWN = f"regexp_replace(html, '{_HIDDEN}', ' ', 'g')"
_PAGES = f"with p as (select page_id, url, coalesce({_SHOWN}, '') s from pages)"
# Markup as browsers write it: some pages with > in quoted values, others with links that are never closed.
_DESCRIBED = "More > less: a page whose description is of fair length, neither too short nor too long"
_ODD = f"""case page_id % 5 when 1 then replace(html, '<a href', '<a title="a>b" href') when 2 then replace(html, '</a>', '') when 3 then replace(html, '<head>', '<head><meta name="description" content="{_DESCRIBED}">') when 4 then replace(html, '<h1>', '<h1 data-x=''1 > 0''>') else html end"""
_ODD_PAGES = f"with p as (select page_id, url, coalesce({_SHOWN.replace('html', 'h')}, '') s from (select page_id, url, {_ODD} h from pages))"
_TOKENS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')"
_PARAGRAPHS = f"""list_filter(list_transform(regexp_split_to_array(s, '(?i)<p(?:\\s{_REST})?>')[2:], lambda x: {_strip(f"regexp_replace(x, '(?is)</?(?:p|{'|'.join(markup.BLOCKS)})(?:[\\s/>]).*$', '')", "")}), lambda x: len({_TOKENS.format('x')}) > 0)"""
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _features(spark, sf_dir, *wanted):
    return extract.features(table(spark, sf_dir, "pages").select("page_id", "url", "html"), *wanted)


def _odd_pages(spark, sf_dir):
    """page_id, url, html as _ODD has it."""
    k, h = F.col("page_id") % 5, F.col("html")
    odd = F.when(k == 1, F.replace(h, F.lit("<a href"), F.lit('<a title="a>b" href'))).when(k == 2, F.replace(h, F.lit("</a>"), F.lit("")))
    odd = odd.when(k == 3, F.replace(h, F.lit("<head>"), F.lit(f'<head><meta name="description" content="{_DESCRIBED}">'))).when(k == 4, F.replace(h, F.lit("<h1>"), F.lit("<h1 data-x='1 > 0'>"))).otherwise(h)
    return table(spark, sf_dir, "pages").select("page_id", "url", odd.alias("html"))


@query(f"{_PAGES}, t as (select page_id, lower({_strip('s')}) t from p) select page_id, len({_TOKENS.format('t')})::int word_count, sha256(t) content_hash from t")
def q_page_text_stats(spark, sf_dir):
    return _features(spark, sf_dir, "word_count", "content_hash").select("page_id", "word_count", "content_hash")


@query(f"""{_PAGES} select page_id, coalesce({_full(_inner('title'))}[1], '') title, array_to_string({_full(_inner('h1'))}, '|') h1, array_to_string(regexp_extract_all(s, '(?i)<h([1-6])\\b', 1), ',') heading_levels from p""")
def q_page_titles_h1(spark, sf_dir):
    levels = F.array_join(F.transform("heading_levels", lambda x: x.cast("string")), ",")
    return _features(spark, sf_dir, "title", "h1", "heading_levels").select("page_id", "title", F.array_join("h1", "|").alias("h1"), levels.alias("heading_levels"))


@query(f"""{_PAGES} select trim(regexp_extract(regexp_extract(s, '(?is)<html\\b[^>]*>', 0), '(?is)\\slang\\s*=\\s*"([^"]*)"', 1)) page_language, count(*) n from p group by 1""")
def q_page_language(spark, sf_dir):
    return _features(spark, sf_dir, "language").groupBy(F.col("language").alias("page_language")).agg(F.count("*").alias("n"))


@query(
    f"""with h as (select page_id, url, {_PATH} w, {_ODD} o from pages), p as (select page_id, url, w, coalesce(regexp_replace(h, '{_HIDDEN}', '', 'g'), '') s from (select page_id, url, w, case page_id % 3 when 1 then replace(o, 'href="/', 'href="') when 2 then replace(o, 'href="/', 'href="../') else o end h from h)),
    a as (select page_id, w, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) o, unnest(regexp_split_to_array(s, '(?i)<a\\s')[2:]) a from p), g as (select *, regexp_extract(a, '^{_REST}>') g from a),
    b as (select page_id, o, case when w = '' then '/' else regexp_extract(w, '^.*/', 0) end d, {_strip(f"case when regexp_matches(a, '(?i)</a\\s*>') then regexp_replace(a[len(g) + 1:], '(?is)</a\\s*>.*$', '') else regexp_replace(a[len(g) + 1:], '(?is)</?(?:p|{'|'.join(markup.BLOCKS)})(?:[\\s/>]).*$', '') end", '')} t, trim(regexp_extract(g, '(?is)href\\s*=\\s*"([^"]*)"', 1)) r from g),
    c as (select page_id, o, t, case when r like '/%' then r when r like '../%' then regexp_replace(d, '[^/]+/$', '') || r[4:] else d || r end r from b where r <> '' and r not like '#%' and not regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:'))
    select page_id, o || r target, t link_text, true internal, false nofollow, regexp_matches(lower(t || ' ' || o || r), '{"|".join(T.BOOKING)}') booking from c"""
)
def q_page_links(spark, sf_dir):
    """Links of pages as browsers write them: > in quoted values, links that are never closed; a third of the pages has its links relative to the folder, another third to the folder above."""
    i, h = F.col("page_id") % 3, F.col("html")
    moved = F.when(i == 1, F.replace(h, F.lit('href="/'), F.lit('href="'))).when(i == 2, F.replace(h, F.lit('href="/'), F.lit('href="../'))).otherwise(h)
    links = extract.anchors(_odd_pages(spark, sf_dir).withColumn("html", moved), keys=("page_id",))
    return links.select("page_id", "target", F.col("text").alias("link_text"), "internal", "nofollow", "booking")


@query(
    f"""select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || case when {_PATH} = '' then '/' else {_PATH} end crawl_url,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || case when {_PATH} in ('', '/') then '/' else regexp_replace({_PATH}, '/$', '') end comparable_url,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace({_PATH}, '/$', '') comparable_page, regexp_replace({_HOST}, '^www\\.', '') host_key from pages"""
)
def q_url_normalize(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.crawl_url(u).alias("crawl_url"), U.comparable_url(u).alias("comparable_url"), U.comparable_page(u).alias("comparable_page"), U.host_key(u).alias("host_key"))


@query(
    f"""with x as (select page_id, url, {_PATH} p, regexp_extract(url, '\\?([^#]*)', 1) q from pages)
    select page_id, 'URL parameters' "check", q evidence from x where q <> '' union all select page_id, 'Uppercase URL', p from x where p <> lower(p)
    union all select page_id, 'Underscore in URL', p from x where contains(p, '_') union all select page_id, 'Long URL', strlen(url)::varchar from x where strlen(url) > 150"""
)
def q_url_format_findings(spark, sf_dir):
    return findings.findings(table(spark, sf_dir, "pages"), findings.url_rules(F.col("url")), ["page_id"]).select("page_id", "check", "evidence")


def _page_findings(spark, sf_dir):
    meta = derived(spark, sf_dir, "site_pages").select("page_id", "status_code", "redirects", "content_type", "indexable")
    facts = extract.features(_odd_pages(spark, sf_dir)).join(meta, "page_id")
    none = F.array().cast("array<string>")
    facts = facts.withColumns({"x_robots": F.lit(""), "final_url": F.col("url"), "external_links": none, "schema_types": none, "author": F.col("meta_author"), "invalid_structured": F.lit(0)})
    return findings.findings(facts, findings.page_rules(), ["page_id", "url"])


_FOUND = f"""f as (select p.page_id, p.url, status_code, redirects, contains(content_type, 'html') html, indexable, s, {_PATH.replace('url', 'p.url')} pa,
    len({_inner('title')}) nt, coalesce({_full(_inner('title'))}[1], '') title, len({_full(_inner('h1'))}) h1, len({_TOKENS.format('lower(' + _strip('s') + ')')}) words, contains(s, '{_DESCRIBED}') described,
    coalesce(list_max(list_transform({_PARAGRAPHS}, lambda x: len({_TOKENS.format('x')}))), 0) longest from p join site_pages m on m.page_id = p.page_id),
  c as (select *, unnest([
    case when status_code not between 200 and 299 then {{'c': 'Non-success response', 's': 'fail', 'p': 'high', 'e': status_code::varchar}} end,
    case when redirects > 1 then {{'c': 'Redirect chain', 's': 'warn', 'p': 'medium', 'e': redirects::varchar}} end,
    case when html and title = '' then {{'c': 'Missing title', 's': 'fail', 'p': 'high', 'e': ''}} when html and nt > 1 then {{'c': 'Multiple titles', 's': 'warn', 'p': 'medium', 'e': nt::varchar}}
      when html and length(title) > 60 then {{'c': 'Long title', 's': 'warn', 'p': 'low', 'e': length(title)::varchar}} when html and length(title) < 20 then {{'c': 'Short title', 's': 'warn', 'p': 'low', 'e': length(title)::varchar}} end,
    case when html and not described then {{'c': 'Missing meta description', 's': 'warn', 'p': 'medium', 'e': ''}} end,
    case when html and h1 = 0 then {{'c': 'Missing H1', 's': 'fail', 'p': 'high', 'e': ''}} when html and h1 > 1 then {{'c': 'Multiple H1s', 's': 'warn', 'p': 'medium', 'e': h1::varchar}} end,
    case when html then {{'c': 'Missing canonical', 's': 'warn', 'p': 'medium', 'e': ''}} end, case when html then {{'c': 'Missing viewport', 's': 'fail', 'p': 'high', 'e': ''}} end,
    case when html then {{'c': 'Missing main landmark', 's': 'warn', 'p': 'low', 'e': ''}} end,
    case when html and words < 50 and indexable then {{'c': 'Very little visible text', 's': 'warn', 'p': 'medium', 'e': words::varchar}} end,
    case when html and words >= 500 and indexable then {{'c': 'Long page has no subheadings', 's': 'warn', 'p': 'low', 'e': words::varchar}} end,
    case when html and longest > 150 and indexable then {{'c': 'Very long paragraph', 's': 'warn', 'p': 'low', 'e': longest::varchar}} end]) x from f)"""


@query(f"{_ODD_PAGES}, {_FOUND} select page_id, x.c \"check\", x.s status, x.p priority, x.e evidence from c where x is not null", "site_pages")
def q_page_findings(spark, sf_dir):
    return _page_findings(spark, sf_dir).select("page_id", "check", "status", "priority", "evidence")


@query(
    f"""{_ODD_PAGES}, {_FOUND} select x.p priority, x.c "check", case x.c {' '.join(f"when '{k}' then '{v}'" for k, v in findings.FIXES.items())} end fix, count(*) n, trim(arg_min(url || ' ' || x.e, {{'u': url, 'e': x.e}})) example from c where x is not null group by 1, 2""",
    "site_pages",
)
def q_issue_groups(spark, sf_dir):
    return findings.issue_groups(_page_findings(spark, sf_dir)).select("priority", "check", "fix", "n", "example")


@query(
    f"""{_PAGES}, x as (select page_id, {_PARAGRAPHS} a from p) select page_id, len(a)::int paragraph_count, coalesce(list_max(list_transform(a, lambda x: len({_TOKENS.format('x')}))), 0)::int longest_paragraph,
    coalesce(list_filter(a, lambda x: len({_TOKENS.format('x')}) >= 5)[1], '') first_paragraph from x"""
)
def q_paragraph_stats(spark, sf_dir):
    return _features(spark, sf_dir, "paragraph_count", "longest_paragraph", "first_paragraph").select("page_id", "paragraph_count", "longest_paragraph", "first_paragraph")


@query("""with p as (select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) t from pages), d as (select t, count(*) n from p where t <> '' group by t having count(*) > 1) select page_id, p.t value, n from p join d on d.t = p.t""")
def q_duplicate_titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("t"))
    return site.duplicates(pages, F.col("t"), "page_id")


@query("with d as (select sha256(text) h, count(*) n from documents where text <> '' group by 1 having count(*) > 1) select doc_id, h value, n from documents join d on sha256(text) = h")
def q_exact_duplicate_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("h"))
    return site.duplicates(docs, F.col("h"), "doc_id")


_NEAR = """, t as (select k, h, unnest(a) w, len(a) n from r where nw >= 100),
  j as (select x.k l, y.k r, count(*) c, any_value(x.n) a, any_value(y.n) b from t x join t y on x.w = y.w and x.k < y.k and x.h <> y.h and x.n >= 0.9 * y.n and y.n >= 0.9 * x.n group by 1, 2)
  select l as "left", r as "right", c / (a + b - c) similarity from j where c / (a + b - c) >= 0.9"""


@query(f"with z as (select doc_id k, sha256(lower(text)) h, {_TOKENS.format('lower(text)')} w from documents), r as (select k, h, list_distinct(w) a, len(w) nw from z){_NEAR}")
def q_near_duplicate_docs(spark, sf_dir):
    words = T.tokenize(F.lower("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.sha2(F.lower("text"), 256).alias("hash"), words.alias("w")).filter(F.size("w") >= 100)
    return site.near_duplicates(docs.select("key", "hash", F.array_distinct("w").alias("tokens")))


@query(f"{_PAGES}, y as (select page_id k, lower({_strip('s')}) t from p), z as (select k, sha256(t) h, {_TOKENS.format('t')} w from y), r as (select k, h, list_distinct(w) a, len(w) nw from z){_NEAR}")
def q_near_duplicate_pages(spark, sf_dir):
    pages = _features(spark, sf_dir, "word_count", "content_hash", "tokens").filter("word_count >= 100")
    return site.near_duplicates(pages.select(F.col("page_id").alias("key"), F.col("content_hash").alias("hash"), F.array_distinct("tokens").alias("tokens")))


@query("select page_id, coalesce(n, 0) inlinks from pages left join (select dst, count(*) n from site_edges group by dst) on dst = page_id", "site_edges")
def q_inlinks(spark, sf_dir):
    out = site.inlinks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("key")), derived(spark, sf_dir, "site_edges"))
    return out.select(F.col("key").alias("page_id"), "inlinks")


_LINKS = """e as (select distinct src, dst, nofollow, anchor, status_code, redirects from site_edges join site_pages on page_id = dst),
  lf as (select distinct src, dst, case when status_code >= 400 then 'Broken internal link' else 'Internal link redirects' end "check", case when status_code >= 400 then 'fail' else 'warn' end status from e where status_code >= 400 or redirects > 0
  union all select distinct src, dst, 'Nofollow internal link', 'warn' from e where nofollow union all select distinct src, dst, 'Empty internal anchor', 'warn' from e where anchor = '')"""


@query(f"with {_LINKS} select * from lf", "site_pages", "site_edges")
def q_broken_links(spark, sf_dir):
    targets = derived(spark, sf_dir, "site_pages").select(F.col("page_id").alias("key"), "status_code", "redirects")
    return site.link_findings(derived(spark, sf_dir, "site_edges"), targets).select("src", "dst", "check", "status")


# Each page once, at the round that reaches it: the recursion ends when a round reaches none.
REACHED = "b(node, depth) using key (node) as (select 0::bigint, 0 union select dst, min(depth) + 1 from b join site_edges on src = node where dst not in (select node from recurring.b) group by dst)"


@query(f"with recursive {REACHED} select node, depth::int depth from b", "site_edges")
def q_bfs_depth(spark, sf_dir):
    start = spark.range(1).select(F.col("id").alias("node"))
    return site.depths(derived(spark, sf_dir, "site_edges"), start)


@query(
    f"""with recursive {REACHED}, i as (select dst, count(*) n from site_edges group by dst),
    x as (select page_id, coalesce(depth, -1) depth, coalesce(n, 0) inlinks, in_sitemap, indexable, contains(content_type, 'html') html, status_code, redirects from site_pages left join b on node = page_id left join i on dst = page_id)
    select page_id, 'Sitemap-only page' "check" from x where depth < 0 and in_sitemap and indexable and html union all select page_id, 'Deep page' from x where depth > 3 and indexable and html
    union all select page_id, 'No internal inlinks' from x where depth > 0 and inlinks = 0 and indexable and html union all select page_id, 'Non-success URL in sitemap' from x where in_sitemap and status_code not between 200 and 299
    union all select page_id, 'Non-indexable URL in sitemap' from x where in_sitemap and not indexable union all select page_id, 'Redirecting URL in sitemap' from x where in_sitemap and redirects > 0""",
    "site_pages",
    "site_edges",
)
def q_sitemap_flags(spark, sf_dir):
    pages = derived(spark, sf_dir, "site_pages").withColumn("html", T.is_html(F.col("content_type"))).withColumn("in_sitemap_as_listed", F.col("in_sitemap"))
    found = q_bfs_depth(spark, sf_dir).withColumnRenamed("node", "page_id")
    rows = pages.join(found, "page_id", "left").join(q_inlinks(spark, sf_dir), "page_id")
    return findings.findings(rows, site.sitemap_rules(), ["page_id"]).select("page_id", "check")


@query(
    """with m as (select l.*, p.page_id is not null crawled, status_code, indexable, exists (select 1 from hreflang b where b.src = l.dst and b.dst = l.src) returns from hreflang l left join site_pages p on page_id = dst)
    select src, dst, language, 'Hreflang target not crawled' "check" from m where not crawled union all select src, dst, language, 'Invalid hreflang target' from m where crawled and (status_code <> 200 or not indexable)
    union all select src, dst, language, 'Missing hreflang return link' from m where crawled and not returns""",
    "site_pages",
    "hreflang",
)
def q_hreflang_reciprocity(spark, sf_dir):
    pages = derived(spark, sf_dir, "site_pages").select(F.col("page_id").alias("key"), "status_code", "indexable")
    return site.hreflang_findings(derived(spark, sf_dir, "hreflang"), pages).select("src", "dst", "language", "check")


@query("select a.page_id, a.canonical_id from site_pages a join site_pages b on b.page_id = a.canonical_id where a.page_id <> a.canonical_id and not b.indexable", "site_pages")
def q_canonical_targets(spark, sf_dir):
    pages = derived(spark, sf_dir, "site_pages").select(F.col("page_id").alias("key"), F.col("canonical_id").alias("canonical"), "indexable")
    return site.canonical_findings(pages).select(F.col("key").alias("page_id"), F.col("canonical").alias("canonical_id"))


ASKED = ("/", "/a/x", "/a/b/c", "/p.tmp", "/q", "/q/open")


@query(
    "with x as (select page_id site, page_id % 5 k, agent, path from pages, (select unnest(['GPTBot', 'Googlebot', 'Other']) agent) a, (select unnest([" + ", ".join(f"'{p}'" for p in ASKED) + "]) path) b) "
    "select site, agent, path, case when agent = 'GPTBot' and k = 0 then not path like '/q%' or path like '/q/open%' when agent = 'GPTBot' then not path like '/a%' or path like '/a/b%' when agent = 'Googlebot' and k < 3 then not path like '/q%' or path like '/q/open%' and k <> 2 else not (path like '/p%' and k <> 4) end allowed from x"
)
def q_robots_access(spark, sf_dir):
    """Each page stands for a site with a robots file of its own. A group without rules, as an empty Disallow leaves it, is one with the next."""
    k = F.col("page_id") % 5
    gpt = F.when(k == 0, "User-agent: GPTBot\nDisallow:\n").otherwise("# all but one folder\nUser-agent: GPTBot\nDisallow: /a # no\nAllow: /a/b\n")
    google = F.when(k < 3, F.concat(F.lit("\nUser-agent: Google\nUser-Agent: bing\nDisallow: /q$\n"), F.when(k != 2, "Allow: /q/open\n").otherwise(""))).otherwise("")
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), F.concat(gpt, google, F.when(k == 4, "\nUser-agent: *\nAllow: /\n").otherwise("\nUser-agent: *\nDisallow: /p*.tmp\n")).alias("body"))
    asked = files.select("site", F.explode(F.array(*[F.lit(a) for a in ("GPTBot", "Googlebot", "Other")])).alias("agent")).select("site", "agent", F.explode(F.array(*[F.lit(p) for p in ASKED])).alias("path"))
    return site.robots_access(site.robots_rules(files), asked).select("site", "agent", "path", "allowed")


@query(
    f"""with {_LINKS} select (select count(*) from site_pages) pages, (select count(*) from site_pages where indexable) indexable, (select count(*) from site_pages where not indexable) non_indexable, (select count(*) from site_pages where in_sitemap) sitemap_urls,
    (select count(distinct dst) from site_edges) internal_links, 0::bigint external_links, count(*) filter (status = 'fail') failures, count(*) filter (status = 'warn') warnings,
    count(*) filter ("check" = 'Broken internal link') broken_internal, count(*) filter ("check" = 'Internal link redirects') redirected_internal from lf""",
    "site_pages",
    "site_edges",
)
def q_site_summary(spark, sf_dir):
    edges = derived(spark, sf_dir, "site_edges").withColumn("internal", F.lit(True))
    return site.summary(derived(spark, sf_dir, "site_pages"), edges, q_broken_links(spark, sf_dir))


@query(
    """select url, internal, 'Broken resource or external link' "check", case when internal then 'high' else 'low' end priority from resources where status >= 400
    union all select url, internal, 'Large image', 'medium' from resources where internal and type like 'image/%' and size > 512000""",
    "resources",
)
def q_resource_findings(spark, sf_dir):
    return findings.findings(derived(spark, sf_dir, "resources"), findings.resource_rules(), ["url", "internal"]).select("url", "internal", "check", "priority")


def _candidates(spark, sf_dir):
    return derived(spark, sf_dir, "candidates").select(*market.CANDIDATE)


_MERGED = """m as (select keyword, max(search_volume) search_volume, max(cpc) cpc, coalesce(arg_max(position, ord) filter (position > 0), 0)::int position, coalesce(arg_max(url, ord) filter (position > 0), arg_min(url, ord)) url,
  coalesce(arg_min(target_url, ord) filter (target_url <> ''), '') target_url, bool_or(explicit) explicit, coalesce(arg_max(source, ord) filter (explicit), arg_min(source, ord)) source, arg_min(relevance, ord) relevance from candidates group by keyword)"""
_IMP = "case when cpc >= 15 or search_volume >= 1000 then 5 when cpc >= 5 or search_volume >= 100 then 4 else 3 end"
_EFF = "case when position <= 0 then 5 when position <= 10 then 1 when position <= 25 then 2 when position <= 40 then 3 when position <= 70 then 4 else 5 end"
_SRC = "case source when 'current-ranking' then 0 when 'supplied' then 1 when 'openrouter' then 2 else 3 end"
_KEY = "case when {0} = '' then null else lower(regexp_extract({0}, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', '') end"


@query(f"with {_MERGED} select * from m", "candidates")
def q_candidates_merge(spark, sf_dir):
    return market.merge(_candidates(spark, sf_dir)).drop("ord")


_SHORT = f"""{_MERGED}, k as (select *, case when explicit or source = 'current-ranking' or coalesce({_KEY.format('target_url')}, {_KEY.format('url')}) is null then 'keyword:' || keyword else coalesce({_KEY.format('target_url')}, {_KEY.format('url')}) end key from m),
  b as (select *, row_number() over (partition by key order by {_SRC}, ({_IMP}) / ({_EFF}) desc, keyword) rn from k),
  s as (select *, row_number() over (order by explicit desc, {_SRC}, case when source = 'current-ranking' then position else 0 end, case when source in ('openrouter', 'site-discovery') then relevance else 0 end, {_IMP} desc, search_volume desc, keyword) o from b where rn = 1)"""


@query(f"with {_SHORT} select keyword, source, position, search_volume, cpc, url, target_url from s where o <= 300", "candidates")
def q_shortlist(spark, sf_dir):
    return market.shortlist(_candidates(spark, sf_dir), 300).select("keyword", "source", "position", "search_volume", "cpc", "url", "target_url")


def _terms_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    term = "case when length(x) > 5 and x like '%s' then x[:-2] else x end"
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z]+'), lambda x: {term}), lambda t: length(t) >= 4 and t not in ({stop})))"


@query(
    f"""with w as (select url page, unnest(list_distinct(list_concat({_terms_sql('url')}, {_terms_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}))) t from pages),
    k as (select keyword, unnest({_terms_sql('keyword')}) t from (select distinct p_type || ' thing example' keyword from part)), s as (select keyword, page, count(*) n from k join w using (t) group by all),
    b as (select keyword, arg_min(page, (-n, page)) target_url from s group by keyword) select keyword, coalesce(target_url, '') target_url from (select distinct p_type || ' thing example' keyword from part) left join b using (keyword)"""
)
def q_assign_pages(spark, sf_dir):
    none = F.array().cast("array<string>")
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), none.alias("h1"), none.alias("seeds"))
    asked = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" thing example")).alias("keyword"), F.lit("").alias("target_url"))
    return market.assign_pages(asked, pages)


@query("select keyword, position, url, search_volume, cpc from candidates where position >= 1 and url <> ''", "candidates")
def q_existing_rankings(spark, sf_dir):
    return market.existing_rankings(_candidates(spark, sf_dir))


@query("select ord, keyword from candidates where source <> 'current-ranking' and keyword not in (select keyword from candidates where position >= 1 and url <> '')", "candidates")
def q_remove_existing(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return market.remove_existing(rows.filter("source <> 'current-ranking'"), market.existing_rankings(rows)).select("ord", "keyword")


_OPP = f"""{_MERGED}, o as (select *, search_volume % 3 <> 0 maps_checked, (search_volume % 7)::int maps_position, (search_volume % 100)::double top_three from m),
  w as (select *, {_IMP} importance, {_EFF} effort, position = 0 or position > 10 ow, maps_checked and (maps_position = 0 or maps_position > 3 or top_three < 50) mw from o)"""


@query(
    f"""with {_OPP} select keyword, importance::int importance, effort::int effort, importance / effort ratio, case when ow and mw then 'weak-organic-and-maps' when ow then 'weak-organic' when mw then 'weak-maps' else 'visible' end status,
    case when not ow and not mw then 'low' when importance >= 4 then 'high' else 'medium' end priority,
    case when position > 0 then 'organic #' || position else 'organic not found in top 100' end || case when not maps_checked then '' when maps_position > 0 then '; Maps #' || maps_position else '; Maps not found in top 20' end || case when maps_checked then '; Maps top-three coverage ' || printf('%.1f', top_three) || '% across 9 grid points' else '' end evidence,
    array_to_string(list_filter([case when ow and target_url <> '' then 'improve-target-page' when ow and url = '' then 'create-page' when ow then 'improve-ranking-page' end, case when mw then 'improve-profile' end, case when not ow and not mw then 'protect' end,
      case when search_volume % 2 = 0 then 'add-booking' end], lambda x: x is not null), ',') actions from w""",
    "candidates",
)
def q_opportunity_scores(spark, sf_dir):
    v = F.col("search_volume")
    rows = market.merge(_candidates(spark, sf_dir)).withColumns({"maps_checked": v % 3 != 0, "maps_position": v % 7, "grid_points": F.lit(9), "top_three": (v % 100).cast("double"), "has_page": F.lit(True), "has_booking": v % 2 != 0, "has_phone": F.lit(True)})
    out = market.opportunities(rows).orderBy(*market.opportunity_order())
    return out.select("keyword", "importance", "effort", "ratio", "status", "priority", "evidence", F.array_join("actions", ",").alias("actions"))


@query(
    f"""with m0 as (select * replace (case when ord % 3 = 0 then keyword else regexp_replace(keyword, '#[0-9]+', '') end as keyword) from candidates), {_MERGED.replace("from candidates", "from m0")}, f as (select m.*, (select min(ord) from m0 c where c.keyword = m.keyword) ord from m), g as (select *, regexp_replace(lower(keyword), '[^a-z0-9]', '', 'g') ck, coalesce({_KEY.format('target_url')}, {_KEY.format('url')}, 'keyword:' || keyword) key from f where search_volume >= 1
      and not regexp_matches(keyword, '^({"|".join(T.INFORMATIONAL)}) ')),
    h as (select *, row_number() over (partition by key order by ord) rn from g where not (length(ck) >= 5 and (contains(ck, 'almond') or contains('almond', ck)))
      and not (len(list_filter(regexp_split_to_array(keyword, '\\s+'), lambda x: x <> '')) <= 3 and len(list_filter(regexp_split_to_array(keyword, '\\s+'), lambda x: regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]'))) > 0))
    select ord, keyword from h where rn = 1 order by ord limit 5""",
    "candidates",
)
def q_grid_candidates(spark, sf_dir):
    plain = F.when(F.col("ord") % 3 == 0, F.col("keyword")).otherwise(F.regexp_replace("keyword", "#[0-9]+", ""))
    return market.grid_candidates(market.merge(_candidates(spark, sf_dir).withColumn("keyword", plain)), ("Almond",)).select("ord", "keyword")


@query(
    """with c as (select s_suppkey k, (s_suppkey % 120 - 60)::double lat, (s_suppkey % 350 - 175)::double lon from supplier)
    select k, p::int point, round(lat + (p // 3 - 1) * (2.0::double / 111.32::double), 9) latitude, round(lon + (p % 3 - 1) * (2.0::double / 111.32::double) / cos(lat * pi() / 180), 9) longitude from c, range(9) t(p)"""
)
def q_geo_grid(spark, sf_dir):
    k = F.col("s_suppkey")
    centers = table(spark, sf_dir, "supplier").select(k.alias("key"), (k % 120 - 60).cast("double").alias("latitude"), (k % 350 - 175).cast("double").alias("longitude"))
    return market.geo_grid(centers).select(F.col("key").alias("k"), "point", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


@query(
    """with t as (select kw, pt, coalesce(max(position) filter (place = kw + 1), 0) position, (kw * pt) % 17 = 5 failed from grid_results group by kw, pt),
    a as (select kw, count(*) filter (not failed) checked, count(*) filter (failed) failed, count(*) filter (not failed and position between 1 and 3) top, count(*) filter (not failed and position > 0) hit,
      list_sort(list(case when position > 0 then position else 21 end) filter (not failed)) ps from t group by kw)
    select kw, checked, failed, round(top * 1000 / checked) / 10 top_three, round(hit * 1000 / checked) / 10 found, case when ps[checked // 2 + 1] = 21 then 0 else ps[checked // 2 + 1] end::int median_position from a""",
    "grid_results",
)
def q_grid_summary(spark, sf_dir):
    results = derived(spark, sf_dir, "grid_results").withColumn("is_target", F.col("place") == F.col("kw") + 1)
    points = market.map_position(results, ["kw", "pt"]).withColumn("failed", (F.col("kw") * F.col("pt")) % 17 == 5)
    return market.grid_summary(points, ["kw"])


@query("select kw, pt, rank, place, position from (select *, row_number() over (partition by kw, pt order by position)::int rank from grid_results where place <> kw + 1) where rank <= 3", "grid_results")
def q_competitors_top3(spark, sf_dir):
    return market.competitors(derived(spark, sf_dir, "grid_results").withColumn("is_target", F.col("place") == F.col("kw") + 1), ["kw", "pt"])


@query(
    f"""with x as (select url, regexp_extract(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), '^[^/]*', 0) seg, page_id % 4 depth from site_pages where indexable and status_code between 200 and 299),
    s as (select seg segment, count(*)::int pages, arg_min(url, (depth, url)) url from x where seg <> '' group by seg) select url, segment, pages from s order by pages desc, segment limit 6""",
    "site_pages",
)
def q_perf_sections(spark, sf_dir):
    pages = derived(spark, sf_dir, "site_pages").withColumn("depth", F.col("page_id") % 4)
    return performance.select_pages(pages).withColumn("pages", F.col("pages").cast("int"))


@query(
    """select user_id, x.c "check", x.p priority from (select user_id, unnest([
    case when lcp > 2500 then {'c': 'Slow lab LCP', 'p': case when lcp > 4000 then 'high' else 'medium' end} end, case when cls > 0.1 then {'c': 'High lab CLS', 'p': case when cls > 0.25 then 'high' else 'medium' end} end,
    case when tbt > 200 then {'c': 'High lab TBT', 'p': case when tbt > 600 then 'high' else 'medium' end} end, case when ttfb > 800 then {'c': 'Slow lab TTFB', 'p': 'medium'} end, case when bytes > 2560000 then {'c': 'Heavy page transfer', 'p': 'medium'} end,
    case when js_bytes > 512000 then {'c': 'Large JavaScript transfer', 'p': 'low'} end, case when requests > 100 then {'c': 'Excessive page requests', 'p': 'low'} end, case when dom_nodes > 1500 then {'c': 'Large rendered DOM', 'p': 'low'} end,
    case when images_without_size > 0 then {'c': 'Rendered images missing dimensions', 'p': 'low'} end, case when images_not_lazy > 0 then {'c': 'Offscreen images not lazy-loaded', 'p': 'low'} end]) x from perf_samples) where x is not null""",
    "perf_samples",
)
def q_perf_findings(spark, sf_dir):
    return findings.findings(derived(spark, sf_dir, "perf_samples"), findings.performance_rules(), ["user_id"]).select("user_id", "check", "priority")


@query("select count(*) pages, max(lcp) worst_lcp, max(cls) worst_cls, max(bytes) worst_bytes from perf_samples", "perf_samples")
def q_perf_summary(spark, sf_dir):
    return performance.summary(derived(spark, sf_dir, "perf_samples")).select("pages", "worst_lcp", "worst_cls", "worst_bytes")


@query(
    """with recursive e as (select user_id, epoch_us(ts) at_, value, row_number() over (partition by user_id order by epoch_us(ts), value) i from events),
    f as (select user_id, i, at_ first, at_ last, value s, greatest(0, value) w from e where i = 1
      union all select e.user_id, e.i, case when o then first else at_ end, at_, case when o then s + value else value end, greatest(w, case when o then s + value else value end)
      from (select e.*, first, last, s, w, first > 0 and at_ - last < 3600000000 and at_ - first < 18000000000 o from f join e on e.user_id = f.user_id and e.i = f.i + 1) e)
    select user_id, round(max(w), 6) worst from f group by user_id"""
)
def q_capped_session(spark, sf_dir):
    shifts = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    return performance.capped_sessions(shifts, "user_id", "at", "value", 3_600_000_000, 18_000_000_000).select("user_id", F.round("worst", 6).alias("worst"))


@query("select user_id, round(sum(case when event_id % 100 >= user_id % 10 then greatest(0, value - 50) else 0 end), 6) tbt from events group by user_id")
def q_blocking_time(spark, sf_dir):
    tasks = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 100).alias("start"), F.col("value").alias("duration"), (F.col("user_id") % 10).alias("fcp"))
    return performance.blocking_time(tasks, "user_id").select("user_id", F.round("tbt", 6).alias("tbt"))


@query("select user_id, count(*) requests, sum(event_id % 1000)::bigint bytes, count(*) filter (event_id % 4 = 1) third_party, sum(case when event_type = 'click' then event_id % 1000 else 0 end)::bigint script_bytes from events group by user_id")
def q_resource_totals(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "script").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", kind.alias("type"), (F.col("event_id") % 1000).alias("bytes"), (F.col("event_id") % 4 == 1).alias("third_party"))
    return performance.resource_totals(rows, "user_id").select("user_id", "requests", "bytes", "third_party", "script_bytes")


@query(
    """select place_id, x.c "check", x.p priority from (select place_id, unnest([case when business_status <> 'OPERATIONAL' then {'c': 'Business status', 'p': 'high'} end, case when category = '' then {'c': 'Missing primary category', 'p': 'medium'} end,
    case when address is null then {'c': 'Missing address', 'p': 'medium'} end, case when phone = '' then {'c': 'Missing phone', 'p': 'medium'} end, case when website = '' then {'c': 'Missing website', 'p': 'medium'} end,
    case when not has_hours then {'c': 'Missing hours', 'p': 'medium'} end, case when reviews = 0 then {'c': 'No reviews', 'p': 'low'} end, case when photos = 0 then {'c': 'No photos', 'p': 'low'} end]) x from profiles) where x is not null""",
    "profiles",
)
def q_profile_findings(spark, sf_dir):
    rows = derived(spark, sf_dir, "profiles").withColumn("hours", F.when(F.col("has_hours"), F.array(F.lit("Mo 9-5"))))
    return findings.findings(rows, findings.profile_rules(), ["place_id"]).select("place_id", "check", "priority")


@query(
    """with h as (select distinct s_suppkey % 25 site, 'biz' || ((s_suppkey * 3) % 20) || '.example' host from supplier where s_suppkey % 2 = 0), f as (select distinct s_suppkey % 25 site, '020 ' || (7000000 + s_suppkey * 13) phone from supplier where s_suppkey % 3 <> 1),
    x as (select place_id, phone, website, case when website <> '' then regexp_replace(lower(regexp_extract(website, '^https?://([^/]*)', 1)), '^www\\.', '') end host, site, regexp_replace(phone, '[^0-9]', '', 'g') d from profiles),
    y as (select x.*, exists (select 1 from h where h.site = x.site and (h.host = x.host or x.host like '%.' || h.host or h.host like '%.' || x.host)) hm,
      exists (select 1 from f where f.site = x.site and length(regexp_replace(f.phone, '[^0-9]', '', 'g')) >= 7 and length(d) >= 7 and right(regexp_replace(f.phone, '[^0-9]', '', 'g'), 9) = right(d, 9)) pm, exists (select 1 from f where f.site = x.site) fp from x)
    select place_id, case when host is not null then case when hm then 'matched' else 'mismatch' end when phone <> '' and pm then 'matched' when phone <> '' and fp then 'mismatch' else 'unverified' end identity from y""",
    "profiles",
)
def q_identity(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    hosts = s.filter(k % 2 == 0).select((k % 25).alias("site"), F.concat(F.lit("biz"), ((k * 3) % 20).cast("string"), F.lit(".example")).alias("host"))
    phones = s.filter(k % 3 != 1).select((k % 25).alias("site"), F.concat(F.lit("020 "), (7000000 + k * 13).cast("string")).alias("phone"))
    return identity.verify(derived(spark, sf_dir, "profiles").select("place_id", "site", "website", "phone"), hosts, phones).select("place_id", "identity")


@query("select n_name country, count(*) n from customer join nation on n_nationkey = c_nationkey group by 1 order by n desc, country limit 5")
def q_backlink_countries(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return market.top_countries(counts.select(F.col("n_name").alias("country"), "n"))


@query("select c_custkey business_id, c_name, count(o_orderkey) page_count from customer left join orders on o_custkey = c_custkey group by 1, 2")
def q_business_pages(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("business_id"), "c_name", F.col("c_acctbal").alias("updated_at"))
    return store.business_pages(b, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business_id"))).select("business_id", "c_name", "page_count")


@query("select user_id, event_type, value, event_id from (select *, row_number() over (partition by user_id order by event_id desc) rn from events) where rn = 1")
def q_upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return store.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@query("select doc_id, quality, toxic from documents join labels using (doc_id) union all select doc_id, null, null from documents where doc_id not in (select doc_id from labels)")
def q_cache_hits(spark, sf_dir):
    hit, miss = store.cached(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])
    return hit.select("doc_id", "quality", "toxic").unionByName(miss, allowMissingColumns=True)


@query("select case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end page_type, count(*) n from labels group by 1")
def q_page_type_counts(spark, sf_dir):
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return store.type_counts(table(spark, sf_dir, "labels").select(kind.alias("page_type")))


@query("select page_id, url from pages where contains(lower(url || ' ' || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'en/')")
def q_page_search(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.lit("").alias("h1"))
    return store.search_pages(pages, " EN/ ").select("page_id", "url")


def _marked(spark, sf_dir):
    """Pages with structured data and dates after their ids."""
    i = F.col("page_id").cast("string")
    good = F.concat(F.lit('{"@graph":[{"@type":["Article","T'), (F.col("page_id") % 3).cast("string"), F.lit('"],"author":[{"name":""},{"name":"Ann  '), i, F.lit('"}],"datePublished":"2026-01-'), i, F.lit('"},{"@type":"Organization"}]}'))
    block = F.concat(F.lit('<script type="application/ld+json">'), F.when(F.col("page_id") % 4 == 3, "{broken").otherwise(good), F.lit("</script>"))
    time = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit('<time itemprop="dateModified" datetime="m'), i, F.lit('">March</time>'))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("<article><time>t"), i, F.lit("</time></article>"))).otherwise("<time>5 May</time>")
    html = F.concat(block, F.lit("<script>var x</script>"), F.when(F.col("page_id") % 2 == 0, block).otherwise(""), time)
    return extract.features(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), "metadata").select("page_id", F.col("metadata").alias("m"))


@query(
    """select page_id, case when page_id % 2 = 0 then 2 else 1 end::int blocks, case when page_id % 4 = 3 then case when page_id % 2 = 0 then 2 else 1 end else 0 end::int invalid, case when page_id % 4 = 3 then '' else 'Article,Organization,T' || page_id % 3 end schema_types,
    case when page_id % 4 = 3 then '' else 'Ann ' || page_id end author, case when page_id % 4 <> 3 then '2026-01-' || page_id when page_id % 5 = 2 then 't' || page_id else '' end published from pages"""
)
def q_jsonld(spark, sf_dir):
    return _marked(spark, sf_dir).select("page_id", "m.blocks", "m.invalid", F.array_join("m.schema_types", ",").alias("schema_types"), "m.author", "m.published")


@query("select page_id, case when page_id % 5 = 1 then 'm' || page_id else '' end modified from pages")
def q_time_meta(spark, sf_dir):
    return _marked(spark, sf_dir).select("page_id", "m.modified")
