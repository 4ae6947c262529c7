"""Queries on provider answers, put-together opportunities, crawl phases, report views, page labels and text helpers, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import extract, findings, identity, market, performance, site, visibility
from ..sources import files, payloads
from ..sources.tables import derived, table
from .queries import _EFF, _IMP, _KEY, _MERGED, REACHED, _candidates, query

# Answers of a provider, made of the derived relations: every seventh call failed, every ninth task did.
_CALL = "case when {0} % 7 = 3 then 40501 else 20000 end"
_TASK = "case when {0} % 9 = 4 then 40102 else 20000 end"
_FAILED = "({0} % 7 = 3 or {0} % 9 = 4)"


def _answer(rows, key: str, result):
    """rows by key with a payload whose first task holds `result` (an aggregate)."""
    k = F.col(key)
    rows = rows.groupBy(key).agg(result.alias("result"))
    task = F.struct(F.when(k % 9 == 4, 40102).otherwise(20000).alias("status_code"), F.lit("said").alias("status_message"), ((k % 5) / 8).alias("cost"), F.col("result"))
    return rows.select(key, F.to_json(F.struct(F.when(k % 7 == 3, 40501).otherwise(20000).alias("status_code"), F.lit("said").alias("status_message"), F.array(task).alias("tasks"))).alias("payload"))


def _searches(spark, sf_dir):
    """Each keyword and point is a search of its own."""
    return derived(spark, sf_dir, "grid_results").withColumn("kw", F.col("kw") * 9 + F.col("pt"))


_SEARCHES = "(select kw * 9 + pt kw, place, position from grid_results)"


def _organic_payloads(spark, sf_dir):
    grid = _searches(spark, sf_dir)
    item = F.struct("position", F.when(F.col("place") % 3 == 0, "paid").otherwise("organic").alias("type"), F.col("position").alias("rank_absolute"), F.concat(F.when(F.col("place") % 2 == 0, "WWW.Biz").otherwise("biz"), (F.col("place") % 5).cast("string"), F.lit(".example")).alias("domain"), F.concat(F.lit("https://biz.example/"), F.col("place").cast("string")).alias("url"))
    return _answer(grid, "kw", F.array(F.struct(F.array_sort(F.collect_list(item)).alias("items"))))


_ORGANIC = f"""o as (select kw, coalesce(min(position) filter (place % 3 <> 0 and place % 5 = 2), 0)::int position, coalesce(arg_min('https://biz.example/' || place, position) filter (place % 3 <> 0 and place % 5 = 2), '') url
  from {_SEARCHES} group by kw having not {_FAILED.format('kw')})"""


@query(f"with {_ORGANIC} select * from o", "grid_results")
def q_organic_rank(spark, sf_dir):
    return payloads.organic(_organic_payloads(spark, sf_dir), "https://www.BIZ2.example/x", "kw")


def _map_payloads(spark, sf_dir):
    grid = _searches(spark, sf_dir)
    p, place = F.col("position"), F.col("place")
    rating = F.when(place % 4 > 0, F.struct((place % 50 / 10).alias("value"), place.alias("votes_count")))
    item = F.struct(p, F.when(p % 5 == 0, "maps_paid_item").otherwise("maps_search").alias("type"), F.when(p % 2 == 0, p).otherwise(0).alias("rank_group"), (p + 1).alias("rank_absolute"), place.cast("string").alias("place_id"), F.concat(F.lit("Biz "), place.cast("string")).alias("title"), rating.alias("rating"))
    return _answer(grid, "kw", F.array(F.struct(F.array_sort(F.collect_list(item)).alias("items"))))


_MAPS = f"""mp as (select kw, case when position % 2 = 0 then position else position + 1 end::int position, place::varchar place_id, 'Biz ' || place "name", case when place % 4 > 0 then place % 50 / 10 else 0 end rating, case when place % 4 > 0 then place else 0 end::int reviews, place % 40 = 7 is_target
  from {_SEARCHES} where position % 5 <> 0 and not {_FAILED.format('kw')})"""


@query(f"with {_MAPS} select kw, position, place_id, \"name\", rating, reviews, place_id = '7' is_target from mp", "grid_results")
def q_map_results(spark, sf_dir):
    return payloads.maps(_map_payloads(spark, sf_dir), "7", "kw").select("kw", "position", "place_id", "name", "rating", "reviews", "is_target")


@query(f"select count(*) calls, sum(case when k % 7 = 3 then 0 else k % 5 / 8 end) \"cost\", count(*) filter ({_FAILED.format('k')}) failed from (select distinct kw k from {_SEARCHES})", "grid_results")
def q_provider_totals(spark, sf_dir):
    return payloads.totals(payloads.answers(_map_payloads(spark, sf_dir), payloads.MAPS))


def _idea_payloads(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("call", F.col("ord") % 20)
    return _answer(rows, "call", F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword", "search_volume", "cpc"))), lambda x: x.dropFields("ord")))


@query(f"select ord % 20 call, (row_number() over (partition by ord % 20 order by ord) - 1)::int ord, keyword, search_volume, cpc from candidates where not {_FAILED.format('(ord % 20)')}", "candidates")
def q_keyword_ideas(spark, sf_dir):
    return payloads.ideas(_idea_payloads(spark, sf_dir), "call")


@query(f"select c_nationkey k, case when c_nationkey % 7 = 3 then '40501: said' when c_nationkey % 9 = 4 then '40102: said' end error, case when {_FAILED.format('c_nationkey')} then 0 else count(*) end backlinks, case when {_FAILED.format('c_nationkey')} then 0 else c_nationkey end::int target_spam_score from customer group by c_nationkey")
def q_backlink_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    answer = _answer(rows, "k", F.array(F.struct(F.count("*").alias("backlinks"), F.struct(F.max("k").alias("target_spam_score")).alias("info"), F.struct(F.lit(1).alias("GB")).alias("referring_links_countries"))))
    return payloads.backlinks(answer, "k").select("k", "error", "backlinks", "target_spam_score")


# Opportunities put together.


def _pages_seen(spark, sf_dir):
    """Pages at addresses that candidates name."""
    i = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(i % 2 == 0, F.concat(F.lit("https://site.example/p/"), (i % 70).cast("string"))).otherwise(F.concat(F.lit("https://SITE.example/t/"), (i % 90).cast("string"), F.lit("/?q=1"))).alias("url"),
        F.when(i % 4 == 0, F.concat(F.lit("https://site.example/p/"), (i % 33).cast("string"))).otherwise("").alias("final_url"), i.alias("pos"), F.col("p_name").alias("title"), (i % 5 == 0).alias("booking"), (i % 7 == 0).alias("phone"), (i % 2 == 0).alias("priority_page"),
    )


_SEEN = """ps as (select p_partkey pos, p_name title, p_partkey % 5 = 0 booking, p_partkey % 7 = 0 phone, p_partkey % 2 = 0 prio, case when p_partkey % 2 = 0 then 'https://site.example/p/' || p_partkey % 70 else 'https://SITE.example/t/' || p_partkey % 90 || '/?q=1' end url,
    case when p_partkey % 2 = 0 then 'https://site.example/p/' || p_partkey % 70 else 'https://site.example/t/' || p_partkey % 90 end k1, case when p_partkey % 4 = 0 then 'https://site.example/p/' || p_partkey % 33 end k2 from part),
  px as (select k, arg_max(url, (pos, w)) url, arg_max(title, (pos, w)) title, arg_max(booking, (pos, w)) booking, arg_max(phone, (pos, w)) phone from (select *, k1 k, 0 w from ps union all select *, k2, 1 from ps) where k is not null group by k),
  pp as (select k, arg_max(url, (pos, w)) url from (select *, k1 k, 0 w from ps where prio union all select *, k2, 1 from ps where prio) where k is not null group by k)"""
_OPPS = f"""{_MERGED}, {_SEEN}, fo as (select keyword, case when search_volume % 5 = 0 then 0 else search_volume % 90 + 1 end::int position, case when search_volume % 5 = 0 then '' else 'https://site.example/p/' || search_volume % 70 end url from m where search_volume % 4 <> 1),
  sn as (select keyword, (search_volume % 6)::int tp, case when search_volume % 2 = 0 then 9 else 0 end::int gp, (search_volume % 100)::double t3 from m where search_volume % 3 <> 0),
  c1 as (select m.keyword, m.source, m.search_volume, m.cpc, m.target_url, case when m.source = 'current-ranking' then m.position else 0 end::int country_position, coalesce(fo.position, m.position) position, case when fo.keyword is not null then fo.url else m.url end url,
    sn.keyword is not null mc, coalesce(tp, 0) tp, coalesce(gp, 0) gp, coalesce(t3, 0) t3 from m left join fo using (keyword) left join sn on sn.keyword = m.keyword),
  c2 as (select c1.*, coalesce(a.title, b.title, '') page_title, coalesce(a.k, b.k) is not null hp, case when a.k is not null then a.booking else coalesce(b.booking, false) end hb, case when a.k is not null then a.phone else coalesce(b.phone, false) end hf
    from c1 left join px a on a.k = {_KEY.format('c1.target_url')} left join px b on b.k = {_KEY.format('c1.url')}),
  c3 as (select *, {_IMP} importance, {_EFF} effort, position = 0 or position > 10 ow, mc and (tp = 0 or tp > 3 or gp > 0 and t3 < 50) mw from c2)"""
_OPP_ROW = """keyword, country_position, page_title, case when ow and mw then 'weak-organic-and-maps' when ow then 'weak-organic' when mw then 'weak-maps' else 'visible' end status, case when not ow and not mw then 'low' when importance >= 4 then 'high' else 'medium' end priority,
  case when position > 0 then 'organic #' || position else 'organic not found in top 100' end || case when not mc then '' when tp > 0 then '; Maps #' || tp else '; Maps not found in top 20' end || case when mc and gp > 0 then '; Maps top-three coverage ' || printf('%.1f', t3) || '% across ' || gp || ' grid points' else '' end evidence,
  len(list_filter([ow, mw, not ow and not mw, hp and not hb, hp and not hf], lambda x: x))::int n_actions"""


def _checked(spark, sf_dir):
    merged = market.merge(_candidates(spark, sf_dir))
    v = F.col("search_volume")
    found = merged.filter(v % 4 != 1).select("keyword", F.when(v % 5 == 0, 0).otherwise(v % 90 + 1).alias("position"), F.when(v % 5 == 0, "").otherwise(F.concat(F.lit("https://site.example/p/"), (v % 70).cast("string"))).alias("url"))
    snapshots = merged.filter(v % 3 != 0).select("keyword", (v % 6).alias("target_position"), F.when(v % 2 == 0, 9).otherwise(0).alias("grid_points"), (v % 100).cast("double").alias("top_three"))
    return visibility.checked(merged, found, snapshots, _pages_seen(spark, sf_dir))


def _shown(rows):
    return rows.select("keyword", "country_position", "page_title", "status", "priority", "evidence", F.size("actions").alias("n_actions"))


@query(f"with {_OPPS} select {_OPP_ROW} from c3", "candidates")
def q_checked_opportunities(spark, sf_dir):
    return _shown(_checked(spark, sf_dir))


@query(f"with {_OPPS.replace('c2 as (select c1.*', 'c2 as (select c1.* replace (case when mc and search_volume % 8 = 2 then 9 else gp end as gp, case when mc and search_volume % 8 = 2 then (search_volume % 61)::double else t3 end as t3)')} select {_OPP_ROW} from c3", "candidates")
def q_grid_updates(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    grids = market.merge(_candidates(spark, sf_dir)).filter("search_volume % 8 = 2").select("keyword", F.lit(9).alias("points"), (F.col("search_volume") % 61).cast("double").alias("top_three"))
    return _shown(visibility.with_grids(rows, grids, _pages_seen(spark, sf_dir)))


@query(f"with {_OPPS} select pp.url, array_to_string(list_sort(list(distinct keyword)), '|') keywords from c3 join pp on pp.k = case when target_url <> '' then {_KEY.format('target_url')} else {_KEY.format('c3.url')} end group by pp.url", "candidates")
def q_target_keywords(spark, sf_dir):
    return visibility.target_keywords(_checked(spark, sf_dir), _pages_seen(spark, sf_dir)).select("url", F.array_join("keywords", "|").alias("keywords"))


@query(
    f"""with {_OPPS}, sg as (select keyword, search_volume, (search_volume % 100)::double t3 from m where search_volume % 3 <> 0 and search_volume % 2 = 0)
    select country_position, keyword, c3.search_volume, case when position > 0 then '#' || position else 'not found in top 100' end organic, case when not mc then 'not checked' when tp > 0 then '#' || tp else 'not found in top 20' end maps,
    case when sg.keyword is null then 'not run' else printf('%.1f', sg.t3) || '%' end grid, url from c3 left join sg using (keyword)""",
    "candidates",
)
def q_current_view(spark, sf_dir):
    v = F.col("search_volume")
    snapshots = market.merge(_candidates(spark, sf_dir)).filter(v % 3 != 0).select("keyword", F.when(v % 2 == 0, 9).otherwise(0).alias("grid_points"), (v % 100).cast("double").alias("top_three"), F.col("ord").alias("pos"))
    return visibility.current_view(_checked(spark, sf_dir), snapshots)


@query("""with f as (select keyword, arg_min(position, ord) position, arg_min(search_volume % 30, ord) mp, arg_min(search_volume, ord) search_volume from candidates group by keyword)
  select keyword, case when position > 0 then '#' || position else 'Not found' end organic, case when mp > 0 then '#' || mp else 'Not found' end maps, search_volume from f order by search_volume desc, keyword limit 12""", "candidates")  # fmt: skip
def q_report_terms(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumns({"maps_position": F.col("search_volume") % 30, "pos": F.col("ord")})
    return visibility.report_terms(rows)


@query(f"with {_OPPS}, s as (select keyword, case when not ow and not mw then 2 when importance >= 4 then 0 else 1 end p, importance / effort r, search_volume v from c3) select keyword, r ratio from s order by p, r desc, v desc, keyword limit 8", "candidates")
def q_report_opportunities(spark, sf_dir):
    return visibility.report_opportunities(_checked(spark, sf_dir)).select("keyword", "ratio")


@query("select position, keyword, search_volume, url from candidates where position >= 1 and url <> '' order by position, search_volume desc, keyword limit 10", "candidates")
def q_report_rankings(spark, sf_dir):
    return visibility.report_rankings(market.existing_rankings(_candidates(spark, sf_dir))).select("position", "keyword", "search_volume", "url")


@query(f"with {_MERGED} select (select count(*) from candidates where position >= 1 and url <> '') existing_rankings, (select count(*) from m where source = 'current-ranking') current_terms, (select count(*) from m where source <> 'current-ranking') opportunities, (select count(*) from m where search_volume % 3 <> 0) maps_checks, (select count(distinct keyword) from candidates) keywords", "candidates")
def q_report_counts(spark, sf_dir):
    rows, merged = _candidates(spark, sf_dir), market.merge(_candidates(spark, sf_dir))
    counts = visibility.list_counts(market.existing_rankings(rows), merged.filter("source = 'current-ranking'"), merged.filter("source <> 'current-ranking'"), merged.filter("search_volume % 3 <> 0"))
    return counts.crossJoin(F.broadcast(visibility.keyword_count(rows)))  # one row each


@query(
    f"""with m0 as (select * replace (regexp_replace(keyword, '#[0-9]+', '') as keyword) from candidates), {_MERGED.replace("from candidates", "from m0")}, f as (select m.*, (select min(ord) from m0 c where c.keyword = m.keyword) ord from m),
    g as (select *, case when source = 'current-ranking' then 0 else 1 end l, coalesce({_KEY.format('target_url')}, {_KEY.format('url')}, 'keyword:' || keyword) key from f where search_volume >= 1 and not regexp_matches(keyword, '^({"|".join(T.INFORMATIONAL)}) ')),
    h as (select *, row_number() over (partition by key order by l, ord) rn from g), i as (select * from h where rn = 1 order by l, ord limit 5) select keyword from i where search_volume % 3 <> 0""",
    "candidates",
)
def q_grid_choice(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("keyword", F.regexp_replace("keyword", "#[0-9]+", ""))
    merged = market.merge(rows)
    return visibility.select_grids(merged.filter("source = 'current-ranking'"), merged.filter("source <> 'current-ranking'"), (), merged.filter("search_volume % 3 <> 0")).select("keyword")


@query(
    """with v as (select keyword, arg_max(search_volume, ord) + 7 sv, arg_max(cpc, ord) c from candidates where ord % 3 <> 0 group by keyword)
    select keyword, case when ord % 2 = 0 then 'supplied' else 'openrouter' end source, ord, coalesce(sv, 0)::int search_volume, coalesce(c, 0) cpc, case when ord % 2 = 0 then 0 else ord end relevance from (select keyword, ord from candidates) left join v using (keyword)""",
    "candidates",
)
def q_generated_candidates(spark, sf_dir):
    """Supplied and generated keywords with the last volume told of them, and both lists as one."""
    rows = _candidates(spark, sf_dir)
    told = rows.filter("ord % 3 <> 0")
    volumes = told.select(F.concat(F.lit(" "), F.upper("keyword")).alias("keyword"), "search_volume", "cpc", "ord").union(told.select("keyword", (F.col("search_volume") + 7).cast("int"), "cpc", F.col("ord") + 10**9))
    some = rows.select("keyword", "ord")
    both = market.with_volumes(some.filter("ord % 2 = 0"), volumes, "supplied").unionByName(market.with_volumes(some.filter("ord % 2 = 1"), volumes, "openrouter"))
    return both.select("keyword", "source", "ord", "search_volume", "cpc", F.col("relevance").cast("long").alias("relevance"))


@query(f"select lower(keyword) keyword, url, position, search_volume, cpc from candidates where position >= 1 and search_volume >= 1 and not regexp_matches(lower(keyword), '^({'|'.join(T.INFORMATIONAL)}) ')", "candidates")
def q_ranked_candidates(spark, sf_dir):
    got = _candidates(spark, sf_dir).select(F.concat(F.lit(" "), F.upper("keyword")).alias("keyword"), "url", "position", "search_volume", "cpc", "ord")
    return market.ranked_candidates(got).select("keyword", "url", "position", "search_volume", "cpc")


@query("select ord % 15 call, (row_number() over (partition by ord % 15 order by ord) - 1)::int ord, keyword, search_volume, cpc, position, url from candidates", "candidates")
def q_ranked_items(spark, sf_dir):
    rows = _candidates(spark, sf_dir).groupBy((F.col("ord") % 15).alias("call")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", "keyword", "search_volume", "cpc", "position", "url")))).alias("payload"))
    return files.ranked_items(rows, "call")


# The crawl.
_DEPTHS = f"with recursive {REACHED.replace('where dst', 'where dst % 9 <> 4 and dst')}, " + (
    "z as (select distinct page_id node from site_pages where in_sitemap and page_id not in (select node from b)), "
    "c(node, depth) using key (node) as (select node, -1 from z union select dst, min(depth) + 1 from c join site_edges on src = node where dst % 9 <> 4 and dst not in (select node from recurring.c) and dst not in (select node from b) group by dst)"
)


def _crawled(spark, sf_dir):
    edges = derived(spark, sf_dir, "site_edges").filter("dst % 9 <> 4")
    sitemap = derived(spark, sf_dir, "site_pages").filter("in_sitemap").select(F.col("page_id").alias("node"))
    return site.crawl(edges, spark.range(1).select(F.col("id").alias("node")), sitemap)


@query(f"{_DEPTHS} select node, depth::int depth from b union all select node, depth from c", "site_pages", "site_edges")
def q_crawl_depths(spark, sf_dir):
    return _crawled(spark, sf_dir)


@query("""select page_id, case when status_code not between 200 and 299 then 'HTTP ' || status_code when content_type not like '%html%' then 'non-HTML response' when noindex then 'noindex directive' when canonical_id <> page_id then 'canonicalised to another URL' end reason,
  status_code between 200 and 299 and page_id % 2 = 0 as_file from site_pages""", "site_pages")  # fmt: skip
def q_indexability(spark, sf_dir):
    i = F.col("page_id")
    rows = derived(spark, sf_dir, "site_pages")
    robots = F.when(F.col("noindex") & (i % 2 == 0), "follow, NOINDEX").otherwise("index")
    reason = findings.indexability(F.col("status_code"), F.col("content_type"), robots, F.when(F.col("noindex") & (i % 2 == 1), "noindex").otherwise(""), F.concat(F.lit("https://x.example/"), F.col("canonical_id").cast("string"), F.lit("/")), F.concat(F.lit("https://X.example/"), i.cast("string"), F.lit("?a=b")))
    return rows.select("page_id", reason.alias("reason"), findings.other_indexability(F.col("status_code"), F.when(i % 2 == 1, "none, noindex")).alias("as_file"))


@query("""select page_id, 'Fetch failed' "check", 'status ' || status_code evidence from site_pages where status_code >= 500 union all select page_id, 'Blocked by robots.txt', '/p/' || page_id from site_pages where status_code < 500 and page_id % 12 = 5""", "site_pages")
def q_crawl_findings(spark, sf_dir):
    i = F.col("page_id")
    rows = derived(spark, sf_dir, "site_pages").select("page_id", F.when(F.col("status_code") >= 500, F.concat(F.lit("status "), F.col("status_code").cast("string"))).alias("error"), (i % 12 != 5).alias("robots_allowed"), F.concat(F.lit("/p/"), i.cast("string")).alias("path"))
    return findings.findings(rows, site.crawl_rules(), ["page_id"]).select("page_id", "check", "evidence")


@query("""with s as (select page_id, case page_id % 6 when 0 then 0 when 1 then 429 when 2 then 503 when 3 then 404 else 200 end st, case when page_id % 4 = 1 then 'https://s/sitemap.xml returned 404' when page_id % 4 = 2 then 'https://s/a.xml: bad' end er, page_id % 3 + 1 n from pages)
  select page_id, 'Robots.txt unavailable' "check", 'warn' status from s where st in (0, 429, 503) union all select page_id, case when page_id % 4 = 1 and n = 1 then 'No XML sitemap found' else 'Sitemap error' end, case when page_id % 4 = 1 and n = 1 then 'warn' else 'fail' end from s where er is not null""")  # fmt: skip
def q_site_file_findings(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(i % 6 == 0, 0).when(i % 6 == 1, 429).when(i % 6 == 2, 503).when(i % 6 == 3, 404).otherwise(200).alias("robots_status"), F.when(i % 4 == 1, "https://s/sitemap.xml returned 404").when(i % 4 == 2, "https://s/a.xml: bad").alias("error"), (i % 3 + 1).alias("sources"))
    found = findings.findings(rows, site.robots_file_rules(), ["page_id"]).unionByName(findings.findings(rows.filter("error is not null"), site.sitemap_error_rules(), ["page_id"]))
    return found.select("page_id", "check", "status")


_TITLES = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(
    f"""with d as (select page_id, unnest([{{'c': 'Duplicate title', 'v': lower(trim(regexp_replace({_TITLES}, '\\s+', ' ', 'g')))}}, {{'c': 'Duplicate meta description', 'v': 'about ' || page_id % 40}}, {{'c': 'Duplicate H1', 'v': case when page_id % 3 = 0 then '' else 'head ' || page_id % 50 end}},
      {{'c': 'Exact duplicate content', 'v': case when page_id % 2 = 0 then sha256((page_id % 30)::varchar) else '' end}}]) x from pages where page_id % 10 <> 3),
    n as (select x.c c, x.v v, count(*) n from d where x.v <> '' group by all having count(*) > 1) select page_id, c "check", n from d join n on x.c = c and x.v = v"""
)
def q_duplicate_findings(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(i.alias("key"), (i % 10 != 3).alias("indexable"), F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.concat(F.lit("About  "), (i % 40).cast("string")).alias("description"), F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Head "), (i % 50).cast("string")))).alias("h1"), F.when(i % 2 == 0, 50).otherwise(49).alias("word_count"), F.sha2((i % 30).cast("string"), 256).alias("content_hash"))
    return site.duplicate_findings(rows).select(F.col("key").alias("page_id"), "check", "n")


@query(
    """with p as (select url, page_id, regexp_extract(url, '^([^?#]*)', 1) a from pages), m as (select *, a in (select a from p where page_id % 3 = 0) or page_id % 5 = 0 in_sitemap from p)
    select url, in_sitemap, a in (select a from m where page_id % 2 = 0) and a not in (select a from m where in_sitemap) unseen from m"""
)
def q_sitemap_membership(spark, sf_dir):
    """A third is listed by its address, a fifth by its final one; and which of some addresses a crawl has not met."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    address, i = U.crawl_url(F.col("url")), F.col("page_id")
    listed = pages.filter("page_id % 3 = 0").select(F.col("url").alias("loc")).union(pages.filter("page_id % 5 = 0").select(F.concat(F.lit("https://final.example/"), i.cast("string"), F.lit("?a=b"))))
    rows = site.in_sitemap(pages.select(address.alias("url"), F.concat(F.lit("https://final.example/"), i.cast("string")).alias("final_url"), F.col("url").alias("as_is"), "page_id"), listed)
    asked = rows.filter("page_id % 2 = 0").select(F.col("url").alias("loc"))
    new = site.unseen(asked, rows.filter("in_sitemap")).select(F.col("loc").alias("__loc"), F.lit(True).alias("u")).distinct()
    return rows.join(new, F.col("url") == F.col("__loc"), "left").select(F.col("as_is").alias("url"), "in_sitemap", F.coalesce("u", F.lit(False)).alias("unseen"))


@query("""with t as (select 'https://a' || page_id % 4 || '.example/r/' || page_id % 40 url from pages union select 'https://site.example/x' || page_id % 9 from pages) select url, true external from t union all select url, false from t where url like 'https://site.example/%' or url like 'https://www.site.example/%'""")
def q_resource_targets(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.array(F.concat(F.lit("https://a"), (i % 4).cast("string"), F.lit(".example/r/"), (i % 40).cast("string"))).alias("resources"), F.array(F.concat(F.lit("https://site.example/x"), (i % 9).cast("string"))).alias("external_links"))
    both = rows.select(F.concat("resources", "external_links").alias("resources"), F.array().cast("array<string>").alias("external_links"))
    start = F.lit("https://www.site.example/")
    return site.resource_targets(rows, start, True).withColumn("external", F.lit(True)).unionByName(site.resource_targets(both, start).withColumn("external", F.lit(False)))


@query("""select user_id, count(*) n, sum(event_id % 1000)::bigint bytes, max(epoch_us(ts)) lcp from events where event_id % 3 <> 0 group by user_id""")
def q_finished_requests(spark, sf_dir):
    """Each event is a response; two of three end, and twice, of which the first counts."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("request"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    ends = e.filter("request % 3 <> 0").select("user_id", "request", (F.col("at") + 1).alias("at"), (F.col("request") % 1000 + 0.4).alias("bytes"))
    again = ends.withColumn("at", F.col("at") + 5)
    done = performance.finished_requests(e.select("user_id", "request", "at", F.lit("https://a/").alias("url"), F.col("event_type").alias("type")), ends.union(again), ("user_id",))
    lcp = performance.largest_paint(e.filter("request % 3 <> 0"), "user_id")
    return done.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).join(lcp, "user_id")


# Every page check, on facts made of ids.


@query(
    """with f as (select *, contains(content_type, 'html') h from page_facts), c as (select page_id, unnest([
    case when status_code not between 200 and 299 then ['Non-success response', 'fail', 'high'] end, case when redirects > 1 then ['Redirect chain', 'warn', 'medium'] end,
    case when h and title_len = 0 then ['Missing title', 'fail', 'high'] when h and n_titles > 1 then ['Multiple titles', 'warn', 'medium'] when h and title_len > 60 then ['Long title', 'warn', 'low'] when h and title_len < 20 then ['Short title', 'warn', 'low'] end,
    case when h and desc_len = 0 then ['Missing meta description', 'warn', 'medium'] when h and n_desc > 1 then ['Multiple meta descriptions', 'warn', 'medium'] when h and desc_len > 160 then ['Long meta description', 'warn', 'low'] when h and desc_len < 70 then ['Short meta description', 'warn', 'low'] end,
    case when h and n_h1 = 0 then ['Missing H1', 'fail', 'high'] when h and n_h1 > 1 then ['Multiple H1s', 'warn', 'medium'] end, case when h and levels in ('1 3', '2 1 2 4') then ['Skipped heading level', 'warn', 'low'] end,
    case when h and n_canon = 0 then ['Missing canonical', 'warn', 'medium'] when h and n_canon > 1 then ['Multiple canonicals', 'fail', 'high'] end, case when h and (robots like '%NoFollow%' or x_robots = 'nofollow') then ['Nofollow directive', 'warn', 'medium'] end,
    case when h and not viewport then ['Missing viewport', 'fail', 'high'] end, case when h and lang = '' then ['Missing page language', 'warn', 'low'] end, case when h and missing_alt > 0 then ['Images missing alt attribute', 'warn', 'medium'] end,
    case when h and invalid > 0 then ['Invalid JSON-LD', 'fail', 'high'] end, case when h and not has_main then ['Missing main landmark', 'warn', 'low'] end, case when h and words < 50 and indexable then ['Very little visible text', 'warn', 'medium'] end,
    case when h and indexable and words >= 500 and n_h2 = 0 then ['Long page has no subheadings', 'warn', 'low'] end, case when h and indexable and longest > 150 then ['Very long paragraph', 'warn', 'low'] end,
    case when h and indexable and (is_article or page_id % 3 = 0) and author = '' then ['Article author not evident', 'warn', 'low'] end, case when h and indexable and (is_article or page_id % 3 = 0) and published = '' then ['Article date not evident', 'warn', 'low'] end,
    case when h and indexable and (is_article or page_id % 3 = 0) and words >= 500 and n_external = 0 then ['Long article has no external sources', 'warn', 'low'] end, case when h and (plain_resource or n_external = 1) then ['Mixed HTTP resource', 'fail', 'high'] end]) x from f)
    select page_id, x[1] "check", x[2] status, x[3] priority from c where x is not null""",
    "page_facts",
)
def q_every_page_check(spark, sf_dir):
    c, none = F.col, F.array().cast("array<string>")

    def many(n, value):
        return F.when(c(n) > 0, F.array_repeat(F.lit(value), c(n))).otherwise(none)

    facts = derived(spark, sf_dir, "page_facts").withColumns({
        "title": F.repeat(F.lit("t"), c("title_len")), "titles": many("n_titles", "t"), "description": F.repeat(F.lit("d"), c("desc_len")), "descriptions": many("n_desc", "d"), "h1": many("n_h1", "h"), "h2": many("n_h2", "h"),
        "heading_levels": F.transform(F.split("levels", " "), lambda x: x.cast("int")), "canonicals": many("n_canon", "https://h.example/"), "has_viewport": c("viewport"), "language": c("lang"), "images_missing_alt": c("missing_alt"), "invalid_structured": c("invalid"),
        "word_count": c("words"), "longest_paragraph": c("longest"), "schema_types": F.when(c("is_article"), F.array(F.lit(" NewsArticle"))).otherwise(F.array(F.lit("WebPage"))), "modified": F.lit(""), "external_links": many("n_external", "http://o.example/"),
        "resources": F.when(c("plain_resource"), F.array(F.lit("http://r.example/"))).otherwise(F.array(F.lit("https://r.example/"))),
    })
    found = findings.ordered(findings.findings(facts, findings.page_rules(), ["page_id", "url"]))
    return found.select("page_id", "check", "status", "priority")


@query("select url, count(*) filter (n = 0) high, count(*) filter (n = 1) medium, count(*) filter (n = 2) low from (select url, page_id % 3 n from pages union all select url, page_id % 2 from pages) group by url")
def q_page_issues(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in ("high", "medium", "low")])
    p = table(spark, sf_dir, "pages")
    rows = p.select("url", F.get(names, (F.col("page_id") % 3).cast("int")).alias("priority")).union(p.select("url", F.get(names, (F.col("page_id") % 2).cast("int"))))
    return findings.page_issues(rows)


@query("""with k as (select s_suppkey i, 'https://h.example/' || s_suppkey url from supplier) select case when i % 2 = 0 then 'https://f.example/' || i else url end page, 'service' page_type, (i % 3 + 1)::int n, case when i % 5 = 0 then '0 high, 0 medium, 0 low' else (i % 4) || ' high, 1 medium, 0 low' end issues,
  case when i % 2 = 0 and i % 3 = 0 then 'booking and phone' when i % 2 = 0 then 'booking' when i % 3 = 0 then 'phone' else 'none' end conversion from k where i % 4 <> 3""")  # fmt: skip
def q_priority_pages(spark, sf_dir):
    i = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(i, F.concat(F.lit("https://h.example/"), i.cast("string")).alias("url"))
    pages = s.select("url", F.when(i % 2 == 0, F.concat(F.lit("https://f.example/"), i.cast("string"))).otherwise("").alias("final_url"), F.lit("service").alias("page_type"), (i % 4 != 3).alias("priority_page"), (i % 2 == 0).alias("booking"), (i % 3 == 0).alias("phone"))
    words = s.select("url", F.array_repeat(F.lit("k"), (i % 3 + 1).cast("int")).alias("keywords"))
    issues = s.filter(i % 5 != 0).select("url", (i % 4).alias("high"), F.lit(1).alias("medium"), F.lit(0).alias("low"))
    return visibility.priority_pages(pages, words, issues).select("page", "page_type", F.size("keywords").alias("n"), "issues", "conversion")


@query("select count(*) pages, count(*) filter (indexable) indexable, count(*) filter (page_id % 4 > 0) with_issues, count(distinct page_id % 5) page_types from site_pages", "site_pages")
def q_page_counts(spark, sf_dir):
    return visibility.page_counts(derived(spark, sf_dir, "site_pages").select("indexable", (F.col("page_id") % 4).alias("issues"), (F.col("page_id") % 5).alias("page_type")))


@query("""select page_id id, case when page_id % 2 = 0 then 'https://f.example/' || page_id else url end url, length(repeat('t', (page_id % 300)::int)[:240])::int title_len, least(page_id % 5, 3)::int n_h1, least(page_id % 12, 10)::int n_types, page_id % 3 > 0 has_booking, page_id % 4 > 0 has_phone,
  case when page_id % 7 = 0 then 'unknown' when page_id % 2 = 0 then 'service' else 'blog' end page_type, case when page_id % 7 = 0 then '' else 'because ' || page_id end reason, case when page_id % 7 = 0 then '' else 'k' || page_id || '|b c|d' end seeds, page_id % 7 <> 0 and page_id % 2 = 0 commercial from pages""")  # fmt: skip
def q_page_labels(spark, sf_dir):
    i = F.col("page_id")
    few = lambda n, x: F.when(n > 0, F.array_repeat(F.lit(x), n.cast("int"))).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf_dir, "pages")
    pages = p.select(i.alias("id"), "url", F.when(i % 2 == 0, F.concat(F.lit("https://f.example/"), i.cast("string"))).otherwise("").alias("final_url"), F.repeat(F.lit("t"), (i % 300).cast("int")).alias("title"), few(i % 5, "h").alias("h1"), few(i % 12, "T").alias("schema_types"), few(i % 3, "b").alias("booking_links"), few(i % 4, "p").alias("phone_links"))
    kind = F.when(i % 7 == 0, "nonsense").when(i % 2 == 0, "service").otherwise("blog")
    seeds = F.array(F.concat(F.lit(" K"), i.cast("string")), F.lit("b  C"), F.lit(""), F.lit("B c"), F.lit("d"), F.lit("e"))
    labels = p.select(i.alias("id"), kind.alias("type"), F.concat(F.lit("because  "), i.cast("string")).alias("reason"), seeds.alias("keyword_seeds"), F.lit(1).alias("pos"))
    labels = labels.union(p.select(i.alias("id"), F.when(i % 7 == 0, "nonsense").otherwise("home"), F.lit("later"), seeds, F.lit(2)))
    got = visibility.labelled(visibility.label_inputs(pages), labels)
    return got.select("id", "url", F.length("title").alias("title_len"), F.size("h1").alias("n_h1"), F.size("schema_types").alias("n_types"), "has_booking", "has_phone", "page_type", "reason", F.array_join("keyword_seeds", "|").alias("seeds"), "commercial")


@query("select count(*) requests, sum(o_orderkey % 100)::bigint prompt_tokens, sum(o_orderkey % 30)::bigint completion_tokens, sum(o_orderkey % 8 / 8) \"cost\", count(*) filter (o_orderkey % 50 = 1) failed from orders")
def q_label_usage(spark, sf_dir):
    k = F.col("o_orderkey")
    return visibility.usage_totals(table(spark, sf_dir, "orders").select((k % 100).alias("prompt_tokens"), (k % 30).alias("completion_tokens"), (k % 8 / 8).alias("cost"), F.when(k % 50 == 1, "failed").alias("error")))


@query("""with s as (select p_partkey % 6 pos, unnest(['b c', 'k' || p_partkey % 4]) k, unnest([0, 1]) "at" from part where p_partkey % 2 = 0) select k keyword, min(pos)::bigint pos, arg_min("at", (pos, "at"))::int "at" from s group by k""")
def q_keyword_seeds(spark, sf_dir):
    i = F.col("p_partkey")
    seeds = F.array(F.lit(" B  c"), F.concat(F.lit("K"), (i % 4).cast("string")), F.lit("b C "), F.lit(""))
    rows = table(spark, sf_dir, "part").select((i % 6).alias("pos"), (i % 2 == 0).alias("priority_page"), visibility.normalized_keywords(seeds).alias("keyword_seeds"))
    return visibility.distinct_seeds(rows)


@query("select distinct host from (select 'start.example' host union all select 'biz' || s_suppkey % 20 || '.example' from supplier)")
def q_audited_hosts(spark, sf_dir):
    i = F.col("s_suppkey")
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.when(i % 2 == 0, "https://WWW.biz").otherwise("http://biz"), (i % 20).cast("string"), F.lit(".example"), F.when(i % 3 == 0, ".").otherwise(""), F.lit("/a")).alias("final_url"))
    return identity.audited_hosts(F.lit("https://www.start.example/x"), pages)


@query("""with h as (select s_suppkey % 25 site, min('biz' || ((s_suppkey * 3) % 20) || '.example') h from supplier where s_suppkey % 2 = 0 group by 1),
  x as (select place_id, site, phone, case when website <> '' then regexp_replace(lower(regexp_extract(website, '^https?://([^/]*)', 1)), '^www\\.', '') end host, regexp_replace(phone, '[^0-9]', '', 'g') d from profiles),
  g as (select distinct s_suppkey % 25 site, 'biz' || ((s_suppkey * 3) % 20) || '.example' host from supplier where s_suppkey % 2 = 0), f as (select distinct s_suppkey % 25 site, '020' || (7000000 + s_suppkey * 13) d from supplier where s_suppkey % 3 <> 1),
  n as (select site, count(*) n from f group by site)
  select place_id, 'high' priority, case when host is not null then 'website host ' || x.host || ' differs from audited host ' || coalesce(h.h, '') else 'phone ' || phone || ' differs from ' || n || ' public website phone numbers' end evidence
  from x left join h using (site) left join n on n.site = x.site where case when host is not null then not exists (select 1 from g where g.site = x.site and (g.host = x.host or x.host like '%.' || g.host or g.host like '%.' || x.host))
    else phone <> '' and n > 0 and not exists (select 1 from f where f.site = x.site and right(f.d, 9) = right(x.d, 9)) end""", "profiles")  # fmt: skip
def q_identity_findings(spark, sf_dir):
    """By host where a profile names one, else by phone."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    hosts = s.filter(k % 2 == 0).select((k % 25).alias("site"), F.concat(F.lit("biz"), ((k * 3) % 20).cast("string"), F.lit(".example")).alias("host"))
    phones = s.filter(k % 3 != 1).select((k % 25).alias("site"), F.concat(F.lit("020 "), (7000000 + k * 13).cast("string")).alias("phone"))
    profiles = derived(spark, sf_dir, "profiles").select("place_id", "site", "website", "phone")
    return findings.identity_findings(identity.verify(profiles, hosts, phones)).select("place_id", "priority", "evidence")


@query("""select place_id, address, case place_id % 5 when 0 then 'Town, Land' when 1 then 'Loc, Land' when 2 then 'Land' when 3 then 'State' else 'Land' end market, case when place_id % 5 = 3 then '' else 'Land' end country, reviews, photos from (select s_suppkey place_id, s_name address, case when s_suppkey % 3 = 0 then null else (s_suppkey % 4)::int end reviews, case when s_suppkey % 2 = 0 then (s_suppkey % 3)::int end photos from supplier)""")
def q_place_profiles(spark, sf_dir):
    """Captured profiles: towns before localities, states without anything smaller, and a locality that is the country."""
    i = F.col("s_suppkey")

    def part(text, kind, when):
        return F.when(when, F.struct(F.lit(text).alias("longText"), F.array(F.lit("political"), F.lit(kind)).alias("types")))

    k = i % 5
    parts = F.array_compact(F.array(part("Loc", "locality", k <= 1), part("Town", "postal_town", k == 0), part("Land", "locality", k == 2), part("State", "administrative_area_level_1", k.isin(0, 3)), part("Land", "country", k != 3)))
    photos = F.when(i % 2 == 0, F.when(i % 3 > 0, F.array_repeat(F.struct(F.lit("p").alias("name")), (i % 3).cast("int"))).otherwise(F.array().cast("array<struct<name:string>>")))
    payload = F.to_json(F.struct(i.cast("string").alias("id"), F.col("s_name").alias("formattedAddress"), parts.alias("addressComponents"), F.when(i % 3 != 0, (i % 4).cast("int")).alias("userRatingCount"), photos.alias("photos")))
    got = files.places(table(spark, sf_dir, "supplier").select(payload.alias("payload")))
    return got.select(F.col("place_id").cast("long").alias("place_id"), "address", "market", "country", "reviews", "photos")


# Text and address helpers.


@query("""select s_suppkey k, 'a' || s_suppkey || 'é<>"' || chr(128512) said, 'x&lt;y' kept from supplier""")
def q_numbered_references(spark, sf_dir):
    i = F.col("s_suppkey").cast("string")
    source = F.concat(F.lit("<p>&#97;"), i, F.lit("&#xe9;&lt;&#62;&#34;&#x1F600;</p>"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), extract.stripped(source).alias("said"), extract.stripped(F.lit("x&amp;lt;y")).alias("kept"))


@query("""select s_suppkey k, s_suppkey % 2 = 0 token, round(s_acctbal, 1) rounded, s_suppkey || case when s_suppkey = 1 then ' page' else ' pages' end label, case when s_suppkey % 3 = 0 then 'place:' || s_name else 'site:s' end key, case when s_suppkey % 3 = 0 then 'http://' else 'https://' end || 'h/' || s_suppkey start_,
  case when s_suppkey % 3 = 0 then 'https://c/' || s_suppkey else 'https://d/' end canonical, 'Y' fp, case when s_suppkey % 4 = 0 then '1.0000000,' || printf('%.7f', s_suppkey / 8) else 'London' end place, least(case when s_suppkey % 20 = 0 then 8 else s_suppkey % 20 end, 10)::int checks, '20260102T030405.006Z-h.example.json' "name" from supplier""")  # fmt: skip
def q_small_helpers(spark, sf_dir):
    i, n = F.col("s_suppkey"), F.col("s_name")
    t = i.cast("string")
    fp = T.page_fingerprint("a", version="2")
    rows = table(spark, sf_dir, "supplier").withColumn("a", F.concat(F.lit("u"), t))
    checks = F.get(F.array(*[F.lit(market.check_limit(k)) for k in range(20)]), (i % 20).cast("int"))
    return rows.select(
        i.alias("k"), T.has_token(F.when(i % 2 == 0, "me  nofollow").otherwise("nofollowed"), "nofollow").alias("token"), T.round_metric(F.col("s_acctbal"), 1).alias("rounded"), T.count_label(i, "page").alias("label"), T.business_key(F.when(i % 3 == 0, n).otherwise(""), F.lit("s")).alias("key"),
        U.start_url(F.when(i % 3 == 0, F.concat(F.lit(" http://h/"), t, F.lit("#f"))).otherwise(F.concat(F.lit("h/"), t))).alias("start_"), extract.canonical(F.when(i % 3 == 0, F.array(F.concat(F.lit("https://c/"), t))).otherwise(F.array().cast("array<string>")), F.lit('<https://x/>; rel="next", <https://d/>; rel="canonical"')).alias("canonical"),
        F.when(F.length(fp) == 64, "Y").alias("fp"), market.search_place(F.when(i % 4 == 0, 1.0).otherwise(0.0), F.when(i % 4 == 0, i / 8).otherwise(0.0), F.lit("London")).alias("place"), checks.alias("checks"),
        files.report_name(F.lit("2026-01-02 03:04:05.006").cast("timestamp"), F.lit("https://www.H.example/x")).alias("name"),
    )
