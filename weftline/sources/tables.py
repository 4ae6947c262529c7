"""Reads of the parquet tables and the relations derived from them, by the same SQL in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SITE_PAGES = """select page_id, url,
  case when page_id % 23 = 7 then 404 when page_id % 29 = 11 then 500 else 200 end status_code,
  case when page_id % 17 = 5 then 1 when page_id % 37 = 9 then 2 else 0 end redirects,
  case when page_id % 41 = 13 then 'application/pdf' else 'text/html; charset=utf-8' end content_type,
  page_id % 19 = 3 noindex, case when page_id % 13 = 4 then page_id + 1 else page_id end canonical_id, page_id % 3 <> 1 in_sitemap,
  case when page_id % 23 <> 7 and page_id % 29 <> 11 and page_id % 41 <> 13 and page_id % 19 <> 3 and page_id % 13 <> 4 then true else false end indexable
  from pages"""
EDGES = """select src, dst, (src + dst) % 11 = 0 nofollow, case when (src * dst) % 13 = 0 then '' else 'link' end anchor from (
  select page_id src, page_id * 3 dst from pages union all select page_id, page_id * 3 + 1 from pages union all select page_id, page_id * 3 + 2 from pages
  union all select page_id, (page_id * 7 + 5) % 50 from pages) e where dst % 10 <> 9 and dst in (select page_id from pages)"""
HREFLANG = """select src, dst, case when src % 2 = 0 then 'en' else 'de' end language from (
  select page_id src, page_id + 1 dst from pages where page_id % 4 < 3 union all select page_id, page_id - 1 from pages where page_id % 4 = 1 or page_id % 6 = 0) x where src <> dst"""
CANDIDATES = """select concat(p_name, ' ', lower(p_brand)) keyword, cast((p_partkey * 37) % 1500 as int) search_volume, round((p_retailprice - 900) / 5, 2) cpc,
  cast(case when p_partkey % 4 = 0 then p_size * 2 else 0 end as int) position,
  case when p_partkey % 4 = 0 then 'current-ranking' when p_partkey % 4 = 1 then 'supplied' when p_partkey % 4 = 2 then 'openrouter' else 'site-discovery' end source,
  p_partkey % 4 = 1 explicit, p_partkey relevance, p_partkey % 50 target_page_id, p_partkey ord,
  case when p_partkey % 4 = 0 then concat('https://site.example/p/', cast(p_partkey % 70 as varchar(20)), '/') else '' end url,
  case when p_partkey % 5 = 0 then concat('https://Site.example/t/', cast(p_partkey % 90 as varchar(20))) else '' end target_url from part"""
GRID = """select kw, pt, place, cast(position as int) position from (select l_partkey % 50 kw, l_orderkey % 9 pt, l_suppkey place,
  row_number() over (partition by l_partkey % 50, l_orderkey % 9 order by l_extendedprice desc, l_orderkey, l_suppkey, l_partkey, l_linenumber) position from lineitem) g where position <= 20"""
SAMPLES = """select user_id, cast(max(value) * 60 as double) lcp, cast(min(value) / 100 as double) cls, cast(avg(value) * 10 as double) tbt, cast(min(value) * 200 as double) ttfb,
  count(*) * 150000 bytes, count(*) * 20000 js_bytes, count(*) * 4 requests, count(*) * 60 dom_nodes, sum(case when event_type = 'click' then 1 else 0 end) images_without_size,
  sum(case when event_type = 'purchase' then 1 else 0 end) images_not_lazy from events group by user_id"""
PROFILES = """select s_suppkey place_id, case when s_suppkey % 11 = 3 then 'CLOSED_TEMPORARILY' else 'OPERATIONAL' end business_status, case when s_suppkey % 7 = 2 then '' else 'dentist' end category,
  case when s_suppkey % 5 = 1 then null else s_name end address, case when s_suppkey % 6 = 4 then '' else concat('+44 20 ', cast(7000000 + s_suppkey * 13 as varchar(20))) end phone,
  case when s_suppkey % 3 = 0 then '' else concat('https://', case when s_suppkey % 4 = 1 then 'www.' when s_suppkey % 4 = 2 then 'shop.' else '' end, 'biz', cast(s_suppkey % 20 as varchar(20)), '.example/') end website,
  case when s_suppkey % 8 = 5 then cast(null as int) else cast(s_suppkey % 3 as int) end reviews, case when s_suppkey % 9 = 4 then cast(null as int) else cast(s_suppkey % 4 as int) end photos,
  s_suppkey % 10 <> 6 has_hours, s_suppkey % 25 site from supplier"""
RESOURCES = """select concat('https://cdn', cast(l_suppkey % 7 as varchar(20)), '.example/r/', cast(l_partkey % 500 as varchar(20))) url,
  max(case when l_partkey % 31 = 4 then 404 when l_partkey % 43 = 6 then 0 else 200 end) status, max(case when l_partkey % 3 = 0 then 'image/png' else 'text/css' end) type,
  cast(max(l_extendedprice * 10) as bigint) size, l_suppkey % 7 < 3 internal from lineitem group by 1, 5"""

PAGE_FACTS = """select page_id, url, case when page_id % 31 = 30 then 404 else 200 end status_code, cast(page_id % 29 % 3 as int) redirects, case when page_id % 27 = 26 then 'application/pdf' else 'text/html' end content_type, page_id % 10 <> 9 indexable,
  case when page_id % 3 = 0 then concat('https://h.example/blog/', cast(page_id as varchar(20))) else concat('https://h.example/p/', cast(page_id as varchar(20))) end final_url,
  cast(case page_id % 11 when 0 then 0 when 1 then 70 when 2 then 12 else 40 end as int) title_len, cast(case when page_id % 11 = 3 then 2 else 1 end as int) n_titles,
  cast(case page_id % 13 when 0 then 0 when 1 then 200 when 2 then 30 else 100 end as int) desc_len, cast(case when page_id % 13 = 3 then 2 else 1 end as int) n_desc, cast(page_id % 7 % 4 as int) n_h1, cast(page_id % 2 as int) n_h2,
  case when page_id % 5 = 4 then '1 3' when page_id % 5 = 3 then '2 1 2 4' else '1 2 3 2' end levels, cast(page_id % 6 % 3 as int) n_canon, case when page_id % 8 = 1 then 'index, NoFollow' else 'index' end robots, case when page_id % 8 = 2 then 'nofollow' else '' end x_robots,
  page_id % 9 <> 5 viewport, case when page_id % 9 = 6 then '' else 'en' end lang, cast(page_id % 4 as int) missing_alt, cast(page_id % 14 % 2 as int) invalid, page_id % 12 <> 7 has_main, cast(case page_id % 15 when 0 then 10 when 1 then 600 when 2 then 700 else 300 end as int) words,
  cast(case when page_id % 16 = 3 then 151 else 150 end as int) longest, page_id % 17 = 4 is_article, case when page_id % 18 < 9 then 'A' else '' end author, case when page_id % 19 = 5 then '2026' else '' end published, cast(page_id % 20 % 2 as int) n_external, page_id % 21 = 8 plain_resource from pages"""

DERIVED = {"page_facts": PAGE_FACTS, "site_pages": SITE_PAGES, "site_edges": EDGES, "hreflang": HREFLANG, "candidates": CANDIDATES, "grid_results": GRID, "perf_samples": SAMPLES, "profiles": PROFILES, "resources": RESOURCES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation. Its base tables are passed by name, so no view is left behind in the session."""
    import re

    sql, used = DERIVED[name], {}
    for base in ("pages", "part", "lineitem", "events", "supplier"):
        if re.search(rf"\bfrom {base}\b", sql):
            sql = re.sub(rf"\bfrom {base}\b", f"from {{{base}}}", sql)
            used[base] = table(spark, sf_dir, base)
    return spark.sql(sql, **used)
