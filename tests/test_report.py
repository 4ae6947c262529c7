"""Lines of the report on an audit."""

from pyspark.sql import functions as F

from weftline import audit, report


def test_lines(spark):
    pages = spark.createDataFrame([("https://x.example/", "<title>T</title><a href=a>A</a><a href=gone></a><a href=https://y.example/>Y</a>"), ("https://x.example/a", "<title>T</title>"), ("https://x.example/gone", "x")], "url string, html string")
    responses = pages.select("url", F.col("url").alias("final_url"), F.when(F.col("url").endswith("gone"), 404).otherwise(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(0).alias("redirects"), F.lit("").alias("x_robots"), F.lit("").alias("link_header"))
    samples = pages.limit(1).select(F.lit("https://x.example/").alias("url"), F.lit(3000.0).alias("lcp"), *[F.lit(0.0).alias(c) for c in ("cls", "tbt", "ttfb")], *[F.lit(0).alias(c) for c in ("bytes", "js_bytes", "requests", "dom_nodes", "images_without_size", "images_not_lazy")])
    out = audit.audit(spark, {"pages": pages, "responses": responses, "sitemap": pages.select(F.col("url").alias("loc")), "perf_samples": samples}, "all", 2, "https://x.example/")
    told = [r.line for r in report.lines(out, "https://x.example/").collect()]
    assert told[:2] == ["SEO audit: https://x.example/", "Crawled: 2 URLs (2 indexable, 0 non-indexable)"]
    assert told[2].startswith("Discovered: 2 internal links, 1 external links") and told[3].startswith("Actions: ")
    assert "Performance: 1 pages measured; worst LCP 3.00s, CLS 0.000, TBT 0ms, TTFB 0ms" in told
    assert "Warning: crawl limit reached; rerun with a higher limit for complete coverage." in told
    at = told.index("PRIORITY\tAREA\tISSUE\tOCCURRENCES\tEXAMPLE\tFIX")
    rows = [line.split("\t") for line in told[at + 1 :]]
    assert all(len(r) == 6 for r in rows) and [r[0] for r in rows] == sorted((r[0] for r in rows), key=["HIGH", "MEDIUM", "LOW"].index)
    twice = next(r for r in rows if r[2] == "Duplicate title")
    assert twice[3] == "2" and twice[4].startswith("https://x.example/ ") and twice[5].startswith("Make each")
    empty = report.lines({"issues": out["issues"].limit(0), "summary": out["summary"]}, "s")
    assert [r.line for r in empty.collect()][-1] == "No deterministic issues found in the public crawl."
