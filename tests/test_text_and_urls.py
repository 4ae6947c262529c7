import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U


def values(spark, rows, expr, *names):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(expr).collect()]


def test_text(spark):
    c = F.col("x")
    assert values(spark, [" a  b\n"], T.clean_text(c), "x") == ["a b"]
    assert values(spark, ["Ünder 12-b"], T.tokenize(c), "x") == [["Ünder", "12", "b"]]
    assert values(spark, ["Dr. X & Co1"], T.compact(c), "x") == ["drxco1"]
    assert values(spark, ["cats", "implants", "glass"], T.normalize_term(c), "x") == ["cats", "implant", "glass"]
    assert values(spark, ["dental implants near your home implants"], T.keyword_terms(c), "x") == [["dental", "implant"]]
    assert values(spark, ["how to", "however", "is it"], T.is_informational(c), "x") == [True, False, True]
    assert values(spark, ["babys here", "toys", "ys", "crys"], T.is_misspelled_plural(c), "x") == [True, False, False, True]
    assert values(spark, ["sw1a dentist", "dentist in london sw1a", "dentist"], T.is_location_code(c), "x") == [True, False, False]
    assert values(spark, ["smile clinic", "smil", "my smileclinic"], T.is_branded(c, "Smile Clinic"), "x") == [True, False, True]
    assert values(spark, ["noindex, follow", "index"], T.has_directive(c, "noindex"), "x") == [True, False]
    assert values(spark, ["London, United Kingdom"], T.country_of(c), "x") == ["United Kingdom"]
    assert values(spark, ["abcdef", "abc"], T.truncate(c, 4, dots=True), "x") == ["abc...", "abc"]


def test_phones(spark):
    rows = [("020 7946 0123", "+44 20 7946 0123"), ("12345", "12345"), ("020 7946 0123", "020 7946 0124")]
    assert values(spark, rows, T.same_phone(F.col("a"), F.col("b")), "a", "b") == [True, False, False]


def test_scores(spark):
    df = spark.sql("select * from values (15.0, 10, 3), (5.0, 10, 0), (0.0, 1000, 26), (0.0, 10, 71) t(cpc, vol, pos)")
    got = df.select(T.importance(F.col("cpc"), F.col("vol")), T.effort(F.col("pos"))).collect()
    assert [tuple(r) for r in got] == [(5, 1), (4, 5), (5, 3), (3, 5)]


def test_levels(spark):
    df = spark.sql("select * from values (array(1, 2, 3)), (array(1, 3)), (cast(array() as array<int>)), (array(3)) t(l)")
    assert [r[0] for r in df.select(T.skips_level(F.col("l"))).collect()] == [False, True, False, False]


@pytest.mark.parametrize(
    "url,crawl,comparable,page",
    [
        ("https://A.com/x/?q=1#f", "https://A.com/x/", "https://a.com/x", "https://a.com/x"),
        ("https://A.com", "https://A.com/", "https://a.com/", "https://a.com"),
        ("https://a.com:8080/B/", "https://a.com:8080/B/", "https://a.com:8080/B", "https://a.com:8080/B"),
    ],
)
def test_urls(spark, url, crawl, comparable, page):
    c = F.col("x")
    df = spark.createDataFrame([(url,)], "x string").select(U.crawl_url(c), U.comparable_url(c), U.comparable_page(c))
    assert tuple(df.first()) == (crawl, comparable, page)


def test_resolution(spark):
    rows = [("https://a.com/x/y?q", r) for r in ("/z", "z", "../z", "//b.com/q", "?k=1", "#f", "mailto:a@b", "http://c.com/", "")]
    got = values(spark, rows, U.resolve(F.col("b"), F.col("r")), "b", "r")
    assert got == ["https://a.com/z", "https://a.com/x/z", "https://a.com/z", "https://b.com/q", "https://a.com/x/y?k=1", None, None, "http://c.com/", None]


def test_hosts(spark):
    assert values(spark, ["https://www.A.com/x", "www.a.com.", "a.com/x"], U.domain(F.col("x")), "x") == ["a.com", "a.com", "a.com"]
    rows = [("shop.a.com", "a.com"), ("xa.com", "a.com"), ("a.com", "a.com")]
    assert values(spark, rows, U.related_host(F.col("a"), F.col("b")), "a", "b") == [True, False, True]
