"""Merges that leave other files alone, and pages for keywords without a product of the two."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.operators import market, store


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("x"))
    assert store.merge(first, path, ["k"], "v", 16) == list(range(16))
    assert rows(store.stored(spark, path)) == rows(first)
    before = files(path)
    new = spark.createDataFrame([(7, 2, "later"), (7, 3, "latest"), (8, 0, "older"), (1000, 1, "new")], "k long, v int, x string")
    touched = store.merge(new, path, ["k"], "v", 16)
    after = files(path)
    same = {p for p in before if after.get(p) == before[p]}
    assert 1 <= len(touched) <= 3 and {int(p.parent.name.split("=")[1]) for p in before.keys() - same} == set(touched) - ({int(p.parent.name.split("=")[1]) for p in after} - {int(p.parent.name.split("=")[1]) for p in before})
    assert all(int(p.parent.name.split("=")[1]) not in touched for p in same) and len(same) >= 13
    want = {r[0]: r for r in rows(first)} | {7: (7, 3, "latest"), 1000: (1000, 1, "new")}
    assert rows(store.stored(spark, path)) == sorted(want.values())
    # Again: the same table.
    store.merge(new, path, ["k"], "v", 16)
    assert rows(store.stored(spark, path)) == sorted(want.values())


def test_merge_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "kept")
    store.merge(spark.createDataFrame([(None, 1, "n"), (1, 1, None)], "k long, v int, x string"), path, ["k"], "v", 4)
    assert store.merge(spark.createDataFrame([], "k long, v int, x string"), path, ["k"], "v", 4) == []
    store.merge(spark.createDataFrame([(None, 2, "m", 5)], "k long, v int, x string, more int"), path, ["k"], "v", 4)
    assert {tuple(r) for r in store.stored(spark, path).select("k", "v", "x", "more").collect()} == {(None, 2, "m", 5), (1, 1, None, None)}
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([(1, 1, "x")], "k long, v int, x string"), path, ["k"], "v", 8)
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([(1, 1)], "bucket long, v int"), path, ["bucket"], "v", 4)


WORDS = "garden river stone window letter winter morning table paper distant walking carried yellow example".split()


def plain(asked, pages):
    """Every keyword against every page."""
    def terms(text):
        import re

        words = [w[:-1] if len(w) > 5 and w.endswith("s") else w for w in re.findall("[a-z]+", text.lower())]
        return {w for w in words if len(w) >= 4 and w not in market.T.STOPWORDS}

    has = {}
    for url, title in pages:
        has.setdefault(url, set()).update(terms(url) | terms(title))
    out = {}
    for keyword, given in asked:
        scored = [(-len(terms(keyword) & t), url) for url, t in has.items() if terms(keyword) & t]
        out[keyword] = given or (min(scored)[1] if scored else "")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_assigned_pages_are_the_best(spark, seed):
    rng = random.Random(seed)
    pages = [(f"https://h.example/{rng.choice(WORDS)}/{i}", " ".join(rng.sample(WORDS, rng.randint(0, 4)))) for i in range(60)] + [("https://h.example/garden/1", "river")] * 2
    asked = [(" ".join(rng.sample(WORDS, rng.randint(1, 6))) + rng.choice(["", " unknown", " example"]), "") for _ in range(80)] + [("none here", ""), ("given", "https://x/")]
    asked = list(dict(asked).items())
    empty = F.array().cast("array<string>")
    p = spark.createDataFrame(pages, "url string, title string").withColumns({"h1": empty, "seeds": empty})
    got = market.assign_pages(spark.createDataFrame(asked, "keyword string, target_url string"), p)
    assert {r.keyword: r.target_url for r in got.collect()} == plain(asked, pages)


def test_a_term_on_all_pages_meets_no_keyword(spark, monkeypatch):
    """Each keyword has one rare term and one that all pages have: what is written in a round stays as small as the keywords."""
    sizes = []
    save = market.saved
    monkeypatch.setattr(market, "saved", lambda df: sizes.append((out := save(df)).count()) or out)
    empty = F.array().cast("array<string>")
    pages = spark.range(300).select(F.concat(F.lit("https://h.example/p"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("common rare"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("title"), empty.alias("h1"), empty.alias("seeds"))
    asked = pages.select(F.concat("title", F.lit(" example")).alias("keyword"), F.lit("").alias("target_url"))
    got = market.assign_pages(asked, pages)
    plan = got._jdf.queryExecution().toString()
    assert got.filter("target_url = ''").count() == 0 and got.count() == 300 and max(sizes) <= 300, plan
