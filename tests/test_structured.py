"""Structured data against a parser of JSON and a walk over what it gives."""

import json
import random

from pyspark.sql import functions as F

from weftline.operators import extract


def facts(spark, *sources):
    df = spark.createDataFrame([(f"http://h.example/{i}", s) for i, s in enumerate(sources)], "url string, html string")
    rows = extract.features(df).select("url", "metadata").collect()
    return [r.metadata for r in sorted(rows, key=lambda r: int(r.url.rsplit("/", 1)[1]))]


def block(text):
    return f'<script type="application/ld+json">{text}</script>'


def walk(value, out):
    """Objects from the top: types of all, the first author and dates that say something."""
    if isinstance(value, list):
        for x in value:
            walk(x, out)
    elif isinstance(value, dict):
        kind = value.get("@type")
        out["types"] |= {t for t in (kind if isinstance(kind, list) else [kind]) if isinstance(t, str) and t.strip()}
        for key, field in (("author", "author"), ("datePublished", "published"), ("dateModified", "modified")):
            if not out[field]:
                out[field] = name(value.get(key)) if key == "author" else text(value.get(key))
        for x in value.values():
            walk(x, out)


def text(value):
    return " ".join(value.split()) if isinstance(value, str) else ""


def name(value):
    if isinstance(value, list):
        return next((n for n in map(name, value) if n), "")
    return text(value.get("name")) if isinstance(value, dict) else text(value)


def random_json(rng, depth=0):
    if depth > 4 or rng.random() < 0.25:
        return rng.choice(["x", "", "a \\ b", 'q"uote', '"author":', "é", "tab\there", 3, -1.5, True, None, " spaced  out "])
    if rng.random() < 0.4:
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    keys = rng.sample(["@type", "author", "name", "datePublished", "dateModified", "k", "@graph", 'od"d'], rng.randint(0, 5))
    return {k: rng.choice(["T1", "T 2", ["T3", "T4"], []]) if k == "@type" else random_json(rng, depth + 1) for k in keys}


def test_random_structures(spark):
    rng = random.Random(3)
    values = [random_json(rng) for _ in range(150)]
    for value, m in zip(values, facts(spark, *[block(json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)) for v in values])):
        want = {"types": set(), "author": "", "published": "", "modified": ""}
        walk(value, want)
        assert (m.blocks, m.invalid, m.schema_types, m.author, m.published, m.modified) == (1, 0, sorted(want["types"]), want["author"], want["published"], want["modified"]), value


def test_blocks(spark):
    bad, none, two, other, upper = facts(spark, block("{bad") + block(""), "<p>x</p>", block('{"author":""}') + block('{"author":"B"}') + block('{"author":"C"}'), '<script type="text/javascript" data-x="application/ld+json">{}</script>', "<SCRIPT data-a='x>y' TYPE=Application/LD+JSON>{\"@type\":\"A\"}</SCRIPT>")
    assert (bad.blocks, bad.invalid) == (2, 2) and (none.blocks, none.author) == (0, "")
    assert two.author == "B" and other.blocks == 0 and (upper.blocks, upper.schema_types) == (1, ["A"])


def test_times(spark):
    a, b, c, d = facts(spark, "<time>x</time><article><p><time>1 May</time></p></article><time datetime='2'>y</time>", "<article></article><time>out</time>", "<time class='is-Updated' datetime=7>z</time><time itemprop=datePublished>8</time>", "<article><article></article><time>in</time></article>")
    assert (a.published, b.published, c.modified, c.published, d.published) == ("1 May", "", "7", "8", "in")


def test_marked_authors(spark):
    sources = ['<a rel="nofollow Author" href=x> Ann  <b>Lee</b></a>', "<p itemprop=author></p><span itemprop=AUTHOR>Bo</span>", "<div rel=author><div>x</div> y</div> z", "<link rel=author href=/a><a rel=authors>no</a>", "<p itemprop=author>open to the end", block('{"author":"J"}') + "<a rel=author>A</a>"]
    assert [m.author for m in facts(spark, *sources)] == ["Ann Lee", "Bo", "x y", "", "open to the end", "J"]


def test_no_python_worker(spark):
    df = spark.createDataFrame([("u", "x")], "url string, html string").select(F.col("url"), F.col("html"))
    plan = extract.features(df)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonSQLMetrics", "")
