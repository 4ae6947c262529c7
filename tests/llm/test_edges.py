"""Empty tables, nulls, repeats, long texts and clashing columns for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, licenses, minhash, mixing, pages, repeats, scoring, secrets, tokens, topk, toxicity

LONG = "word " * 30_000
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x y z one two three four", None), (4, LONG, "b"), (5, "token = abcdefgh12 under the MIT License", "b")]
CLASH = ["size", "of", "n", "node", "label", "bucket", "hashes", "words", "gram", "row", "held_out", "spans", "host", "target", "copies", "__x"]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASH})


def bench(spark, rows=((1, "a b c d e f g h i j k l"), (2, None))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((1, 0), (None, 1), (3, None))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


RUNS = {
    "secrets": lambda s, d: secrets.scan(d),
    "redact": lambda s, d: secrets.redact(d),
    "leaks": lambda s, d: decontaminate.leaks(d, bench(s)),
    "clean": lambda s, d: decontaminate.clean(d, bench(s)),
    "near": lambda s, d: minhash.near_duplicates(d),
    "unique": lambda s, d: minhash.unique(d),
    "repeats": lambda s, d: repeats.remove_repeats(d),
    "toxicity": lambda s, d: toxicity.clean(d, labels(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "scoring": lambda s, d: scoring.score(d),
    "tokens": lambda s, d: tokens.token_counts(d, VOCABULARY),
    "mixing": lambda s, d: mixing.mix(d),
}
#: Rows out of the seven in ROWS.
COUNT = {"leaks": 0}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    assert len(RUNS[name](spark, docs(spark)).collect()) == COUNT.get(name, len(ROWS))


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](spark, docs(spark, [])).collect() == []


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, float("nan")]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0]), (50, [float("inf"), 1.0]), (7, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("q", "dim", "shard", "score", "rank")})
    got = [tuple(r) for r in topk.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 256 * 256 * 5), (0, 2, 4, 256 * 256 * 5), (0, 3, 7, 0)]
    assert topk.nearest(df.filter("vec_id > 100")).collect() == []


def test_vectors_of_any_size(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [1e14, 0.0]), (3, [1e300, -1e300]), (4, [-1e300, 0.0]), (50, [3.1e12, 1.0]), (50, [3.1e12, 1.0])]
    got = sorted(tuple(r) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [r for r in got if r[0] == 0] == [(0, 1, 3, 2**63 - 1), (0, 2, 2, 256 * 256 * 10**14), (0, 3, 50, 256 * 256 * 31 * 10**11), (0, 4, 50, 256 * 256 * 31 * 10**11), (0, 5, 1, 131072)]
    assert len(got) == 15 and [r[2] for r in got if r[0] == 50 and r[1] <= 2] == [2, 2, 3, 3]


def test_odd_pages(spark):
    rows = [(1, None, "<p>a</p>"), (2, "http://h/x", None), (3, "http://h/y", ""), (3, "http://h/y", ""), (None, "nonsense", "<article>Text<b>bold</b> &amp; more"), (4, "http://h/z", "<p>" + LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "text", "path", "__html")})
    got = {(r.page_id, r.n_chars) for r in pages.extract(df).collect()}
    assert got == {(1, 1), (2, 0), (3, 0), (None, 15), (4, len(LONG) - 1)}
    assert pages.extract(df.filter("page_id > 9")).collect() == []


def test_nulls_keep_their_place(spark):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark)).collect()}
    assert got[None].component_id is None and got[None].kept and got[1].n_shingles == 0 and got[1].component_id == 1
    scored = {r.doc_id: r for r in scoring.score(docs(spark)).collect()}
    assert scored[1].n_tokens == scored[2].n_tokens == 1 and scored[4].n_tokens == 30_001
    assert scored[1].score < 0 and not scored[None].held_out


def test_leaks_of_odd_rows(spark):
    """Null ids, repeated rows, very long texts and ties with hits: one row for each id and text, at the first of equal places."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, item, "a"), (1, item, "a"), (1, item, "a"), (2, LONG + item, None), (3, item.upper(), "b"), (4, f"{item}. {item}", "b"), (5, item.replace("gamma", "x").replace("theta", "y"), "b"), (6, "alpha beta gamma", "b")]
    for bench_rows in ([(1, item), (2, item), (None, "")],):
        got = decontaminate.leaks(docs(spark, rows), bench(spark, bench_rows)).collect()
        told = sorted((str(r.doc_id), r.item_id, r.doc_start, r.n_same) for r in got)
        assert told == sorted((d, i, at, n) for d, at, n in [("None", 0, 10), ("1", 0, 10), ("2", 30_000, 10), ("3", 0, 10), ("4", 0, 10), ("5", 0, 8)] for i in (1, 2))
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, rows), bench(spark, [(1, item)])).collect()}
    assert kept == {6}
