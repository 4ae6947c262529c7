"""Near duplicates against every pair, also where one token is in a third of the sets and groups are cut into tiles."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.operators import site


def plain(rows, least):
    out = set()
    for (a, x, h), (b, y, g) in combinations(rows, 2):
        both = len(set(x) & set(y))
        if h != g and x and y and both / (len(set(x)) + len(set(y)) - both) >= least:
            out.add((min(a, b), max(a, b), round(both / (len(set(x)) + len(set(y)) - both), 9)))
    return out


def random_sets(rng, n):
    rows = []
    for i in range(n):
        size = rng.choice([1, 2, 5, 10, 11, 20, 40, 41, 43])
        base = rng.randrange(6)
        tokens = [f"{base}-{k}" for k in range(size)]
        for _ in range(rng.randrange(3)):
            tokens[rng.randrange(size)] = f"x{rng.randrange(40)}"
        if i % 3 == 0:
            tokens.append("hot")
        rows.append((i, sorted(set(tokens)), rng.randrange(n // 2)))
    return rows + [(n, [], 0), (n + 1, ["hot"], 1)]


@pytest.mark.parametrize("seed, least, tile", [(1, 0.9, 2000), (2, 0.9, 3), (3, 0.75, 5), (4, 0.5, 4)])
def test_pairs_equal_those_of_all_sets(spark, monkeypatch, seed, least, tile):
    monkeypatch.setattr(site, "TILE", tile)
    rows = random_sets(random.Random(seed), 150)
    df = spark.createDataFrame(rows, "key long, tokens array<string>, hash long")
    got = {(r.left, r.right, round(r.similarity, 9)) for r in site.near_duplicates(df, least).collect()}
    assert got == plain(rows, least)


def test_no_tile_is_larger_than_its_bound(spark, monkeypatch):
    """All sets share one token of their prefixes: rows of a tile stay bounded, and no pair is met twice or missed."""
    monkeypatch.setattr(site, "TILE", 10)
    prefix = spark.range(100).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("set"), F.lit(8).alias("size"), F.lit(0).alias("pos"), F.lit(7).cast("long").alias("token"))
    met = site._meeting(prefix, 0.9)
    assert met.count() == 100 * 99 // 2


def test_token_lists_do_not_stay_on_disk(spark):
    """What holds whole sets is deleted once the pairs are confirmed, and no pair carries a set."""
    from pathlib import Path

    root, words = Path(spark.conf.get("spark.checkpoint.dir")), [f"w{k}" for k in range(400)]
    rows = [(i, str(i), words[i % 5 :] + [f"x{i}"]) for i in range(60)]
    before = set(root.iterdir())
    df = spark.createDataFrame(rows, "key int, hash string, tokens array<string>")
    assert site.near_duplicates(df).count() == 60 * 59 // 2
    left = [spark.read.parquet(str(p)).columns for p in set(root.iterdir()) - before if any(p.glob("*.parquet"))]
    assert left and not any("tokens" in columns for columns in left)


def test_unlike_sets_do_not_move_whole(spark, monkeypatch):
    """Sets that share rare tokens and little else are told apart by their marks, and whole sets are written once."""
    pairs, written, confirmed, saved = [], [], site._confirmed, site.saved
    monkeypatch.setattr(site, "_confirmed", lambda found, *a: pairs.append(found.count()) or confirmed(found, *a))
    monkeypatch.setattr(site, "saved", lambda df, *a, **b: written.append(df.columns) or saved(df, *a, **b))
    rows = [(i, str(i), [f"rare{k}" for k in range(15)] + [f"{i}-{k}" for k in range(85)]) for i in range(20)]
    rows += [(i, str(i), [f"alike{k}" for k in range(99)] + [f"x{i}"]) for i in range(20, 23)]
    df = spark.createDataFrame(rows, "key long, hash string, tokens array<string>")
    assert {(r.left, r.right) for r in site.near_duplicates(df).collect()} == {(20, 21), (20, 22), (21, 22)}
    assert pairs == [3]
    assert sum("tokens" in columns for columns in written) == 1


@pytest.mark.parametrize("crowded", [100_000, 0])
def test_large_sets_with_marks_of_different_lengths(spark, monkeypatch, crowded):
    """Marks double in number at 1024 and 2048 tokens; pairs at the threshold across these sizes stay, and so do those met by tokens that are not broadcast."""
    monkeypatch.setattr(site, "CROWDED", crowded)
    monkeypatch.setattr(site, "TILE", 4)
    rng, rows = random.Random(5), []
    for i, size in enumerate([980, 1000, 1020, 1024, 1030, 1100, 1130, 2000, 2040, 2060, 2200] * 2):
        rows.append((i, [f"w{k}" for k in range(size - 30)] + [f"y{rng.randrange(90)}" for _ in range(30)], i))
    rows.append((len(rows), [f"w{k}" for k in range(900)] + [f"z{k}" for k in range(100)], -1))
    rows.append((len(rows), [f"w{k}" for k in range(900)], -2))
    df = spark.createDataFrame([(a, sorted(set(x)), h) for a, x, h in rows], "key long, tokens array<string>, hash long")
    got = {(r.left, r.right, round(r.similarity, 9)) for r in site.near_duplicates(df).collect()}
    assert got == plain(rows, 0.9) and len(got) > 50
