"""Vector codes against plain Lloyd rounds over integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lloyd


def plain(rows, rounds=4):
    """rows (vec_id, vector, label) that take part, as integers; every distance in every round."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // 4
    parts = [[tuple(r[1][p * width : (p + 1) * width]) for r in rows] for p in range(4)]
    books = [list(part[:256]) for part in parts]

    def nearest(p):
        return [min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, books[p][e])), e)) for v in parts[p]]

    for _ in range(rounds):
        for p in range(4):
            got = {}
            for v, e in zip(parts[p], nearest(p)):
                got.setdefault(e, []).append(v)
            for e, vs in got.items():
                books[p][e] = tuple(sum(c) // len(vs) for c in zip(*vs))
    at = [nearest(p) for p in range(4)]
    out = []
    for i, (vec_id, _, label) in enumerate(rows):
        error = sum(sum((a - b) ** 2 for a, b in zip(parts[p][i], books[p][at[p][i]])) for p in range(4))
        out.append((vec_id, label, "".join(f"{at[p][i]:02x}" for p in range(4)), error))
    return sorted(out, key=str), books


def told(spark, rows, **more):
    df = spark.createDataFrame([(i, v, l) for i, v, l in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    codes, books = lloyd.compress(df.withColumns({c: F.lit(1) for c in ("id", "vector", "ids", "code", "error", "delta", "entries")}), **more)
    return sorted([tuple(r) for r in codes.collect()], key=str), books


def integers(rows):
    return [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows]


@pytest.mark.parametrize("seed, n, width, block", [(1, 900, 8, 64), (2, 600, 4, 8192), (3, 40, 12, 7)])
def test_equals_plain_rounds(spark, monkeypatch, seed, n, width, block):
    monkeypatch.setattr(lloyd, "BLOCK", block)
    rng = random.Random(seed)
    rows = [(rng.randrange(5 * n), [rng.gauss(rng.choice([-1, 0, 2]), 0.05) for _ in range(width)], rng.choice([None, 1, 2])) for _ in range(n)]
    rows += rows[:30] + [(None, rows[5][1], None)]
    got, books = told(spark, rows)
    want, entries = plain(integers(rows))
    assert books.tolist() == [[list(e) for e in b] for b in entries]
    assert got == want


def test_ties_and_copies(spark):
    """Coarse values, so that many distances are equal, and entries that are copies of each other."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, -0.0004]) for _ in range(8)], 0) for i in range(700)]
    rows += [(i, [1.0] * 8, None) for i in range(700, 1100)]
    assert told(spark, rows)[0] == plain(integers(rows))[0]


def test_very_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-9e4, 9e4) for _ in range(8)], 0) for i in range(300)]
    assert told(spark, rows)[0] == plain(integers(rows))[0]
    # What exceeds 2 ** 30 / sqrt(length) counts as that.
    got, books = told(spark, [(1, [1e300, -1e300, 0.0, 1.0], 0), (2, [0.0] * 4, 0)])
    assert books[:, 0, 0].tolist() == [1 << 29, -(1 << 29), 0, 1024] and [g[3] for g in got] == [0, 0]


def test_rows_that_take_no_part(spark):
    good = [(3, [0.5] * 4, 1), (9, [-0.5] * 4, None)]
    odd = [(0, None, 1), (1, [1.0, None, 1.0, 1.0], 1), (1, [float("nan")] * 4, 1), (1, [float("inf")] * 4, 1), (1, [-math.inf] * 4, 1), (2, [], 1), (2, [1.0] * 6, 1), (4, [1.0] * 8, 1)]
    got, books = told(spark, good + odd)
    assert got == [(3, 1, "00000000", 0), (9, None, "01010101", 0)] and books.shape == (4, 2, 1)
    got, books = told(spark, odd[:6])
    assert got == [] and books.size == 0
    assert told(spark, [])[0] == []


def test_label_errors_put_nulls_together(spark):
    df = spark.createDataFrame([(1, None, "00", 3), (2, None, "00", 4), (3, 5, "00", 1)], "id long, label int, code string, error long")
    assert sorted((r.id, r.label_error) for r in lloyd.with_label_errors(df).collect()) == [(1, 7), (2, 7), (3, 1)]


def test_only_violated_parts_are_scanned_again(monkeypatch):
    """Groups far apart: a small drift pops nothing, a drift of one entry leaves the others' heaps alone."""
    rng = np.random.default_rng(6)
    book = np.array([[0, 0], [1000, 0], [0, 1000]], np.int64)
    vectors = book[rng.integers(0, 3, 500)] + rng.integers(-20, 20, (500, 2))
    closed = np.zeros(3)
    part = lloyd.Part.of(vectors, book, closed)
    for e in range(3):
        its = part.keys[part.begins[e] : part.begins[e + 1]]
        assert (its[:-1] <= its[1:]).all() and (part.entries[part.members[part.begins[e] : part.begins[e + 1]]] == e).all()
    scans = []
    scan = lloyd.scanned
    monkeypatch.setattr(lloyd, "scanned", lambda v, b, c: scans.append(len(v)) or scan(v, b, c))
    assert part.again(book, closed + 50).size == 0 and scans == []
    moved = np.array([[600, 0], [1000, 0], [0, 1000]], np.int64)
    changed = part.again(moved, np.array([600.0, 1300.0, 600.0]))
    assert scans and scans[0] < 500
    far = ((vectors[:, None] - moved) ** 2).sum(2)
    assert (part.entries == far.argmin(1)).all()
    assert sorted(changed[0].tolist()) == sorted(np.flatnonzero(((vectors[:, None] - book) ** 2).sum(2).argmin(1) != far.argmin(1)).tolist())
    for e in range(3):
        its = part.keys[part.begins[e] : part.begins[e + 1]].tolist()
        assert all(its[(i - 1) // 2] <= its[i] for i in range(1, len(its)))
        assert sorted(part.members.tolist()) == list(range(500))
