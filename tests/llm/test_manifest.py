"""Merkle manifests against a plain tree over lists."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from weftline.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[2], row[3], row[4], text)))


def tree(nodes):
    """Levels from the leaves to the top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    for level in levels[:-1]:
        run = i - i % 3
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 3])
        i //= 3


def plain(rows, seen):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, seen(r))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (known, doc, own, other) in enumerate(sorted(by[s])):
            steps = [*path(trees[s], i), *path(top, k)]
            node = other
            for a, z in steps:
                node = h(a + node + z)
            out.append((doc if known else None, own, other, trees[s][-1][0], top[-1][0], tuple(steps), node))
    return sorted(out, key=str)


def told(spark, rows, seen=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    df = df.withColumns({c: F.lit(1) for c in ("digest", "grp", "idx", "n", "seen", "at", "part", "row", "path", "root", "leaf")})
    got = manifest.manifest(df, seen).withColumn("folded", manifest.fold(F.col("seen_leaf"), F.col("path")))
    return sorted([(r.doc_id, r.leaf, r.seen_leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path), r.folded) for r in got.collect()], key=str)


def random_rows(n, sources, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-n, 2 * n), n)
    return [(i, rng.choice([None, "", "a\nb", "text é中", "\n"]), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3])) for i in ids]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (3, [None]), (120, ["a"] * 9 + [None, "b", "é", "Z", ""]), (150, [f"s{i}" for i in range(60)])])
def test_equals_a_plain_tree(spark, monkeypatch, n, sources):
    """Blocks of nine leaves, so that sources are many blocks and sources themselves climb in rounds."""
    monkeypatch.setattr(manifest, "HEIGHT", 2)
    monkeypatch.setattr(manifest, "SIZE", 9)
    rows = random_rows(n, sources, n)
    rows += rows[:4] + [(None, "x", sources[0], None, None)] * 2 + ([(rows[0][0], "other", *rows[0][2:])] if n > 1 else [])
    halved = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = told(spark, rows, halved)
    assert got == plain(rows, lambda r: r[1].replace("\n", "") if r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1])
    for _, own, seen, _, root, _, folded in got:
        assert (own == seen) == (folded == root)


def test_empty_table(spark):
    assert told(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 26, 27, 28, 80, 81, 200, 243])
@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_traversal_tells_every_path(n, step):
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves) if n else [[]]
    assert [list(path(levels, i)) for i in range(n)] == list(manifest.traversal(leaves, len(levels) - 1, step))


def test_traversal_holds_few_nodes():
    """What is held grows with the stacked subtrees, not with the block."""
    tree = manifest.TreeHash(4, 6)
    for i in range(700):
        tree.push(h(str(i)))
        assert sum(map(len, tree.open)) <= 12 and sum(len(run) for level in tree.runs for run in level) <= 12
