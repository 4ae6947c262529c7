"""MinHash near-duplicates: banded candidates, odd sketches to rate them, full sets to confirm them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, small
from .graph import components

K, ROWS, BITS = 128, 4, 512
BANDS = K // ROWS
#: Popcount of the XOR of two odd sketches up to which a pair is confirmed on full sets. At Jaccard 0.75 the expected count is
#: 57 with a deviation of 9, at 0.4 it is 116, for unrelated sets 162.
NEAR = 112
#: Sketches that one task compares with as many others at a time.
BLOCK, ELEMENTS = 256, 400_000
SLICE = 1_000_000
#: Bands of the first round.
FIRST = 3
_RNG = np.random.RandomState(20240501)
_A, _B = ((_RNG.randint(0, 2**32, K, dtype=np.uint64) | 1).astype(np.uint32) for _ in range(2))
_C = _RNG.randint(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list, width: int = 5) -> list[np.ndarray]:
    """For each text (bytes or None) the sorted 64-bit hashes of its distinct shingles of `width` words; of fewer words, the whole sequence as one."""
    words = [(t or b"").lower().split() for t in texts]  # bytes: A-Z alone change, and 09-0D and 20 alone part words
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    h = pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)
    runs = sum((h[k : len(h) - width + 1 + k] * _C[k] for k in range(width)), np.uint64(0)) if len(h) >= width else np.zeros(0, np.uint64)
    runs = mixed(runs) if len(runs) else runs
    out = []
    for n, end in zip(counts, ends):
        if n >= width:
            out.append(np.unique(runs[end - n : end - width + 1]))
        elif n:
            out.append(mixed((h[end - n : end] * _C[:n]).sum(keepdims=True) + _C[8:9] * np.uint64(n)))
        else:
            out.append(h[:0])
    return out


def minima(s: np.ndarray) -> np.ndarray:
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 1024):
        np.minimum(out, (low[i : i + 1024, None] * _A + high[i : i + 1024, None] * _B).min(axis=0), out=out)
    return out


def _slices(batches, text):
    """(batch's part, its texts as bytes), each of about SLICE bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
        group = np.cumsum(sizes) // SLICE
        for g in np.unique(group):
            at, to = np.searchsorted(group, g), np.searchsorted(group, g, side="right")
            yield batch.slice(at, to - at), column.slice(at, to - at).cast(pa.binary()).to_pylist()


def _signed(batches):
    for part, texts in _slices(batches, "text"):
        sets = shingles(texts)
        mins = np.array([minima(s) for s in sets], dtype=np.uint32).reshape(len(sets), K).astype(np.uint64)
        some = np.array([len(s) > 0 for s in sets])
        bits = (mixed(mins + (np.arange(K, dtype=np.uint64) << np.uint64(32)) * np.uint64(7) + np.uint64(1)) % np.uint64(BITS)).astype(np.int64)
        odd = np.zeros((len(sets), BITS), np.uint8)
        for k in range(K):
            odd[np.arange(len(sets)), bits[:, k]] ^= 1
        sketch = np.packbits(odd, axis=1).view(np.int64)
        band = mixed((mins.reshape(-1, BANDS, ROWS) * _C[:ROWS]).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64) * _C[9]).view(np.int64)
        marks = np.array([[mixed(s).sum(), mixed(s * _C[10]).sum()] if len(s) else [0, 0] for s in sets], dtype=np.uint64).reshape(len(sets), 2)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([m.tobytes() for m in marks], pa.binary()),
                pa.array([list(b) if x else [] for b, x in zip(band, some)], pa.list_(pa.int64())),
                *[pa.array(sketch[:, k]) for k in range(BITS // 64)],
            ],
            ["doc_id", "n_shingles", "mark", "bands", *[f"s{k}" for k in range(BITS // 64)]],
        )


def _sets(batches):
    for part, texts in _slices(batches, "text"):
        sets = shingles(texts)
        good = [len(s) > 0 and np.array([mixed(s).sum(), mixed(s * _C[10]).sum()], dtype=np.uint64).tobytes() == m for s, m in zip(sets, part.column(1).to_pylist())]
        nodes = [n for n, g in zip(part.column(0).to_pylist(), good) if g]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s, g in zip(sets, good) if g], pa.list_(pa.int64()))], ["node", "grams"])


def _candidates(left: pd.DataFrame, right: pd.DataFrame):
    """(i, j) of the pairs of both blocks whose sketches are near and whose labels differ; each pair comes from one side alone."""
    names = [f"s{k}" for k in range(BITS // 64)]
    x, y = (d[names].to_numpy(np.int64).view(np.uint64) for d in (left, right))
    a, b, la, lb, rest = left["node"].to_numpy(), right["node"].to_numpy(), left["label"].to_numpy(), right["label"].to_numpy(), right["rest"].to_numpy().astype(bool)
    rows, cols = [], []
    for i in range(len(x)):
        j = np.flatnonzero((np.bitwise_count(y ^ x[i]).sum(axis=1) <= NEAR) & (lb != la[i]) & (~rest | (a[i] < b)))
        rows.append(np.full(len(j), i))
        cols.append(j)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _pairs(left, right, i, j) -> pd.DataFrame:
    a, b = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).astype("int64")


def _near(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    return _pairs(left, right, *_candidates(left, right))


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by products of 0-1 matrices over runs of the shared elements."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(shared), 4096):
        run = shared[at : at + 4096]
        m = []
        for side in (x, y):
            z = np.zeros((len(side), len(run)), np.float32)
            for k, s in enumerate(side):
                part = s[np.searchsorted(s, run[0]) : np.searchsorted(s, run[-1], side="right")]
                p = np.searchsorted(run, part)
                z[k, p[run[p] == part]] = 1
            m.append(z)
        out += m[0] @ m[1].T
    return out


def _linked(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Confirmed links between two blocks, of which only those are told that join labels not yet joined here."""
    i, j = _candidates(left, right)
    if not len(i):
        return _pairs(left, right, i, j)
    x, y = left["grams"].to_numpy(), right["grams"].to_numpy()
    if len(i) < 2000:
        c = np.array([len(np.intersect1d(x[p], y[q], assume_unique=True)) for p, q in zip(i, j)])
    else:
        us, ui = np.unique(i, return_inverse=True)
        vs, vj = np.unique(j, return_inverse=True)
        c = common([np.sort(x[p]) for p in us], [np.sort(y[q]) for q in vs])[ui, vj].astype(np.int64)
    t = np.array([len(s) for s in x])[i] + np.array([len(s) for s in y])[j]
    ok = np.flatnonzero(c * 100 >= percent * (t - c))
    up: dict = {}

    def top(n):
        while up.get(n, n) != n:
            up[n] = up.get(up[n], up[n])
            n = up[n]
        return n

    la, lb, told = left["label"].to_numpy(), right["label"].to_numpy(), []
    for k in ok:
        p, q = top(la[i[k]]), top(lb[j[k]])
        if p != q:
            up[p] = q
            told.append(k)
    return _pairs(left, right, i[told], j[told])


def blocks_of(n, size):
    """Blocks so that each has about BLOCK sets and ELEMENTS shingles at most."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / ELEMENTS), F.lit(1)).cast("long")


def tiled(rows: DataFrame, key: str, run, columns: list[str], percent: int) -> DataFrame:
    """(a, b) that `run` finds between the blocks of a key's `rest` rows and the blocks of all its rows. rows: key, node, label, rest, left and right (numbers of blocks), columns."""
    keys, kept = [key, "i", "j"], [key, "i", "j", "node", "label", "rest", *columns]
    one = rows.filter("rest").withColumn("i", F.pmod(F.xxhash64("node"), "left")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("right") - 1)))
    two = rows.withColumn("j", F.pmod(F.xxhash64("node"), "right")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)))
    one, two = (x.select(*[F.col(c).alias(f"{c}{n}") for c in kept]).toDF(*kept) for n, x in enumerate((one, two)))
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(lambda x, y: run(x, y, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts with the same shingle set are one node, so copies never meet in pairs. Nodes that share one of 32 bands of 4
    MinHash samples are candidates (a pair at 0.75 shares none with a chance of 5e-6). Labels spread over the incidence of nodes
    and buckets, in two rounds: in each bucket the least node of every label is held against the bucket's least label, odd
    sketches, the parity bitmaps of the 128 samples, rate the pairs by the popcount of their XOR, full sets confirm each
    node's best pair, and labels that are linked become one. The first round has FIRST bands, in which every node is its own label; the second has
    the others, where a family that the first has joined is one row a bucket, so rows follow the nodes and not the families'
    incidences. Labels that near pairs hold together are a cluster; one that keeps several labels is searched whole, block
    against block, where candidates by sketch are confirmed on full sets in place and a block tells only links
    that join labels, never all its pairs. Last, pairs of different clusters in one bucket get the same test.
    So a link within a bucket is lost only where a sketch is off by six deviations, whatever the bucket's size.

    Null or empty text, or no words: 0 shingles, linked with nothing, kept. Null doc_id: component null, kept, links
    nothing. Repeated rows: equal rows give equal results (both are kept, as they are one id). Empty table: no rows.
    Other columns don't matter.
    """
    names = [f"s{k}" for k in range(BITS // 64)]
    base = saved(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, n_shingles long, mark binary, bands array<long>, " + ", ".join(f"{s} long" for s in names)), "signed")
    firsts = base.filter("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in names])
    nodes = saved(firsts.filter("doc is not null").withColumn("node", F.monotonically_increasing_id()), "nodes")
    sketch, count = nodes.select("node", *names), nodes.count()

    def apart(pairs):
        x, y = (sketch.select(F.col("node").alias(f"{p}_node"), *[F.col(s).alias(f"{p}_{s}") for s in names]) for p in "xy")
        far = sum((F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in names), F.lit(0))
        return pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node")).select("a", "b", far.alias("apart")).filter(F.col("apart") <= NEAR)

    def full(wanted):
        """Shingle sets of the nodes in `wanted` (column node)."""
        who = saved(nodes.select("node", "doc", "mark").join(wanted, "node", "left_semi"), "wanted", count)
        return saved(docs.select("doc_id", "text").join(small(who), F.col("doc_id") == F.col("doc")).select("node", "mark", "text").dropDuplicates(["node", "text"]).mapInArrow(_sets, "node long, grams array<long>"), "sets")

    def confirmed(pairs, sets):
        x, y = (sets.select(F.col("node").alias(p), F.col("grams").alias(f"{p}_grams")) for p in "xy")
        both = pairs.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y"))
        common = F.size(F.array_intersect("x_grams", "y_grams"))
        return both.select("a", "b", common.alias("c"), (F.size("x_grams") + F.size("y_grams")).alias("t")).filter(F.col("c") * 100 >= percent * (F.col("t") - F.col("c"))).select("a", "b")

    def either(pairs):
        return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    def labelled(rows, labels, by, name):
        if labels is None:
            return rows.withColumn(name, F.col(by))
        got = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        return rows.join(got, F.col(by) == F.col("__node"), "left").withColumn(name, F.coalesce("__label", by)).drop("__node", "__label")

    def joined(labels, links):
        """labels after the links between components."""
        if labels is None:
            return components(links, count)
        over = labelled(labelled(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b")
        up = components(over, count).select(F.col("node").alias("was"), F.col("label").alias("is"))
        every = labels.union(up.select(F.col("was").alias("node"), F.col("was").alias("label")).join(labels.select("node"), "node", "left_anti"))
        return saved(every.join(up, F.col("label") == F.col("was"), "left").select("node", F.coalesce("is", "label").alias("label")), "labels", count)

    def seen(labels, first, bands, *more):
        """(bucket, label, least node) of some bands: a label is one row in a bucket, however many nodes it has there."""
        rows = labelled(nodes.select("node", "bands"), labels, "node", "label").select("node", "label", F.explode(F.slice("bands", first, bands)).alias("bucket"))
        return rows.groupBy("bucket", "label").agg(F.min("node").alias("node"), *more)

    labels, star, sets = None, None, None
    for first, bands in ((1, FIRST), (FIRST + 1, BANDS - FIRST)):
        rows = seen(labels, first, bands)
        heads = rows.groupBy("bucket").agg(F.min(F.struct("label", "node")).alias("head"), F.count("*").alias("k")).filter("k > 1").select(F.col("bucket").alias("in"), F.col("head.label").alias("least"), F.col("head.node").alias("b"))
        pairs = rows.join(heads, (F.col("bucket") == F.col("in")) & (F.col("label") != F.col("least"))).select(F.col("node").alias("a"), "b").distinct()
        near = saved(apart(pairs), "star")
        if not near.limit(1).count():
            continue
        wanted = either(near)
        got = full(wanted.join(sets, "node", "left_anti") if sets is not None else wanted)
        star, sets = (near, got) if star is None else (star.union(near), sets.union(got))
        best = near.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        links = saved(confirmed(best, sets), "links")
        if links.limit(1).count():
            labels = joined(labels, links)

    # Clusters: labels that near pairs hold together. Those with several labels are searched whole.
    clusters = joined(labels, star) if star is not None else None
    if clusters is not None:
        parts = labelled(clusters.withColumnRenamed("label", "cluster"), labels, "node", "label").join(nodes.select(F.col("node").alias("of"), F.col("size")), F.col("node") == F.col("of")).drop("of")
        counts = parts.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        split = counts.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("n").alias("m"), F.count("*").alias("k")).filter("k > 1")
        tiles = saved(split.select(F.col("cluster").alias("in"), "main", blocks_of(F.col("n"), F.col("s")).alias("right"), blocks_of(F.col("n") - F.col("m"), F.col("s")).alias("left")), "clusters", count)
        if tiles.limit(1).count():
            rest = parts.join(tiles, F.col("cluster") == F.col("in")).select("cluster", "node", "label", (F.col("label") != F.col("main")).alias("rest"), "left", "right")
            rest = saved(rest.join(sketch, "node").join(sets, "node"), "rest")
            links = saved(tiled(rest, "cluster", _linked, [*names, "grams"], percent), "links")
            if links.limit(1).count():
                labels = joined(labels, links)

    # Buckets that several clusters share: pairs across clusters are near by their sketches, if at all, and are few.
    sizes = seen(clusters, 1, BANDS, F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n_all"), F.count("*").alias("k")).filter("k > 1 and n_all > 2")
    sizes = saved(sizes.select(F.col("bucket").alias("in"), F.col("main.label").alias("most"), F.ceil((F.col("n_all") - F.col("main.n")) / BLOCK).alias("left"), F.ceil(F.col("n_all") / BLOCK).alias("right")), "mixed")
    if sizes.limit(1).count():
        rest = labelled(nodes.select("node", "bands"), clusters, "node", "label").select("node", "label", F.explode("bands").alias("bucket")).join(small(sizes), F.col("bucket") == F.col("in"))
        rest = rest.select("bucket", "node", "label", (F.col("label") != F.col("most")).alias("rest"), "left", "right")
        pairs = tiled(rest.join(sketch, "node"), "bucket", _near, names, percent).distinct()
        pairs = saved(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti") if star is not None else pairs, "pairs")
        if pairs.limit(1).count():
            links = saved(confirmed(pairs, full(either(pairs))), "links")
            if links.limit(1).count():
                labels = joined(labels, links)

    group = labelled(nodes.select("node", "doc", "mark"), labels, "node", "label")
    least = group.groupBy("label").agg(F.min("doc").alias("component_id")).withColumnRenamed("label", "of")
    found = group.join(least, F.col("label") == F.col("of")).select(F.col("mark").alias("its"), "component_id")
    out = base.select("doc_id", "n_shingles", "mark").join(found, (F.col("mark") == F.col("its")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def unique(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stay: of each group the document with the smallest id, and all without an id."""
    (of,) = fresh(docs, "__id")
    gone = saved(near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias(of)).distinct(), "gone")
    return docs.join(small(gone), F.col("doc_id") == F.col(of), "left_anti")
