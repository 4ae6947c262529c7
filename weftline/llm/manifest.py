"""Merkle manifest of a table: each row's leaf, its source's subroot, the root, and the authentication path that leads there."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PER_FILE, saved, small

#: Nodes that become one, as the contract has it.
ARITY = 3
#: Levels of a block: 2,187 nodes, that is all that a task holds of a tree, with their paths some 5 MB.
HEIGHT = 7
SIZE = ARITY**HEIGHT
#: Levels of each subtree that the traversal stacks.
STEP = 2
#: Bytes of a table that may be broadcast, told by its rows' own lengths.
BROADCAST_BYTES = 16_000_000
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars")


def leaf_of(text: Column) -> Column:
    """Digest of a row of documents that has this text: doc_id, source, lang, n_chars and text, each as its bytes' number, a colon and its value, or - if null."""

    def told(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.sha2(F.concat(*[told(F.col(c)) for c in FIELDS], told(text)), 256)


def parent(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


class TreeHash:
    """A subtree of `top` levels, grown leaf by leaf: holds the run that is open at each level and, of closed runs, those at the levels from `keep` on."""

    def __init__(self, keep: int, top: int):
        self.keep, self.top, self.root = keep, top, None
        self.open: list[list[str]] = [[] for _ in range(top)]
        self.runs: list[list[list[str]]] = [[] for _ in range(top - keep)]

    def _closed(self, level: int) -> str:
        run, self.open[level] = self.open[level], []
        if level >= self.keep:
            self.runs[level - self.keep].append(run)
        return parent(run)

    def push(self, node: str, level: int = 0) -> None:
        while level < self.top:
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, level = self._closed(level), level + 1
        self.root = node

    def finish(self) -> TreeHash:
        """Closes runs that are short of nodes, as the last of each level may be."""
        for level in range(self.top):
            if self.open[level]:
                self.push(self._closed(level), level + 1)
        return self


def grown(leaves: list[str], keep: int, top: int) -> TreeHash:
    tree = TreeHash(keep, top)
    for leaf in leaves:
        tree.push(leaf)
    return tree.finish()


def traversal(leaves: list[str], height: int, step: int = STEP) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn what stands left and right of its path at each level (a fractal traversal).

    Subtrees of `step` levels are stacked above the present leaf; these exist, and each but the topmost has a desired one, its right
    neighbour, which takes one leaf each time a path is told, so that it is whole when the present leaf gets there. Only the runs
    of existing and desired subtrees are held."""
    spans = [(low, min(low + step, height)) for low in range(0, height, step)]
    existing = [grown(leaves[: ARITY**top], low, top).runs for low, top in spans]
    desired = [TreeHash(low, top) for low, top in spans]
    path = [("", "")] * height
    for i in range(len(leaves)):
        for k, (low, top) in enumerate(spans):
            if i % ARITY**top:
                break
            if i:
                existing[k], desired[k] = desired[k].finish().runs, TreeHash(low, top)
        for level in range(height):
            if i % ARITY**level:
                break
            low, top = spans[level // step]
            run = existing[level // step][level - low][i // ARITY ** (level + 1) % ARITY ** (top - 1 - level)]
            at = i // ARITY**level % ARITY
            path[level] = "".join(run[:at]), "".join(run[at + 1 :])
        yield list(path)
        for k, (_, top) in enumerate(spans):
            if i + ARITY**top >= len(leaves):
                break
            desired[k].push(leaves[i + ARITY**top])


def levels(n: int) -> int:
    """Levels above n nodes in a block, of which there are more if n exceeds one."""
    height = 0
    while height < HEIGHT and ARITY**height < n:
        height += 1
    return height


def _blocks(table: pa.Table) -> Iterator[tuple[int, int, int, list[dict]]]:
    """Rows (grp, idx, n, more) of a group by block: grp, block, n, rows in order."""
    rows = table.sort_by([("grp", "ascending"), ("idx", "ascending")]).to_pylist()
    for (grp, block), some in groupby(rows, key=lambda r: (r["grp"], r["idx"] // SIZE)):
        some = list(some)
        yield grp, block, some[0]["n"], some


TOPS = pa.schema([("grp", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _tops(table: pa.Table) -> pa.Table:
    out = [{"grp": grp, "idx": block, "n": -(-n // SIZE), "digest": bytes.fromhex(grown([r["digest"].hex() for r in rows], HEIGHT, levels(n)).root) if levels(n) else rows[0]["digest"]} for grp, block, n, rows in _blocks(table)]
    return pa.Table.from_pylist(out, TOPS)


def _listed(paths: list[list[tuple[str, str]]]) -> pa.Array:
    """Paths as Arrow lists of (left, right)."""
    offsets = [0]
    for p in paths:
        offsets.append(offsets[-1] + len(p))
    steps = [s for p in paths for s in p]
    structs = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _paths(table: pa.Table) -> pa.Table:
    """Of nodes: grp, idx, block and the path up to the block's top."""
    grps, idxs, blocks, paths = [], [], [], []
    for grp, block, n, rows in _blocks(table):
        paths.extend(traversal([r["digest"].hex() for r in rows], levels(n)))
        grps.extend([grp] * len(rows))
        idxs.extend(r["idx"] for r in rows)
        blocks.extend([block] * len(rows))
    return pa.Table.from_arrays([pa.array(grps, pa.int64()), pa.array(idxs, pa.int64()), pa.array(blocks, pa.int64()), _listed(paths)], ["grp", "idx", "block", "path"])


def _proofs(key: pa.DataType):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        """Of leaves: what they bear and the path up to the root: the block's own, then what the upper trees gave for its top."""
        upper = {(r["grp"], r["idx"]): (r["subroot"], [(s["left"], s["right"]) for s in r["path"]]) for r in above.to_pylist()}
        ids, leaves, seen, subroots, paths = [], [], [], [], []
        for grp, block, n, rows in _blocks(nodes):
            subroot, rest = upper[grp, block]
            leaf = [r["digest"].hex() for r in rows]
            paths.extend(p + rest for p in traversal(leaf, levels(n)))
            ids.extend(r["doc_id"] for r in rows)
            leaves.extend(leaf)
            seen.extend(r["seen"].hex() if r["seen"] is not None else own for r, own in zip(rows, leaf))
            subroots.extend([subroot] * len(rows))
        texts = [pa.array(c, pa.string()) for c in (leaves, seen, subroots)]
        return pa.Table.from_arrays([pa.array(ids, key), *texts, _listed(paths)], ["doc_id", "leaf", "seen_leaf", "subroot", "path"])

    return run


def _sized(df: DataFrame, size: Column) -> DataFrame:
    """df as a broadcast side if its rows, each of `size` bytes, are few enough, else as it is for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _path_size(path: str) -> Column:
    """Bytes of a row with a path, of which each level has two digests at most, and a few numbers."""
    return F.size(path) * 160 + 100


def _dealt(nodes: DataFrame) -> DataFrame:
    """nodes (grp, idx, n) with the key of their block; blocks of small groups share a key, by where the groups begin, so that no
    key has more than two blocks' rows and there are few keys however many groups there are."""
    many = F.col("n") > SIZE
    return nodes.withColumns({"deal": F.when(many, F.col("grp")).otherwise(-1), "block": F.when(many, F.expr(f"idx div {SIZE}")).otherwise(F.expr(f"grp div {SIZE}"))})


def _climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (grp, idx, n: of the group, digest) with n above 1 to (grp, idx, path up to the group's top) and (grp, digest of the top). Each round
    makes one node of a block, so 10 ** 11 leaves take four."""
    dealt = _dealt(nodes).groupBy("deal", "block")
    own = dealt.applyInArrow(_paths, f"grp long, idx long, block long, path {PATH}")
    tops = saved(dealt.applyInArrow(_tops, "grp long, idx long, n long, digest binary"), "tops")
    more = tops.filter("n > 1")
    done = tops.filter("n = 1").select("grp", "digest")
    if more.isEmpty():
        return saved(own.drop("block"), "paths"), done
    above, roots = _climbed(more)
    upper = above.select("grp", F.col("idx").alias("block"), F.col("path").alias("rest"))
    joined = own.join(_sized(upper, _path_size("rest")), ["grp", "block"], "left")
    return saved(joined.select("grp", "idx", F.concat("path", F.coalesce("rest", F.array().cast(PATH))).alias("path")), "paths"), done.unionByName(roots)


def _placed(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows in order over all their parts, written, with `at`: the part's number above the row's place in it."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.withColumn("at", F.monotonically_increasing_id()), name)


PART, ROW = "shiftright(at, 33)", "at & 8589934591"


def _starts(runs: DataFrame) -> DataFrame:
    """part and before, the rows of all earlier parts. runs: part, c; as many rows as there are parts pass one task."""
    sums = runs.groupBy("part").agg(F.sum("c").alias("c"))
    return sums.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path make."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """doc_id, leaf, seen_leaf, subroot, root and path of every row of documents. seen: the text that is found where the data are checked, by
    default the row's own; seen_leaf is the leaf with it, and fold(seen_leaf, path) equals root as long as nothing was changed.

    Leaves of a source ascend by doc_id, null first, equal ones by leaf, so repeated rows give the same tree whatever their order.
    Sources ascend by their bytes, null first. A lone leaf is its source's subroot, a lone subroot the root; an empty table
    gives no rows. Columns other than the five of a leaf are not read.

    Texts are read once. Then leaves are sorted over all parts, counted by part and source, and dealt in aligned blocks of 3 ** 7, so one
    source with most rows is as many blocks as others together. A block's own path and that of its top, which comes
    from the much smaller upper trees, meet where the block is traversed; leaves move twice, paths of leaves never."""
    text = F.col("text")
    changed = F.when(~seen.eqNullSafe(text), F.unhex(leaf_of(seen))) if seen is not None else F.lit(None).cast("binary")
    leaves = saved(docs.select("doc_id", "source", F.unhex(leaf_of(text)).alias("digest"), changed.alias("seen")), "leaves")
    # Equal rows may be many; their places in the files tell them apart, so that no part of the order is theirs alone.
    leaves = leaves.withColumn("row", F.monotonically_increasing_id())
    table = _placed(leaves, "ordered", F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")).drop("row")
    runs = saved(table.groupBy(F.expr(PART).alias("part"), "source").agg(F.count("*").alias("c"), F.min(F.expr(ROW)).alias("lo")), "runs", rows=PER_FILE)
    of = Window.partitionBy("source")
    runs = runs.join(small(_starts(runs)), "part")
    runs = runs.select("part", F.col("source").alias("of"), "before", F.min(F.expr("before + lo")).over(of).alias("grp"), F.sum("c").over(of).alias("n"))
    runs = saved(runs, "runs", rows=PER_FILE)
    met = table.withColumn("p", F.expr(PART)).join(_sized(runs, F.coalesce(F.octet_length("of"), F.lit(0)) + 48), (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))
    nodes = met.select("doc_id", "digest", "seen", "grp", "n", F.expr(f"before + ({ROW}) - grp").alias("idx"))
    tops = saved(_dealt(nodes.select("grp", "idx", "n", "digest")).groupBy("deal", "block").applyInArrow(_tops, "grp long, idx long, n long, digest binary"), "tops")
    above, subroots = _climbed(tops.filter("n > 1"))
    subroots = saved(subroots.unionByName(tops.filter("n = 1").select("grp", "digest")), "subroots")
    # Sources in order are one group more.
    listed = _placed(subroots, "sources", F.col("grp")).withColumn("part", F.expr(PART))
    first = _starts(listed.groupBy("part").agg(F.count("*").alias("c")))
    sources = listed.join(small(first), "part").select(F.col("grp").alias("source"), "digest", F.lit(0).cast("long").alias("grp"), F.expr(f"before + ({ROW})").alias("idx"))
    total = sources.count()
    sources = sources.withColumn("n", F.lit(total).cast("long"))
    empty = F.array().cast(PATH)
    if total > 1:
        ends, root = _climbed(sources.select("grp", "idx", "n", "digest"))
        sources = sources.join(_sized(ends.select("idx", "path"), _path_size("path")), "idx")
    else:
        sources, root = sources.withColumn("path", empty), sources
    sources = sources.select("source", F.hex("digest").alias("subroot"), F.col("path").alias("last"))
    rest = above.select("grp", "idx", "path")
    sizes = runs.select(F.col("grp").alias("source"), F.col("n").alias("leaves")).distinct()
    upper = tops.select("grp", "idx").join(rest, ["grp", "idx"], "left").join(_sized(sources, _path_size("last")), F.col("grp") == F.col("source")).drop("source").join(small(sizes), F.col("grp") == F.col("source")).drop("source")
    upper = upper.select("grp", F.expr(f"idx * {SIZE}").alias("idx"), F.col("leaves").alias("n"), F.lower("subroot").alias("subroot"), F.concat(F.coalesce("path", empty), "last").alias("path"), F.col("idx").alias("top"))
    upper = _dealt(upper).withColumn("idx", F.col("top")).drop("top")
    kind = docs.select("doc_id").schema["doc_id"].dataType
    key = pa.int32() if kind.simpleString() == "int" else pa.int64()
    proofs = _dealt(nodes).groupBy("deal", "block").cogroup(upper.groupBy("deal", "block")).applyInArrow(_proofs(key), f"doc_id {kind.simpleString()}, leaf string, seen_leaf string, subroot string, path {PATH}")
    tip = [r.digest.hex() for r in root.select("digest").collect()]
    return proofs.withColumn("root", F.lit(tip[0] if tip else None).cast("string"))
