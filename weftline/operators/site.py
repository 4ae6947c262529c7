"""Link graph, sitemap, duplicates and site-wide checks."""

from __future__ import annotations

import contextlib
import math
import re
import tempfile
import uuid
from functools import reduce
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.urls import crawl_url, host_key
from .findings import chain, findings, rule


#: Paths that scratch gave out and forget has not deleted.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a local run has a folder of its own; on a cluster it would leave parts on single machines, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/weftline-checkpoints"
    _MADE.append(path := f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}")
    return path


def forget(spark: SparkSession) -> None:
    """Deletes what was written to scratch by this driver, once the results that were made from it have been written or are not wanted."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of the queries that run in it go when these end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dropped(df: DataFrame) -> None:
    """Deletes what saved wrote as df, once nothing that is still to be read is made of it."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, **options) -> DataFrame:
    """Writes df to a path of scratch and reads it back, so loops keep a short lineage and lost executors cost little. The write's own shuffle files go when it ends."""
    path = scratch(df.sparkSession)
    with _cleaned(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inlinks(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that lead to each page, itself included. pages: key; edges: src, dst."""
    counts = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n"))
    return pages.select("key").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("inlinks"))


def link_findings(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Checks 42 to 45 for links to crawled pages, once for each (source, check, target). edges: src, dst, nofollow,
    anchor; targets: key, status_code, redirects. A broken target is not said to redirect as well."""
    met = edges.join(targets.withColumnRenamed("key", "dst"), "dst")
    rules = [
        chain(
            ("links", "Broken internal link", "fail", "high", (F.col("status_code") >= 400) | (F.col("status_code") == 0), F.col("status_code")),
            ("links", "Internal link redirects", "warn", "medium", F.col("redirects") > 0, F.col("redirects")),
        ),
        rule("links", "Nofollow internal link", "warn", "low", F.col("nofollow")),
        rule("links", "Empty internal anchor", "warn", "low", F.trim("anchor") == ""),
    ]
    return findings(met, rules, ["src", "dst"]).dropDuplicates(["src", "dst", "check"])


class _Seen:
    """Nodes met so far, as written parts that rounds append to; many parts are written as one, so plans stay short however long a path is."""

    def __init__(self, first: DataFrame, most: int = 12):
        self.parts, self.most = [first], most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [saved(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def _links(edges: DataFrame, *more: Column) -> DataFrame:
    """Each (src, dst) once, without links to itself, written and dealt by src: rounds join frontiers to it."""
    return saved(edges.filter("src <> dst").groupBy("src", "dst").agg(*(more or [F.lit(1).alias("one")])).repartition("src"))


def depths(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """Fewest links from the start pages to each page, up to `limit` if one is given. edges: src, dst; start: node. Each round joins the
    new frontier alone, and is written to the checkpoint folder."""
    first = saved(start.select("node", F.lit(0).alias("depth")).distinct())
    return _spread(_links(edges), _Seen(first), first, 1, limit).all()


def _spread(edges: DataFrame, seen: _Seen, frontier: DataFrame, first: int, limit: int | None) -> _Seen:
    for depth in count(first) if limit is None else range(first, limit + 1):
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = saved(reached.join(seen.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen


class Crawl(NamedTuple):
    """pages: node, depth, rank (from 1, as they are fetched); failed: node of what was tried in vain; limit_reached: something was left to fetch."""

    pages: DataFrame
    failed: DataFrame
    limit_reached: bool


def _in_order(rows: DataFrame, order: list, base: int) -> DataFrame:
    """rows, written, with `at`: numbers that grow in this order from `base` on, with gaps. No row moves to a single task for it."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(sorted_rows.withColumn("at", F.monotonically_increasing_id() + base))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in this order, from 1: rows are counted by part, so only as many sums as there are parts meet."""
    placed = _in_order(rows, order, 0)
    part = F.shiftright("at", 33)
    sums = placed.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = sums.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    met = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return met.withColumn(name, F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "at")


def crawl_order(edges: DataFrame, start: DataFrame, sitemap: DataFrame, fetched: DataFrame | None = None, limit: int | None = None) -> Crawl:
    """A crawl as a queue has it: pages in the order in which links tell of them, up to `limit` pages.

    edges: src, dst, pos (the link's place in its page); start and sitemap: node; fetched: node, final (where it led), ok. What stands first in the queue is
    fetched first: links come behind all that were told before, those of one page by pos, then by address. What fails (no row, or not ok) has
    no links and counts for nothing; without `fetched` all succeed. A page whose address another one led to before is not fetched again. When nothing is left, the
    sitemap's addresses that were not met start a second phase, by address, at depth -1; what they tell of has depth 0 and on.

    A round takes all of one depth: its order is the parent's place, then the link's. Rounds end with the page that meets the limit, so their number and
    size follow the limit, not the graph. Repeated links and rows count once; an empty start leaves the sitemap's phase."""
    links = _links(edges, F.min("pos").alias("pos"))
    asked = fetched.select("node", "final", "ok").dropDuplicates(["node"]) if fetched is not None else None
    base, have = 0, 0
    queued: _Seen | None = None
    out: list[DataFrame] = []
    lost: list[DataFrame] = []
    finals: list[DataFrame] = []
    for depth, first in ((0, start), (-1, sitemap)):
        rows = first.select("node").distinct().filter("node is not null")
        if queued is not None:
            rows = rows.join(queued.all(), "node", "left_anti")
            rows = rows.join(reduce(DataFrame.unionByName, finals), "node", "left_anti") if finals else rows
        order = [F.col("node")]
        while True:
            if asked is not None:
                rows = rows.join(asked, "node", "left").withColumns({"ok": F.coalesce("ok", F.lit(False)), "final": F.coalesce("final", "node")})
            else:
                rows = rows.withColumns({"ok": F.lit(True), "final": F.col("node")})
            tried = _in_order(rows, order, base)
            size, last, n, led_on = tried.agg(F.count("*"), F.max("at"), F.count_if("ok"), F.count_if(F.col("ok") & (F.col("final") != F.col("node")))).first()
            if queued is None:
                queued = _Seen(tried.select("node"))
            elif size:
                queued.add(tried.select("node"))
            if not size:
                break
            base = last + 1
            if led_on:
                led = tried.filter("ok and final <> node").groupBy(F.col("final").alias("to")).agg(F.min("at").alias("since"))
                tried = saved(tried.join(led, F.col("node") == F.col("to"), "left").filter("since is null or since > at").drop("to", "since"))
                n = tried.filter("ok").count()
            good = tried.filter("ok")
            over = limit is not None and have + n >= limit
            if over:
                cut = good.orderBy("at").limit(limit - have).agg(F.max("at")).first()[0]
                reached = not tried.filter(F.col("at") > cut).isEmpty()
                good, tried = good.filter(F.col("at") <= cut), tried.filter(F.col("at") <= cut)
            have += n
            lost.append(tried.filter("not ok").select("node"))
            out.append(good.select("node", F.lit(depth).alias("depth"), "at"))
            if led_on:
                finals.append(saved(good.filter("final <> node").select(F.col("final").alias("node")).distinct()))
                if len(finals) > 12:
                    finals = [saved(reduce(DataFrame.unionByName, finals))]
            told = good.select(F.col("node").alias("src"), F.col("at").alias("parent")).join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("parent", "pos")).alias("by"))
            told = told.join(queued.all(), "node", "left_anti")
            told = told.join(reduce(DataFrame.unionByName, finals), "node", "left_anti") if finals else told
            if over:
                met = reduce(DataFrame.unionByName, [queued.all(), *finals])
                reached = reached or not told.isEmpty() or not sitemap.select("node").join(met, "node", "left_anti").isEmpty()
                return Crawl(numbered(reduce(DataFrame.unionByName, out), [F.col("at")], "rank"), reduce(DataFrame.unionByName, lost), reached)
            rows, order, depth = told, [F.col("by.parent"), F.col("by.pos"), F.col("node")], depth + 1
    none = start.select("node", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("at")).limit(0)
    pages = reduce(DataFrame.unionByName, out) if out else none
    return Crawl(numbered(pages, [F.col("at")], "rank"), reduce(DataFrame.unionByName, lost) if lost else none.select("node"), False)


def crawl(edges: DataFrame, start: DataFrame, sitemap: DataFrame, pages: int | None = None) -> DataFrame:
    """node, depth of both phases of a crawl of at most `pages` pages, all of which can be fetched. Without pos in edges (src, dst), links of one page come by address."""
    if pages is not None:
        placed = edges if "pos" in edges.columns else edges.withColumn("pos", F.lit(0))
        return crawl_order(placed, start, sitemap, None, pages).pages.select("node", "depth")
    links = _links(edges)
    first = saved(start.select("node", F.lit(0).alias("depth")).distinct())
    seen = _spread(links, _Seen(first), first, 1, None)
    left = saved(sitemap.select("node").distinct().join(seen.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(-1)))
    if left.isEmpty():
        return seen.all()
    seen.add(left)
    return _spread(links, seen, left, 0, None).all()


def in_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """pages (url, final_url, more) with in_sitemap: one of both addresses is listed. sitemap: loc, as crawl addresses."""
    listed = sitemap.select(crawl_url(F.col("loc")).alias("__loc")).distinct()
    one, two = (listed.select(F.col("__loc").alias(f"__{k}"), F.lit(True).alias(f"__in{k}")) for k in "ab")
    met = pages.join(one, F.col("url") == F.col("__a"), "left").join(two, F.col("final_url") == F.col("__b"), "left")
    return met.withColumn("in_sitemap", F.coalesce("__ina", F.lit(False)) | F.coalesce("__inb", F.lit(False))).drop("__a", "__b", "__ina", "__inb")


def unseen(sitemap: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses (loc) of the sitemap that the crawl (url) has not met."""
    return sitemap.join(seen.select(F.col("url").alias("loc")), "loc", "left_anti")


def resource_targets(pages: DataFrame, start, external: bool = False) -> DataFrame:
    """url: resources of pages (resources, external_links), each once, by url; other hosts' and external links only if `external`."""
    rows = pages.select(F.explode("resources").alias("url"))
    if external:
        rows = rows.unionByName(pages.select(F.explode("external_links").alias("url")))
    rows = rows.distinct()
    return (rows if external else rows.filter(host_key(F.col("url")) == host_key(start))).orderBy("url")


def crawl_rules() -> list[Column]:
    """Checks 29 and 30 over error (null: the page was fetched), path and robots_allowed."""
    return [
        rule("response", "Fetch failed", "fail", "high", F.col("error").isNotNull(), F.col("error")),
        rule("crawlability", "Blocked by robots.txt", "fail", "high", F.col("error").isNull() & ~F.col("robots_allowed"), F.col("path")),
    ]


def robots_file_rules() -> list[Column]:
    """Check 54 over robots_status."""
    s = F.col("robots_status")
    return [rule("crawlability", "Robots.txt unavailable", "warn", "medium", (s == 0) | (s == 429) | (s >= 500), F.concat(F.lit("HTTP "), s.cast("string")))]


def sitemap_error_rules() -> list[Column]:
    """Checks 55 and 56 over error of each failed sitemap and sources, the number of those that its site has."""
    lone = F.contains("error", F.lit("/sitemap.xml returned 404")) & (F.col("sources") == 1)
    return [chain(("sitemap", "No XML sitemap found", "warn", "medium", lone, F.col("error")), ("sitemap", "Sitemap error", "fail", "high", F.lit(True), F.col("error")))]


def duplicate_findings(pages: DataFrame) -> DataFrame:
    """Checks 46 to 49, a row for each page that shares a value: key, check, category, n. pages: key, indexable, title, description, h1, word_count, content_hash."""
    good = pages.filter("indexable")
    told = (
        ("Duplicate title", "on-page", F.lower(clean_text(F.col("title")))),
        ("Duplicate meta description", "on-page", F.lower(clean_text(F.col("description")))),
        ("Duplicate H1", "headings", F.lower(clean_text(F.coalesce(F.try_element_at("h1", F.lit(1)), F.lit(""))))),
        ("Exact duplicate content", "content", F.when(F.col("word_count") >= 50, F.col("content_hash")).otherwise("")),
    )
    said = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(category).alias("category"), value.alias("value")) for check, category, value in told])
    rows = good.select("key", F.inline(said)).filter("value <> ''")
    shared = rows.groupBy("check", "value").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(shared, ["check", "value"]).select("key", "check", "category", "n")


def near_duplicate_findings(pages: DataFrame, least: float = 0.9) -> DataFrame:
    """Check 50: key, other, evidence, told at the page that comes first. pages: key, indexable, word_count, tokens, content_hash."""
    good = pages.filter("indexable and word_count >= 100").select("key", F.col("content_hash").alias("hash"), F.array_distinct("tokens").alias("tokens"))
    pairs = near_duplicates(good, least)
    return pairs.select(F.col("left").alias("key"), F.col("right").alias("other"), F.concat(F.round(F.col("similarity") * 100).cast("int").cast("string"), F.lit("% similar")).alias("evidence"))


def duplicates(pages: DataFrame, field: Column, key: str = "key") -> DataFrame:
    """Pages whose field, if it has a value, another page has as well: key, value, n. The count goes over (value) sums, which combine before the shuffle."""
    rows = pages.select(key, field.alias("value")).filter("value is not null and value <> ''")
    shared = rows.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(shared, "value").select(key, "value", "n")


#: Sets of one token and size that meet in one tile at most, tokens beyond that and sets to confirm which are broadcast, and most frequent tokens that are ranked.
TILE, CROWDED, RANKED = 2000, 100_000, 1 << 18


def _sent(df: DataFrame) -> DataFrame:
    """df, broadcast if it has CROWDED rows at most."""
    return F.broadcast(df) if df.count() <= CROWDED else df


def _meeting(prefix: DataFrame, least: float) -> DataFrame:
    """set_a, set_b of sets that share a token of their prefixes and may be similar by size and place, and the tile (token, cell, tile) in which they
    meet, the least of several. prefix: set, size, pos, token and, if known, prev, the token before it in the prefix.

    A token with more than TILE sets is cut: sizes are dealt into classes that grow by 1 / least, so a set meets its own class and the next, and a class with
    more than TILE sets into tiles: each pair meets in one of them, and none is larger than TILE sets a side. Two sets that share the token before as well
    have met there, so they are not told again: pairs come once for each run of tokens that stand together in both, not for each token."""
    prev = F.col("prev") if "prev" in prefix.columns else F.lit(None).cast("long")
    rows = prefix.withColumn("prev", prev).withColumn("class", F.floor(F.log(F.col("size").cast("double")) / -math.log(least) + 1e-9).cast("int"))
    most = _sent(saved(rows.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("token")))
    crowded = _sent(saved(rows.join(most, "token").groupBy("token", "class").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))))
    # A class that a token's rows reach from the one below may have none of its own; it meets nothing.
    reached = F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.array("class", F.col("class") + 1))

    def side(p, df, tile):
        df = df.withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int")).withColumn("tile", F.explode(tile))
        return df.select(*[F.col(c).alias(f"{c}_{p}") for c in ("set", "size", "pos", "token", "prev", "cell", "tile")])

    met_by = rows.join(crowded, ["token", "class"], "left")
    tiles = crowded.select("token", F.col("class").alias("cell"), F.col("tiles").alias("into"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    x = met_by.withColumn("cell", F.explode(reached)).join(tiles, ["token", "cell"], "left").filter("tiles is null or into is not null").withColumn("tiles", F.coalesce("into", F.lit(1)))
    x = side("a", x, F.transform(others, lambda j: F.col("chunk") * F.col("tiles") + j))
    y = met_by.withColumn("cell", F.when(F.col("tiles").isNull(), -1).otherwise(F.col("class"))).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    y = side("b", y, F.transform(others, lambda i: i * F.col("tiles") + F.col("chunk")))
    smaller = F.struct("size_a", "set_a") < F.struct("size_b", "set_b")
    fits = F.col("size_a") >= F.lit(least) * F.col("size_b") - 1e-9
    # What both can still share from this token on, against what they must.
    enough = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")) - 1e-6
    first = F.coalesce(F.col("prev_a") != F.col("prev_b"), F.lit(True))
    met = x.join(y, (F.col("token_a") == F.col("token_b")) & (F.col("cell_a") == F.col("cell_b")) & (F.col("tile_a") == F.col("tile_b")) & smaller & fits & enough & first)
    return met.groupBy("set_a", "set_b").agg(F.min(F.struct(*[F.col(f"{c}_a").alias(c) for c in _TILE])).alias("at")).select("at.*", "set_a", "set_b")


_TILE = ("token", "cell", "tile")


def _heads(read: DataFrame, least: float) -> DataFrame:
    """node, set, size, marks, prefix of each set of read (row, set, tokens), told by its least row. prefix: its first tokens, rare ones first: the RANKED most
    frequent come last, by how many rows hold them, and the others, by hash, first. marks: for each residue of the hashes, if an odd number of the set's tokens has it.

    Any order that all sets share will do; this one needs no token to move, but for sums by token. Copies become one set by their heads, about a tenth of the tokens."""
    spark = read.sparkSession
    counted = saved(read.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f")).filter("f > 1"))
    have, bound = 0, 1 << 62
    for row in sorted(counted.groupBy(F.floor(F.log2("f")).alias("e")).agg(F.count("*").alias("n")).collect(), reverse=True):
        have += row["n"]
        if have > RANKED:
            break
        bound = 1 << row["e"]
    ranked = counted.filter(F.col("f") >= bound).toPandas().sort_values("token")
    dropped(counted)
    sent = spark.sparkContext.broadcast((ranked["token"].to_numpy(np.int64), ranked["f"].to_numpy(np.int64)))

    def cut(batches):
        names, f = sent.value
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token, of = batch.column(2).flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            # As many marks as half the tokens, 512 at least, so that they tell unlike sets apart.
            width = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(size, 2) / 2)).astype(np.int64))
            start = np.concatenate([[0], np.cumsum(width)])
            odd = np.packbits((np.bincount(start[of] + (token & (width - 1)[of]), minlength=start[-1]) & 1).astype(np.uint8))
            at = np.minimum(np.searchsorted(names, token), max(0, len(names) - 1))
            order = np.lexsort((token, np.where(names[at] == token, f[at], 0) if len(names) else token, of))
            pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            kept = pos < (size - np.ceil(np.round(least * size, 6)) + 1)[of]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(size)))])
            marks = [odd[a:b].tobytes() for a, b in zip(start[:-1] // 8, start[1:] // 8)]
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token[order][kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(marks, pa.binary()), prefix], ["node", "set", "size", "marks", "prefix"])

    each = read.select("row", "set", "tokens").mapInArrow(cut, "node long, set binary, size int, marks binary, prefix array<long>")
    return each.groupBy("set").agg(F.min(F.struct("node", "size", "marks", "prefix")).alias("head")).select("head.*", "set")


def _likely(met: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The pairs met whose marks allow for a Jaccard of `least`: each mark that differs is a token at least that one of the sets alone has."""
    told = [heads.select(F.col("node").alias(f"set_{p}"), F.col("size").alias(f"size_{p}"), F.col("marks").alias(f"marks_{p}")) for p in "ab"]
    rows = met.join(told[0], "set_a").join(told[1], "set_b").select(*_TILE, "set_a", "set_b", "size_a", "size_b", "marks_a", "marks_b")

    def folded(marks, width):
        bits = np.frombuffer(marks, np.uint8)
        return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)

    def kept(batches):
        for batch in batches:
            most = (1 - least) / (1 + least) * (batch.column(5).to_numpy() + batch.column(6).to_numpy()) + 1e-6
            x, y = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            width = [min(len(a), len(b)) for a, b in zip(x, y)]
            apart = [np.bitwise_count(folded(a, n) ^ folded(b, n)).sum() for a, b, n in zip(x, y, width)]
            yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(np.array(apart, np.int64) <= most))

    return rows.mapInArrow(kept, met.select(*_TILE, "set_a", "set_b").schema)


def _confirmed(found: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """set_a, set_b, similarity of the pairs found whose full sets (nodes: set, tokens) have a Jaccard of `least` or more.

    A set goes to each tile in which it has a pair to confirm, once, however many pairs there are; a tile's sets come before its pairs, and are held while it is read."""
    wanted = _sent(saved(found.select(*_TILE, F.explode(F.array("set_a", "set_b")).alias("set_a")).distinct()))
    sets = nodes.select(F.col("set").alias("set_a"), "tokens").join(wanted, "set_a")
    rows = sets.select(*_TILE, "set_a", F.lit(None).cast("long").alias("set_b"), "tokens").unionByName(found.withColumn("tokens", F.lit(None).cast("array<long>")))

    def compared(batches):
        tile, held = None, {}
        for batch in batches:
            parts, out = [batch.column(k).to_pylist() for k in range(5)], []
            tokens = batch.column(5)
            for i, (*at, a, b) in enumerate(zip(*parts)):
                if at != tile:
                    tile, held = at, {}
                if b is None:
                    held[a] = tokens[i].values.to_numpy()
                    continue
                x, y = held[a], held[b]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                similarity = common / (len(x) + len(y) - common)
                if similarity >= least:
                    out.append((a, b, similarity))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["set_a", "set_b", "similarity"])

    dealt = rows.repartition(*_TILE).sortWithinPartitions(*_TILE, F.col("set_b").asc_nulls_first())
    return dealt.mapInArrow(compared, "set_a long, set_b long, similarity double")


def near_duplicates(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs (left, right, similarity) of rows (key, tokens: distinct, hash) with other hashes and a token-set Jaccard of `least` or more.

    Prefix filtering: tokens are ordered from rare to frequent, and two sets that similar share one of their first
    n - ceil(least * n) + 1. So only those are joined, rare ones first, with filters by size, by the tokens' places and by marks of the whole sets; full
    sets confirm. Tokens are told by 64-bit hashes, which move and compare as numbers. Rows with equal token sets are one side of the join: their copies come back by a join on the set."""
    hashed = F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t))))
    name = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens"))]))
    read = rows.select("key", "hash", hashed.alias("tokens")).filter(F.size("tokens") > 0).withColumn("set", name).withColumn("row", F.monotonically_increasing_id())
    # A dictionary of this size holds a file's tokens, so that each takes a few bits.
    read = saved(read, **{"parquet.dictionary.page.size": 1 << 23})
    heads = saved(_heads(read, least))
    # Sets and hashes are told by their least row.
    texts = read.groupBy("hash").agg(F.min("row").alias("text"))
    sets = saved(read.select("key", "hash", "set").join(heads.select("set", "node"), "set").join(texts, "hash").select("key", "node", "text"))
    placed = F.inline(F.transform("prefix", lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.get("prefix", i - 1).alias("prev"))))
    met = saved(_meeting(heads.select(F.col("node").alias("set"), "size", placed), least))
    found = saved(_likely(met, heads, least))
    dropped(met)
    dropped(heads)
    close = saved(_confirmed(found, read.select(F.col("row").alias("set"), "tokens"), least))
    dropped(read)
    dropped(found)
    # Copies with one hash are one group: groups are paired, and keys come back last.
    groups = sets.select("node", "text").distinct()
    x, y = (groups.select(F.col("node").alias(f"node_{p}"), F.col("text").alias(f"text_{p}")) for p in "xy")
    apart = close.join(x, F.col("set_a") == F.col("node_x")).join(y, F.col("set_b") == F.col("node_y")).filter("text_x <> text_y")
    same = x.join(y, (F.col("node_x") == F.col("node_y")) & (F.col("text_x") < F.col("text_y"))).withColumn("similarity", F.lit(1.0))
    pairs = apart.select("node_x", "text_x", "node_y", "text_y", "similarity").unionByName(same)
    one, two = (sets.select(F.col("key").alias(f"key_{p}"), F.col("node").alias(f"node_{p}"), F.col("text").alias(f"text_{p}")) for p in "xy")
    told = pairs.join(one, ["node_x", "text_x"]).join(two, ["node_y", "text_y"])
    return told.select(F.least("key_x", "key_y").alias("left"), F.greatest("key_x", "key_y").alias("right"), "similarity")


def sitemap_rules() -> list[Column]:
    """Checks 31 to 36 over depth (null or negative: never linked), inlinks, in_sitemap, in_sitemap_as_listed, indexable, html, status_code, redirects."""
    c = F.col
    good = c("indexable") & c("html")
    return [
        rule("sitemap", "Sitemap-only page", "warn", "medium", (F.coalesce("depth", F.lit(-1)) < 0) & c("in_sitemap") & good),
        rule("links", "Deep page", "warn", "low", (c("depth") > 3) & good, c("depth")),
        rule("links", "No internal inlinks", "warn", "medium", (c("depth") > 0) & (c("inlinks") == 0) & good),
        rule("sitemap", "Non-success URL in sitemap", "fail", "high", c("in_sitemap") & ~c("status_code").between(200, 299), c("status_code")),
        rule("sitemap", "Non-indexable URL in sitemap", "fail", "high", c("in_sitemap") & ~c("indexable")),
        rule("sitemap", "Redirecting URL in sitemap", "fail", "high", c("in_sitemap_as_listed") & (c("redirects") > 0), c("redirects")),
    ]


def canonical_findings(pages: DataFrame) -> DataFrame:
    """Check 37: the page that a canonical names was crawled and cannot be indexed. pages: key, canonical (a key or null), indexable."""
    named = pages.select(F.col("key").alias("canonical"), F.col("indexable").alias("good"))
    return pages.filter("canonical is not null and canonical <> key").join(named, "canonical").filter("not good").select("key", "canonical")


def hreflang_findings(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Checks 51 to 53. links: src, dst, language; pages: key, status_code, indexable. A link back is one to the source from any language."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("returns")).distinct()
    met = links.join(pages.select(F.col("key").alias("dst"), "status_code", "indexable", F.lit(True).alias("crawled")), "dst", "left").join(back, ["src", "dst"], "left")
    rules = [
        chain(
            ("international", "Hreflang target not crawled", "warn", "medium", F.col("crawled").isNull()),
            ("international", "Invalid hreflang target", "fail", "high", (F.col("status_code") != 200) | ~F.col("indexable"), F.col("status_code")),
        ),
        rule("international", "Missing hreflang return link", "fail", "high", F.col("crawled").isNotNull() & F.col("returns").isNull()),
    ]
    return findings(met, rules, ["src", "dst", "language"])


def summary(pages: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters. pages: indexable, in_sitemap; edges: dst, internal; found: status, check."""
    p = pages.agg(F.count("*").alias("pages"), F.count_if("indexable").alias("indexable"), F.count_if(~F.col("indexable")).alias("non_indexable"), F.count_if("in_sitemap").alias("sitemap_urls"))
    e = edges.agg(F.count_distinct(F.when(F.col("internal"), F.col("dst"))).alias("internal_links"), F.count_distinct(F.when(~F.col("internal"), F.col("dst"))).alias("external_links"))
    f = found.agg(F.count_if(F.col("status") == "fail").alias("failures"), F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("check") == "Broken internal link").alias("broken_internal"), F.count_if(F.col("check") == "Internal link redirects").alias("redirected_internal"))
    return p.join(F.broadcast(e), how="cross").join(F.broadcast(f), how="cross")  # one row each


#: Bytes of a robots file that are read.
ROBOTS_BYTES = 1 << 20


def robots_rules(files: DataFrame) -> DataFrame:
    """Lines of robots files (site, body) as rules: site, grp, agents, pos, allow, path. A user-agent line after rules opens a
    group; comments and lines without a value go. Of a file its first ROBOTS_BYTES are read."""
    body = F.when(F.octet_length("body") > ROBOTS_BYTES, F.decode(F.substring(F.encode("body", "UTF-8"), 1, ROBOTS_BYTES), "UTF-8")).otherwise(F.col("body"))
    lines = files.select("site", F.posexplode(F.split(body, r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter(F.contains("raw", F.lit(":")))
    lines = lines.select("site", "line", F.lower(F.trim(F.regexp_extract("raw", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1)).alias("value"))
    told = lines.filter("field = 'user-agent' or field in ('allow', 'disallow') and value <> ''")
    by = Window.partitionBy("site").orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by), F.lit("allow")) != "user-agent")
    grouped = told.withColumn("grp", F.sum(opens.cast("int")).over(by)).filter("grp > 0")
    agents = grouped.filter("field = 'user-agent'").groupBy("site", "grp").agg(F.collect_list(F.lower("value")).alias("agents"))
    return grouped.filter("field <> 'user-agent'").select("site", "grp", F.col("line").alias("pos"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")).join(agents, ["site", "grp"], "right")


# The agents that a site's robots file is read for.
AGENTS = ("Googlebot", "Bingbot", "OAI-SearchBot", "GPTBot", "PerplexityBot", "Claude-SearchBot", "ClaudeBot")


def agents_access(rules: DataFrame, sites: DataFrame, path: str = "/") -> DataFrame:
    """What each of AGENTS may read of each site (site)."""
    asked = sites.select("site", F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent"), F.lit(path).alias("path"))
    return robots_access(rules, asked)


def robots_access(rules: DataFrame, asked: DataFrame, compat: bool = False) -> DataFrame:
    """asked (site, agent, path) with allowed and rule. The groups with the longest agent name inside the asked one apply (* counts
    as length 0); of their rules with a matching prefix (up to a *, without a final $) the longest decides, ties allow.

    Without a matching group everything is allowed; with compat all groups apply then, as some crawlers' checkers do."""
    fits = F.transform("agents", lambda a: F.when(a == "*", 0).when(F.contains(F.lower("agent"), a), F.length(a)).otherwise(-1))
    met = asked.join(rules.withColumnRenamed("path", "of"), "site", "left").withColumn("fit", F.coalesce(F.array_max(fits), F.lit(-1)))
    met = met.withColumn("best", F.max("fit").over(Window.partitionBy("site", "agent", "path"))).filter("fit = best")
    if not compat:
        met = met.withColumn("of", F.when(F.col("best") >= 0, F.col("of")))
    prefix = F.regexp_replace(F.regexp_replace("of", r"\$$", ""), r"\*.*$", "")
    top = F.max(F.when(F.startswith("path", prefix), F.struct(F.length(prefix).alias("n"), F.col("allow").alias("allow"), F.when(F.col("allow"), F.col("pos")).otherwise(-F.col("pos")).alias("late"), F.col("of").alias("of"))))
    out = met.groupBy("site", "agent", "path").agg(top.alias("top"))
    return out.select("site", "agent", "path", F.coalesce("top.allow", F.lit(True)).alias("allowed"), F.when(F.col("top").isNull(), "no matching rule").otherwise(F.concat(F.when(F.col("top.allow"), "Allow: ").otherwise("Disallow: "), F.col("top.of"))).alias("rule"))
