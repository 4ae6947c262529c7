"""Benchmark decontamination by spaced-seed hashing (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, saved, small

#: 1: the token counts, 0: it may be any. All ways in which three of five tokens in a row can agree. An item of four tokens or more parts into blocks of 5 to 9 (or is one of 4);
#: if LEAST of its tokens agree, so does that share of some block, and then three of five in a row: no such pair is missed.
TRIPLES = ("111", "1101", "1011", "11001", "10101", "10011")
#: Items too short for a triple are tried by each of their tokens.
SINGLE, SHORT = ("1",), 4
#: Share of an item's tokens that must stand in the document on one alignment.
LEAST = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits (all beyond ASCII count as letters), lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """Array of (mask, hash of the tokens that the mask keeps) of the window that begins at `at` (from 0)."""
    return F.array(*[F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *[F.get(hashes, at + i) for i, c in enumerate(mask) if c == "1"]).alias("seed")) for k, mask in enumerate(masks)])


def _windows(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Seeds at each place; near the end, where a mask reaches beyond the text, of the tokens that are there."""
    at = rows.filter(F.size("hashes") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)))
    return at.select(*rows.columns, "at", F.inline(_seeds(F.col("hashes"), F.col("at"), masks)))


def _seeded(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    return saved(_windows(items, masks).select("mask", "seed", F.col("at").alias("item_at"), "item_id").distinct(), "seeds")


def leaks(docs: DataFrame, bench: DataFrame, masks: tuple[str, ...] = TRIPLES, least: float = LEAST) -> DataFrame:
    """Rows doc_id, text_hash, item_id, doc_start, n_item, n_same, share: a document and an item whose tokens stand in it.

    Every window of each text is hashed under each mask, so a pair of windows meets when they agree on one mask's
    tokens, whatever stands at the others; items of fewer than SHORT tokens meet by single tokens. With TRIPLES and a `least` of
    0.6 or more every pair is found. A hit fixes an alignment; there all of the item's tokens are compared, and the pair
    counts if at least `least` of them agree. One row a pair: the alignment with most agreement, then the first. While the items' seeds and
    tokens fit a checked broadcast, all that is done where the text lies, in one pass. Beyond it both sides shuffle by the seed, windows as rows of a
    few numbers; alignments count once however many windows hit them, and only texts that have one meet them with their tokens.

    Null text or text without tokens: no rows; likewise items. Repeated documents: one row for each
    (id, text); equal items under two ids: each counts. Null ids stay null. Empty tables: no rows. Other columns don't matter.
    """
    items = bench.select("item_id", _hashed(F.col("text")).alias("hashes"))
    seeds, brief = (_seeded(items.filter(fits), m) for fits, m in ((F.size("hashes") >= SHORT, masks), (F.size("hashes") < SHORT, SINGLE)))
    whole = items.select(F.col("item_id").alias("of_item"), F.col("hashes").alias("item")).distinct()
    few = (whole.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_ROWS and seeds.union(brief).count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hashed(F.col("text")).alias("hashes"))
    hits = _windows(rows, masks).join(F.broadcast(seeds) if few else seeds, ["mask", "seed"])
    if not brief.isEmpty():
        hits = hits.unionByName(_windows(rows, SINGLE).join(F.broadcast(brief) if few else brief, ["mask", "seed"]))
    aligned = hits.withColumn("doc_start", F.col("at") - F.col("item_at"))
    if not few:
        aligned = saved(aligned.select("doc_id", "text_hash", "item_id", "doc_start").distinct(), "alignments")
        its = aligned.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
        mine = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
        texts = rows.join(its, mine, "left_semi").dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
        aligned = aligned.join(texts, mine).drop("__id", "__hash")
    # Both arrays are laid side by side by the alignment's shift and compared place by place.
    there = F.slice("hashes", F.greatest(F.col("doc_start") + 1, F.lit(1)), F.greatest(F.size("item") + F.least(F.col("doc_start"), F.lit(0)), F.lit(0)))
    here = F.slice("item", F.greatest(1 - F.col("doc_start"), F.lit(1)), F.size("item"))
    same = F.size(F.filter(F.zip_with(there, here, lambda x, y: x == y), lambda z: F.coalesce(z, F.lit(False))))
    checked = (
        aligned.join(F.broadcast(whole) if few else whole, F.col("item_id").eqNullSafe(F.col("of_item")))
        .select("doc_id", "text_hash", "item_id", F.size("item").alias("n_item"), F.struct(same.alias("n_same"), (-F.col("doc_start")).alias("back")).alias("best"))
        .filter(F.col("best.n_same") >= F.lit(least) * F.col("n_item"))
    )
    out = checked.groupBy("doc_id", "text_hash", "item_id", "n_item").agg(F.max("best").alias("best"))
    return out.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("doc_start"), "n_item", F.col("best.n_same").alias("n_same"), (F.col("best.n_same") / F.col("n_item")).alias("share"))


def clean(docs: DataFrame, bench: DataFrame, masks: tuple[str, ...] = TRIPLES, least: float = LEAST) -> DataFrame:
    """docs without the rows that hold a benchmark item. A row is told by its id and its text, so a null id is no special case."""
    of, its = fresh(docs, "__id", "__hash")
    bad = saved(leaks(docs, bench, masks, least).select(F.col("doc_id").alias(of), F.col("text_hash").alias(its)).distinct(), "leaks")
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(its)), "left_anti")
