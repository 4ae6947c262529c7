"""Mixing sources to target weights by Pareto order sampling (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, small

SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (3, 1, 2), "mix-1"
#: Rank buckets of a source: the cut is found on their sums, and only the bucket that it falls into is sorted.
BUCKETS = 4096


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes: source, source_size. Adds target: the sources by code point, null last, weigh `weights` in turn and share
    `share` of all sizes; none gets more than cap times its size, and what is over goes to the others by weight.

    That is min(cap * size, level * weight) with one level for all, found from running sums over the sources in order
    of the level at which each is full: the first source that what is left doesn't fill gives the level. Sources that are full at
    one level enter the sums together. One row per source, so the one-partition window is as small as the sources are.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    upto = Window.orderBy("full_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level_with = Window.partitionBy("full_at")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("full_at")

    def below(column):
        """Sum over the sources that are full at a lower level; exact, as sizes and weights are whole numbers."""
        return F.sum(column).over(upto) - F.sum(column).over(level_with)

    rest = weighed.withColumn("left", share * F.sum("source_size").over(every) - cap * below("source_size")).withColumn("open", F.sum("weight").over(every) - below("weight"))
    first = F.min(F.when(F.col("full_at") * F.col("open") >= F.col("left"), F.struct("full_at", (F.col("left") / F.col("open")).alias("level")))).over(every)
    level = first["level"]
    return rest.select("source", "source_size", F.least(cap * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, seed: str, weight: str | None) -> DataFrame:
    due = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return docs.withColumns({"__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "__u": u, "__due": due})


def _ranked(sized: DataFrame, aims: DataFrame, cap: float) -> DataFrame:
    rows = sized.join(aims, F.col("source").eqNullSafe(F.col("__of")))
    each = F.least(F.lit(cap), F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0) * F.col("__due"))
    rows = rows.withColumn("__each", each).withColumn("__whole", F.floor("__each")).withColumn("__p", F.col("__each") - F.col("__whole"))
    rank = F.col("__u") * (1 - F.col("__p")) / (F.col("__u") * (1 - F.col("__p")) + (1 - F.col("__u")) * F.col("__p"))
    rows = rows.withColumn("__rank", rank)
    # Ranks crowd at 0 or 1 where p is near 1 or 0; held against the source's mean odds they are spread as u is.
    spread = F.col("__rank") * F.col("__p0") / (F.col("__rank") * F.col("__p0") + (1 - F.col("__rank")) * (1 - F.col("__p0")))
    rows = rows.withColumn("__bucket", F.floor(spread * BUCKETS).cast("int"))
    rows = rows.withColumn("__extra", F.when(F.col("__whole") + 1 <= cap, F.col("__size")).otherwise(0))
    return rows.withColumn("__key", F.struct(F.col("__rank").alias("r"), F.col("__u").alias("u"), F.coalesce("doc_id", F.lit(-(2**62))).alias("d"), F.col("__size").alias("s")))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """Each row of docs (doc_id, source, text, more if wanted) with size, source_size, target, copies, taken in place of text if
    docs has no more than those three, else beside it.

    A document is due target / source_size copies, times its `weight` over 1 if such a column is named. Whole copies are
    certain. The fraction p is its inclusion probability: documents of a source are ranked by the Pareto order
    (u / (1 - u)) / (p / (1 - p)), u being uniform and fixed by seed and doc_id, and one more copy each is taken in this order
    until the source's words are nearest to its target. The cut is found in two steps (sums of rank buckets, then the one
    bucket that holds it), so a source with most of the rows is not sorted in one task, and then is one rank per
    source that each row is held against where it lies: texts do not move.

    Null text or no words: size 0, taken 0. Null source: a source of its own, the last. Null doc_id: as an id of its own.
    Repeated rows: each counts; rows equal in id and size are taken alike, all or none at the cut. Empty table: no rows. Columns named as the added ones are replaced.
    """
    skinny = saved(_sized(docs, seed, weight).select("doc_id", "source", "__size", "__u", "__due"), "sized")
    sizes = saved(skinny.groupBy("source").agg(F.sum("__size").alias("source_size"), F.avg("__due").alias("__mean")), "sizes")
    aims = targets(sizes.drop("__mean"), share, cap, weights).join(sizes.select(F.col("source").alias("__of"), "__mean"), F.col("source").eqNullSafe(F.col("__of")))
    mean = F.least(F.lit(cap), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("__mean"))
    aims = aims.select("__of", F.col("source_size").alias("__total"), F.col("target").alias("__target"), F.least(F.greatest(mean - F.floor(mean), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("__p0"))
    aims = small(saved(aims, "targets"))
    ranked = _ranked(skinny, aims, cap)
    sums = ranked.groupBy("source", "__bucket").agg(F.sum("__extra").alias("words"), F.sum(F.col("__whole") * F.col("__size")).alias("certain"), F.min("__target").alias("goal"))
    by = Window.partitionBy("source")
    cut = (
        sums.withColumn("need", F.col("goal") - F.sum("certain").over(by))
        .withColumn("before", F.sum("words").over(by.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .filter(F.col("before") < F.col("need"))
        .groupBy("source")
        .agg(F.max("__bucket").alias("__last"), F.max("before").alias("__before"), F.max("need").alias("__need"))
        .withColumnRenamed("source", "__cut_of")
    )
    cut = saved(cut, "cut")
    inside = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ranked.join(small(cut), F.col("source").eqNullSafe(F.col("__cut_of")) & (F.col("__bucket") == F.col("__last")))
    edge = edge.filter("__extra > 0").groupBy("source", "__key").agg(F.sum("__extra").alias("__extra"), F.min("__before").alias("__before"), F.min("__need").alias("__need"))  # rows with one key are one, however many
    edge = edge.withColumn("upto", F.sum("__extra").over(inside)).filter(F.col("__before") + F.col("upto") - F.col("__extra") / 2 <= F.col("__need"))
    upto = edge.groupBy("source").agg(F.max("__key").alias("__upto")).withColumnRenamed("source", "__upto_of")
    cut = small(saved(cut.join(upto, F.col("__cut_of").eqNullSafe(F.col("__upto_of")), "left").select("__cut_of", "__last", "__upto"), "cut"))
    whole = set(docs.columns) > {"doc_id", "source", "text"}
    rows = _ranked(_sized(docs, seed, weight) if whole else skinny, aims, cap).join(cut, F.col("source").eqNullSafe(F.col("__cut_of")), "left")
    more = (F.col("__extra") > 0) & F.coalesce((F.col("__bucket") < F.col("__last")) | ((F.col("__bucket") == F.col("__last")) & (F.col("__key") <= F.col("__upto"))), F.lit(False))
    added = {"size": F.col("__size"), "source_size": F.col("__total"), "target": F.col("__target"), "copies": F.col("__whole") + more.cast("long"), "taken": (F.col("__whole") + more.cast("long")) * F.col("__size")}
    own = [c for c in (docs.columns if whole else ("doc_id", "source")) if c not in added]
    return rows.select(*own, *[v.alias(k) for k, v in added.items()])
