"""Tables kept by key, and the reads of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .site import saved

#: Parts that a kept table is dealt into by its keys; a merge rewrites those that new rows fall into.
BUCKETS = 64


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the latest by `version` for each key; of equal versions the new one. One aggregation, no sort."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new", *[c for c in rest if c != version])).alias("row"))
    return last.select(*keys, "row.*").select(*old.columns)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table that `merge` keeps."""
    return spark.read.parquet(path).drop("of", "bucket")


def _kept(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def merge(new: DataFrame, path: str, keys: list[str], version: str, buckets: int = BUCKETS) -> list[int]:
    """Puts rows of new into the table at path, the latest by `version` for each key, and returns the buckets that were rewritten; others' files stay as they are.

    Rows are dealt into `buckets` folders by the hash of their keys. Only the folders that new rows fall into are read (the filter prunes the scan) and, once their
    merged rows are written in full to the checkpoint folder, replaced by a dynamic partition overwrite, each at once by a rename: a merge that fails before leaves
    the table as it was, and one that is run again gives the same. Folders are written in files of the advisory size, so a large one is no single task.
    A table is made where there is none; one of another number of buckets is an error. Columns that only new has are null in old rows. Keys of null are a key; an empty new changes nothing."""
    spark = new.sparkSession
    clash = {"of", "bucket"} & set(new.columns)
    if clash:
        raise ValueError(f"columns named {', '.join(sorted(clash))} belong to the table's folders")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = saved(new.withColumn("bucket", bucket))
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    rows = fresh.drop("bucket")
    if _kept(spark, path):
        table = spark.read.parquet(path)
        if {r["of"] for r in table.select("of").limit(1).collect()} - {buckets}:
            raise ValueError(f"the table at {path} has another number of buckets")
        old = table.filter(F.col("bucket").isin(touched)).drop("of", "bucket")
        for c in [c for c in rows.columns if c not in old.columns]:
            old = old.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        for c in [c for c in old.columns if c not in rows.columns]:
            rows = rows.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    else:
        old = rows.limit(0)
    staged = saved(upsert(old, rows, keys, version).withColumns({"of": F.lit(buckets), "bucket": bucket}))
    staged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)
    return touched


def business_pages(businesses: DataFrame, pages: DataFrame) -> DataFrame:
    """Each business with its number of pages, the latest first."""
    counts = pages.groupBy("business_id").agg(F.count("*").alias("page_count"))
    return businesses.join(counts, "business_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0))).orderBy(F.desc("updated_at"), "business_id")


def search_pages(pages: DataFrame, query: str = "", page_type: str = "") -> DataFrame:
    """Pages of a type with a text in url, title or h1, any case."""
    out = pages if not page_type else pages.filter(F.col("page_type") == page_type)
    return out.filter(F.contains(F.lower(F.concat_ws(" ", "url", "title", "h1")), F.lit(query.strip().lower()))) if query.strip() else out


def cached(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with what the cache holds for their keys, rows that it lacks)."""
    return rows.join(cache, keys), rows.join(cache, keys, "left_anti")


def type_counts(labels: DataFrame, column: str = "page_type") -> DataFrame:
    return labels.groupBy(column).agg(F.count("*").alias("n"))
