"""What the operators of this subpackage share: reading, saving, size-checked broadcasts, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import weftline

# Functions sent to executors travel by value, so executors need not have the library.
cloudpickle.register_pickle_by_value(weftline)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast; every broadcast table here has at most 48 bytes a row, so 24 MB.
BROADCAST_ROWS = 500_000
PER_FILE = 250_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors see. Where it is unset, a local run gets
    a folder of its own; on a cluster that would leave parts on single machines, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/weftline-checkpoints"


def saved(df: DataFrame, name: str = "part", rows: int | None = None) -> DataFrame:
    """Writes df into the shared checkpoint folder and reads it back: cuts the lineage, survives lost executors. The write's own
    shuffle files go when it ends.

    rows: for tables of a few numbers a row, about how many there are; they go to files of PER_FILE rows, or one for each core,
    instead of one for each shuffle partition, as loops write many such tables."""
    spark = df.sparkSession
    path = f"{shared(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // PER_FILE + 1))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that saved() wrote and returned as df, which nothing will read again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as a broadcast side if it has at most `rows` rows, which are counted, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
