"""Documents to a training mix in five stages; each is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, minhash, mixing, secrets, toxicity
from weftline.llm.common import read, saved


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model, fitted on the labelled ones among docs, rejects."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return minhash.unique(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret; all documents stay, n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, source_size, target, copies and taken words."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("secrets", secret), ("mixing", mixed)]
#: SQL cannot express the fitted model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix takes after the stages before it, each over all that its predecessor kept; every stage but the last is written and read again.

    Null ids and texts stay until the mix, which takes no words from a null text; empty texts are no one's copies. Repeated rows are near copies of each other, of which one
    stays. Ties within stages go to the smaller id. Texts of any length are read whole. An empty table gives no rows. Columns of documents other than doc_id, text, source and n_chars pass as they
    are, whatever their names, and the mix adds size, source_size, target, copies and taken."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
