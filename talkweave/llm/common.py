"""Helpers the operators of this folder share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.session import shared_dir

# White space that ends a word: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


# Spark removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, purpose: str, folders: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    With ``folders`` (the last columns of ``df``) there is a folder of files for each of their values.

    The table replaces the shuffles it was made from, so their files go with the write.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*folders or []).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = [path]
    return out


def saved_parts(parts: list[DataFrame], purpose: str) -> DataFrame:
    """The union of ``parts`` of equal columns, saved one after another, so that only one part's shuffles exist at a time."""
    tables = [saved(df, purpose) for df in parts]
    out = reduce(DataFrame.unionByName, tables)
    out._saved_at = [path for df in tables for path in df._saved_at]
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` or ``saved_parts`` returned, once everything that reads them has been written."""
    for df in tables:
        for path in df._saved_at:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as an array (null text: none)."""
    return F.filter(F.split(whole(text), SPACE + "+"), lambda w: w != "")
