"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; the result is
written as Parquet to the shared folder and read again by the next stage.

1. quality: documents the perplexity model rejects go.
2. near_duplicates: of each group of similar documents one row stays, with the smallest id.
3. secrets: every secret found is replaced in the text.
4. mixing: documents occur as often as their fitted rate says; toxic ones have a target of none.
5. packing: what is left is packed into sequences (one row per piece).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm.common import saved, table
from talkweave.llm.mixing import mixed_documents
from talkweave.llm.packing import pack_documents
from talkweave.llm.perplexity import judged
from talkweave.llm.secrets import redact_findings, scan_unseen
from talkweave.llm.shingles import similar_groups

SHINGLE_WORDS = 5
SIMILARITY = 80

# The stages train models and follow links, which SQL does not express.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique row key, written so that it stays the same, and the key's name, which no column has.

    Ids may be null or repeated.
    """
    key = "_row"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    return saved(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _only(keyed: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Documents whose row key is in ``rows``."""
    return keyed.join(rows, key, "left_semi").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the model keeps; each row is judged by itself.

    Null, empty and wordless texts go; without a trusted label every text with a word stays; repeated
    rows and ids get one verdict for one text and language; an empty table stays empty.
    """
    keyed, key = _keyed(docs)
    rows = judged(keyed.select(key, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"), key=key)
    return _only(keyed, key, rows.filter("kept").select(key))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group: that with the smallest id, one without id only if none has an id.

    Ties (repeated rows or ids) leave one row; texts without a word link with nothing and all stay.
    """
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("row"), "doc_id", "text")
    groups = similar_groups(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY)
    places = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("place"))
    first = groups.select(F.col("doc_id").alias("row"), "component_id").join(places, "row").groupBy("component_id").agg(F.min("place").alias("place"))
    return _only(keyed, key, first.select(F.col("place.row").alias(key)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; null and empty texts and repeated rows stay as they are."""
    findings, _ = scan_unseen(docs, "doc_id", "text")
    return redact_findings(docs, "text", findings)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that expected domain totals match the targets.

    Null and wordless texts have no tokens; an empty table stays empty; repeated rows are drawn together.
    """
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset; a null text is empty, repeated rows have pieces of their own."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
