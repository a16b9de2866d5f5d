"""Two-pass external shuffle into shards.

Pass one scatters whole records over memory-sized buckets by seeded hashes; pass two shuffles each
bucket by Fisher-Yates and writes it into its shard's files.  The shard of a record follows from its id and the number of shards
alone (the highest of one seeded hash per shard), so one more shard only takes records into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import DOCUMENTS, saved, table, whole

SEED = 20
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is highest."""
    best = F.array_max(
        F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("h"), F.lit(i).alias("s")) for i in range(shards)])
    )
    return best["s"]


def shuffled_shards(
    records: DataFrame, key: str, size: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``records``, written as shard files and read from them, with ``shard`` and ``slot``, the place within the shard, gapless from 0.

    The sum of ``size`` (bytes) of a shard decides how many buckets it has.  The bucket of a record is
    drawn by its content and its place in the input, so that equal keys or rows fill no single bucket.
    All records keep their row: a null key is a key like any other.  Input columns called shard or slot
    are replaced.
    """
    records = records.drop("shard", "slot")
    names = [f"c{i}" for i in range(len(records.columns))]
    placed = records.toDF(*names).withColumn("shard", shard_of(F.col(names[records.columns.index(key)]), shards, seed))
    # One row per shard.
    of_size = F.sum(F.col(names[records.columns.index(size)]).cast("double"))
    totals = {r["shard"]: r["total"] or 0.0 for r in placed.groupBy("shard").agg(of_size.alias("total")).collect()}
    buckets = F.get(F.array(*[F.lit(max(1, -(-int(totals.get(i, 0)) // bucket_bytes))) for i in range(shards)]), F.col("shard"))
    drawn = F.xxhash64(F.lit(seed + 1), *names, F.monotonically_increasing_id())
    scattered = placed.withColumn("bucket", F.pmod(drawn, buckets).cast("int"))
    # One row per bucket; sorted in and between buckets, so a rerun of a task draws the same order.
    gathered = scattered.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))
    mixed = gathered.sortWithinPartitions("shard", "bucket").select(
        "shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("i", "r")
    )
    files = saved(mixed.select("bucket", "i", *[F.col(f"r.{n}").alias(n) for n in names], "shard"), "shards", ["shard"])
    counts = files.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return files.join(offsets, ["shard", "bucket"]).select(
        *[F.col(n).alias(c) for n, c in zip(names, records.columns)],
        "shard", (F.col("first") + F.col("i")).cast("long").alias("slot"),
    )


def write_shards(shuffled: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes one folder per shard, each file a run of slots in order."""
    part = F.floor(F.col("slot") / rows_per_file)
    (
        shuffled.withColumn("part", part)
        .repartition("shard", "part")
        .sortWithinPartitions("shard", "slot")
        .drop("part")
        .write.partitionBy("shard").parquet(path)
    )


@register("op2_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    text = whole(F.col("text"))
    size = (F.octet_length(text) + 1).cast("long")
    records = table(spark, folder, "documents").select(*DOCUMENTS, size.alias("size"))
    return shuffled_shards(records, "doc_id", "size", 16).select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        shard_of(F.col("doc_id"), 17).alias("grown_shard"),
    )
