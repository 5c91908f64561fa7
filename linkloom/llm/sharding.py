"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded
hash. Pass two shuffles every bucket with Fisher-Yates and writes it. Read bucket
after bucket, the records are in one random order; record number ``g`` of it goes
to shard ``g mod shards``, slot ``g div shards``, so shards differ by at most one
record and slots have no gaps.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder

BUCKET_BYTES = 16 << 20
SEED = 20_240_607
#: Up to this many buckets their starts, 12 bytes each, are broadcast; beyond it the
#: records are shuffled to them.
BROADCAST_BUCKETS = 500_000


def scatter(records: DataFrame, size: str, buckets: int, seed: int = SEED) -> DataFrame:
    """``(bucket, key, record)``: every record whole, in a uniformly drawn bucket.

    The draw hashes the seed and the record's place in the input, not its
    contents: equal records, however many, spread over all buckets. The places
    are stable when ``records`` is read from stored tables, as it should be.
    """
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    drawn = records.select(key.alias("key"), F.struct(*(f"`{c}`" for c in records.columns)).alias("record"))
    bucket = F.pmod(F.shiftright("key", 7), F.lit(buckets)).cast("int")
    return drawn.select(bucket.alias("bucket"), "key", "record")


def shuffle_buckets(scattered: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """``(bucket, at, record)`` with the records of each bucket in a random order.

    ``shuffle`` is Fisher-Yates over the bucket's array. Its generator runs on
    from row to row of a task, so arrays and buckets are sorted first: a task
    that is run again draws the same order.
    """
    gathered = (
        scattered.repartition(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("key", "record"))).alias("records"))
        .sortWithinPartitions("bucket")
    )
    mixed = gathered.select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    return mixed.select("bucket", F.posexplode("records").alias("at", "entry")).select(
        "bucket", "at", F.col("entry.record").alias("record")
    )


def external_shuffle(
    records: DataFrame,
    size: str,
    shards: int = 8,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``(shard, slot, record)``: all records in seeded random order over the shards.

    ``size`` names the column with a record's bytes; buckets are as many as give
    each ``bucket_bytes`` on average. Null sizes count as nothing, an empty input
    gives an empty result, and repeated rows are all kept as records of their own.
    Input columns keep their names inside ``record``, whatever they are.
    """
    run = RunFolder(records.sparkSession, "sharding")
    total = records.agg(F.sum(f"`{size}`")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    written = run.keep(shuffle_buckets(scatter(records, size, buckets, seed), buckets, seed), "shuffled")
    # One row per bucket: a count of a few hundred thousand rows at 100 TB.
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        written.groupBy("bucket").agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(before, F.lit(0)).alias("start"))
    )
    if buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    place = F.col("start") + F.col("at")
    return written.join(starts, "bucket").select(
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
        "record",
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the records as Parquet, one folder per shard, in slot order within files.

    A shard is written as many files of consecutive slots, never by one task.
    """
    (
        shuffled.select("shard", "slot", "record.*")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 8 shards under the law ``rows``.

    Null texts have size 1 and the CRC of no bytes, 0.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumn("_bytes", F.octet_length(text) + F.lit(1).cast("long"))
    placed = external_shuffle(sized, "_bytes")
    return placed.select(
        F.col("record.doc_id").alias("doc_id"),
        F.col("record._bytes").cast("long").alias("size"),
        F.crc32(F.coalesce("record.text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
