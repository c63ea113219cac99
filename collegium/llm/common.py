"""What the operators share: reading tables, written intermediate tables and totals over split groups."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.sources.scratch import delete, shared_dir

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that a Python task turns into objects at a time.
SLICE = 512

#: Bytes of texts, about, in a bucket of a keyed copy.
BUCKET_BYTES = 256 << 20

#: Buckets of a group whose sums one task adds up at a time.
FAN = 4096

#: The setting by which Spark removes a query's shuffle files at its end, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Longs of a map of bits: 33 million bits, some 12 MB when broadcast, whatever the number of keys.
MAP_LONGS = 1 << 19


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that a task holds a few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage and outlives lost executors.

    The result of a query may read it lazily, so it goes when the driver's Python ends, or with its scope().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go at its end: what it has written is read instead of them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def keyed_copy(df: DataFrame, keys: list[str], name: str, size: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df written into the shared folder in buckets by `keys` (none of them null).

    Rows with whole texts that meet several narrow tables are moved once, here; each later join on the keys moves the
    other side only. Nothing splits a bucket later, so their number follows the bytes (`size`, of a row): about
    bucket_bytes each, and one for each shuffle partition at least, within the session's limit on buckets.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    total = df.agg(F.sum(size.cast("long"))).head()[0] or 0
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes)))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("compression", "zstd").option("path", path).saveAsTable(table)
    keep(spark, path, table)
    return spark.table(table)


_made: list[list[tuple[str, str | None]]] = []


def keep(spark: SparkSession, path: str, table: str | None = None) -> None:
    atexit.register(discard, spark, path, table)
    if _made:
        _made[-1].append((path, table))


@contextmanager
def scope(spark: SparkSession, but_last: bool = False) -> Iterator[list[tuple[str, str | None]]]:
    """What is materialised inside goes at its end, unless it is taken from the list, the last made last.

    With but_last, what was made last stays, and goes with the scope around.
    """
    _made.append([])
    try:
        yield _made[-1]
    finally:
        own = _made.pop()
        if but_last and own:
            stays = own.pop()
            if _made:
                _made[-1].append(stays)
        for made in own:
            discard(spark, *made)


def discard(spark: SparkSession, path: str, table: str | None = None) -> None:
    if spark.sparkContext._jsc is None:  # at exit, after the session has ended
        return
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    delete(spark, path)


def may_be_among(rows: DataFrame, wanted: DataFrame, keys: list[str], longs: int = MAP_LONGS) -> DataFrame:
    """The rows whose keys may be those of a row of wanted: all that are, and by chance some that are not.

    The keys are a map of 64 * longs bits of their hashes, and only that is broadcast, so its size follows neither
    table. Rows stay where they are, and a key that many of them hold is no task's alone. The more keys there are, the
    more rows are let through, up to all; whoever calls this decides on what is left.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(64 * longs))
    marked = {"_long": F.shiftright(bit, 6), "_bit": F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))}
    bits = wanted.withColumns(marked).groupBy("_long").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumns(marked).join(F.broadcast(bits), "_long").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return found.select(*rows.columns)


def by_id(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Rows (doc_id, text) in ranges of ids, sorted within; rows of one id, or of none, by a hash of their text.

    The ids of a range's ends may go on in the next one: equal ids are dealt by that hash, and rows that repeat both
    by chance, as nothing tells these apart. So no id, however many rows it has, is one task's.
    """
    way = F.desc if descending else F.asc
    dealt = rows.withColumns({"_hash": F.xxhash64("text"), "_deal": F.rand(0)})
    order = [way("doc_id"), F.asc("_hash"), F.asc("_deal")]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns)


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, out: str, fan: int = FAN) -> DataFrame:
    """Adds `out`: the sum of value over the rows before this one in its group (a long, 0 for the first).

    A group may hold any share of the rows: it is split by the whole number `bucket`, which must not fall as `order`
    rises. Bucket sums are pre-aggregated and added up for `fan` buckets at a time, then over these, so a task holds a
    bucket's rows, `fan` buckets' sums or a group's share of 1 / (rows of a bucket * fan).
    """
    keys = [*group, bucket]
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum")).withColumn("_wide", F.floor(F.col(bucket) / fan))
    wide = sums.groupBy(*group, "_wide").agg(F.sum("_sum").alias("_wide_sum"))
    wide = wide.select(*group, "_wide", F.coalesce(F.sum("_wide_sum").over(before(group, "_wide")), F.lit(0)).alias("_wide_before"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before([*group, "_wide"], bucket)), F.lit(0)))
    sums = sums.join(wide, [*group, "_wide"]).select(*keys, (F.col("_before") + F.col("_wide_before")).alias("_offset"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, keys)
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_inside", "_offset")
    )


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df range-partitioned by `order` and written, with its partition in the column `_part`.

    Partitions ascend with the order, and rows that tie share one, so that `_part` serves running_total as bucket
    of a single group: a total over the whole table without one task for all of it.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
