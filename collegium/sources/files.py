"""File sources and sinks with declared schemas: JSON snapshots, blobs by content, collections by owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collegium.sources.scratch import delete, exists

AUDIENCE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("scheme", "programme", "branch", "department", "stream", "college")],
    T.StructField("semester", T.IntegerType()),
    T.StructField("courses", T.ArrayType(T.StringType())),
    T.StructField("examCycle", T.StringType()),
    T.StructField("unresolvedScope", T.BooleanType()),
])
ITEM = T.StructType([*[T.StructField(n, T.StringType()) for n in ("externalId", "url", "title", "body", "publishedAt", "updatedAt", "supersedes")], T.StructField("audience", AUDIENCE)])
SNAPSHOT = T.StructType([*[T.StructField(n, T.StringType()) for n in ("family", "capturedAt", "note")], T.StructField("items", T.ArrayType(ITEM)), T.StructField("_corrupt", T.StringType())])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: the snapshot's fields and status: ok, malformed (no JSON) or incomplete.

    A file that can't be read as a snapshot is never an empty success: its row stays, with its status.
    """
    rows = spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"))
    bad = F.exists("items", lambda i: i["externalId"].isNull() | i["title"].isNull() | i["url"].isNull())
    status = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("family").isNull() | F.col("items").isNull() | bad, "incomplete").otherwise("ok")
    return rows.withColumn("status", status).drop("_corrupt")


def snapshot_items(snapshots: DataFrame) -> DataFrame:
    """One row per item of the snapshots that are ok: family, the item's fields and audience."""
    return snapshots.where("status = 'ok'").select("family", F.inline("items"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """sha256, shard (its first two digits), path, length, kind by name and magic bytes, content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sha = F.sha2("content", 256)
    kind = F.when(F.col("path").rlike(r"(?i)\.pdf$"), "pdf").when(F.col("path").rlike(r"(?i)\.(png|jpe?g|webp)$"), "image").otherwise("other")
    looks = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    return rows.select(sha.alias("sha256"), F.substring(sha, 1, 2).alias("shard"), "path", "length", kind.alias("kind"), looks.alias("looks_like_pdf"), "content")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """One row for each content, in folders by shard. Writing the same content again changes nothing but the file."""
    blobs.dropDuplicates(["sha256"]).select("sha256", "length", "content", "shard").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def manifest(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """A download manifest after a round: url, sha256, outcome.

    known has url and sha256; fetched has url, sha256 (null: nothing came) and status. Outcomes: new, changed,
    unchanged, duplicate (the content is known under another url), failed, gone (known and not asked for).
    """
    old = known.select("url", F.col("sha256").alias("_old"))
    contents = known.select(F.col("sha256").alias("_sha")).distinct()
    rows = fetched.join(old, "url", "full_outer").join(contents, F.col("sha256") == F.col("_sha"), "left")
    outcome = (
        F.when(F.col("status").isNull(), "gone")
        .when(F.col("sha256").isNull(), "failed")
        .when(F.col("_old") == F.col("sha256"), "unchanged")
        .when(F.col("_old").isNotNull(), "changed")
        .when(F.col("_sha").isNotNull(), "duplicate")
        .otherwise("new")
    )
    return rows.select("url", F.coalesce("sha256", "_old").alias("sha256"), outcome.alias("outcome"))


#: Rows, about, of a folder of a collection; an owner's rows are all in one of them.
FOLDER_ROWS = 1_000_000


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """(version, buckets) of a collection as its last marker says; (0, 0) where there is none."""
    markers = f"{path}/_markers"
    if not exists(spark, markers):
        return 0, 0
    last = spark.read.schema("version int, buckets int").json(markers).orderBy(F.desc("version")).first()
    return (last.version, last.buckets) if last else (0, 0)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """A collection's rows with their bucket: of each bucket the latest version that a marker vouches for."""
    version, _ = _state(spark, path)
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("_version") <= version)
    latest = rows.select("bucket", "_version").groupBy("bucket").agg(F.max("_version").alias("_version"))
    return rows.join(latest, ["bucket", "_version"], "left_semi").drop("_version")


def write_collection(rows: DataFrame, path: str, owner: str = "owner", folder_rows: int = FOLDER_ROWS) -> None:
    """A collection in buckets by a hash of the owner; of the buckets that rows fall into, only these owners' rows change.

    A touched bucket is written anew beside the one that is held, and a marker is set when all are there: a job that dies
    on the way leaves the collection as it was. The first writing sets the number of buckets, by the number of rows.
    """
    spark = rows.sparkSession
    version, buckets = _state(spark, path)
    buckets = buckets or max(1, -(-rows.count() // folder_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int"))
    if version:
        held = read_collection(spark, path).join(rows.select("bucket").distinct(), "bucket", "left_semi")
        rows = rows.unionByName(held.join(rows.select(owner).distinct(), owner, "left_anti"))
    # A bucket's rows come together first, so that its folder gets one file and not one from every task; a bucket that is
    # too large for a task is split again.
    rows.withColumn("_version", F.lit(version + 1)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", "_version").parquet(path)
    spark.createDataFrame([(version + 1, buckets)], "version int, buckets int").coalesce(1).write.mode("append").json(f"{path}/_markers")


def vacuum_collection(spark: SparkSession, path: str) -> int:
    """Deletes what newer versions of buckets have replaced, and what no marker vouches for; how many folders went."""
    version, _ = _state(spark, path)
    rows = spark.read.option("basePath", path).parquet(path).select("bucket", "_version").distinct()
    latest = rows.where(F.col("_version") <= version).groupBy("bucket").agg(F.max("_version").alias("latest"))
    stale = rows.join(latest, "bucket", "left").where(F.col("latest").isNull() | (F.col("_version") != F.col("latest"))).collect()  # a row for each folder
    for r in stale:
        delete(spark, f"{path}/bucket={r.bucket}/_version={r._version}")
    return len(stale)


def without_owners(spark: SparkSession, path: str, prefix: str, owner: str = "owner") -> DataFrame:
    """What a collection holds once every owner with a prefix is cleared."""
    return read_collection(spark, path).drop("bucket").where(~F.startswith(F.col(owner).cast("string"), F.lit(prefix)))


def refusal(registry: DataFrame, families: DataFrame) -> DataFrame:
    """family, permitted, reason of the first gate that is shut; a family that is not registered is refused."""
    rows = families.join(registry, "family", "left")
    reason = (
        F.when(F.col("enabled").isNull(), "not_registered")
        .when(~F.col("enabled"), "disabled")
        .when(~F.coalesce("permission_recorded", F.lit(False)), "no_permission")
        .when(~F.coalesce("robots_allow", F.lit(False)), "robots")
        .when(F.coalesce("adapter", F.lit("")) == "", "no_adapter")
        .when(F.coalesce("mode", F.lit("none")) != "live", "not_live")
    )
    return rows.select("family", reason.isNull().alias("permitted"), reason.alias("reason"))
