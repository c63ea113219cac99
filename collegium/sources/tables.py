"""Readers of the tables and their projections into academic shapes (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owned(df: DataFrame, owner: object, column: str = "student") -> DataFrame:
    """The rows of one owner; a plain predicate, so it reaches the scan."""
    return df.where(F.col(column) == F.lit(owner))


def whole(value: Column) -> Column:
    """A double that stands for a whole number, as a long."""
    return F.floor(value + 0.5).cast("bigint")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: student, semester, code, internal, external, total, credits, has_see and the line.

    The join is on the order key, of which both sides hold one row or a few for each order; neither is broadcast
    unless Spark finds it small.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("_year"))
    internal = whole(F.col("l_quantity"))
    external = whole(F.col("l_discount") * 100) * 5
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("student"),
        (F.col("_year") - 1994).cast("bigint").alias("semester"),
        F.col("l_partkey").alias("part"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"),
        internal.alias("internal"),
        external.alias("external"),
        (internal + external).alias("total"),
        (1 + F.col("l_linenumber") % 4).cast("bigint").alias("credits"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        whole(F.col("l_tax") * 100).alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_orderkey").alias("order_key"),
    )


def attempts_with_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempts with has_see (null: unknown) and, for courses without an examination, internal marks over 100."""
    rows = attempts(spark, sf_dir)
    has_see = F.when(F.col("line") == 7, F.lit(None).cast("boolean")).otherwise(F.col("line") != 5)
    rows = rows.withColumn("has_see", has_see)
    none = ~F.coalesce("has_see", F.lit(True))
    internal = F.when(none, F.col("internal") * 2).otherwise(F.col("internal"))
    external = F.when(none, F.lit(0)).otherwise(F.col("external"))
    return rows.withColumns({"internal": internal, "external": external, "total": internal + external})


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student, subject, attended, conducted, counted from single events."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("student"), F.col("event_type").alias("subject")).agg(F.count_if(F.col("value") >= 8).alias("attended"), F.count(F.lit(1)).alias("conducted"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student, branch (null where not told), college, semester."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(
        F.col("c_custkey").alias("student"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("branch"),
        F.col("c_nationkey").cast("string").alias("college"),
        (1 + F.col("c_custkey") % 8).cast("bigint").alias("semester"),
    )


#: The notices' titles by key modulo 12; {name} and {type} are the part's.
TITLES = ["Time Table for the examination", "Results announced for {name}", "Application for revaluation of {name}", "Examination registration, last date", "Academic calendar", "Revised regulations", "Scheme of teaching", "Syllabus of {name}", "Examination centre note", "Circular on {type}", "Revised Time Table postponed", "{name} {type}"]


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notice, title and the audience axes branch, college, semester and courses; null: not targeted."""
    rows = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    title = None
    for k, text in enumerate(TITLES):
        said = F.replace(F.replace(F.lit(text), F.lit("{name}"), F.col("p_name")), F.lit("{type}"), F.col("p_type"))
        title = F.when(key % 12 == k, said) if title is None else title.when(key % 12 == k, said)
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return rows.select(
        key.alias("notice"),
        title.alias("title"),
        F.when(key % 3 == 0, F.element_at(segments, (key % 5 + 1).cast("int"))).alias("branch"),
        F.when(key % 5 == 0, (F.col("p_size") % 25).cast("string")).alias("college"),
        F.when(key % 7 == 0, (1 + key % 8).cast("bigint")).alias("semester"),
        (key % 97 == 0).alias("unreadable_scope"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 120).cast("int")).alias("published"),
        F.when(key % 4 == 0, F.date_add(F.lit("2024-02-01").cast("date"), (key % 60).cast("int"))).alias("deadline"),
    )


def snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """One of two captures of the documents: item, title, body, url, supersedes."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    body = F.col("text") if version == 1 else F.when(key % 20 == 3, F.concat(F.col("text"), F.lit(" (revised)"))).otherwise(F.col("text"))
    supersedes = F.lit(None).cast("bigint") if version == 1 else F.when(key % 40 == 0, key + 2).when(key % 40 == 20, key + 10)
    kept = docs.where(key % 10 != (0 if version == 1 else 1))
    return kept.select(key.alias("item"), F.col("source").alias("family"), body.alias("body"), F.concat(F.lit("https://notices.example/"), key.cast("string")).alias("url"), supersedes.alias("supersedes"))
