"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import MAP_LONGS, materialise, may_be_among

#: Code points of a text's start that the second pass hashes.
PREFIX = 256


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The values of keys that two or more rows hold; counts are combined before the shuffle."""
    return rows.groupBy(*keys).count().where("count > 1").drop("count")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, map_longs: int = MAP_LONGS) -> DataFrame:
    """The groups of equal texts with two or more rows: digest, keep_id, group_size.

    Three passes, each over the rows that the one before left: byte length, hash of the first `prefix` code
    points, SHA-256 of the whole text; null counts as the empty text. Whole texts are hashed only where length and
    prefix recur. What recurs goes to the scan as a map of 64 * map_longs bits, at every size, so that no text is
    shuffled; a row that the map lets through by chance shares length, prefix and digest with no other and drops out.

    The row with the largest id stays; if all ids of a group are null, keep_id is null. Copies of one text are
    counted before the shuffle, so a group of any size is one row for each task. Columns other than the two named
    are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("n_bytes"))
    lengths = materialise(_repeated(rows, ["n_bytes"]), "lengths")
    rows = may_be_among(rows, lengths, ["n_bytes"], map_longs).withColumn("head", F.xxhash64(F.substring("text", 1, prefix)))
    heads = materialise(_repeated(rows, ["n_bytes", "head"]), "heads")
    left = may_be_among(rows, heads, ["n_bytes", "head"], map_longs)
    left = left.select("id", "n_bytes", "head", F.unhex(F.sha2("text", 256)).alias("digest"))
    same = left.groupBy("n_bytes", "head", "digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return same.where("group_size > 1").select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    A text that nothing equals is its own group. Rows that share id and text are told apart by nothing, so they
    carry the same values. A null id is kept only in a group without any other id. An empty table gives no rows.
    """
    groups = materialise(exact_groups(docs, id_col, text_col, prefix), "groups")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    # Narrow rows meet the groups; a hot group's rows are split by adaptive skew handling, as the join needs no order.
    return rows.join(groups.select("digest", "keep_id", "group_size"), "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
