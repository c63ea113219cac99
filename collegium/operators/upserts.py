"""Upserts of headers with children, states and dimensions: joins that give the next state with what was done.

Parquet has no MERGE, so each function returns all rows of the next state, or the decisions, to be written elsewhere.
Keys may be null; null equals null, as the unique indexes over replaced nulls have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_key(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys])


def upsert_headers(current: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], compared: list[str]) -> DataFrame:
    """keys, columns and action: inserted, updated or unchanged for what came in, kept for the rest.

    Only a difference in `compared` updates a row; then all columns take the incoming values.
    """
    rows = current.withColumn("_c", F.lit(True)).alias("c").join(incoming.withColumn("_i", F.lit(True)).alias("i"), same_key(keys), "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(f"c.{c}").eqNullSafe(F.col(f"i.{c}")) for c in compared])
    action = F.when(F.col("_i").isNull(), "kept").when(F.col("_c").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    taken = action.isin("inserted", "updated")
    return rows.select(*[F.coalesce(F.col(f"i.{k}"), F.col(f"c.{k}")).alias(k) for k in keys], *[F.when(taken, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in columns], action.alias("action"))


def replace_children(current: DataFrame, incoming: DataFrame, parents: DataFrame, parent: list[str], key: list[str], columns: list[str]) -> DataFrame:
    """The next children with their action; of a parent that came in (a row of `parents`) exactly the incoming ones stay.

    A child that its parent no longer has is deleted (action deleted, to be left out when written); children of
    other parents are kept. A parent that came in without children loses all of them.
    """
    touched = parents.select(*parent).distinct().withColumn("_touched", F.lit(True))
    both = current.withColumn("_c", F.lit(True)).alias("c").join(incoming.withColumn("_i", F.lit(True)).alias("i"), [*parent, *key], "full_outer")
    rows = both.select(*parent, *key, "_c", "_i", *[F.col(f"c.{c}").alias(f"_c_{c}") for c in columns], *[F.col(f"i.{c}").alias(f"_i_{c}") for c in columns]).join(touched, parent, "left")
    action = F.when(F.col("_i") & F.col("_c"), "updated").when(F.col("_i"), "inserted").when(F.col("_touched"), "deleted").otherwise("kept")
    return rows.select(*parent, *key, *[F.when(F.col("_i"), F.col(f"_i_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in columns], action.alias("action"))


def insert_once(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not there yet, one for each key; nulls in keys are equal."""
    fresh = incoming.dropDuplicates(keys).alias("i").join(current.alias("c"), same_key(keys), "left_anti")
    return fresh


def upsert_profiles(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, outcome, revision and columns after the write.

    A new profile is saved as revision 1. One whose base revision is not the current one is a conflict and shows what
    is held; a write without base revision wins. Every saved update raises the revision.
    """
    rows = incoming.alias("i").join(current.alias("c"), key, "left")
    held = F.col("c.revision").isNotNull()
    conflict = held & F.coalesce(F.col("i.base") != F.col("c.revision"), F.lit(False))
    outcome = F.when(conflict, "conflict").otherwise("saved")
    revision = F.when(~held, F.lit(1)).when(conflict, F.col("c.revision")).otherwise(F.col("c.revision") + 1)
    return rows.select(key, outcome.alias("outcome"), revision.cast("bigint").alias("revision"), *[F.when(conflict, F.col(f"c.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in columns])


def set_states(records: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Records with the last change of each key taken over; keys without a record get one.

    changes has key, state, version and at; records has key, state, version. The last change by `at` counts.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct("state", "version"), F.col("at")).alias("m")).select(key, F.col("m.state").alias("_state"), F.col("m.version").alias("_version"))
    rows = records.join(last, key, "full_outer")
    return rows.select(key, F.coalesce("_state", "state").alias("state"), F.coalesce("_version", "version").alias("version"))


def mark_all_read(notices: DataFrame) -> DataFrame:
    """notices with state: every unread one is read."""
    return notices.withColumn("state", F.when(F.col("state") == "unread", "read").otherwise(F.col("state")))
