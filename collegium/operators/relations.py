"""How documents that come in relate to those that are kept: duplicate, revision or new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _duplicates(incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """incoming with `_same`: whether a saved document has its fingerprint. Null fingerprints equal nothing."""
    known = saved.select(F.col("fingerprint").alias("_print"), F.lit(True).alias("_same")).distinct()
    rows = incoming.join(known, F.col("fingerprint") == F.col("_print"), "left").drop("_print")
    return rows.withColumn("_same", F.coalesce("_same", F.lit(False)))


def relation(same: Column, found: Column) -> Column:
    return F.when(same, "duplicate").when(found, "revision").otherwise("new")


def relate_calendars(incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """incoming(id, fingerprint, semester, year) with its relation; a revision is of the same term.

    A term is semester and year together, null being a value of each; a document that states neither revises none.
    Saved documents are one row for each fingerprint or term before the joins, so no group of copies multiplies.
    """
    terms = saved.select(F.col("semester").alias("_semester"), F.col("year").alias("_year"), F.lit(True).alias("_term")).distinct()
    stated = F.col("semester").isNotNull() | F.col("year").isNotNull()
    on = F.col("semester").eqNullSafe(F.col("_semester")) & F.col("year").eqNullSafe(F.col("_year"))
    rows = _duplicates(incoming, saved).join(terms, on, "left")
    return rows.select("id", relation(F.col("_same"), F.coalesce("_term", F.lit(False)) & stated).alias("relation"))


def relate_timetables(incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """incoming(id, fingerprint, class_name, effective) with relation and supersedes.

    The kept timetable in force is its class's latest by effective date. A revision supersedes it unless it takes
    effect earlier; where either states no date, it does. Null is a class of its own.
    """
    active = saved.groupBy(F.col("class_name").alias("_class")).agg(F.max("effective").alias("_active"), F.lit(True).alias("_held"))
    rows = _duplicates(incoming, saved).join(active, F.col("class_name").eqNullSafe(F.col("_class")), "left")
    kind = relation(F.col("_same"), F.coalesce("_held", F.lit(False)))
    supersedes = F.when(kind == "revision", F.coalesce(F.col("effective") >= F.col("_active"), F.lit(True)))
    return rows.select("id", kind.alias("relation"), supersedes.alias("supersedes"))


def publication_rank(state: Column) -> Column:
    """0 not stated, 1 draft or provisional, 2 anything else."""
    return F.when(state.isNull(), 0).when(state.isin("draft", "provisional"), 1).otherwise(2)


def relate_exam_timetables(incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """incoming(id, fingerprint, cycle, state) with relation and supersedes, by how far each is published.

    Of the saved ones of a cycle (in any case) the last by `position` counts. No cycle is no revision of any.
    """
    last = saved.where("cycle IS NOT NULL").groupBy(F.lower("cycle").alias("_cycle")).agg(F.max_by(publication_rank(F.col("state")), F.col("position")).alias("_rank"))
    rows = _duplicates(incoming, saved).join(last, F.lower("cycle") == F.col("_cycle"), "left")
    kind = relation(F.col("_same"), F.col("_cycle").isNotNull())
    supersedes = F.when(kind == "revision", publication_rank(F.col("state")) > F.col("_rank"))
    return rows.select("id", kind.alias("relation"), supersedes.alias("supersedes"))
