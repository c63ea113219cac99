"""Invariants as queries: rows that break one, counted with examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Examples that a report shows, and parts in which a check's violations are ranked.
EXAMPLES, SALTS = 5, 64
WHOLE = ("tinyint", "smallint", "int", "bigint")


def violations(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """check, what of the rows that break a check; all checks of a table in one scan of it.

    checks has a condition, which an unknown value does not meet, and what to show of the row, by name.
    """
    broken = [F.when(condition, F.struct(F.lit(name).alias("check"), what.cast("string").alias("what"))) for name, (condition, what) in checks.items()]
    # Filtered first, which Spark does before it joins: what is joined and sorted are the rows that break a check.
    some = reduce(Column.__or__, [condition for condition, _ in checks.values()])
    return df.where(some).select(F.inline(F.array_compact(F.array(*broken))))


def duplicates(df: DataFrame, check: str, keys: list[str]) -> DataFrame:
    """check, what of the keys that more than one row holds; nulls count as empty."""
    text = {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}
    # Whole numbers are one text each, and narrower to group by.
    named = [F.col(k) if kind in WHOLE else text[k].alias(k) for k, kind in df.select(*keys).dtypes]
    return df.groupBy(*named).count().where("count > 1").select(F.lit(check).alias("check"), F.concat_ws("|", *text.values()).alias("what"))


def report(checks: list[str], found: list[DataFrame], salts: int = SALTS) -> DataFrame:
    """One row per check: violations, passed, examples (the first five in order).

    Equal violations are counted before they are ranked. A check that every row breaks is ranked in parts first, of
    which each gives five, so that no task sees all of them.
    """
    spark = found[0].sparkSession
    rows = reduce(DataFrame.unionByName, found).groupBy("check", "what").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("what"), F.lit(salts)))
    # In one order, so that rows are sorted once for both.
    inside = W.partitionBy("check", "salt").orderBy("what")
    total = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.row_number().over(inside)
    parts = rows.withColumns({"part": total, "r": first}).where(F.col("r") <= EXAMPLES)
    # At most `salts` times EXAMPLES rows of a check are left.
    ranked = parts.withColumn("r_all", F.row_number().over(W.partitionBy("check").orderBy("what")))
    counted = ranked.groupBy("check").agg(
        F.sum(F.when(F.col("r") == 1, F.col("part"))).alias("violations"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("r_all") <= EXAMPLES, F.col("what")))), ", ").alias("examples"),
    )
    named = spark.createDataFrame([(c,) for c in checks], "check string")
    n = F.coalesce("violations", F.lit(0)).cast("bigint")
    return named.join(counted, "check", "left").select("check", n.alias("violations"), (n == 0).alias("passed"), F.coalesce("examples", F.lit("")).alias("examples"))


def reconcile(computed: DataFrame, printed: DataFrame, key: str) -> DataFrame:
    """key, computed, printed and a result: pass, fail, or skip where nothing is printed."""
    rows = computed.join(printed, key, "left")
    result = F.when(F.col("printed").isNull(), "skip").when(F.col("printed") == F.col("computed"), "pass").otherwise("fail")
    return rows.select(key, "computed", "printed", result.alias("result"))
