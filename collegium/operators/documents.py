"""Parsers of positioned text and of printed lines, as expressions on Columns.

A document or a page is a group while its runs are dealt to rows, so its size is bounded by what is printed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions.text import bound

#: Pages of a document lie so far below each other.
PAGE_DOWN = 10_000.0
#: The height of a group without any.
USUAL_HEIGHT = 10.0
# Shares of the median height within which runs are level, between which a space is printed, and by which
# a run may stand beside the column it continues.
LEVEL, SPACE, BESIDE = 0.5, 0.18, 0.5


def median_height(heights: Iterable[float]) -> float:
    """The upper middle of the positive heights, 10 if there is none."""
    known = sorted(h for h in heights if h > 0)
    return known[len(known) // 2] if known else USUAL_HEIGHT


def upper_median(values: Column) -> Column:
    """Aggregate: the upper middle of the values, null without any."""
    found = F.sort_array(F.collect_list(values))
    return F.get(found, F.floor(F.size(found) / 2).cast("int"))


def with_rows(runs: DataFrame, by: list[str], share: float, level: str = "y") -> DataFrame:
    """runs with `row` (from 0, from the top) and `high`, the median height: a run joins the row whose first run it is
    level with, within a share of the height.

    Rows begin at the levels that lie farther than that below the row before, found in one pass over a group's levels.
    """
    heights = F.coalesce(upper_median(F.when(F.col("height") > 0, F.col("height"))), F.lit(USUAL_HEIGHT))
    held = F.collect_list(F.struct(*[c for c in runs.columns if c not in by])).alias("held")
    groups = runs.dropna(subset=by).groupBy(*by).agg(heights.alias("high"), F.sort_array(F.collect_set(level), asc=False).alias("levels"), held)
    far = lambda tops, y: (F.size(tops) == 0) | (F.element_at(tops, -1) - y > share * F.col("high"))
    tops = F.aggregate("levels", F.array().cast("array<double>"), lambda tops, y: F.when(far(tops, y), F.concat(tops, F.array(y))).otherwise(tops))
    # A group's runs travel with it and are dealt out again: joined to it, a small table's groups would be broadcast.
    rows = groups.select(*by, "high", tops.alias("tops"), "held").select(*by, "high", "tops", F.inline("held"))
    own = F.size(F.filter("tops", lambda top: top >= F.col(level))) - 1
    return rows.select(*runs.columns, "high", own.alias("row"))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def joined(*order: str, text: str = "text", where: Column | None = None) -> Column:
    """Aggregate: the texts in an order of columns, with one space between words."""
    item = F.struct(*order, F.col(text).alias("_text"))
    items = F.sort_array(F.collect_list(item if where is None else F.when(where, item)))
    return spaced(F.array_join(F.transform(items, lambda x: x["_text"]), " "))


def lines_of_runs(runs: DataFrame) -> DataFrame:
    """runs(doc, page, text, x, y, width, height) as lines: doc, page, line, text, y, runs.

    A cell that is too long goes on in a row of its own below, with nothing in the first column: such rows belong to
    the line above (see continued()). Runs of a line follow each other by place, then downwards; a space divides those
    that stand apart or were printed in different rows. Blank runs are none.
    """
    rows = continued(with_rows(runs.where(F.trim("text") != ""), ["doc", "page"], LEVEL))
    across = F.struct("x", F.col("y").isNull().alias("lost"), (-F.col("y")).alias("down"), "text", "width", "y")
    line_high = F.coalesce(upper_median(F.when(F.col("height") > 0, F.col("height"))), F.lit(USUAL_HEIGHT)).alias("line_high")
    lines = rows.groupBy("doc", "page", "head").agg(F.sort_array(F.collect_list(across)).alias("cells"), line_high, F.max("high").alias("high"), F.max("y").alias("y"))

    def piece(cell: Column, i: Column) -> Column:
        before = F.get("cells", i - 1)
        apart = (cell["x"] - (before["x"] + before["width"]) > SPACE * F.col("line_high")) | (F.abs(cell["y"] - before["y"]) > LEVEL * F.col("high"))
        return F.concat(F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), cell["text"])

    number = F.row_number().over(W.partitionBy("doc", "page").orderBy("head")) - 1
    text = F.trim(F.array_join(F.transform("cells", piece), ""))
    return lines.select("doc", "page", number.alias("line"), text.alias("text"), "y", F.size("cells").alias("runs"))


def continued(rows: DataFrame) -> DataFrame:
    """rows with head: the row that each row of runs belongs to, itself unless it is the rest of a wrapped one.

    A row is the rest of the line above if its first run stands beside that line's first one, and all its runs stand
    in columns that the line already uses, give or take a share of its height. Rows of a page are taken in order, as
    each widens what the next may stand under.
    """
    cells = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "height")))
    held = F.collect_list(F.struct(*[c for c in rows.columns if c not in ("doc", "page", "row")]))
    lines = rows.groupBy("doc", "page", "row").agg(cells.alias("cells"), held.alias("held"))
    pages = lines.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("row", "cells", "held"))).alias("lines"))
    line = "struct<head:int,cells:array<struct<down:double,x:double,height:double>>,heads:array<int>>"

    def step(above: Column, row: Column) -> Column:
        heights = F.sort_array(F.transform(F.filter(above["cells"], lambda c: c["height"] > 0), lambda c: c["height"]))
        slack = BESIDE * F.coalesce(F.get(heights, F.floor(F.size(heights) / 2).cast("int")), F.lit(USUAL_HEIGHT))
        beside = F.abs(F.get(row["cells"], F.lit(0))["x"] - F.get(above["cells"], F.lit(0))["x"]) > slack
        held = F.forall(row["cells"], lambda c: F.exists(above["cells"], lambda o: F.abs(c["x"] - o["x"]) <= slack))
        rest = F.coalesce(beside & held, F.lit(False))
        head = F.when(rest, above["head"]).otherwise(row["row"])
        return F.struct(head.alias("head"), F.when(rest, F.concat(above["cells"], row["cells"])).otherwise(row["cells"]).alias("cells"), F.concat(above["heads"], F.array(head)).alias("heads"))

    none = F.struct(F.lit(None).cast("int").alias("head"), F.array().alias("cells"), F.array().alias("heads")).cast(line)
    printed = F.transform("lines", lambda x: F.struct(x["row"].alias("row"), x["cells"].alias("cells")))
    found = pages.select("doc", "page", "lines", F.aggregate(printed, none, step, lambda x: x["heads"]).alias("heads"))
    found = found.select("doc", "page", F.inline(F.arrays_zip(F.col("heads").alias("head"), F.transform("lines", lambda x: x["row"]).alias("row"), F.transform("lines", lambda x: x["held"]).alias("held"))))
    found = found.toDF("doc", "page", "head", "row", "held").select("doc", "page", "head", "row", F.inline("held"))
    return found.select(*rows.columns, "head")


def words_to_runs(words: DataFrame) -> DataFrame:
    """Recognised words with boxes from the top as runs from the bottom of a page of page_height."""
    return words.where(F.trim("text") != "").select("doc", "page", "text", F.col("x0").alias("x"), (F.col("page_height") - F.col("y1")).alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "confidence")


def page_quality(words: DataFrame) -> DataFrame:
    """Per page: words, mean confidence, and whether a review is worth it (20 words, a mean of 40)."""
    rows = words.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("words"), F.avg("confidence").alias("confidence"))
    return rows.withColumn("worth_reviewing", (F.col("words") >= 20) & (F.col("confidence") >= 40))


#: A course code, a status letter and a date as cards print them.
CODE, STATUS, DATE = r"^\s*([A-Z]{1,5}[A-Z0-9]*\d{3}[A-Z]?)\b", r"\b([PFAWXN]|NE)\b", r"(\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4})\s*$"


def consistent_triple(numbers: Column) -> Column:
    """The rightmost three neighbours (array of ints) of which the third is the sum of the others, else null."""


    def rightmost(numbers: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(numbers) - 2)), lambda i: F.try_element_at(numbers, i) + F.try_element_at(numbers, i + 1) == F.try_element_at(numbers, i + 2))
        return bound(F.array_max(places), lambda at: F.when(at.isNotNull(), F.slice(numbers, F.coalesce(at, F.lit(1)), F.lit(3))))

    return bound(numbers, rightmost)


def card_rows(lines: DataFrame) -> DataFrame:
    """Lines that begin with a course code as rows of a result card.

    Adds code, title, internal, external, total, result, announced, readable. A row whose numbers hold no triple
    that adds up stays, unreadable, with nulls.
    """
    plain = F.regexp_replace("text", r"[|_]+", " ")
    number = F.lit(r"(?<![\w.])(\d{1,3})(?![\w.])")

    def read(text: Column) -> Column:
        return F.struct(F.regexp_extract(text, CODE, 1).alias("code"), F.regexp_extract(text, DATE, 1).alias("date"), F.regexp_replace(F.regexp_replace(text, CODE, ""), DATE, "").alias("rest"))

    def fields(r: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(r["rest"], number, F.lit(1)), lambda x: x.cast("int"))
        return F.struct(
            r["code"].alias("code"),
            F.trim(F.regexp_extract(r["rest"], r"^(.*?)(?:\s\d{1,3}(?![\w.])|$)", 1)).alias("title"),
            consistent_triple(numbers).alias("marks"),
            F.regexp_extract(F.regexp_replace(r["rest"], r"^.*\d", ""), STATUS, 1).alias("result"),
            r["date"].alias("date"),
        )

    read_row = bound(bound(plain, read), lambda r: F.when(r["code"] != "", F.array(fields(r))).otherwise(F.array()))
    rows = lines.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(lines.columns)], F.inline(read_row))
    announced = F.coalesce(F.try_to_date(F.nullif("date", F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif("date", F.lit("")), "dd-MM-yyyy"))
    return rows.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(lines.columns)],
        "code",
        F.nullif("title", F.lit("")).alias("title"),
        *[F.col("marks")[i].alias(n) for i, n in enumerate(("internal", "external", "total"))],
        F.nullif("result", F.lit("")).alias("result"),
        announced.alias("announced"),
        F.col("marks").isNotNull().alias("readable"),
    )


def nearest_slot(cells: DataFrame, slots: DataFrame) -> DataFrame:
    """Each cell with the slot whose columns span its centre, else the nearest; ties go to the left one.

    cells has doc, cell, centre; slots has doc, slot, left, right. The slots of one document are a row of a grid.
    """
    gap = F.greatest(F.lit(0.0), F.col("left") - F.col("centre"), F.col("centre") - F.col("right"))
    met = cells.join(slots, "doc").groupBy("doc", "cell").agg(F.min(F.struct(gap.alias("gap"), "left", "slot")).alias("m"))
    return met.select("doc", "cell", "m.slot", (F.col("m.gap") == 0).alias("inside"))


def better_reading(readings: DataFrame) -> DataFrame:
    """The reading of each document with most rows, then fewest dropped, then most words; the earlier on ties."""
    order = F.struct("rows", (-F.col("dropped")).alias("kept"), "words", (-F.col("reading")).alias("earlier"))
    return readings.groupBy("doc").agg(F.max_by("reading", order).alias("reading"))
