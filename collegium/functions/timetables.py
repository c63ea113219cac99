"""Headers of class timetables and the grids of printed tables, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions.declarations import first
from collegium.functions.text import academic_year

# The labels of a timetable's header, and the headings and totals of a scheme's page.
EFFECT = [r"(?i)w\.?\s*e\.?\s*f\.?\s*[:\s]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{4})", r"(?i)\bwith\s+effect(?:ive)?\s+from\s*[:\s]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{4})"]
CLASS = r"(?i)\bclass\s*[:\-–]\s*([^\n]{1,60})"
CLASS_END = r"(?is)(\bTIME\s*-?\s*TABLE\b|\bROOM\b|\bW\.?\s*E\.?\s*F\b|\bACADEMIC\s+YEAR\b).*"
HEADING = r"(?i)\b([IVX]{1,4}\s*\(\s*[A-Z]\s*\))\s*[-–—:]?\s*Time\s*-?\s*table\b"
REVISION = [r"(?i)time\s*-?\s*table\s*\(\s*(R\d)\s*\)", r"(?im)^.*\btime\s*-?\s*table\b.*?\(\s*(R\d)\s*\).*$"]
ROOM = r"(?i)\broom\s*(?:no\.?)?\s*[:\-–]?\s*([A-Z]?\d{2,4}[A-Z]?)\b"
SEMESTER = [r"(?i)\bsemester\s*[:\-–]?\s*([1-8])\b", r"(?i)\bsemester\s*[:\-–]?\s*([IVX]{1,4})\b"]
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII"]
PAGE_SEMESTER = r"(?i)^(I|II|III|IV|V|VI|VII|VIII)\s*SEMESTER\b"
WHOLE_NUMBER = r"^\d{1,3}$"
LEAST_CREDITS, MOST_CREDITS, COLUMN_CELLS, HEADING_LENGTH = 10, 30, 3, 24


def roman_number(text: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(text)), F.lit(0)).cast("int")


def effective_from(text: Column) -> Column:
    """The date that a timetable takes effect on, day first; null for a day that no month has."""
    parts = [F.coalesce(*[first(text, p, g) for p in EFFECT]) for g in (3, 2, 1)]
    printed = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(parts[0].isNotNull(), F.try_to_date(printed, "yyyy-MM-dd").cast("string"))


def class_name(text: Column) -> Column:
    """What stands behind the word class, up to the next label; without it, a section before the word timetable."""
    raw = first(text, CLASS)
    cut = F.nullif(F.trim(F.regexp_replace(raw, CLASS_END, "")), F.lit(""))
    return F.when(raw.isNotNull(), cut).otherwise(F.trim(F.regexp_replace(first(text, HEADING), r"\s+", " ")))


def header(rows: DataFrame) -> DataFrame:
    """rows with `text` replaced by class_name, semester (else that of the class's name), academic_year, revision,
    effective_from and room; what a header does not state is null."""
    text = F.col("text")
    rows = rows.withColumn("class_name", class_name(text))
    semester = F.coalesce(first(text, SEMESTER[0]).cast("int"), roman_number(first(text, SEMESTER[1])), roman_number(first(F.col("class_name"), r"(?i)^([IVX]{1,4})\b")))
    revision = F.upper(F.coalesce(*[first(text, p) for p in REVISION]))
    kept = [c for c in rows.columns if c not in ("text", "class_name")]
    return rows.select(*kept, "class_name", semester.alias("semester"), academic_year(text).alias("academic_year"), revision.alias("revision"), effective_from(text).alias("effective_from"), first(text, ROOM).alias("room"))


def slots_for_batch(classes: DataFrame, dictionary: DataFrame, batch: str | None, room: str | None) -> DataFrame:
    """The classes without a batch and those of one, with the dictionary's faculty, an activity where no course is named,
    and the class's own room where a slot names none."""
    own = F.col("batch").isNull() | (F.col("batch") == F.lit(batch.upper() if batch else None))
    rows = classes.where(F.coalesce(own, F.col("batch").isNull())).join(dictionary, "code", "left")
    return rows.select("id", "day", "code", F.when(F.col("code").isNull(), F.col("initials")).alias("activity"), F.coalesce("room", F.lit(room)).alias("room"), "faculty")


def page_semester(runs: DataFrame) -> DataFrame:
    """doc, page, semester that a page's first short heading names, highest on the page first."""
    named = roman_number(first(F.trim("text"), PAGE_SEMESTER))
    rows = runs.where((F.length(F.trim("text")) <= HEADING_LENGTH) & named.isNotNull())
    return rows.groupBy("doc", "page").agg(F.min_by(named, F.struct(-F.col("y"), F.col("x"))).alias("semester"))


def printed_totals(runs: DataFrame) -> DataFrame:
    """doc, page, semester, credits of rows that begin with TOTAL: their rightmost whole number, if it can be credits.

    A page without a heading is of the semester that the one before is of.
    """
    text = F.trim("text")
    named = roman_number(first(text, PAGE_SEMESTER))
    place = F.when((F.length(text) <= HEADING_LENGTH) & named.isNotNull(), F.struct(-F.col("y"), F.col("x"), named.alias("semester")))
    whole = text.rlike(WHOLE_NUMBER)
    rows = runs.dropna(subset=["doc", "page"]).groupBy("doc", "page", F.round("y").alias("row")).agg(
        F.min_by(text, F.when(text != "", F.col("x"))).alias("head"),
        F.max_by(F.when(whole, text.try_cast("int")), F.when(whole, F.col("x"))).alias("credits"),
        F.min(place).alias("heading"),
    )
    printed = F.col("head").rlike(r"(?i)^TOTAL\b") & F.col("credits").between(LEAST_CREDITS, MOST_CREDITS)
    pages = rows.groupBy("doc", "page").agg(F.min("heading")["semester"].alias("semester"), F.collect_list(F.when(printed, F.col("credits"))).alias("credits"))
    above = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, 0)  # the pages of one document
    pages = pages.withColumn("semester", F.last("semester", ignorenulls=True).over(above)).where("semester IS NOT NULL")
    return pages.select("doc", "page", "semester", F.explode("credits").alias("credits"))


def rightmost_numeric_column(runs: DataFrame) -> DataFrame:
    """doc, x: the rightmost place (rounded) that holds COLUMN_CELLS whole numbers or more, null without one."""
    counts = runs.groupBy("doc", F.floor(F.col("x") + 0.5).alias("at")).agg(F.count_if(F.trim("text").rlike(WHOLE_NUMBER)).alias("n"))
    return counts.groupBy("doc").agg(F.max(F.when(F.col("n") >= COLUMN_CELLS, F.col("at"))).alias("x"))


def row_spans(codes: DataFrame) -> DataFrame:
    """doc, y, top, bottom: a row ends halfway to the next code; without one above or below, the other gap stands for it."""
    w = W.partitionBy("doc").orderBy("y")  # the codes of one page or document
    above, below = F.lead("y").over(w), F.lag("y").over(w)
    rows = codes.select("doc", "y", above.alias("a"), below.alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    up = F.when(F.col("a").isNull(), F.col("y") - F.col("b")).otherwise(F.col("a") - F.col("y")) / 2
    down = F.when(F.col("b").isNull(), F.col("a") - F.col("y")).otherwise(F.col("y") - F.col("b"))
    return rows.select("doc", "y", (F.col("y") + up).alias("top"), (F.col("y") - down / 2).alias("bottom"))
