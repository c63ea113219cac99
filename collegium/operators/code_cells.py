"""Course codes that a scheme prints in pieces: several runs on one line without gaps, or a compound over two lines.

Nothing is joined unless what it spells is a code; a gap between runs is a space, and so two cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.operators.documents import LEVEL, with_rows

# Codes as schemes print them, the first line of a wrapped compound, and the bounds of pieces.
COURSE_CODE = r"^B[A-Z]{2,7}\d{3}[A-Za-z]?$"
COMPOUND_CODES = r"^B[A-Z]{2,7}\d{3}[A-Za-z]?(?:/B[A-Z]{2,7}\d{3}[A-Za-z]?)+$"
WRAPPED_CODE_HEAD = r"^B[A-Z]{2,7}\d{3}[A-Za-z]?/[A-Z]{0,7}$"
MAX_CODE_PIECES, CODE_PIECE_GAP, WRAPPED_CODE_LINES = 4, 0.5, 1.6

PAGE = ["doc", "page"]
RUN = [*PAGE, "text", "x", "y", "width", "height"]


def pieces_on_a_line(rows: DataFrame) -> DataFrame:
    """Of rows of runs with `at`, their place in the row from the left: doc, page, row, first, count of the pieces that
    spell a code.

    Runs that touch are an island; a run that is a code by itself is none of it. From the left, the longest spelling
    that begins at a run is taken, and goes on behind it.
    """
    line = W.partitionBy(*PAGE, "row").orderBy("at")
    said = F.trim("text")
    alone = said.rlike(COURSE_CODE)
    apart = (F.col("x") - F.lag(F.col("x") + F.col("width")).over(line) > CODE_PIECE_GAP) | alone | F.lag(alone).over(line)
    runs = rows.withColumn("island", F.count_if(F.coalesce(apart, F.lit(True))).over(line)).where(~alone)
    island = [*PAGE, "row", "island"]
    parts = runs.groupBy(*island).agg(F.sort_array(F.collect_list(F.struct("at", said.alias("said")))).alias("parts")).where(F.size("parts") > 1)
    text = lambda n, k: F.array_join(F.transform(F.slice("parts", n, k), lambda p: p["said"]), "")
    spelled = lambda n: F.filter(F.sequence(F.lit(2), F.lit(MAX_CODE_PIECES)), lambda k: (n + k - 1 <= F.size("parts")) & text(n, k).rlike(COURSE_CODE))
    found = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(n.alias("n"), F.array_max(spelled(n)).alias("count")))
    state = "struct<free:int,taken:array<struct<n:int,count:int>>>"
    none = F.struct(F.lit(1).alias("free"), F.array().alias("taken")).cast(state)

    def take(done: Column, x: Column) -> Column:
        fits = x["count"].isNotNull() & (x["n"] >= done["free"])
        return F.when(fits, F.struct((x["n"] + x["count"]).alias("free"), F.concat(done["taken"], F.array(x)).alias("taken"))).otherwise(done)

    taken = parts.select(*island, "parts", F.explode(F.aggregate(found, none, take, lambda s: s["taken"])).alias("t"))
    return taken.select(*PAGE, "row", F.get("parts", F.col("t.n") - 1)["at"].alias("first"), F.col("t.count").alias("count"))


def joined_codes(runs: DataFrame) -> DataFrame:
    """runs(doc, page, text, x, y, width, height) with the pieces of codes as one run each; all others as they are.

    A compound that breaks behind its slash is joined with the nearest run below in its column that completes it, on the
    baseline between both; a run that two heads could take goes to the nearer one. Blank runs stay.
    """
    blank = runs.where(F.trim("text") == "").select(*RUN)
    rows = with_rows(runs.where(F.trim("text") != "").select(*RUN), PAGE, LEVEL)
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy(*PAGE, "row").orderBy("x", F.desc("y"), "text")))
    line = [*PAGE, "row"]
    pieces = pieces_on_a_line(rows).withColumn("at", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    marked = rows.join(pieces.select(*line, "at", "first"), [*line, "at"], "left")
    inside = F.struct("at", F.trim("text").alias("said"))
    level = marked.where("first IS NOT NULL").groupBy(*line, "first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(inside)), lambda p: p["said"]), "").alias("text"),
        F.min("x").alias("x"), F.min_by("y", "at").alias("y"), (F.max_by(F.col("x") + F.col("width"), "at") - F.min("x")).alias("width"), F.min_by("height", "at").alias("height"),
    )
    single = marked.where("first IS NULL").withColumn("id", F.struct("row", "at"))
    said = F.trim("text")
    heads = single.where(said.rlike(WRAPPED_CODE_HEAD)).select(*PAGE, F.col("id").alias("head"), said.alias("start"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("width").alias("hw"), F.col("height").alias("hh"), "high")
    below = single.select(*PAGE, F.col("id").alias("tail"), said.alias("end"), "x", "y", "width")
    down = F.col("hy") - F.col("y")
    met = heads.join(below, PAGE).where((down > 0) & (down <= WRAPPED_CODE_LINES * F.col("high")) & (F.abs(F.col("x") - F.col("hx")) <= F.col("high")) & F.concat("start", "end").rlike(COMPOUND_CODES))
    nearest = lambda by: F.row_number().over(W.partitionBy(*PAGE, by).orderBy(down, "head", "tail"))
    met = met.withColumn("turn", nearest("head")).where("turn = 1").withColumn("turn", nearest("tail")).where("turn = 1")
    wrapped = met.select(*PAGE, F.concat("start", "end").alias("text"), F.least("x", "hx").alias("x"), ((F.col("hy") + F.col("y")) / 2).alias("y"), F.greatest("width", "hw").alias("width"), F.col("hh").alias("height"))
    used = met.select(*PAGE, F.explode(F.array("head", "tail")).alias("id"))
    rest = single.join(used, [*PAGE, "id"], "left_anti")
    return rest.select(*RUN).unionByName(level.select(*RUN)).unionByName(wrapped.select(*RUN)).unionByName(blank)
