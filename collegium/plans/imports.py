"""Queries over documents that are read in: terms, cells and how each relates to what is kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.functions import text as X
from collegium.operators import relations as R
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

INCOMING = """
incoming AS (
  SELECT p_partkey AS id, p_name AS fingerprint, CASE WHEN p_size % 9 > 0 THEN p_size % 9 END AS semester, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS year,
         CASE WHEN p_partkey % 13 > 0 THEN p_brand || ' ' || p_type END AS class_name, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 100 END AS effective,
         CASE WHEN p_partkey % 6 > 0 THEN upper(p_type) || (p_size % 10) END AS cycle, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'draft' WHEN 2 THEN 'provisional' ELSE 'final' END AS state
  FROM part WHERE p_partkey % 2 = 0
)"""
SAVED = """
saved AS (
  SELECT p_name AS fingerprint, CASE WHEN p_size % 9 > 0 THEN p_size % 9 END AS semester, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS year,
         CASE WHEN p_partkey % 13 > 0 THEN p_brand || ' ' || p_type END AS class_name, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 100 END AS effective,
         CASE WHEN p_partkey % 6 > 0 THEN p_type || (p_size % 10) END AS cycle, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'draft' WHEN 3 THEN 'provisional' ELSE 'final' END AS state, p_partkey AS position
  FROM part WHERE p_partkey % 16 = 5
)"""


def documents_in(spark, sf_dir):
    """(incoming, saved): part keys as documents, with their fingerprints, terms, classes and cycles."""
    key = F.col("p_partkey")
    rows = T.table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("fingerprint"),
        F.when(F.col("p_size") % 9 > 0, F.col("p_size") % 9).alias("semester"),
        F.when(key % 9 > 0, F.col("p_brand")).alias("year"),
        F.when(key % 13 > 0, F.concat_ws(" ", "p_brand", "p_type")).alias("class_name"),
        F.when(key % 5 > 0, key % 100).alias("effective"),
        F.when(key % 6 > 0, F.concat("p_type", (F.col("p_size") % 10).cast("string"))).alias("cycle"),
        key.alias("position"),
    )
    state = lambda draft, provisional: F.when(key % 4 == draft, "draft").when(key % 4 == provisional, "provisional").when(key % 4 > 0, "final")
    incoming = rows.withColumn("p_partkey", F.col("id")).where("id % 2 = 0").withColumns({"cycle": F.upper("cycle"), "state": state(1, 2)})
    return incoming.drop("p_partkey", "position"), rows.withColumn("p_partkey", F.col("id")).where("id % 16 = 5").withColumn("state", state(1, 3)).drop("p_partkey", "id")


@query("calendar_relations", S.with_(INCOMING, SAVED, query="""
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM saved s WHERE s.fingerprint = i.fingerprint) THEN 'duplicate'
  WHEN (semester IS NOT NULL OR year IS NOT NULL) AND EXISTS (SELECT 1 FROM saved s WHERE s.semester IS NOT DISTINCT FROM i.semester AND s.year IS NOT DISTINCT FROM i.year) THEN 'revision' ELSE 'new' END AS relation
FROM incoming i"""))
def calendar_relations(spark, sf_dir):
    return R.relate_calendars(*documents_in(spark, sf_dir))


@query("timetable_relations", S.with_(INCOMING, SAVED, query="""
SELECT id, relation, CASE WHEN relation = 'revision' THEN coalesce(effective >= active, true) END AS supersedes FROM (
  SELECT id, effective, (SELECT max(effective) FROM saved s WHERE s.class_name IS NOT DISTINCT FROM i.class_name) AS active,
    CASE WHEN EXISTS (SELECT 1 FROM saved s WHERE s.fingerprint = i.fingerprint) THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM saved s WHERE s.class_name IS NOT DISTINCT FROM i.class_name) THEN 'revision' ELSE 'new' END AS relation
  FROM incoming i)"""))
def timetable_relations(spark, sf_dir):
    return R.relate_timetables(*documents_in(spark, sf_dir))


@query("exam_timetable_relations", S.with_(INCOMING, SAVED, query="""
SELECT id, relation, CASE WHEN relation = 'revision' THEN CASE WHEN state IS NULL THEN 0 WHEN state IN ('draft', 'provisional') THEN 1 ELSE 2 END > held END AS supersedes FROM (
  SELECT i.id, i.state, l.held, CASE WHEN EXISTS (SELECT 1 FROM saved s WHERE s.fingerprint = i.fingerprint) THEN 'duplicate' WHEN l.cycle IS NOT NULL THEN 'revision' ELSE 'new' END AS relation
  FROM incoming i LEFT JOIN (
    SELECT lower(cycle) AS cycle, CASE WHEN state IS NULL THEN 0 WHEN state IN ('draft', 'provisional') THEN 1 ELSE 2 END AS held
    FROM saved WHERE cycle IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(cycle) ORDER BY position DESC) = 1) l ON l.cycle = lower(i.cycle))"""))
def exam_timetable_relations(spark, sf_dir):
    return R.relate_exam_timetables(*documents_in(spark, sf_dir))


@query("terms_in_titles", """
SELECT p_partkey, CASE WHEN (2021 + p_partkey % 5) + 1 = 2020 + p_size % 8 THEN (2021 + p_partkey % 5) || '-' || (20 + p_size % 8) END AS year,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 10 BETWEEN 1 AND 8 THEN p_size % 10 END WHEN p_partkey % 3 = 1 THEN [1, 2, 3, 4, 5, 6, 7, 8][1 + p_partkey % 8] END AS semester
FROM part""")
def terms_in_titles(spark, sf_dir):
    """Academic years of two that follow each other, and semesters in Arabic or Roman figures, out of titles."""
    key = F.col("p_partkey")
    roman = F.element_at(F.array(*[F.lit(r) for r in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII")]), (1 + key % 8).cast("int"))
    term = F.when(key % 3 == 0, F.concat(F.lit("sem: "), (F.col("p_size") % 10).cast("string"))).when(key % 3 == 1, F.concat(roman, F.lit(" Semester"))).otherwise("all terms")
    end = F.when(key % 2 == 0, F.lit("20")).otherwise("")
    title = F.concat(F.lit("Calendar "), (2021 + key % 5).cast("string"), F.lit(" - "), end, (20 + F.col("p_size") % 8).cast("string"), F.lit(", "), term)
    rows = T.table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", X.academic_year(F.col("title")).alias("year"), X.semester_of(F.col("title")).alias("semester"))


@query("exam_cells", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'alternatives' WHEN 2 THEN 'pattern' WHEN 3 THEN 'code' ELSE 'other' END AS kind FROM part")
def exam_cells(spark, sf_dir):
    """What cells of an examination's timetable are: a code, several, a pattern with wildcards, or other words."""
    key = F.col("p_partkey")
    number = F.lpad((key % 1000).cast("string"), 3, "0")
    cell = (
        F.when(key % 5 == 0, F.concat(F.lit(" BCS"), number))
        .when(key % 5 == 1, F.concat(F.lit("BBOK"), number, F.lit(" / BBOC"), number))
        .when(key % 5 == 2, F.concat(F.lit("B**"), number))
        .when(key % 5 == 3, F.concat(F.lit("21CIV"), number))
        .otherwise(F.concat(F.col("p_name"), F.lit(" / BCS"), number))
    )
    return T.table(spark, sf_dir, "part").select("p_partkey", X.exam_cell_kind(cell).alias("kind"))


@query("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25")
def keyset_page(spark, sf_dir):
    """The page after a key: the bound reaches the scan, and no earlier page is read."""
    rows = T.table(spark, sf_dir, "customer").where(F.col("c_custkey") > 40)
    return rows.orderBy("c_custkey").limit(25).select("c_custkey", "c_name")
