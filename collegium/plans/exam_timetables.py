"""Queries over examination timetables, read from planted documents of four layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.operators.exam_timetables import exam_events, exam_warnings
from collegium.plans import sql as S
from collegium.plans.printed import column, one_of, said
from collegium.registry import query
from collegium.sources import tables as T

CODE = "'BCS3' || lpad(CAST((doc * 10 + {r}) % 100 AS STRING), 2, '0')"


def cell(page, text, x, y, width):
    """A printed cell: its text by layout (or one for all), and where it stands."""
    return page, one_of("doc", *text) if isinstance(text, tuple) else text, x, y, width


NONE = "CAST(NULL AS STRING)"
#: Layouts: one sheet; two sheets, the second without headers; a sheet without a row of semesters; a blank sheet.
CELLS = [
    cell(1, (said("Draft Time Table, Dec.2025/Jan.2026"), said("Revised Time Table June / July 2026"), said("Provisional list"), said(" ")), 100, 740, 300),
    cell(1, (said("No. VTU/BGM/598"), NONE, said("No. VTU/1"), NONE), 420, 740, 90),
    cell(1, (said("2021 Scheme"), said("2018 Scheme"), NONE, NONE), 200, 760, 320),
    cell(1, (said("2022 Scheme"), said("Scheme of 2022"), said("2022 Scheme"), NONE), 200, 720, 100),
    cell(1, (NONE, said("Scheme of 2021"), NONE, NONE), 400, 722, 130),
    cell(1, (said("Date, Day"), said("Date"), said("Date"), NONE), 20, 700, 60),
    cell(1, (said("III - Semester"), said("Semester IV"), said("III - Semester"), NONE), 210, 700, 80),
    cell(1, (said("V-Semester"), said("VIII semester"), NONE, NONE), 410, 702, 80),
    cell(1, (said("2.00pm to 5.00pm"), said("9.30 - 12.30pm"), NONE, NONE), 205, 680, 90),
    cell(1, (said("9.30am to 12.30pm"), NONE, NONE, NONE), 405, 681, 90),
] + [
    c for r in range(4) for c in (
        cell(2 if r == 3 else 1, (said(f"{10 + r}-01-2026"), said(f"{7 * r}/0{r + 6}/2026"), said("10.01.2026"), NONE), 20, 650 - 25 * r, 55),
        cell(2 if r == 3 else 1, (said("Friday"), said("Wed"), NONE, NONE), 80, 648 - 25 * r, 40),
        cell(2 if r == 3 else 1, (CODE.format(r=r), [said("BCS401/ 21CS42"), said("Open"), said("--"), said("BCS404 only")][r], said("BCS301"), NONE), 210, 649 - 25 * r, 60),
        cell(2 if r == 3 else 1, ([said("B**501"), CODE.format(r=r) + " || ' / 21CIV57'", said("Open Elective"), said("--")][r], [said("21**81 / BCS801"), said("18CS81"), NONE, said("\u2014")][r], NONE, NONE), 412, 652 - 25 * r, 70),
    )
] + [cell(1, (NONE, said("Elective"), NONE, NONE), 272, 624, 40), cell(1, (said("as notified dt.01/01/2099"), said("31-13-2026"), NONE, NONE), 210, 500, 100), cell(1, (NONE, said("32-01-2026"), NONE, NONE), 20, 480, 50), cell(1, (NONE, said("BCS999"), NONE, NONE), 210, 480, 50)]

#: In the SQL, rows are groups of cells at most five units apart; which column a cell is in follows from its place.
READ = f"""
docs AS (SELECT s_suppkey AS doc FROM supplier),
printed AS (SELECT doc, unnest([{', '.join(f"{{'page': {p}, 'text': {t}, 'x': {x}, 'y': {y}, 'width': {w}}}" for p, t, x, y, w in CELLS)}], recursive := true) FROM docs),
cells AS (SELECT doc, page, text, x, y, x + width / 2 AS centre, 10000 * page - y AS down FROM printed WHERE trim(text) <> ''),
gaps AS (SELECT *, down - lag(down) OVER (PARTITION BY doc ORDER BY down, x) AS gap FROM cells),
rows AS (SELECT *, count(*) FILTER (WHERE gap > 5) OVER (PARTITION BY doc ORDER BY down, x) AS r FROM gaps),
sides AS (SELECT *, CASE WHEN centre BETWEEN 162 AND 338 THEN 3 WHEN centre BETWEEN 362 AND 538 THEN 5 WHEN centre < 162 THEN 0 END AS side FROM rows),
heads AS (SELECT doc, r AS header FROM rows WHERE text ILIKE '%semester%' GROUP BY doc, r HAVING count(*) >= 2),
semesters AS (SELECT doc, side, list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII'], trim(regexp_replace(text, '(?i)semester|-', '', 'g'))) AS semester FROM sides JOIN heads USING (doc) WHERE r = header AND text ILIKE '%semester%'),
schemes AS (SELECT doc, s AS side, regexp_extract(text, '20\\d\\d') AS scheme FROM printed, unnest([3, 5]) AS u(s) WHERE text LIKE '%Scheme%' AND y < 730 AND CASE s WHEN 3 THEN 250 ELSE 450 END BETWEEN x AND x + width),
sessions AS (SELECT doc, side, text AS session FROM sides WHERE regexp_matches(text, '\\d.\\d\\d ?(am|pm)')),
dates AS (SELECT doc, r, string_agg(text, ' ' ORDER BY x) AS text FROM sides WHERE side = 0 GROUP BY doc, r),
days AS (
  SELECT doc, r, regexp_extract(text, '[A-Z][a-z]+') AS weekday, regexp_extract(text, '(\\d+).(\\d+).(\\d{{4}})', ['d', 'm', 'y']) AS p FROM dates WHERE regexp_matches(text, '\\d+[-./]\\d+[-./]\\d{{4}}')),
found AS (
  SELECT doc, r, p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS exam_date, nullif(weekday, '') AS weekday, side, string_agg(text, ' ' ORDER BY x) AS printed
  FROM days JOIN sides USING (doc, r) WHERE CAST(p.m AS INTEGER) <= 12 AND CAST(p.d AS INTEGER) <= 31 AND side > 0 AND doc IN (SELECT doc FROM heads) GROUP BY ALL),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(printed, '\\*') THEN 'pattern' WHEN regexp_matches(printed, '^[A-Z0-9]+\\d[A-Z]*$') THEN 'code' WHEN regexp_matches(printed, '^[A-Z0-9]+\\d ?/ ?[A-Z0-9]+\\d$') THEN 'alternatives' ELSE 'other' END AS kind FROM found)"""


def planted(spark, sf_dir):
    """Sheets for each document, as positioned cells."""
    docs = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"))
    place = lambda p, t, x, y, w: F.struct(F.lit(p).alias("page"), column(t).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("width"))
    return docs.select("doc", F.inline(F.array(*[place(*c) for c in CELLS]))).where("text IS NOT NULL").withColumn("height", F.lit(10.0))


@query("exam_timetable_events", S.with_(READ, query="""
SELECT k.doc, CASE WHEN k.doc % 4 = 0 THEN 'Dec.2025/Jan.2026' ELSE 'June / July 2026' END AS cycle, lower(regexp_extract((SELECT min(text) FROM cells c WHERE c.doc = k.doc AND text LIKE '%Time Table%'), 'Draft|Revised')) AS publication,
  (SELECT min(replace(text, 'No. ', '')) FROM cells c WHERE c.doc = k.doc AND text LIKE 'No. %') AS notification, exam_date, weekday, scheme, CAST(semester AS INTEGER) AS semester, session,
  CASE WHEN session LIKE '2.00pm%' THEN '14:00' WHEN session LIKE '9.30am%' THEN '09:30' WHEN session LIKE '9.30 - %' THEN '21:30' END AS start, CASE WHEN session LIKE '2.00pm%' THEN '17:00' WHEN session LIKE '9.30%' THEN '12:30' END AS "end",
  printed, kind, CASE WHEN kind IN ('code', 'alternatives') THEN regexp_replace(printed, ' ?/ ?', ',') ELSE '' END AS codes
FROM kinds k JOIN semesters USING (doc, side) LEFT JOIN schemes USING (doc, side) LEFT JOIN sessions USING (doc, side) WHERE printed NOT IN ('--', '\u2014')"""))
def exam_timetable_events(spark, sf_dir):
    """Dated cells of examination timetables under the scheme, semester and session of their column."""
    return exam_events(planted(spark, sf_dir)).withColumn("codes", F.array_join("codes", ","))


@query("exam_timetable_warnings", S.with_(READ, query="""
SELECT doc, CASE WHEN cells IS NULL THEN 'nothing_read' WHEN header IS NULL THEN 'no_columns' WHEN events IS NULL THEN 'no_rows' WHEN patterns > 0 THEN 'patterns' END AS warning, coalesce(patterns, 0) AS n
FROM docs LEFT JOIN (SELECT doc, count(*) AS cells FROM cells GROUP BY doc) USING (doc) LEFT JOIN heads USING (doc) LEFT JOIN (SELECT doc, count(*) AS events, count(*) FILTER (WHERE kind = 'pattern') AS patterns FROM kinds GROUP BY doc) USING (doc)
WHERE warning IS NOT NULL"""))
def exam_timetable_warnings(spark, sf_dir):
    """What to know of an examination timetable before it is used: no text, no columns, no rows, or codes as patterns."""
    return exam_warnings(planted(spark, sf_dir))
