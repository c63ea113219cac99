"""Queries over syllabi and class timetables' headers, read from planted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.functions import timetables as H
from collegium.operators import syllabi as Y
from collegium.plans import sql as S
from collegium.plans.printed import column, one_of, said, unnested
from collegium.registry import query
from collegium.sources import tables as T

CODE = "'BCS' || lpad(CAST((doc * 2 + k) % 1000 AS STRING), 3, '0')"
SEMESTER = "1 + doc % 8"
ROMAN = one_of("doc", *[said(r) for r in Y.ROMAN])
NUMBER = "CAST(k AS STRING)"
#: The lines of a course in five layouts: labels with values, a title before the semester, a title under its label, one
#: over it after a stamp, and a laboratory without modules.
LINES = [one_of("doc", *forms) for forms in [
    (f"'Course Title: Graph Theory ' || {NUMBER}", f"'Algebra of Sets Semester - ' || CAST({SEMESTER} AS STRING)", said("Course Title"), said("16-2-2023"), f"'Course Title : Lab ' || {NUMBER}"),
    (said("Choice based system"), said("Choice based system"), f"'Operating Systems ' || {NUMBER}", f"{ROMAN} || ' Semester'", said("page 1")),
    (f"'Course Code: ' || lower({CODE}) || ' CIE Marks 50'", said("Course Code"), f"'Course Code: ' || {CODE}", f"'Optics and Waves ' || {NUMBER}", f"'Course Code ' || {CODE} || ' SEE Marks 999'"),
    (f"{ROMAN} || ' Semester'", f"{CODE} || '/205'", f"'Semester ' || {ROMAN}", said("Course Title:"), f"{ROMAN} || ' Semester'"),
    (said("Teaching Hours/Week (L:T:P) 3:0 : 2 SEE Marks 50"), said("SEE Marks 50"), said("Course Code is repeated here"), f"'Course Code: ' || {CODE}", said("Teaching Hours 0:0:2")),
    (f"'Total Marks 100 Credits ' || CAST(nation % 12 AS STRING)", said("Total Marks 100 Credits 04"), said("CIE Marks none, CIE Marks 40"), said("Credits 3"), said("Credits 01 Exam Hours 100")),
    (said("Course objectives:"), said("Course objectives"), said("Course Objectives: CO"), said("Teaching-Learning Process"), said("Sl. NO Experiments")),
    (said("Know what a graph is and is not"), said("short"), said("Explain processes and threads"), said("no objective at all"), said("Total Marks 30")),
    (said("short"), said("Know sets, relations and functions"), said("Use locks without a deadlock"), said("Module-1 (8 Hours)"), said("Course outcome")),
    (said("Module-1: Paths (8 Hours)"), said("Module 1 No. of Hours: 9"), said("Course outcomes"), said("Laser and Optical Fibers:"), said("CO1 Build and test circuits")),
    (said("Walks: open and closed ones"), said("Sets, Relations, Functions: prose with commas"), said("1) CO 1 Explain what systems are"), said("LASER : Characteristic properties of a beam"), said("CO2 no")),
    (said("walks: again"), said("SETS, MAPS: set in capitals"), said("Module 1"), said("Fiber Losses, Applications: networks"), "CAST(NULL AS STRING)"),
    (said("Euler and Hamilton"), said("Vol. 2: has a stop"), said("10 Hrs on processes"), said("Optical fibers: kinds"), said("CO 3 Write a report of each")),
    (said("Module 2"), said("Module-0 none"), said("Paging:  of memory"), said("LASER: once more"), said("Web links: none")),
    (said("Note: no topic"), said("Ghost: a topic of none"), said("Text Books: none"), said("Module-2: Waves"), said("Marks: 30")),
    (said("Colouring:"), said("Reference Books"), said("Late: after the end"), said("A requisite that goes on for more than fifty characters: prose"), said("Unit: none")),
    (said("CO2 Explain what colours are"), said("Lost: after the end"), said("Module 2: Files 4 Hours"), said("Superposition:"), "CAST(NULL AS STRING)"),
]]

DOCS = f"""
courses AS (SELECT s_suppkey AS doc, k, s_nationkey AS nation FROM supplier, unnest([0, 1]) AS x(k)),
printed AS (SELECT doc, k, {unnested(LINES)} FROM courses),
lines AS (SELECT doc, k, line, text FROM printed WHERE text IS NOT NULL),
ends AS (SELECT doc, k, min(line) AS body FROM lines WHERE regexp_matches(text, '(?i)^(course\\s*objectives?|teaching[-\\s]*learning|sl\\.|course\\s*outcome|module)') GROUP BY doc, k),
header AS (SELECT l.*, lag(text) OVER w AS above, lead(text) OVER w AS below FROM lines l JOIN ends USING (doc, k) WHERE line < body WINDOW w AS (PARTITION BY doc, k ORDER BY line)),
fields AS (
  SELECT doc, k, upper(coalesce(min(CASE WHEN text ILIKE '%course code%BCS%' THEN regexp_extract(text, '(?i)BCS\\d+') END), min(CASE WHEN text = 'Course Code' THEN below[:6] END))) AS code,
    coalesce(min(CASE WHEN regexp_matches(text, '^Course Title ?: ?[A-Z]') THEN trim(split_part(text, ':', 2)) END), min(CASE WHEN regexp_matches(text, '^Course Title:?$') THEN CASE WHEN starts_with(below, 'Course') THEN above ELSE below END END), min(CASE WHEN text LIKE '% Semester - %' THEN split_part(text, ' Semester', 1) END)) AS title,
    min(CASE WHEN text ILIKE '%semester%' THEN coalesce(TRY_CAST(regexp_extract(text, '\\d') AS INTEGER), list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII'], trim(replace(text, 'Semester', '')))) END) AS semester,
    min(TRY_CAST(regexp_extract(text, 'Credits? (\\d+)', 1) AS INTEGER)) AS credits, min(TRY_CAST(regexp_extract(text, 'CIE Marks\\D*(\\d+)', 1) AS INTEGER)) AS cie_marks, min(TRY_CAST(regexp_extract(text, 'SEE Marks (\\d+)', 1) AS INTEGER)) AS see_marks,
    min(TRY_CAST(regexp_extract(text, 'Exam Hours (\\d+)', 1) AS INTEGER)) AS exam_hours, min(nullif(replace(regexp_extract(text, 'Teaching Hours.*(\\d:\\d ?: ?\\d)', 1), ' ', ''), '')) AS teaching_hours
  FROM header GROUP BY doc, k),
goals AS (
  SELECT doc, k, string_agg(text, '; ' ORDER BY line) FILTER (WHERE regexp_matches(text, '^(1\\) )?CO ?\\d .{{6}}')) AS outcomes,
    CAST(count(*) FILTER (WHERE line > (SELECT min(line) FROM lines o WHERE o.doc = l.doc AND o.k = l.k AND o.text ILIKE 'course objectives%') AND line < (SELECT min(line) FROM lines o WHERE o.doc = l.doc AND o.k = l.k AND regexp_matches(o.text, '^(Course outcome|Module)')) AND len(text) > 12) AS INTEGER) AS objectives
  FROM lines l GROUP BY doc, k),
moduled AS (
  SELECT doc, k, line, text, count(*) FILTER (WHERE text LIKE 'Module%') OVER w AS m, line - max(CASE WHEN text LIKE 'Module%' THEN line END) OVER w AS place FROM lines WINDOW w AS (PARTITION BY doc, k ORDER BY line)),
bodies AS (
  SELECT * FROM moduled x WHERE m > 0 AND NOT EXISTS (SELECT 1 FROM moduled e WHERE e.doc = x.doc AND e.k = x.k AND e.m = x.m AND e.line <= x.line AND regexp_matches(e.text, '^(Course outcome|Text Books|Reference Books|Web link)'))),
heads AS (
  SELECT doc, k, m, regexp_extract(text, '\\d') AS number, regexp_extract(regexp_replace(text, '^Module.\\d', ''), '(\\d+) Hours', 1) || regexp_extract(text, 'Hours: (\\d+)', 1) AS hours,
    trim(regexp_replace(regexp_replace(text, '^Module.\\d', ''), '\\(?(\\d+ Hours|No. of Hours: \\d+)\\)?', ''), ': ') AS title
  FROM bodies WHERE place = 0),
topics AS (
  SELECT *, title = '' AND place = 1 AND regexp_matches(text, '^[A-Za-z][^:]*:$') AS is_title, CASE WHEN regexp_matches(text, '^[A-Za-z][^:;!?.]{{2,46}}\\s*:') AND NOT regexp_matches(text, '(?i)^(note|web|text|marks|unit)') AND (NOT contains(split_part(text, ':', 1), ',') OR split_part(text, ':', 1) = upper(split_part(text, ':', 1))) THEN trim(split_part(text, ':', 1)) END AS topic
  FROM bodies JOIN heads USING (doc, k, m) WHERE place > 0),
once AS (SELECT *, row_number() OVER (PARTITION BY doc, k, m, lower(topic) ORDER BY line) AS turn FROM topics WHERE topic IS NOT NULL AND NOT is_title),
named AS (
  SELECT h.doc, h.k, h.m, h.number, CASE WHEN h.title <> '' THEN h.title ELSE (SELECT min(trim(text, ': ')) FROM topics t WHERE t.doc = h.doc AND t.k = h.k AND t.m = h.m AND is_title) END AS title,
    coalesce(nullif(h.hours, ''), (SELECT min(nullif(regexp_extract(text, '^(\\d+) Hrs', 1), '')) FROM topics t WHERE t.doc = h.doc AND t.k = h.k AND t.m = h.m AND place = 1)) AS hours,
    (SELECT string_agg(topic, ',' ORDER BY line) FROM once t WHERE t.doc = h.doc AND t.k = h.k AND t.m = h.m AND turn = 1) AS topics,
    coalesce((SELECT string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY line) FROM topics t WHERE t.doc = h.doc AND t.k = h.k AND t.m = h.m), '') AS content
  FROM heads h WHERE number <> '0')"""


def planted(spark, sf_dir) -> DataFrame:
    """Two courses for each document, each on a page of its own (the first modules of one layout on the page after it)."""
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_nationkey").alias("nation"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = rows.select("doc", "k", F.posexplode(F.array(*[column(x) for x in LINES])).alias("line", "text"))
    later = ((F.col("doc") % 5 == 3) & (F.col("line") >= 8)).cast("int")
    return rows.select("doc", (1 + 2 * F.col("k") + later).alias("page"), "line", "text")


def state(name: str, low: int, high: int) -> str:
    return f"CASE WHEN {name} IS NULL THEN 'unavailable' WHEN {name} BETWEEN {low} AND {high} THEN 'resolved' ELSE 'ambiguous' END AS {name}_state"


@query("syllabus_courses", S.with_(DOCS, query=f"""
SELECT doc, code, title, CAST(semester AS INTEGER) AS semester, credits, {state('credits', 0, 10)}, cie_marks, see_marks, {state('see_marks', 0, 200)}, {state('exam_hours', 1, 6)}, teaching_hours, objectives, coalesce(replace(replace(outcomes, '1) ', ''), 'CO ', 'CO'), '') AS outcomes FROM fields JOIN goals USING (doc, k)"""))
def syllabus_courses(spark, sf_dir):
    """Courses of syllabi in five layouts: fields with how sure they are, teaching hours, objectives and outcomes."""
    found = Y.syllabus_courses(planted(spark, sf_dir))
    return found.select("doc", "code", "title", "semester", "credits", "credits_state", "cie_marks", "see_marks", "see_marks_state", "exam_hours_state", "teaching_hours", F.size("objectives").alias("objectives"), F.array_join("outcomes", "; ").alias("outcomes"))


@query("syllabus_printed_modules", S.with_(DOCS, query="""
SELECT doc, code, CAST(number AS INTEGER) AS number, n.title, CAST(hours AS INTEGER) AS hours, content, coalesce(topics, '') AS topics FROM named n JOIN fields USING (doc, k)"""))
def syllabus_printed_modules(spark, sf_dir):
    """Modules of syllabi with titles (of their own or promoted from a heading that stands alone), hours, text and topics."""
    found = Y.syllabus_courses(planted(spark, sf_dir)).select("doc", "code", F.inline("modules"))
    return found.select("doc", "code", "number", "title", "hours", "content", F.array_join("topics", ",").alias("topics"))


@query("syllabus_blocks", S.with_(DOCS, query="SELECT doc, count(DISTINCT k) AS blocks FROM lines WHERE text ILIKE '%course code%' GROUP BY doc"))
def syllabus_blocks(spark, sf_dir):
    """Blocks of a document, one for each labelled code that does not follow another too closely."""
    return Y.syllabus_courses(planted(spark, sf_dir)).groupBy("doc").agg(F.count(F.lit(1)).alias("blocks"))


@query("timetable_headers", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'V (A)' WHEN 1 THEN 'III B' WHEN 2 THEN 'VII ( C )' END AS class_name, CAST(CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 6 END AS INTEGER) AS semester,
  CASE WHEN c_custkey % 3 = 0 THEN '2026-27' END AS academic_year, CASE WHEN c_custkey % 4 < 2 THEN 'R2' END AS revision, CASE WHEN c_custkey % 5 = 0 THEN '2026-02-05' WHEN c_custkey % 5 = 1 THEN '2026-11-15' END AS effective_from, CASE WHEN c_custkey % 2 = 0 THEN 'A204' END AS room FROM customer""")
def timetable_headers(spark, sf_dir):
    """Class, semester, year, revision, effect and room that a class timetable's header states."""
    key = F.col("c_custkey")
    line = F.when(key % 4 == 0, "Class: V (A) Time Table (r2)").when(key % 4 == 1, "CLASS - III B ROOM 7 \nTime-Table (R2) semester: 4").when(key % 4 == 2, "VII ( C ) - Timetable").otherwise("Weekly plan, Semester - VI")
    year = F.when(key % 3 == 0, "2026–2027").when(key % 3 == 1, "2026-2029").otherwise("2026")
    effect = F.when(key % 5 == 0, "w.e.f: 5-2-2026").when(key % 5 == 1, "with effect from 15/11/2026").when(key % 5 == 2, "W.E.F. 31/02/2026")
    text = F.concat_ws("\n", line, year, effect, F.when(key % 2 == 0, "Room No. A204"))
    return H.header(T.table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")))


TOTALS = """
totals AS (SELECT p_partkey // 8 AS doc, 1 + p_partkey % 8 AS page, p_partkey % 3 = 0 AS headed, p_size FROM part)"""


@query("printed_totals", S.with_(TOTALS, query="""
SELECT doc, page, semester, p_size AS credits FROM (SELECT *, max(CASE WHEN headed THEN page END) OVER (PARTITION BY doc ORDER BY page) AS since FROM totals) t, LATERAL (SELECT since AS semester) WHERE semester IS NOT NULL AND p_size BETWEEN 10 AND 30"""))
def printed_totals(spark, sf_dir):
    """Credits that schemes print in their TOTAL rows, under the semester that their page or one before it is headed with."""
    key = F.col("p_partkey")
    page = 1 + key % 8
    roman = F.element_at(F.array(*[F.lit(r) for r in Y.ROMAN]), page.cast("int"))
    run = lambda text, x, y: F.struct(text.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    cells = F.array(run(F.when(key % 3 == 0, F.concat(roman, F.lit(" SEMESTER"))).otherwise("Scheme"), 100, 700), run(F.lit("TOTAL"), 20, 300), run(F.lit("900"), 200, 300), run(F.col("p_size").cast("string"), 400, 300.3), run(F.lit("marks"), 450, 300), run(F.lit("25"), 30, 200))
    return H.printed_totals(T.table(spark, sf_dir, "part").select(F.floor(key / 8).alias("doc"), page.alias("page"), F.inline(cells)))


@query("numeric_columns", "SELECT p_partkey // 10 AS doc, max(CASE WHEN n >= 3 THEN x END) AS x FROM (SELECT p_partkey // 10 AS d, p_size % 4 * 50 AS x, count(*) AS n FROM part WHERE p_partkey % 4 > 0 GROUP BY ALL) c RIGHT JOIN part ON p_partkey // 10 = d GROUP BY doc")
def numeric_columns(spark, sf_dir):
    """The rightmost place where three or more whole numbers stand in a column."""
    key = F.col("p_partkey")
    cells = T.table(spark, sf_dir, "part").select(F.floor(key / 10).alias("doc"), F.when(key % 4 > 0, (key % 1000).cast("string")).otherwise("Total").alias("text"), (F.col("p_size") % 4 * 50 + 0.2).alias("x"))
    return H.rightmost_numeric_column(cells)


@query("row_spans", """
SELECT doc, y, y + CASE WHEN above IS NULL THEN (y - below) / 2 ELSE (above - y) / 2 END AS top, y - CASE WHEN below IS NULL THEN above - y ELSE y - below END / 2 AS bottom
FROM (SELECT p_partkey // 5 AS doc, (p_partkey % 5) * 30.0::DOUBLE + p_size % 7 AS y, lead(y) OVER w AS above, lag(y) OVER w AS below FROM part WINDOW w AS (PARTITION BY p_partkey // 5 ORDER BY (p_partkey % 5) * 30.0::DOUBLE + p_size % 7))""")
def row_spans(spark, sf_dir):
    """How far each code's row reaches: halfway to its neighbours above and below."""
    key = F.col("p_partkey")
    codes = T.table(spark, sf_dir, "part").select(F.floor(key / 5).alias("doc"), (key % 5 * 30.0 + F.col("p_size") % 7).alias("y"))
    return H.row_spans(codes)


@query("slots_of_a_batch", """
SELECT o_orderkey AS id, o_orderpriority AS day, CASE WHEN o_orderkey % 3 > 0 THEN 'C' || (o_orderkey % 20) END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'LIB' END AS activity, CASE WHEN o_orderkey % 7 = 0 THEN 'LAB1' ELSE 'A204' END AS room, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 20 < 15 THEN 'F' || (o_orderkey % 20) END AS faculty
FROM orders WHERE o_orderkey % 4 > 1 OR o_orderkey % 4 = 0""")
def slots_of_a_batch(spark, sf_dir):
    """The classes of one batch: those of all batches and its own, with faculty from the dictionary and the class's room."""
    key = F.col("o_orderkey")
    code = F.when(key % 3 > 0, F.concat(F.lit("C"), (key % 20).cast("string")))
    classes = T.table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderpriority").alias("day"), code.alias("code"), F.when(code.isNull(), "LIB").alias("initials"), F.when(key % 7 == 0, "LAB1").alias("room"), F.when(key % 4 == 0, "B1").when(key % 4 == 1, "B2").alias("batch"))
    number = (key % 20).cast("string")
    dictionary = T.table(spark, sf_dir, "orders").where(key % 20 < 15).select(F.concat(F.lit("C"), number).alias("code"), F.concat(F.lit("F"), number).alias("faculty")).distinct()
    return H.slots_for_batch(classes, dictionary, "b1", "A204")
