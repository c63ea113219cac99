"""Queries over whole documents that are read in: calendars, kinds of documents and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.functions import calendars as C
from collegium.functions import document_types as K
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

CALENDARS = """
entries AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS line, 1 + p_size % 28 AS d, 1 + p_size % 9 AS m, p_partkey // 10 % 2 = 0 AS dated FROM part),
events AS (
  SELECT doc, line, dated, make_date(2026, 9, d)::VARCHAR AS start, NULL AS "end", 'Commencement of II semester classes' AS title, 'SEMESTER_START' AS category, true AS readable FROM entries WHERE line = 1
  UNION ALL SELECT doc, line, dated, make_date(2026, m, 1)::VARCHAR, make_date(2026, m, 15)::VARCHAR, 'Dasara vacations', 'HOLIDAY', true FROM entries WHERE line = 2
  UNION ALL SELECT doc, line, dated, make_date(2026, 8, d)::VARCHAR, NULL, 'Last working day', 'LAST_WORKING_DAY', true FROM entries WHERE line = 4 AND dated
  UNION ALL SELECT doc, line, dated, make_date(2026, m, 15)::VARCHAR, NULL, '--', NULL, false FROM entries WHERE line = 6
  UNION ALL SELECT doc, line, dated, make_date(2026, 11, d)::VARCHAR, NULL, 'Registration closes', 'REGISTRATION', true FROM entries WHERE line = 7
  UNION ALL SELECT doc, line, dated, make_date(2026, 9, 1)::VARCHAR, make_date(2026, 9, 2 + d)::VARCHAR, '– Internal assessments', 'ACADEMIC_PERIOD', true FROM entries WHERE line = 9)"""


def calendars(spark, sf_dir):
    """Documents of ten printed lines; every other one states no year and no semester."""
    key, size = F.col("p_partkey"), F.col("p_size")
    doc, line = F.floor(key / 10), key % 10
    d, m = (1 + size % 28).cast("string"), F.lpad((1 + size % 9).cast("string"), 2, "0")
    header = F.when(doc % 2 == 0, "Academic Calendar 2026 – 27, V Semester of the year").otherwise("ACADEMIC CALENDAR")
    text = (
        F.when(line == 0, header)
        .when(line == 1, F.concat(d, F.lit(" Sept. 2026 Commencement of II semester classes")))
        .when(line == 2, F.concat(F.lit(" 1/"), m, F.lit("/2026 to 15-"), m, F.lit("-2026  Dasara vacations")))
        .when(line == 3, "Note: 01-01-2026 is no working day")
        .when(line == 4, F.concat(F.lpad(d, 2, "0"), F.lit(" Aug Last working day")))
        .when(line == 5, "31 Feb 2026 Impossible day")
        .when(line == 6, F.concat(F.lit("15."), m, F.lit(".2026 --")))
        .when(line == 7, F.concat(F.lit("Registration closes "), d, F.lit("-Nov-2026")))
        .when(line == 8, "Sports meet")
        .otherwise(F.concat((2 + size % 28 + 1).cast("string"), F.lit(" September 2026 – 1 Sep 2026 Internal assessments")))
    )
    return T.table(spark, sf_dir, "part").select(doc.alias("doc"), line.alias("line"), text.alias("text"))


@query("calendar_events", S.with_(CALENDARS, query='SELECT doc, line, start, "end", title, category FROM events WHERE readable'))
def calendar_events(spark, sf_dir):
    """Events of academic calendars: dates in words and numbers, spans in either order, years from the document."""
    return C.calendar_lines(C.calendar_documents(calendars(spark, sf_dir))).where("readable").select("doc", "line", "start", "end", "title", "category")


@query("calendar_documents", S.with_(CALENDARS, query="""
SELECT doc, CASE WHEN doc % 2 = 0 THEN '2026-27' END AS academic_year, CASE WHEN doc % 2 = 0 THEN 5 WHEN n.second THEN 2 END AS semester, coalesce(events, 0) AS n_events, coalesce(unreadable, 0) AS unreadable
FROM (SELECT doc, bool_or(line = 1) AS second FROM entries GROUP BY doc) n LEFT JOIN (SELECT doc, count(*) FILTER (WHERE readable) AS events, count(*) FILTER (WHERE NOT readable) AS unreadable FROM events GROUP BY doc) e USING (doc)"""))
def calendar_documents(spark, sf_dir):
    """What each calendar states of itself, with its events and the dated lines that could not be read."""
    docs = C.calendar_documents(calendars(spark, sf_dir))
    counts = C.calendar_lines(docs).groupBy("doc").agg(F.count_if("readable").alias("n_events"), F.count_if(~F.col("readable")).alias("unreadable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.drop("lines").join(counts, "doc", "left").select("doc", "academic_year", "semester", zero("n_events"), zero("unreadable"))


@query("calendar_warnings", S.with_(CALENDARS, query="""
SELECT doc, warning, CAST(CASE warning WHEN 'unreadable' THEN unreadable ELSE 1 END AS INTEGER) AS n
FROM (SELECT e.doc, count(*) FILTER (WHERE readable) AS n_events, count(*) FILTER (WHERE NOT readable) AS unreadable, bool_or(dated) AS dated, (SELECT bool_or(line = 1) FROM entries x WHERE x.doc = e.doc) AS second FROM events e GROUP BY e.doc), unnest(['no_semester', 'no_year', 'unreadable']) AS w(warning)
WHERE CASE warning WHEN 'no_semester' THEN n_events > 0 AND NOT dated AND NOT second WHEN 'no_year' THEN n_events > 0 AND NOT dated ELSE unreadable > 0 END"""))
def calendar_warnings(spark, sf_dir):
    """What to know of each calendar before it is used."""
    return C.calendar_warnings(C.calendar_documents(calendars(spark, sf_dir)))


@query("calendar_conflicts", S.with_(CALENDARS, """
saved AS (SELECT DISTINCT doc, CASE WHEN doc % 3 > 0 THEN doc % 8 END AS semester, CASE WHEN doc % 5 > 0 THEN '2026-27' END AS academic_year, doc * 7 % 100 AS imported FROM entries)""", query="""
SELECT t.semester, t.academic_year, e.doc, e.title, e.category, o.start AS before, e.start AS after
FROM (SELECT semester, academic_year, arg_min(doc, imported * 1000000 + doc) AS older, arg_max(doc, imported * 1000000 + doc) AS newer FROM saved GROUP BY semester, academic_year HAVING count(*) > 1) t
JOIN events e ON e.doc = t.newer JOIN (SELECT doc, category, arg_min(start, line) AS start FROM events GROUP BY doc, category) o ON o.doc = t.older AND o.category = e.category
WHERE o.start <> e.start AND e.category <> 'OTHER_ACADEMIC'"""))
def calendar_conflicts(spark, sf_dir):
    """Events of each term's last calendar that contradict its first one, by category."""
    docs = C.calendar_documents(calendars(spark, sf_dir))
    doc = F.col("doc")
    saved = docs.select("doc", F.when(doc % 3 > 0, doc % 8).alias("semester"), F.when(doc % 5 > 0, "2026-27").alias("academic_year"), (doc * 7 % 100).alias("imported"))
    return C.calendar_conflicts(saved, C.calendar_lines(docs).select("doc", "line", "title", "category", "start"))


#: Phrases that the planted documents are put together from.
PHRASES = ["University Seat Number", "Provisional Results", "Internal Marks", "Announced / Updated", "Academic  Calendar", "Calendar of Events", "commencement of the class", "last working day", "odd semester", "Monday then Tuesday", "w.e.f.", "10:00 am to 11.00", "lunch", "Scheme of Teaching", "Teaching hours / week", "Course Code", "outcome based education", "Draft Time Table", "Date, Day", "Registrar (Evaluation)", "Answer any five", "Max. Marks", "USN"]


def _sql_score(kind: str) -> str:
    parts = [f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in K.SIGNALS[kind]]
    total = " + ".join(parts)
    return f"CASE WHEN regexp_matches(text, '{K.SIGNALS[kind][0][0]}') THEN {total} ELSE 0 END AS {kind}" if kind == "course_scheme" else f"{total} AS {kind}"


@query("document_types", f"""
WITH d AS (SELECT p_partkey, array_to_string(list_filter([{', '.join(f"CASE WHEN (p_partkey // 3 + {i * i + 1}) * {i + 7} % 11 < 2 THEN '{p}' END" for i, p in enumerate(PHRASES))}], lambda x: x IS NOT NULL), chr(10)) AS text FROM part),
s AS (SELECT p_partkey, text, {', '.join(_sql_score(k) for k in K.SIGNALS)} FROM d),
r AS (SELECT *, list_reverse_sort([result, academic_calendar, college_timetable, course_scheme]) AS t FROM s)
SELECT p_partkey, CASE WHEN trim(text) = '' THEN 'unsupported' WHEN exam_timetable >= 6 THEN 'exam_timetable' WHEN question_paper >= 6 OR t[1] < 6 OR t[1] - t[2] < 2 THEN 'unsupported'
  WHEN result = t[1] THEN 'result' WHEN academic_calendar = t[1] THEN 'academic_calendar' WHEN college_timetable = t[1] THEN 'college_timetable' ELSE 'course_scheme' END AS type,
  CASE WHEN trim(text) = '' THEN 'empty' WHEN exam_timetable >= 6 THEN NULL WHEN question_paper >= 6 THEN 'question_paper' WHEN t[1] < 6 THEN 'too_little' WHEN t[1] - t[2] < 2 THEN 'too_close' END AS reason
FROM r""")
def document_types(spark, sf_dir):
    """The kind of each document by weighted signals, or why none is decided."""
    key = F.col("p_partkey")
    said = [F.when((F.floor(key / 3) + (i * i + 1)) * (i + 7) % 11 < 2, p) for i, p in enumerate(PHRASES)]
    rows = T.table(spark, sf_dir, "part").select(key, F.concat_ws("\n", *said).alias("text"))
    kind, reason = K.document_type(F.col("text"))
    return rows.select("p_partkey", kind.alias("type"), reason.alias("reason"))


@query("signal_scores", f"""
SELECT p_partkey, {', '.join(_sql_score(k) for k in K.SIGNALS)} FROM (SELECT p_partkey, array_to_string(list_filter([{', '.join(f"CASE WHEN (p_partkey // 3 + {i * i + 1}) * {i + 7} % 11 < 2 THEN '{p}' END" for i, p in enumerate(PHRASES))}], lambda x: x IS NOT NULL), chr(10)) AS text FROM part)""")
def signal_scores(spark, sf_dir):
    """The sum of weights of each kind's signals."""
    key = F.col("p_partkey")
    said = [F.when((F.floor(key / 3) + (i * i + 1)) * (i + 7) % 11 < 2, p) for i, p in enumerate(PHRASES)]
    rows = T.table(spark, sf_dir, "part").select(key, F.concat_ws("\n", *said).alias("text"))
    return rows.select("p_partkey", *[K.score(F.col("text"), k).alias(k) for k in K.SIGNALS])


@query("text_fingerprints", """
SELECT c_custkey, printf('%08x', h1) || printf('%08x', h2) AS fingerprint FROM (
  SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, codes), lambda h, c: xor(h, c) * 16777619 % 4294967296) AS h1, list_reduce(list_prepend(16777619::HUGEINT, codes), lambda h, c: (h + c) * 2246822507 % 4294967296) AS h2
  FROM (SELECT c_custkey, list_transform(string_split(lower(trim(regexp_replace(c_name || '  ' || c_mktsegment || ' é', '\\s+', ' ', 'g'))), ''), lambda x: unicode(x)::HUGEINT) AS codes FROM customer))""")
def text_fingerprints(spark, sf_dir):
    """A fingerprint that case and white space don't change."""
    return T.table(spark, sf_dir, "customer").select("c_custkey", C.fingerprint(F.concat("c_name", F.lit("  "), "c_mktsegment", F.lit(" é"))).alias("fingerprint"))
