"""Queries over what links, documents and cells say of themselves."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions import declarations as D
from collegium.functions import text as X
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

LINKS = """
links AS (SELECT p_partkey, (['1st to 2 semester scheme', 'I & II Semester Syllabus', '3-8 Syllabus', 'Stream Programs', 'First  year notes', '2021 scheme book', 'VIII semester', '4 – 6 sch'])[p_partkey % 8 + 1] AS text,
  'https://vtu.example/pdf/' || CASE WHEN p_size % 3 = 0 THEN '2022syll/' WHEN p_size % 3 = 1 THEN 'archive/' ELSE '2018_3to8/' END || p_partkey || '.pdf' AS url,
  (['Computer Science', 'Physics Cycle', 'BMATS101 Mathematics for CSE Stream-I', 'Civil Stream', NULL])[p_partkey % 5 + 1] AS label FROM part)"""


def links(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    folder = F.when(size % 3 == 0, "2022syll/").when(size % 3 == 1, "archive/").otherwise("2018_3to8/")
    return T.table(spark, sf_dir, "part").select(
        key,
        pick(["1st to 2 semester scheme", "I & II Semester Syllabus", "3-8 Syllabus", "Stream Programs", "First  year notes", "2021 scheme book", "VIII semester", "4 – 6 sch"], 8).alias("text"),
        F.concat(F.lit("https://vtu.example/pdf/"), folder, key.cast("string"), F.lit(".pdf")).alias("url"),
        pick(["Computer Science", "Physics Cycle", "BMATS101 Mathematics for CSE Stream-I", "Civil Stream", None], 5).alias("label"),
    )


@query("described_links", S.with_(LINKS, query=r"""
SELECT p_partkey, CASE p_partkey % 8 WHEN 3 THEN 'programme_index' WHEN 1 THEN 'syllabus' WHEN 2 THEN 'syllabus' WHEN 0 THEN 'scheme' WHEN 5 THEN 'scheme' WHEN 7 THEN 'scheme' ELSE 'unclassified' END AS kind,
  CASE WHEN p_partkey % 8 = 5 THEN '2021' WHEN p_size % 3 = 0 THEN '2022' WHEN p_size % 3 = 2 THEN '2018' END AS scheme_year,
  CAST(CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 1 WHEN 7 THEN 4 END AS INTEGER) AS semester_from, CAST(CASE p_partkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 4 THEN 2 WHEN 7 THEN 6 END AS INTEGER) AS semester_to,
  CASE WHEN p_partkey % 5 = 0 THEN 'Computer Science' END AS programme, CASE WHEN p_partkey % 5 IN (2, 3) THEN label END AS stream,
  CASE WHEN p_partkey % 5 = 4 THEN p_partkey % 8 IN (1, 3) ELSE p_partkey % 5 IN (1, 2, 3) END AS common
FROM links JOIN part USING (p_partkey)"""))
def described_links(spark, sf_dir):
    """Kind, year, semesters, programme and stream of each link of a listing, out of its words, row label and address."""
    text, url, label = F.col("text"), F.col("url"), F.col("label")
    low, high = D.semester_range(text)
    common = F.coalesce(label, text).rlike(D.COMMON)
    stream = F.when(label.rlike(r"(?i)\bstream\b"), label)
    return links(spark, sf_dir).select("p_partkey", D.document_kind(text, url).alias("kind"), D.scheme_year(text, url).alias("scheme_year"), low.alias("semester_from"), high.alias("semester_to"), D.programme_of(label).alias("programme"), stream.alias("stream"), common.alias("common"))


@query("label_columns", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 2 ELSE 1 END AS label_column FROM part")
def label_columns(spark, sf_dir):
    """Which column of a listing's table names its rows, read off its header."""
    headers = [["Sl. No", "Program Title", "Scheme"], ["Programs", "1st yr Syllabus", ""], ["S.No", "UG Scheme and Syllabus", " "], ["SL.No.", "", "Course Title"], ["Slno.", "Programme Name", "Syllabus"]]
    cells = F.element_at(F.array(*[F.array(*[F.lit(c) for c in h]) for h in headers]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "part").select("p_partkey", D.label_column(cells).alias("label_column"))


@query("table_links", """
SELECT url, min(page * 10 + place) AS first_seen, first(label ORDER BY page * 10 + place) AS label FROM (
  SELECT p_partkey AS page, place, 'https://vtu.example/' || ((p_partkey + place) % 700) || '.pdf' AS url, CASE WHEN place < 2 THEN p_name || ' ' || place END AS label FROM part, (VALUES (0), (1), (2)) x(place)) GROUP BY url""")
def table_links(spark, sf_dir):
    """Links of listings' tables with the label of their row, then links outside any row; the first of an address counts.

    The header row's label column governs the rows below it; a cell's own links are no part of its label.
    """
    key = F.col("p_partkey")
    link = lambda n: F.concat(F.lit('<a href="/'), ((key + n) % 700).cast("string"), F.lit('.pdf">file</a>'))
    row = lambda n: F.concat(F.lit(f"<tr><td>{n + 1}a</td><td>"), F.col("p_name"), F.lit(f" {n}<br/>"), F.lit("</td><td>"), link(n), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>Sl. No</th><th>Program Title</th><th>Scheme</th></tr>"), row(0), row(1), F.lit("</table>"), link(2))
    pages = T.table(spark, sf_dir, "part").select(key.alias("page"), html.alias("html"))
    rows = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))).alias("row", "tr"))
    rows = rows.withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    header = F.col("tr").rlike("(?i)<th")
    above = W.partitionBy("page").orderBy("row").rowsBetween(W.unboundedPreceding, 0)  # the rows of one page
    rows = rows.withColumn("column", F.last(F.when(header, D.label_column(F.transform("cells", X.strip_tags))), ignorenulls=True).over(above)).where(~header)
    cell = F.try_element_at("cells", F.col("column") + 1)
    label = F.nullif(F.left(X.strip_tags(F.regexp_replace(cell, r"(?is)<a\b[^>]*>.*?</a>", " ")), F.lit(160)), F.lit(""))
    hrefs = lambda html: F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]*href="([^"]+\.pdf)"'), F.lit(1)))
    inside = rows.select("page", F.col("row").alias("group"), label.alias("label"), hrefs(F.col("tr")).alias("place", "href"))
    outside = pages.select("page", F.lit(1 << 20).alias("group"), F.lit(None).cast("string").alias("label"), hrefs(F.col("html")).alias("place", "href"))
    url = F.concat(F.lit("https://vtu.example"), F.col("href"))
    found = inside.unionByName(outside).groupBy(url.alias("url")).agg(F.min(F.struct("page", "group", "place", "label")).alias("m"))
    within = F.when(F.col("m.group") == 1 << 20, 2).otherwise(F.col("m.group") - 1)
    return found.select("url", (F.col("m.page") * 10 + within).alias("first_seen"), "m.label")


PAPERS = """
papers AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '1BPLC1' || lpad((p_partkey % 100)::VARCHAR, 2, '0') ELSE 'BESC1' || lpad((p_partkey % 100)::VARCHAR, 2, '0') END AS code FROM part)"""


@query("source_declarations", S.with_(PAPERS, query="""
SELECT p_partkey, CASE WHEN code IS NULL THEN '' ELSE code || CASE WHEN p_partkey % 4 = 0 THEN ',BCS301' ELSE '' END END AS codes, p_partkey % 3 = 0 AS is_model_paper, CASE WHEN p_partkey % 5 = 0 THEN '2022-23' WHEN p_partkey % 5 = 1 THEN '2025' END AS effect_from,
  CASE p_partkey % 6 WHEN 0 THEN 'third' WHEN 1 THEN 'fifth' END AS semester, p_partkey % 2 = 0 AS is_degree_exam, CAST(CASE WHEN p_partkey % 8 > 0 THEN 50 + p_partkey % 51 END AS INTEGER) AS max_marks,
  p_partkey % 7 > 1 AS speaks_for_scheme, CASE WHEN p_partkey % 9 > 0 THEN 'BESC1' || lpad((p_partkey % 100)::VARCHAR, 2, '0') END AS claimed, p_partkey % 9 = 0 OR p_partkey % 7 > 1 AS agrees, p_partkey % 7 = 1 AS later
FROM papers"""))
def source_declarations(spark, sf_dir):
    """Codes, sitting, effect, semester and marks that a paper prints, whether it speaks for the scheme, and its file name."""
    key = F.col("p_partkey")
    two = F.lpad((key % 100).cast("string"), 2, "0")
    code = F.when(key % 7 == 1, F.concat(F.lit("1BPLC1"), two)).when(key % 7 > 1, F.concat(F.lit("BESC1"), two))
    said = lambda when, text: F.when(when, text).otherwise("")
    text = F.concat_ws(
        " ",
        F.lit("Course"),
        F.coalesce(code, F.lit("none")),
        F.when(code.isNotNull() & (key % 4 == 0), F.concat(F.lit("BCS301 and again "), code)),
        said(key % 3 == 0, "Model  Question Paper"),
        F.when(key % 5 == 0, "with effect from 2022-23").when(key % 5 == 1, "With Effect From 2025"),
        F.when(key % 6 == 0, "Third Semester").when(key % 6 == 1, "Fifth / Sixth semester"),
        said(key % 2 == 0, "Degree Examination"),
        F.when(key % 8 > 0, F.concat(F.lit("Max. Marks: "), (50 + key % 51).cast("string"))),
    )
    name = F.when(key % 9 > 0, F.concat(F.lit("paper BESC1"), two, F.lit(" scan.pdf"))).otherwise("scan.pdf")
    rows = T.table(spark, sf_dir, "part").select(key, text.alias("text"), name.alias("name")).withColumns({"found": D.codes_in(F.col("text")), "claimed": F.try_element_at(D.codes_in(F.col("name")), F.lit(1))})
    text, codes = F.col("text"), F.col("found")
    return rows.select(
        "p_partkey",
        F.array_join(codes, ",").alias("codes"),
        text.rlike(D.MODEL_PAPER).alias("is_model_paper"),
        D.first(text, D.EFFECT_FROM).alias("effect_from"),
        F.lower(D.first(text, D.SEMESTER_PHRASE)).alias("semester"),
        text.rlike(D.DEGREE_EXAM).alias("is_degree_exam"),
        D.first(text, D.MAX_MARKS).cast("int").alias("max_marks"),
        D.speaks_for_scheme(codes).alias("speaks_for_scheme"),
        "claimed",
        (F.col("claimed").isNull() | F.coalesce(F.array_contains(codes, F.col("claimed")), F.lit(False))).alias("agrees"),
        F.exists(codes, D.is_later_family).alias("later"),
    )


@query("programme_matches", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Computer Science & Business System' WHEN 1 THEN 'Business System' WHEN 4 THEN 'csx' WHEN 5 THEN c_mktsegment || ' Studies' END AS "match", CASE c_custkey % 6 WHEN 2 THEN 'empty' WHEN 3 THEN 'unknown_alias' END AS error FROM customer""")
def programme_matches(spark, sf_dir):
    """Programmes as somebody names them: aliases, parts of labels, nothing, and acronyms that nobody knows."""
    key = F.col("c_custkey")
    name = F.when(key % 6 == 0, " CsBs ").when(key % 6 == 1, "Business System").when(key % 6 == 2, "  ").when(key % 6 == 3, "ECE").when(key % 6 == 4, "csx").otherwise(F.concat("c_mktsegment", F.lit(" Studies")))
    match, error = D.programme_match(name)
    return T.table(spark, sf_dir, "customer").select("c_custkey", match.alias("match"), error.alias("error"))


@query("calendar_categories", """
SELECT p_partkey, (['EXAM_PERIOD', 'REGISTRATION', 'LAST_WORKING_DAY', 'SEMESTER_START', 'HOLIDAY', 'ACADEMIC_PERIOD', 'OTHER_ACADEMIC', 'EXAM_PERIOD', 'SEMESTER_START', 'OTHER_ACADEMIC'])[p_partkey % 10 + 1] AS category FROM part""")
def calendar_categories(spark, sf_dir):
    """What rows of a calendar are; overlapping phrases go to the first, so that an examination's start is no term's."""
    titles = ["Commencement of semester end examinations", "Registration and breaks", "Last  Working Day", "Commencement of II semester classes", "Dasara vacations", "Internal assessments", "Sports day", "Viva voce", "Classes: commencement", "testing"]
    title = F.element_at(F.array(*[F.lit(t) for t in titles]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return T.table(spark, sf_dir, "part").select("p_partkey", D.calendar_category(title).alias("category"))


@query("session_times", """
SELECT event_id, CASE WHEN h IS NOT NULL THEN lpad(CASE WHEN pm THEN 12 + h % 12 ELSE h % 12 END::VARCHAR, 2, '0') || ':30' END AS start, CASE WHEN h IS NOT NULL THEN lpad(CASE WHEN epm THEN 12 + e % 12 ELSE e % 12 END::VARCHAR, 2, '0') || ':00' END AS "end"
FROM (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN 1 + event_id % 12 END AS h, 1 + event_id % 11 AS e, event_id % 3 = 0 OR (event_id % 3 = 2 AND event_id % 2 = 0) AS pm, event_id % 2 = 0 AS epm FROM events)""")
def session_times(spark, sf_dir):
    """Sessions as a.m. and p.m. ranges; a start that says neither takes the end's."""
    n = F.col("event_id")
    start = F.concat((1 + n % 12).cast("string"), F.lit(".30"), F.when(n % 3 == 0, "pm").when(n % 3 == 1, "am").otherwise(""))
    text = F.when(n % 13 > 0, F.concat(start, F.lit(" to "), (1 + n % 11).cast("string"), F.lit(":00"), F.when(n % 2 == 0, "PM").otherwise("am"))).otherwise("forenoon")
    begins, ends = D.session_times(text)
    return T.table(spark, sf_dir, "events").select("event_id", begins.alias("start"), ends.alias("end"))


@query("slot_times", """
WITH t AS (SELECT event_id, event_id % 14 AS h, event_id % 60 AS m, (event_id // 7) % 14 AS e, event_id % 45 AS f FROM events),
c AS (SELECT *, CASE WHEN e < 8 THEN e + 12 ELSE e END AS e2, CASE WHEN h = 12 THEN 0 ELSE h END AS am, CASE WHEN h < 12 THEN h + 12 ELSE h END AS pm FROM t),
s AS (SELECT event_id, e2 * 60 + f AS ends, am * 60 + m AS a, pm * 60 + m AS p FROM c)
SELECT event_id, CASE WHEN x IS NOT NULL THEN lpad((x // 60)::VARCHAR, 2, '0') || ':' || lpad((x % 60)::VARCHAR, 2, '0') END AS start, CASE WHEN x IS NOT NULL THEN lpad((ends // 60)::VARCHAR, 2, '0') || ':' || lpad((ends % 60)::VARCHAR, 2, '0') END AS "end"
FROM (SELECT event_id, ends, CASE WHEN p < ends THEN p WHEN a < ends THEN a END AS x FROM s)""")
def slot_times(spark, sf_dir):
    """Class hours without a.m. or p.m.: the day of a college decides the end, and the start is the latest before it."""
    n = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(n % 14), F.lit(":"), two(n % 60), F.lit(" - "), two(F.floor(n / 7) % 14), F.lit("."), two(n % 45))
    begins, ends = D.slot_times(text)
    return T.table(spark, sf_dir, "events").select("event_id", begins.alias("start"), ends.alias("end"))


@query("weekdays_and_entries", """
SELECT o_orderkey, o_orderkey % 8 < 6 AS weekday, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Library' ELSE '' END WHEN o_orderkey % 5 > 1 THEN o_orderpriority ELSE 'C' || o_orderkey END AS name,
  CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 1 THEN 'C' || o_orderkey END AS detail, CASE WHEN o_orderkey % 3 > 0 THEN 'C' || o_orderkey END AS attendance_code FROM orders""")
def weekdays_and_entries(spark, sf_dir):
    """How slots are shown, and whether their day is one that classes are on."""
    key = F.col("o_orderkey")
    day = F.element_at(F.array(*[F.lit(d) for d in (*D.WEEKDAYS, "Sun", "")]), (key % 8 + 1).cast("int"))
    code = F.when(key % 3 > 0, F.concat(F.lit("C"), key.cast("string")))
    title = F.when(key % 5 == 0, "").when(key % 5 == 1, code).otherwise(F.col("o_orderpriority"))
    entry = D.timetable_entry(code, F.when(key % 2 == 0, "Library"), title)
    return T.table(spark, sf_dir, "orders").select("o_orderkey", D.is_weekday(day).alias("weekday"), entry.alias("e")).select("o_orderkey", "weekday", "e.name", "e.detail", "e.attendance_code")


@query("exam_relevance", """
SELECT o_orderkey, CASE WHEN scheme = 1 THEN 'not_applicable' WHEN semester = 2 THEN CASE WHEN code = 'B' THEN 'backlog' ELSE 'not_applicable' END WHEN code = 'A' THEN 'enrolled' WHEN code = 'B' THEN 'backlog' WHEN code IS NULL THEN 'unresolved' ELSE 'not_applicable' END AS relevance
FROM (SELECT o_orderkey, o_orderkey % 5 AS scheme, o_orderkey % 4 AS semester, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS code FROM orders)""")
def exam_relevance(spark, sf_dir):
    """Whether an examination is a student's: enrolled, owed, of their column but unresolved, or nobody's business."""
    key = F.col("o_orderkey")
    code = F.when(key % 7 == 1, "A").when(key % 7 == 2, "B").when(key % 7 > 2, "C")
    event = {"scheme": F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "2018").otherwise("2022"), "semester": F.when(key % 4 == 3, F.lit(None)).when(key % 4 == 2, 3).otherwise(5), "codes": F.array_compact(F.array(code))}
    audience = {"scheme": F.lit("2022"), "semester": F.lit(5), "enrolled": F.array(F.lit("A")), "owed": F.array(F.lit("B"))}
    return T.table(spark, sf_dir, "orders").select("o_orderkey", D.exam_relevance(event, audience).alias("relevance"))


@query("same_names", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS same FROM customer")
def same_names(spark, sf_dir):
    """Names equal but for case and outer space; an absent one equals nothing."""
    key, name = F.col("c_custkey"), F.col("c_mktsegment")
    other = F.when(key % 4 == 0, F.concat(F.lit("  "), F.lower(name))).when(key % 4 == 1, F.concat(name, F.lit("s"))).when(key % 4 == 3, name)
    return T.table(spark, sf_dir, "customer").select("c_custkey", X.same_name(name, other).alias("same"))


@query("other_titles", "SELECT p_name AS code, arg_min(p_type, p_partkey) AS shown, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (WHERE p_type <> f), '') AS others FROM (SELECT *, first_value(p_type) OVER (PARTITION BY p_name ORDER BY p_partkey) AS f FROM part) GROUP BY p_name")
def other_titles(spark, sf_dir):
    """Titles of a subject other than the shown one."""
    rows = T.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("code")).agg(F.min_by("p_type", "p_partkey").alias("shown"), F.collect_set("p_type").alias("t"))
    return rows.select("code", "shown", F.array_join(F.sort_array(F.filter("t", lambda x: x != F.col("shown"))), ",").alias("others"))
