"""Queries over class timetables, read from planted documents of three layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.functions import text as X
from collegium.operators import class_timetables as C
from collegium.plans import sql as S
from collegium.plans.printed import column, one_of, said
from collegium.registry import query
from collegium.sources import tables as T

NONE = "CAST(NULL AS STRING)"


def cell(text, x, y, width, layout=None):
    """A printed cell of one layout or of all: its text, and where it stands."""
    texts = [text if layout in (None, k) else NONE for k in range(3)]
    return one_of("doc", *texts), x, y, width


def days_from(day: int, text: str) -> str:
    """The text in documents that print so many days, else none."""
    return f"CASE WHEN {day} < CAST(floor(doc / 3) AS INT) % 3 + 2 THEN {text} END"


#: One row of hours, a day on one row, and a dictionary with initials.
LEVEL = [(said(h), 100 + 110 * s, 720, 90) for s, h in enumerate(["9.00 - 10.00", "10:00-11:00", "11.15 to 12.15", "1:30 – 2:30"])] + [
    c
    for d, name in enumerate(["Monday", "TUE", "Wed", "thurs"])
    for c in [(days_from(d, said(name)), 20, 690 - 30 * d, 50)] + [
        (days_from(d, f"CASE (doc + {d * 4 + s}) % 6 WHEN 0 THEN 'DBMS-T' WHEN 1 THEN 'os LH-30{s}' WHEN 2 THEN 'XYZ' WHEN 3 THEN 'DBMS LAB (B1+B2)' WHEN 4 THEN 'OS B2 / DBMS B1' ELSE 'Lunch{s}' END"), 110 + 110 * s, 690 - 30 * d + s, 60)
        for s in range(4)
    ]
] + [
    (said("BCS403 Database"), 20, 560, 90), (said("Management Systems DBMS Dr. Anita Rao 3+0+2"), 115, 560, 200), (said("BCS303 Operating Systems OS Prof. John Paul 2+0+2 2 +0+ 2"), 20, 530, 250),
    (said("BCS502 Computer Networks CN Ms. Rita Sen"), 20, 500, 250), (said("Principal's seal"), 20, 270, 80),
]
#: Hours over three rows, days between their subjects and rooms, a break set downwards, a laboratory over two hours, and a
#: dictionary without initials, with wrapped titles and staff without a name.
STACKED = [c for s, (a, b) in enumerate([("9:00", "9:55"), ("10:00", "10:55"), ("10:55", "11:15"), ("11:15", "12:10"), ("12:15", "1:10")]) for c in [(said(a), 100 + 110 * s, 730, 40), (said("to"), 105 + 110 * s, 720, 20), (said(b), 102 + 110 * s, 710, 40)]] + [
    c
    for d, name in enumerate(["Mon", "Tuesday", "Fri."])
    for c in [
        (said(name), 20, 680 - 40 * d, 40),
        ([said("CN-T"), said("TOC"), said("Value added")][d], 95, 690 - 40 * d, 50),
        ([said("LH-302"), NONE, said("Course")][d], 98, 670 - 40 * d, 44),
        ([said("---MRMM---"), "CASE WHEN doc % 2 = 0 THEN 'TC' ELSE 'MR' END", said("RMIPR LAB(E1, E2)")][d], 205, 690 - 40 * d, 60),
        ([said("CNL-B1/CSL-B2"), said("CSL"), NONE][d], 432, 690 - 40 * d, [180, 40, 1][d]),
        ([said("OJAS"), NONE, NONE][d], 430, 670 - 40 * d, 40),
        ([said("TEJOMAYI"), said("SEMINAR"), said("EW A-12")][d], 535, [670, 690, 690][d] - 40 * d, 60),
    ]
] + [(said(x), 325, 690 - 20 * i, 8) for i, x in enumerate("LUNCH")] + [
    c
    for i, (name, staff, hours) in enumerate([
        ("BCS501 Computer Networks(T/L)", "Prof. A Rao", "3+0+2 2+0+2"), ("BCS502 Theory of Computation", "New Faculty", "4+0+0"), ("BCS503 Computer Networks Lab", "Prof. A Rao", "0+0+2"),
        ("BCS504 Computer Science Lab", "Dr. C D", "0+0+2"), ("BCS505/BPE505 Value added Course", "New Faculty", "1+0+0"), ("BCS506 Marketing Research & Marketing", "Prof. A B", "3+0+0 3 +0+0"),
        ("Management", None, None), ("BCS507 Research Methodology and IPR", "Ms. E", "2+0+0"), ("BCS508 Total Organic Carbon", "New Faculty", None), ("BCS509 E-waste", None, None),
    ])
    for c in [(said(name), 20, 500 - 14 * i, 150), (said(staff) if staff else NONE, 220, 500 - 14 * i, 60), (said(hours) if hours else NONE, 320, 500 - 14 * i, 60)]
] + [(said("BATCH B1: 1 to 30"), 20, 300, 100)]
#: A list without hours.
PLAIN = [(said("Monday DBMS OS"), 20, 700, 100), (said("BCS403 Database"), 20, 600, 100)]
CELLS = [cell(*c, layout) for layout, cells in enumerate((LEVEL, STACKED, PLAIN)) for c in cells]

#: In the SQL, a column and a band follow from a cell's place in its layout; titles, names and classes from its text.
READ = f"""
docs AS (SELECT s_suppkey AS doc, s_suppkey % 3 AS layout FROM supplier),
printed AS (SELECT doc, layout, unnest([{', '.join(f"{{'text': {t}, 'x': {x}, 'y': {y}, 'width': {w}}}" for t, x, y, w in CELLS)}], recursive := true) FROM docs),
cells AS (SELECT * FROM printed WHERE text IS NOT NULL),
table_rows AS (SELECT doc, layout, y, string_agg(text, ' ' ORDER BY x) AS text, min(text) FILTER (WHERE x < 110 AND (layout = 1 OR x < 30)) AS name FROM cells WHERE (layout = 0 AND y BETWEEN 500 AND 560) OR (layout = 1 AND y BETWEEN 360 AND 500) OR (layout = 2 AND y = 600) GROUP BY doc, layout, y),
heads AS (SELECT *, regexp_extract(text, 'BCS\\d+') AS code FROM table_rows WHERE text LIKE 'BCS%'),
dictionary AS (
  SELECT h.doc, h.layout, h.code,
    CASE h.layout WHEN 0 THEN trim(regexp_extract(h.text, 'BCS\\d+ (.*?) [A-Z]{{2,4}} ', 1)) ELSE trim(regexp_replace(h.name, '(/?B[A-Z]+\\d+)+', '') || coalesce((SELECT ' ' || n.text FROM table_rows n WHERE n.doc = h.doc AND n.y = h.y - 14 AND n.text NOT LIKE 'BCS%'), '')) END AS title,
    CASE h.layout WHEN 0 THEN regexp_extract(h.text, ' ([A-Z]{{2,4}}) (Dr|Prof|Ms)', 1) END AS initials, nullif(trim(regexp_extract(h.text, '(Dr|Prof|Ms)[. ]+[A-Z][A-Za-z]*( [A-Z][a-z]*)?')), '') AS faculty,
    list_transform(regexp_extract_all(h.text, '\\d ?\\+ ?\\d ?\\+ ?\\d'), lambda w: replace(w, ' ', '')) AS hours
  FROM heads h),
title_words AS (SELECT doc, code, title, string_split_regex(t, '[^A-Za-z0-9&]+') AS w FROM dictionary, unnest([title, regexp_replace(title, '\\([^)]*\\)', ' ')]) AS u(t)),
shortened AS (
  SELECT DISTINCT doc, code, upper(array_to_string(list_transform(list_filter(w, lambda x: x <> '' AND (k OR lower(x) NOT IN ('of', 'and', '&'))), lambda x: CASE WHEN len(x) > 1 AND x = upper(x) THEN x ELSE x[1] END), '')) AS name FROM title_words, unnest([true, false]) AS u(k)
),
short_names AS (SELECT doc, name, min(code) AS code, count(*) AS n FROM shortened WHERE len(name) > 1 GROUP BY doc, name),
days AS (SELECT doc, layout, y AS band, (['Mon', 'Tue', 'Wed', 'Thu', 'Fri'])[list_position(['m', 't', 'w', 'th', 'f'], CASE WHEN lower(text) LIKE 'th%' THEN 'th' ELSE lower(text[1]) END)] AS day FROM cells WHERE x = 20 AND y > 570 AND layout < 2),
places AS (
  SELECT c.doc, c.layout, c.text, c.x, c.y, d.band, d.day, CAST(floor((c.x + c.width / 2 - CASE c.layout WHEN 0 THEN 90 ELSE 65 END) / 110) AS INTEGER) AS s, CAST(floor((c.x + c.width - CASE c.layout WHEN 0 THEN 90 ELSE 65 END) / 110) AS INTEGER) AS reach,
    CAST(floor((c.x - CASE c.layout WHEN 0 THEN 90 ELSE 65 END) / 110) AS INTEGER) AS b
  FROM cells c JOIN days d ON d.doc = c.doc AND c.y - d.band BETWEEN -11 AND 11 WHERE c.x > 20 AND len(c.text) > 1 AND (c.layout = 1 OR c.y <= 700) AND c.y > 560 AND c.y < 705),
owned AS (SELECT p.*, coalesce((SELECT min(q.b) FROM places q WHERE q.doc = p.doc AND q.band = p.band AND q.b <= p.s AND q.reach >= p.s), p.s) AS own FROM places p),
grouped AS (SELECT doc, layout, day, band, own AS s, max(greatest(s, reach)) AS last, trim(string_agg(text, ' ' ORDER BY y DESC, x), '-') AS text FROM owned GROUP BY ALL),
entries AS (
  SELECT *, 'plain' AS form, upper(regexp_extract(text, '^[A-Za-z]+')) AS wanted, CAST(NULL AS VARCHAR) AS batch, nullif(upper(regexp_extract(text, ' (LH-\\d+|A-\\d+)$', 1)), '') AS room FROM grouped WHERE text NOT LIKE '%/%' AND text NOT LIKE '%LAB%' AND text NOT LIKE 'Value%' AND text NOT LIKE 'Lunch%'
  UNION ALL SELECT *, 'label', text, NULL, NULL FROM grouped WHERE text LIKE 'Value%' OR text LIKE 'Lunch%'
  UNION ALL SELECT *, 'lab', split_part(text, ' ', 1), unnest(regexp_extract_all(text, '[BE]\\d')), NULL FROM grouped WHERE text LIKE '% LAB%'
  UNION ALL SELECT *, 'split', regexp_extract(text, '^[A-Z]+'), regexp_extract(text, 'B\\d'), CASE layout WHEN 1 THEN split_part(text, ' ', 2) END FROM grouped WHERE text LIKE '%/%'
  UNION ALL SELECT *, 'split', regexp_extract(text, '/ ?([A-Z]+)', 1), regexp_extract(text, '/.*(B\\d)', 1), CASE layout WHEN 1 THEN split_part(text, ' ', 3) END FROM grouped WHERE text LIKE '%/%'),
classes AS (
  SELECT e.*, coalesce(t.code, i.code, CASE WHEN n.n = 1 THEN n.code END) AS code, CASE WHEN t.code IS NOT NULL OR i.code IS NOT NULL THEN 'declared' WHEN n.n = 1 THEN 'initialism' WHEN n.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS resolution,
    CASE e.layout WHEN 0 THEN (['09:00', '10:00', '11:15', '13:30'])[s + 1] ELSE (['09:00', '10:00', '10:55', '11:15', '12:15'])[s + 1] END AS start, CASE e.layout WHEN 0 THEN (['10:00', '11:00', '12:15', '14:30'])[last + 1] ELSE (['09:55', '10:55', '11:15', '12:10', '13:10'])[last + 1] END AS "end"
  FROM entries e LEFT JOIN dictionary t ON t.doc = e.doc AND upper(t.title) = upper(e.wanted) LEFT JOIN dictionary i ON i.doc = e.doc AND i.initials = e.wanted LEFT JOIN short_names n ON n.doc = e.doc AND n.name = e.wanted),
seen AS (SELECT doc, count(DISTINCT day) AS days, count(code) * 2 >= count(*) AND count(DISTINCT day) >= 3 AS complete FROM classes GROUP BY doc)"""


def planted(spark, sf_dir):
    """A sheet for each document, as positioned cells."""
    docs = C.dealt(T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc")))
    place = lambda t, x, y, w: F.struct(column(t).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("width"))
    return docs.select("doc", F.inline(F.array(*[place(*c) for c in CELLS]))).where("text IS NOT NULL").select("doc", F.lit(1).alias("page"), "text", "x", "y", "width", F.lit(10.0).alias("height"))


@query("timetable_classes", S.with_(READ, query="""
SELECT c.doc, day, start, "end", CAST(last - s + 1 AS INTEGER) AS spans, CASE form WHEN 'label' THEN substring(wanted, 1, 20) ELSE wanted END AS initials, batch, room, c.code, d.title, d.faculty, resolution, CASE c.layout WHEN 0 THEN 4 ELSE 5 END AS slots, CAST(days AS INTEGER) AS days, complete
FROM classes c JOIN seen USING (doc) LEFT JOIN dictionary d ON d.doc = c.doc AND d.code = c.code"""))
def timetable_classes_query(spark, sf_dir):
    """Classes of timetables: split and laboratory cells with batches and rooms, cells over several hours, subjects by the
    dictionary's initials or by initials that exactly one title can be shortened to."""
    return C.timetable_classes(planted(spark, sf_dir))


@query("timetable_dictionaries", S.with_(READ, query="SELECT doc, code, title, initials, faculty, hours[1] AS college_hours, hours[2] AS scheme_hours FROM dictionary"))
def timetable_dictionaries(spark, sf_dir):
    """The tables of subjects at the foot of class timetables: names over several rows, staff, and both workloads."""
    return C.sheets(planted(spark, sf_dir)).dictionary.drop("entry")


@query("timetable_names", S.with_(READ, query="""
SELECT doc, wanted, CASE WHEN n = 1 THEN code END AS code, resolution FROM (
  SELECT doc, upper(title) AS wanted, code, 1 AS n, 'declared' AS resolution, 0 AS way FROM dictionary
  UNION ALL SELECT doc, initials, code, 1, 'declared', 1 FROM dictionary WHERE initials IS NOT NULL
  UNION ALL SELECT doc, name, code, n, CASE WHEN n = 1 THEN 'initialism' ELSE 'ambiguous' END, 2 FROM (
    SELECT doc, name, min(code) AS code, count(DISTINCT code) AS n FROM (SELECT doc, code, name FROM shortened UNION SELECT s.doc, s.code, s.name || d.initials FROM shortened s JOIN dictionary d ON d.doc = s.doc AND d.code = s.code WHERE d.initials IS NOT NULL) WHERE len(name) > 1 GROUP BY doc, name))
QUALIFY row_number() OVER (PARTITION BY doc, wanted ORDER BY way) = 1"""))
def timetable_names(spark, sf_dir):
    """The index of what cells may call each subject, and which of these names are ambiguous."""
    dictionary = C.sheets(planted(spark, sf_dir)).dictionary
    return C.names_of(dictionary).join(dictionary.select("doc", "entry", "code"), ["doc", "entry"], "left").select("doc", "wanted", "code", "resolution")


@query("timetable_warnings", S.with_(READ, query="""
SELECT doc, 'no_times' AS warning FROM docs WHERE layout = 2
UNION ALL SELECT DISTINCT doc, resolution FROM classes WHERE resolution IN ('unknown', 'ambiguous')
UNION ALL SELECT DISTINCT doc, 'clashes' FROM (SELECT doc FROM classes GROUP BY doc, day, start, batch HAVING count(*) > 1)
UNION ALL SELECT doc, 'partial' FROM seen WHERE NOT complete"""))
def timetable_warnings(spark, sf_dir):
    """What to know of a class timetable before it is used."""
    return C.grid_warnings(planted(spark, sf_dir))


@query("timetable_batches", S.with_(READ, query="SELECT doc, string_agg(DISTINCT batch, ',' ORDER BY batch) AS batches, count(*) FILTER (WHERE batch IS NULL) AS of_all FROM classes GROUP BY doc"))
def timetable_batches(spark, sf_dir):
    """Whether a batch must be chosen before a timetable is taken over, and how many classes are everybody's."""
    rows = C.timetable_classes(planted(spark, sf_dir)).groupBy("doc").agg(F.array_join(F.sort_array(F.collect_set("batch")), ",").alias("batches"), F.count_if(F.col("batch").isNull()).alias("of_all"))
    return rows.select("doc", F.nullif("batches", F.lit("")).alias("batches"), "of_all")
