"""Queries over schemes of teaching, read from planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.operators.code_cells import joined_codes
from collegium.operators.schemes import scheme_rows
from collegium.plans import sql as S
from collegium.plans.printed import column, one_of, said
from collegium.registry import query
from collegium.sources import tables as T

PLANTED = """
docs AS (SELECT s_suppkey AS doc, 1 + s_suppkey % 4 AS credits, 'BCS' || lpad((s_suppkey % 90 + 301)::VARCHAR, 3, '0') AS code FROM supplier),
rows AS (
  SELECT doc, 1 AS page, code, 'Graph Theory and its uses' AS title, credits, 5 AS semester, NULL AS slot, NULL AS alternative_to, NULL AS reason FROM docs
  UNION ALL SELECT doc, 1, 'BCS501', 'Operating Systems', 4, 5, NULL, NULL, NULL FROM docs
  UNION ALL SELECT doc, 1, 'BIS501', 'Operating Systems', 4, 5, NULL, 'BCS501', NULL FROM docs
  UNION ALL SELECT doc, 1, 'BCS515x', 'Professional Elective', 3, 5, NULL, NULL, NULL FROM docs
  UNION ALL SELECT doc, 1, 'BYOG559', 'Yoga', 0, 5, NULL, 'BNSK558', NULL FROM docs
  UNION ALL SELECT doc, 1, 'BNSK558', 'Social Service', 0, 5, NULL, 'BYOG559', NULL FROM docs
  UNION ALL SELECT doc, 1, 'BCS777', 'Wide row', NULL, NULL, NULL, NULL, 'no_credits' FROM docs
  UNION ALL SELECT doc, 2, 'BCS515A', 'Compilers', 3, 5, 'BCS515x', NULL, NULL FROM docs
  UNION ALL SELECT doc, 2, 'BCS616B', 'Robotics', NULL, NULL, NULL, NULL, 'no_semester' FROM docs)"""


def planted(spark, sf_dir):
    """Two sheets for each document: a semester's table with alternatives, and a list of electives without one."""
    docs = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"))
    d = F.col("doc")
    cell = lambda text, x, y, page=1: F.struct(F.lit(page).alias("page"), (text if not isinstance(text, (str, int)) else F.lit(str(text))).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    numbers = lambda y, last, marks=100: [cell(n, 300 + 30 * i, y) for i, n in enumerate((3, 0, 0, 50, 50, marks))] + ([] if last is None else [cell(last, 480, y)])
    code = F.concat(F.lit("BCS"), F.lpad((d % 90 + 301).cast("string"), 3, "0"))
    cells = [cell("B.E. in Computer Science", 100, 780), cell("Scheme of Teaching and Examinations 2022", 100, 760), cell("V SEMESTER", 100, 740)]
    cells += [cell(code, 50, 700), cell("Graph Theory", 110, 700), cell("and its uses", 110, 688), cell("TD: CS", 250, 700), *numbers(700, (1 + d % 4).cast("string"))]
    cells += [cell("BCS501/BIS501", 50, 650), cell("Operating Systems", 110, 650), *numbers(650, 4)]
    cells += [cell("BCS515x", 50, 600), cell("Professional Elective", 110, 600), *numbers(600, 3)]
    cells += [cell("BYOG559", 50, 540), cell("Yoga", 110, 540), cell("OR", 80, 520), *numbers(520, 0), cell("BNSK558", 50, 500), cell("Social Service", 110, 500)]
    cells += [cell("BCS777", 50, 400), cell("Wide row", 110, 400), *numbers(400, None)]
    cells += [cell("BCS 515A", 50, 700, 2), cell("Compilers", 130, 700, 2), cell("BCS616B", 50, 600, 2), cell("Robotics", 130, 600, 2)]
    return docs.select("doc", F.inline(F.array(*cells))).withColumns({"width": F.lit(40.0), "height": F.lit(10.0)})


@query("scheme_courses", S.with_(PLANTED, query="SELECT doc, page, code, title, credits, semester, slot, alternative_to, reason, 'Computer Science' AS programme, '2022' AS scheme_year FROM rows"))
def scheme_courses(spark, sf_dir):
    """Courses of schemes with credits, alternatives and electives that inherit a slot's credits; others say why not."""
    return scheme_rows(planted(spark, sf_dir))


@query("scheme_refusals", S.with_(PLANTED, query="SELECT reason, count(*) AS codes FROM rows WHERE reason IS NOT NULL GROUP BY reason"))
def scheme_refusals(spark, sf_dir):
    """Codes of schemes that are no course, by the reason."""
    return scheme_rows(planted(spark, sf_dir)).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("codes"))


#: Cells of a page in layouts: codes in two to four pieces, with a gap, beside a whole code; compounds over two lines, with
#: the tail too far down, in another column, or wanted by two heads.
PIECES = [
    (one_of("doc", said("BCS"), said("B"), said("BCS4"), said("BCS401")), 50, 700, 20), (one_of("doc", said("401"), said("CS"), said("0"), said("A")), 70, 700.4, 20), (one_of("doc", "CAST(NULL AS STRING)", said("40"), said("1"), said("B")), 90.3, 700, 10),
    (one_of("doc", "CAST(NULL AS STRING)", said("1a"), said("X"), said("IS501")), one_of("doc", "0.0", "100.4", "101.0", "100.0"), 699.8, 30), (said("Graph Theory"), 150, 700, 80),
    (one_of("doc", said("BAE402/"), said("BAE402/B"), said("BAE402/"), said("BAE402/")), 50, 650, 40), (said("Aerodynamics"), 150, 644, 80), (one_of("doc", said("BAS402"), said("AS402"), said("402"), said("BAS402")), one_of("doc", "52.0", "50.0", "50.0", "75.0"), 637, 40),
    (said("BMA101/"), 300, 650, 40), (said("BMA102/"), 300, 648, 40), (said("BPH101"), 302, one_of("doc", "640.0", "633.0", "640.0", "620.0"), 40), (said(" "), 10, 10, 5),
]


def pieces(spark, sf_dir):
    docs = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"))
    at = lambda v: column(v if isinstance(v, str) else str(float(v))).cast("double")
    cells = [F.struct(column(t).alias("text"), at(x).alias("x"), at(y).alias("y"), at(w).alias("width")) for t, x, y, w in PIECES]
    return docs.select("doc", F.inline(F.array(*cells))).where("text IS NOT NULL").withColumns({"page": F.lit(1), "height": F.lit(10.0)})


@query("joined_codes", f"""
WITH cells AS (SELECT s_suppkey AS doc, s_suppkey % 4 AS form, unnest([{', '.join(f"{{'text': {t.replace('doc', 's_suppkey')}, 'x': CAST({str(x).replace('doc', 's_suppkey')} AS DOUBLE), 'y': CAST({str(y).replace('doc', 's_suppkey')} AS DOUBLE), 'width': CAST({w} AS DOUBLE)}}" for t, x, y, w in PIECES)}], recursive := true) FROM supplier),
line AS (SELECT *, x + width AS r, row_number() OVER (PARTITION BY doc ORDER BY x) AS k FROM cells WHERE text IS NOT NULL AND y BETWEEN 690 AND 710),
chain AS (
  SELECT a.doc, a.k AS first, b.k AS last, (SELECT string_agg(c.text, '' ORDER BY c.k) FROM line c WHERE c.doc = a.doc AND c.k BETWEEN a.k AND b.k) AS text, a.x, a.y, b.r - a.x AS width
  FROM line a JOIN line b ON b.doc = a.doc AND b.k BETWEEN a.k + 1 AND a.k + 3
  WHERE NOT EXISTS (SELECT 1 FROM line c JOIN line n ON n.doc = c.doc AND n.k = c.k + 1 WHERE c.doc = a.doc AND c.k >= a.k AND n.k <= b.k AND n.x - c.r > 0.5)
    AND NOT EXISTS (SELECT 1 FROM line c WHERE c.doc = a.doc AND c.k BETWEEN a.k AND b.k AND regexp_matches(c.text, '^B[A-Z]{{2,7}}\\d{{3}}[A-Za-z]?$'))),
codes AS (SELECT * FROM chain WHERE regexp_matches(text, '^B[A-Z]{{2,7}}\\d{{3}}[A-Za-z]?$')),
taken AS (SELECT * FROM codes QUALIFY row_number() OVER (PARTITION BY doc ORDER BY first, last DESC) = 1),
rest AS (SELECT c.* FROM cells c LEFT JOIN line l ON l.doc = c.doc AND l.x = c.x AND l.y = c.y LEFT JOIN taken t ON t.doc = c.doc AND l.k BETWEEN t.first AND t.last WHERE c.text IS NOT NULL AND t.doc IS NULL),
met AS (
  SELECT h.doc, h.text || b.text AS text, least(h.x, b.x) AS x, (h.y + b.y) / 2 AS y, greatest(h.width, b.width) AS width, h.text AS head, b.text AS tail, h.y AS hy, b.y AS ty
  FROM rest h JOIN rest b ON b.doc = h.doc AND h.text LIKE '%/%' AND b.y < h.y AND h.y - b.y <= 16 AND abs(h.x - b.x) <= 10 AND regexp_matches(h.text || b.text, '^(B[A-Z]{{2,7}}\\d{{3}}[A-Za-z]?/)+B[A-Z]{{2,7}}\\d{{3}}[A-Za-z]?$')
  QUALIFY row_number() OVER (PARTITION BY b.doc, b.text ORDER BY h.y - b.y) = 1)
SELECT doc, text, x, y, width FROM rest r WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.doc = r.doc AND (r.text = m.head AND r.y = m.hy OR r.text = m.tail AND r.y = m.ty))
UNION ALL SELECT doc, text, x, y, width FROM taken UNION ALL SELECT doc, text, x, y, width FROM met""")
def joined_codes_query(spark, sf_dir):
    """Runs of schemes with the pieces of codes joined: on one line without gaps, or over two lines behind a slash."""
    return joined_codes(pieces(spark, sf_dir)).select("doc", "text", "x", "y", "width")
