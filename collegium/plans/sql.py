"""Common table expressions of the oracle's SQL, written apart from the DataFrame projections."""

ATTEMPTS = """
attempts AS (
  SELECT o_custkey AS student, CAST(year(o_orderdate) - 1994 AS BIGINT) AS semester, l_partkey AS part,
         'P' || CAST(l_partkey AS VARCHAR) AS code,
         CAST(floor(l_quantity + 0.5) AS BIGINT) AS internal,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) * 5 AS external,
         CAST(floor(l_quantity + 0.5) AS BIGINT) + CAST(floor(l_discount * 100 + 0.5) AS BIGINT) * 5 AS total,
         CAST(1 + l_linenumber % 4 AS BIGINT) AS credits, CAST(l_linenumber AS BIGINT) AS line,
         CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax, l_returnflag AS flag, l_linestatus AS line_status, l_orderkey AS order_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

BANDS = """
bands(letter, points, low, high) AS (VALUES ('O', 10, 90, 100), ('A+', 9, 80, 89), ('A', 8, 70, 79), ('B+', 7, 60, 69), ('B', 6, 55, 59), ('C', 5, 50, 54), ('P', 4, 40, 49), ('F', 0, 0, 39))"""

GRADED = (
    ATTEMPTS
    + ","
    + BANDS
    + """,
graded AS (
  SELECT a.*, a.internal >= 20 AND a.external >= 17.5 AND a.total >= 40 AS passed,
         CASE WHEN a.internal >= 20 AND a.external >= 17.5 AND a.total >= 40 THEN b.letter ELSE 'F' END AS letter,
         CASE WHEN a.internal >= 20 AND a.external >= 17.5 AND a.total >= 40 THEN b.points ELSE 0 END AS points
  FROM attempts a JOIN bands b ON a.total BETWEEN b.low AND b.high
)"""
)

SEMESTERS = (
    GRADED
    + """,
semesters AS (
  SELECT student, semester, count(*) AS courses, CAST(sum(credits) AS BIGINT) AS credits,
         floor(CAST(sum(credits * points) AS DOUBLE) / CAST(sum(credits) AS DOUBLE) * 100 + 0.5 + 1e-9) / 100 AS sgpa,
         count(*) FILTER (WHERE NOT passed) AS backlogs, CAST(sum(total) AS BIGINT) AS marks
  FROM graded GROUP BY student, semester
)"""
)

ATTENDANCE = """
attendance AS (
  SELECT user_id AS student, event_type AS subject, count(*) FILTER (WHERE value >= 8) AS attended, count(*) AS conducted
  FROM events GROUP BY user_id, event_type
)"""

PROFILES = """
profiles AS (
  SELECT c_custkey AS student, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS branch, CAST(c_nationkey AS VARCHAR) AS college, 1 + c_custkey % 8 AS semester
  FROM customer
)"""

NOTICES = """
notices AS (
  SELECT p_partkey AS notice,
         CASE p_partkey % 12 WHEN 0 THEN 'Time Table for the examination' WHEN 1 THEN 'Results announced for ' || p_name
           WHEN 2 THEN 'Application for revaluation of ' || p_name WHEN 3 THEN 'Examination registration, last date'
           WHEN 4 THEN 'Academic calendar' WHEN 5 THEN 'Revised regulations' WHEN 6 THEN 'Scheme of teaching'
           WHEN 7 THEN 'Syllabus of ' || p_name WHEN 8 THEN 'Examination centre note' WHEN 9 THEN 'Circular on ' || p_type
           WHEN 10 THEN 'Revised Time Table postponed' ELSE p_name || ' ' || p_type END AS title,
         CASE WHEN p_partkey % 3 = 0 THEN (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_partkey % 5 + 1] END AS branch,
         CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size % 25 AS VARCHAR) END AS college,
         CASE WHEN p_partkey % 7 = 0 THEN 1 + p_partkey % 8 END AS semester,
         p_partkey % 97 = 0 AS unreadable_scope,
         DATE '2024-01-01' + CAST(p_partkey % 120 AS INTEGER) AS published,
         CASE WHEN p_partkey % 4 = 0 THEN DATE '2024-02-01' + CAST(p_partkey % 60 AS INTEGER) END AS deadline
  FROM part
)"""

SNAPSHOTS = """
v1 AS (
  SELECT doc_id AS item, source AS family, text AS body, 'https://notices.example/' || doc_id AS url, CAST(NULL AS BIGINT) AS supersedes
  FROM documents WHERE doc_id % 10 <> 0
),
v2 AS (
  SELECT doc_id AS item, source AS family, CASE WHEN doc_id % 20 = 3 THEN text || ' (revised)' ELSE text END AS body, 'https://notices.example/' || doc_id AS url,
         CASE WHEN doc_id % 40 = 0 THEN doc_id + 2 WHEN doc_id % 40 = 20 THEN doc_id + 10 END AS supersedes
  FROM documents WHERE doc_id % 10 <> 1
)"""


def with_(*parts: str, query: str) -> str:
    return f"WITH {','.join(p.strip() for p in parts)}\n{query}"
