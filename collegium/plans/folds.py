"""Queries whose results later batches and rounds add to, and small rules that rows state themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.functions import rules as R
from collegium.functions import text as X
from collegium.operators import folds as G
from collegium.plans import sql as S
from collegium.plans.grading import graded
from collegium.registry import query
from collegium.sources import tables as T
from collegium.sources.scratch import new_dir, stored

LETTERS = [b[0] for b in R.BANDS]


def parts_of(spark, sf_dir, keys, counts):
    """Partial counts of the graded rows, stored semester by semester in one pass, the third of them a second time."""
    rows, path = graded(spark, sf_dir).where(F.col("semester").between(1, 7)), new_dir(spark, "parts")
    rows = stored(rows.select("semester", *keys, *[hit.alias(name) for name, hit in counts.items()]), "marked")  # joined once
    counts = {name: F.col(name) for name in counts}
    G.store_batches(rows, path, "semester", keys, counts)
    G.store_partials(rows.where(F.col("semester") == 3), path, "3", keys, counts)
    return G.merged_partials(spark, path, keys, list(counts))


@query("merged_distributions", S.with_(S.GRADED, query=f"SELECT code, {', '.join(f"count(*) FILTER (WHERE letter = '{x}') AS n{i}" for i, x in enumerate(LETTERS))} FROM graded GROUP BY code"))
def merged_distributions(spark, sf_dir):
    """Grades of each course from stored partial counts of semesters: the same as one count over everything."""
    return parts_of(spark, sf_dir, ["code"], {f"n{i}": F.col("letter") == x for i, x in enumerate(LETTERS)})


OUTCOMES = {"passed": "passed", "failed": "NOT passed", "distinction": "points >= 9", "narrow": "passed AND total < 45", "no_internal": "internal < 20", "no_external": "external < 17.5", "sum_only": "NOT passed AND total >= 40", "full": "credits = 4", "first_line": "line = 1", "every": "true"}


@query("merged_outcomes", S.with_(S.GRADED, query=f"SELECT student, {', '.join(f'count(*) FILTER (WHERE {hit}) AS {name}' for name, hit in OUTCOMES.items())} FROM graded GROUP BY student"))
def merged_outcomes(spark, sf_dir):
    """Ten counters of each student, added up over stored parts."""
    return parts_of(spark, sf_dir, ["student"], {name: F.expr(hit) for name, hit in OUTCOMES.items()})


@query("histogram_cuts", """
WITH v AS (SELECT l_suppkey AS page, CAST(CASE l_suppkey % 4 WHEN 0 THEN 100 + l_quantity % 20 WHEN 1 THEN 7 ELSE floor(l_extendedprice) % 256 END AS INTEGER) AS level FROM lineitem),
s AS (SELECT page, level, row_number() OVER (PARTITION BY page ORDER BY level) AS r, count(*) OVER (PARTITION BY page) AS n FROM v),
c AS (SELECT page, min(level) FILTER (WHERE r = floor(n * 0.02) + 1) AS low, min(level) FILTER (WHERE r = n - floor(n * 0.02)) AS high FROM s GROUP BY page)
SELECT page, low, high, high - low >= 32 AS worth_it FROM c""")
def histogram_cuts(spark, sf_dir):
    """Where two hundredths of each page's levels end, from mergeable counts of levels: no value is sorted."""
    rows, page = T.table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    level = F.when(page % 4 == 0, 100 + F.col("l_quantity") % 20).when(page % 4 == 1, 7).otherwise(F.floor("l_extendedprice") % 256).cast("int")
    bins = rows.groupBy(page.alias("page"), level.alias("level"), F.col("l_linenumber")).agg(F.count(F.lit(1)).alias("n"))
    return G.histogram_cuts(bins.drop("l_linenumber"), ["page"])


PUSHES = """
known AS (SELECT o_custkey AS client, o_orderkey AS id, 1 AS revision, o_orderpriority AS fingerprint FROM orders WHERE o_orderkey % 3 > 0),
outcomes AS (
  SELECT o_custkey AS client, o_orderkey AS id, r AS round, CASE (o_orderkey + r) % 5 WHEN 0 THEN 'conflict' WHEN 1 THEN 'rejected' ELSE 'applied' END AS status, 2 + r AS revision, o_orderstatus || r AS fingerprint, (o_orderkey + r) % 7 = 0 AS gone, CASE (o_orderkey + r) % 5 WHEN 1 THEN 'no such field' END AS reason
  FROM orders, unnest([0, 1, 2]) AS x(r) WHERE o_orderkey % 4 <> r)"""


def pushes(spark, sf_dir):
    rows, key, r = T.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("round")
    known = rows.where(key % 3 > 0).select(F.col("o_custkey").alias("client"), key.alias("id"), F.lit(1).alias("revision"), F.col("o_orderpriority").alias("fingerprint"))
    said = rows.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(key % 4 != r)
    status = F.when((key + r) % 5 == 0, "conflict").when((key + r) % 5 == 1, "rejected").otherwise("applied")
    return known, said.select(F.col("o_custkey").alias("client"), key.alias("id"), "round", status.alias("status"), (2 + r).alias("revision"), F.concat("o_orderstatus", r.cast("string")).alias("fingerprint"), ((key + r) % 7 == 0).alias("gone"), F.when((key + r) % 5 == 1, "no such field").alias("reason"))


@query("pushed_books", S.with_(PUSHES, query="""
SELECT client, id, revision, fingerprint FROM (
  SELECT *, row_number() OVER (PARTITION BY client, id ORDER BY round DESC) AS turn FROM (SELECT client, id, -1 AS round, revision, fingerprint, false AS gone FROM known UNION ALL SELECT client, id, round, revision, fingerprint, gone FROM outcomes WHERE status = 'applied'))
WHERE turn = 1 AND NOT gone"""))
def pushed_books(spark, sf_dir):
    """What each client knows of its records after three rounds of pushes: applied ones count, the last one holds."""
    return G.after_pushes(*pushes(spark, sf_dir))


@query("push_conflicts", S.with_(PUSHES, query="""
SELECT o.client, o.id, round, coalesce(reason, 'This record changed somewhere else.') AS reason, k.fingerprint AS local, o.fingerprint AS server FROM outcomes o LEFT JOIN known k ON k.client = o.client AND k.id = o.id WHERE status <> 'applied'"""))
def push_conflicts(spark, sf_dir):
    """Outcomes that somebody must decide, with both versions."""
    known, outcomes = pushes(spark, sf_dir)
    return G.push_conflicts(outcomes, known)


PULLS = """
remote AS (SELECT o_custkey % 50 AS client, o_orderkey AS id, CAST(o_orderdate AS DATE) AS updated, 3 AS revision, o_orderstatus AS fingerprint, CASE WHEN o_orderkey % 9 = 0 THEN 'delete' WHEN o_orderkey % 11 = 0 THEN 'conflict' ELSE 'upsert' END AS step FROM orders),
rounds AS (SELECT *, (row_number() OVER (PARTITION BY client ORDER BY updated, id) - 1) // 25 AS round FROM remote)"""


def remote(spark, sf_dir):
    key = F.col("o_orderkey")
    step = F.when(key % 9 == 0, "delete").when(key % 11 == 0, "conflict").otherwise("upsert")
    return T.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("client"), key.alias("id"), F.to_date("o_orderdate").alias("updated"), F.lit(3).alias("revision"), F.col("o_orderstatus").alias("fingerprint"), step.alias("step"))


@query("pull_cursors", S.with_(PULLS, query="SELECT client, round, max(updated)::VARCHAR AS updated, arg_max(id, (updated, id)) AS id, count(*) AS records FROM rounds GROUP BY client, round"))
def pull_cursors(spark, sf_dir):
    """Pulls of 25 records and the cursors between them, which name the id beside the time, so that equal times are never skipped."""
    return G.cursors(G.pull_rounds(remote(spark, sf_dir), 25)).withColumn("updated", F.col("updated").cast("string"))


@query("pulled_books", S.with_(PULLS, query="""
SELECT client, id, revision, fingerprint FROM (SELECT client, id, CASE WHEN step = 'upsert' THEN 3 ELSE 1 END AS revision, CASE WHEN step = 'upsert' THEN fingerprint ELSE 'old' END AS fingerprint, step FROM rounds) WHERE step <> 'delete' AND (step = 'upsert' OR id % 2 = 0)"""))
def pulled_books(spark, sf_dir):
    """What each client knows after all rounds: taken records at their revision, deleted ones gone, conflicts as they were."""
    rounds = G.pull_rounds(remote(spark, sf_dir), 25)
    known = rounds.where("id % 2 = 0").select("client", "id", F.lit(1).alias("revision"), F.lit("old").alias("fingerprint"))
    return G.after_pulls(known, rounds)


@query("rounded_by_rule", """
SELECT o_orderkey, places, CASE WHEN isfinite(v) AND places BETWEEN 0 AND 15 THEN CASE WHEN v < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * floor(abs(v) * power(10.0::DOUBLE, places) + 0.5 + 1e-9) / power(10.0::DOUBLE, places) + 0.0 END AS rounded
FROM (SELECT o_orderkey, CASE WHEN n_nationkey % 6 < 5 THEN CAST(n_nationkey % 6 AS INTEGER) ELSE 16 END AS places, CASE o_orderkey % 10 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE (o_totalprice - 100000) / 7 END AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""")
def rounded_by_rule(spark, sf_dir):
    """Values rounded to the decimal places that the rule row of each nation states; not finite ones and odd rules give null."""
    places = F.when(F.col("n_nationkey") % 6 < 5, (F.col("n_nationkey") % 6).cast("int")).otherwise(16)
    rules = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), places.alias("places"))
    rows = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(rules), "c_nationkey")  # 25 rows
    key = F.col("o_orderkey")
    value = F.when(key % 10 == 0, float("nan")).when(key % 10 == 1, float("inf")).otherwise((F.col("o_totalprice") - 100000) / 7)
    return rows.select("o_orderkey", "places", R.half_up_by(value, F.col("places")).alias("rounded"))


@query("finite_values", "SELECT event_type, count(*) FILTER (WHERE isfinite(v)) AS finite, count(*) FILTER (WHERE v IS NOT NULL AND NOT isfinite(v)) AS not_finite, count(*) FILTER (WHERE v IS NULL) AS missing FROM (SELECT event_type, CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS v FROM events) GROUP BY event_type")
def finite_values(spark, sf_dir):
    """Finite values of each kind of event, apart from NaN and infinities, and from missing ones."""
    key = F.col("event_id") % 7
    v = F.when(key == 0, float("nan")).when(key == 1, float("-inf")).when(key != 2, F.col("value"))
    rows = T.table(spark, sf_dir, "events").select("event_type", v.alias("v"))
    finite = R.finite(F.col("v"))
    return rows.groupBy("event_type").agg(F.count_if(finite).alias("finite"), F.count_if(F.col("v").isNotNull() & ~finite).alias("not_finite"), F.count_if(F.col("v").isNull()).alias("missing"))


@query("percentages_by_formula", S.with_(S.SEMESTERS, query="""
SELECT student, formula, CASE WHEN cgpa IS NULL OR NOT isfinite(cgpa) THEN 'invalid_input' WHEN formula <> 'cgpa_x_10' THEN 'unsupported_formula' ELSE 'ok' END AS status, CASE WHEN isfinite(cgpa) AND formula = 'cgpa_x_10' THEN floor(cgpa * 10 * 100 + 0.5 + 1e-9) / 100 END AS percentage
FROM (SELECT student, CASE student % 4 WHEN 0 THEN 'cgpa_minus_075' ELSE 'cgpa_x_10' END AS formula, CASE student % 9 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE ELSE max(sgpa) END AS cgpa FROM semesters GROUP BY student)"""))
def percentages_by_formula(spark, sf_dir):
    """Percentages by formulas that a table lists; an id that it has not gives a row that says so."""
    from collegium.plans.grading import semesters

    student = F.col("student")
    cgpa = F.when(student % 9 == 0, F.lit(None)).when(student % 9 == 1, float("nan")).otherwise(F.max("sgpa"))
    rows = semesters(spark, sf_dir).groupBy("student").agg(cgpa.alias("cgpa")).withColumn("formula", F.when(student % 4 == 0, "cgpa_minus_075").otherwise("cgpa_x_10"))
    formulas = spark.createDataFrame(list(R.FORMULAS.items()), "id string, factor double")
    return R.percentages(rows, formulas).select("student", "formula", "status", "percentage")


@query("joined_reasons", """
SELECT o_orderkey, CASE len(r) WHEN 0 THEN 'no grade or credits' WHEN 1 THEN r[1] ELSE array_to_string(r[:len(r) - 1], ', ') || ' or ' || r[len(r)] END AS said
FROM (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'no grade' END, CASE WHEN o_orderkey % 3 = 0 THEN 'no credits' END, CASE WHEN o_orderkey % 5 = 0 THEN 'an unknown letter' END], lambda x: x IS NOT NULL) AS r FROM orders)""")
def joined_reasons(spark, sf_dir):
    """Reasons as a sentence has them: a, b or c."""
    key = F.col("o_orderkey")
    reasons = F.filter(F.array(F.when(key % 2 == 0, "no grade"), F.when(key % 3 == 0, "no credits"), F.when(key % 5 == 0, "an unknown letter")), lambda x: x.isNotNull())
    return T.table(spark, sf_dir, "orders").select("o_orderkey", X.join_reasons(reasons).alias("said"))


@query("cached_pages", "SELECT sha256(n_name) AS sha256, CASE WHEN n_nationkey % 5 = 0 THEN 2 END AS n_pages, CASE WHEN n_nationkey % 5 = 0 THEN n_name END AS first_text FROM nation")
def cached_pages(spark, sf_dir):
    """The extracted text of documents by digest: none for another version, broken files, scans, or what is not cached."""
    path, n = new_dir(spark, "cache"), F.col("n_nationkey")
    text = F.when(n % 5 == 1, "{broken").otherwise(F.to_json(F.struct(F.when(n % 5 == 2, "scan").otherwise("text").alias("status"), F.array(F.struct(F.lit(1).alias("page"), F.col("n_name").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("").alias("text"))).alias("pages"))))
    rows = T.table(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("sha256"), F.when(n % 5 == 3, "1").otherwise("2").alias("version"), text.alias("value"), n.alias("n"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in rows.where("n % 5 < 4").collect():  # a file for each of 25 nations, as an extractor leaves them
        target = fs.Path(f"{path}/{r.sha256}.{r.version}.json")
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(r.value.encode()))
        out.close()
    found = G.cached_pages(spark, path, rows.select("sha256"), "2")
    return found.select("sha256", F.when(F.col("pages").isNotNull(), F.size("pages")).alias("n_pages"), F.get("pages", F.lit(0))["text"].alias("first_text"))


RAW = """'{"id": "r' || o_orderkey || '", "subjectCode": ' || CASE o_orderkey % 3 WHEN 0 THEN '"  BCS' || o_orderkey % 1000 || ' "' WHEN 1 THEN '""' ELSE '7' END || ', "internal": ' || CASE o_orderkey % 4 WHEN 0 THEN '"38"' WHEN 1 THEN 'null' WHEN 2 THEN '21.5' ELSE '1e999' END || ', "hasSee": ' || CASE o_orderkey % 2 WHEN 0 THEN 'true' ELSE '"true"' END || ', "provenance": "' || CASE o_orderkey % 5 WHEN 0 THEN 'catalogue' WHEN 1 THEN 'guess' ELSE '' END || '", "gradeLetter": " "}'"""


@query("normalised_rows", """
SELECT o_orderkey, 'r' || o_orderkey AS id, code, coalesce(code, '') AS title, CASE WHEN o_orderkey % 4 = 2 THEN 21.5::DOUBLE END AS internal, CASE WHEN o_orderkey % 2 = 0 THEN true END AS has_see, CASE WHEN o_orderkey % 5 = 0 THEN 'catalogue' ELSE 'manual' END AS provenance, NULL::VARCHAR AS letter
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'BCS' || o_orderkey % 1000 END AS code FROM orders)""")
def normalised_rows(spark, sf_dir):
    """Untrusted result rows with every field there: absent stays absent, and an unknown provenance is manual."""
    found = T.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(RAW).alias("raw")).select("o_orderkey", X.normalised_result(F.col("raw")).alias("r"))
    return found.select("o_orderkey", "r.id", F.col("r.subjectCode").alias("code"), F.col("r.subjectTitle").alias("title"), "r.internal", F.col("r.hasSee").alias("has_see"), "r.provenance", F.col("r.gradeLetter").alias("letter"))
