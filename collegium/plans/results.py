"""Queries over printed result rows: their kinds, sources, issues, and files of one semester side by side."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions import readings as N
from collegium.functions import rules as R
from collegium.functions.text import text_or_null
from collegium.plans import sql as S
from collegium.plans.lookups import as_json
from collegium.registry import query
from collegium.sources import tables as T

PRINTED = """
printed AS (
  SELECT order_key, line, student, semester, code, total, tax,
    CASE WHEN line = 2 THEN true WHEN line = 3 THEN false END AS has_see, CASE WHEN line = 4 AND part % 2 = 0 THEN part % 4 = 0 END AS reference_see,
    CASE tax WHEN 1 THEN 'PP' WHEN 2 THEN ' au ' WHEN 3 THEN 'A+' END AS letter, CASE WHEN tax = 4 THEN NULL WHEN line = 6 THEN internal + 30 ELSE internal END AS internal, CASE WHEN line = 6 OR line = 7 THEN 0 WHEN tax = 5 THEN NULL ELSE external END AS external
  FROM attempts)"""


def printed(spark, sf_dir):
    """Rows as cards print them, with planted gaps."""
    line, tax, part = F.col("line"), F.col("tax"), F.col("part")
    return T.attempts(spark, sf_dir).select(
        "order_key", "line", "student", "semester", "code", "total", "tax",
        F.when(line == 2, True).when(line == 3, False).alias("has_see"),
        F.when((line == 4) & (part % 2 == 0), part % 4 == 0).alias("reference_see"),
        F.when(tax == 1, "PP").when(tax == 2, " au ").when(tax == 3, "A+").alias("letter"),
        F.when(tax == 4, F.lit(None)).when(line == 6, F.col("internal") + 30).otherwise(F.col("internal")).alias("internal"),
        F.when(line.isin(6, 7), 0).when(tax == 5, F.lit(None)).otherwise(F.col("external")).alias("external"),
    )


@query("course_kinds", S.with_(S.ATTEMPTS, PRINTED, query="""
SELECT kind, source, count(*) AS rows, count(*) FILTER (WHERE kind IN ('see_bearing', 'cie_only')) AS counting, count(*) FILTER (WHERE kind = 'see_bearing') AS with_see FROM (
  SELECT CASE WHEN coalesce(has_see, reference_see) THEN 'see_bearing' WHEN NOT coalesce(has_see, reference_see) THEN 'cie_only' WHEN letter = 'PP' THEN 'non_credit' WHEN letter = ' au ' THEN 'audit' WHEN external > 0 THEN 'see_bearing' WHEN internal > 50 AND coalesce(external, 0) = 0 THEN 'cie_only' END AS kind,
    CASE WHEN coalesce(has_see, reference_see) IS NOT NULL THEN 'catalogue' WHEN letter IN ('PP', ' au ') THEN 'grade' WHEN external > 0 OR (internal > 50 AND coalesce(external, 0) = 0) THEN 'marks' END AS source
  FROM printed) GROUP BY ALL"""))
def course_kinds(spark, sf_dir):
    """What kind of course each row is of and what tells it; rows that nothing tells stay unknown."""
    kind, source = N.course_kind(F.col("has_see"), F.col("reference_see"), F.col("letter"), F.col("internal"), F.col("external"))
    rows = printed(spark, sf_dir).select(kind.alias("kind"), source.alias("source"))
    return rows.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(N.counts_toward_average(F.col("kind"))).alias("counting"), F.count_if(N.has_see_of(F.col("kind"))).alias("with_see"))


@query("row_issues", S.with_(S.ATTEMPTS, query="""
SELECT issue, count(*) AS rows FROM (SELECT unnest(list_filter([
  CASE WHEN line = 1 AND tax = 0 THEN 'code:missing' END,
  CASE WHEN tax = 1 THEN 'internal:negative' WHEN internal > 45 AND tax = 2 THEN 'internal:too_large' END,
  CASE WHEN external > 0 AND tax = 3 THEN 'external:too_large' END,
  CASE WHEN tax = 5 THEN 'total:too_large' END,
  CASE WHEN tax = 1 OR (tax = 2 AND internal > 45) OR tax = 5 OR (tax = 3 AND external > 0) THEN 'total:does_not_add_up' END,
  CASE WHEN line = 6 AND credits = 3 THEN 'credits:out_of_range' END,
  CASE WHEN line = 2 AND tax = 7 THEN 'announced:format' END], lambda x: x IS NOT NULL)) AS issue FROM attempts) GROUP BY issue"""))
def row_issues(spark, sf_dir):
    """Every issue of every row, counted; a row may have several."""
    line, tax = F.col("line"), F.col("tax")
    internal = F.when(tax == 1, -F.col("internal")).when((tax == 2) & (F.col("internal") > 45), F.col("internal") + 60).otherwise(F.col("internal"))
    external = F.when((tax == 3) & (F.col("external") > 0), F.col("external") + 50).otherwise(F.col("external"))
    total = F.when(tax == 5, F.col("total") + 101).otherwise(F.col("total"))
    code = F.when((line == 1) & (tax == 0), " ").otherwise(F.col("code"))
    title = F.when(~((line == 1) & (tax == 0)), F.col("code"))
    credits = F.when((line == 6) & (F.col("credits") == 3), 31).otherwise(F.col("credits"))
    announced = F.when((line == 2) & (tax == 7), "7-1-2024").when(line == 3, "2024-01-07")
    issues = N.row_issues(code, title, internal, external, total, (tax == 2).cast("boolean"), credits, announced)
    return T.attempts(spark, sf_dir).select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query("stored_rows", S.with_(S.ATTEMPTS, query="""
SELECT order_key, line, code, CASE WHEN tax = 0 THEN code ELSE 'Course ' || tax END AS title, CAST(NULL AS VARCHAR) AS letter, CASE WHEN p_size % 3 > 0 THEN 1 + p_size % 4 END AS credits, CASE WHEN p_size % 3 > 0 THEN 'catalogue' ELSE 'manual' END AS provenance
FROM attempts JOIN part ON p_partkey = part"""))
def stored_rows(spark, sf_dir):
    """Read rows as they are stored: no grade is invented, credits come from the reference where it knows the course."""
    size = F.col("p_size")
    reference = T.table(spark, sf_dir, "part").where(size % 3 > 0).select(F.col("p_partkey").alias("part"), (1 + size % 4).alias("reference_credits"))
    rows = T.attempts(spark, sf_dir).withColumn("printed", F.when(F.col("tax") == 0, "  ").otherwise(F.concat(F.lit("Course "), F.col("tax").cast("string"))))
    rows = rows.join(reference, "part", "left")
    title = F.coalesce(text_or_null(F.col("printed")), F.col("code"))
    return rows.select("order_key", "line", "code", title.alias("title"), F.lit(None).cast("string").alias("letter"), F.col("reference_credits").alias("credits"), F.when(F.col("reference_credits").isNull(), "manual").otherwise("catalogue").alias("provenance"))


@query("enriched_rows", S.with_(S.ATTEMPTS, query="""
SELECT credit_source, grade_source, point_source, complete, count(*) AS rows FROM (
  SELECT CASE WHEN line = 7 THEN CASE WHEN part % 2 = 0 THEN 'catalogue' END ELSE 'yours' END AS credit_source, CASE WHEN tax = 8 THEN 'card' WHEN p THEN 'rules' END AS grade_source,
    CASE WHEN tax = 8 THEN CASE WHEN line = 1 THEN 'card' WHEN line <> 2 THEN 'rules' END WHEN p THEN 'rules' END AS point_source,
    (line <> 7 OR part % 2 = 0) AND (tax = 8 OR p) AND NOT (tax = 8 AND line = 2) AS complete
  FROM (SELECT *, internal >= 20 AND external >= 17.5 AND total >= 40 AS p FROM attempts)) GROUP BY ALL"""))
def enriched_rows(spark, sf_dir):
    """Where each row's credits, grade and point come from, and whether that is all it needs.

    Printed values come first; a grade follows from marks that pass, and a letter without verified points stays
    recorded but not scored.
    """
    line, tax = F.col("line"), F.col("tax")
    printed_letter = F.when(tax == 8, F.when(line == 2, "AB").otherwise("A"))
    passed = R.heads(F.col("internal"), F.col("external"), F.col("total"), F.lit(True))["passed"]
    letter = F.coalesce(printed_letter, F.when(passed, R.grade_of_marks(F.col("total"))))
    credit = F.when(line != 7, "yours").when(F.col("part") % 2 == 0, "catalogue")
    grade = F.when(printed_letter.isNotNull(), "card").when(letter.isNotNull(), "rules")
    point = F.when((tax == 8) & (line == 1), "card").when(R.points_of(letter).isNotNull(), "rules")
    rows = T.attempts(spark, sf_dir).select(credit.alias("credit_source"), grade.alias("grade_source"), point.alias("point_source"))
    complete = F.col("credit_source").isNotNull() & F.col("grade_source").isNotNull() & F.col("point_source").isNotNull()
    return rows.withColumn("complete", complete).groupBy("credit_source", "grade_source", "point_source", "complete").agg(F.count(F.lit(1)).alias("rows"))


FILES = """
files AS (SELECT o_custkey AS student, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 3 END AS semester, o_orderkey AS file, o_orderkey % 11 > 0 AS card, o_orderkey % 13 AS rows, o_orderpriority || (o_orderkey % 2) AS content FROM orders)"""


@query("files_by_semester", S.with_(FILES, query="""
SELECT student, semester, files, duplicate, saved, NOT cards AND true AS blocked_by_card, CASE WHEN NOT cards THEN 'not_a_card' WHEN semester IS NULL THEN 'semester_unknown' WHEN duplicate = 'differs' THEN 'files_differ' WHEN saved THEN 'already_saved' END AS reason,
  semester IS NOT NULL AND duplicate <> 'differs' AND NOT saved AND cards AND filled AS ready
FROM (SELECT student, semester, count(*) AS files, bool_and(card) AS cards, bool_and(rows > 0) AS filled, semester IS NOT NULL AND student % 4 = semester AS saved,
    CASE WHEN count(*) < 2 THEN 'none' WHEN list(content ORDER BY file)[1] = list(content ORDER BY file)[2] THEN 'identical' ELSE 'differs' END AS duplicate FROM files GROUP BY student, semester)"""))
def files_by_semester(spark, sf_dir):
    """A student's files by the semester that they print: alike or not, saved already, why not to import, and readiness.

    Only the first two files of a semester are compared, so a rank bounds what is gathered.
    """
    key = F.col("o_orderkey")
    files = T.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("student"), F.when(key % 6 > 0, key % 3).alias("semester"), key.alias("file"), (key % 11 > 0).alias("card"), (key % 13).alias("n_rows"), F.concat("o_orderpriority", (key % 2).cast("string")).alias("content")
    )
    rank = F.row_number().over(W.partitionBy("student", "semester").orderBy("file"))
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("content")))
    groups = files.withColumn("rank", rank).groupBy("student", "semester").agg(F.count(F.lit(1)).alias("files"), F.bool_and("card").alias("cards"), F.bool_and(F.col("n_rows") > 0).alias("filled"), at(1).alias("a"), at(2).alias("b"))
    duplicate = F.when(F.col("files") < 2, "none").when(F.col("a") == F.col("b"), "identical").otherwise("differs")
    saved = F.coalesce(F.col("student") % 4 == F.col("semester"), F.lit(False))
    groups = groups.withColumns({"duplicate": duplicate, "saved": saved})
    args = [F.col(c) for c in ("semester", "duplicate", "saved", "cards")]
    return groups.select("student", "semester", "files", "duplicate", "saved", (~F.col("cards")).alias("blocked_by_card"), N.blocking_reason(*args).alias("reason"), N.ready_to_import(*args, F.col("filled")).alias("ready"))


@query("derivations", S.with_(S.SEMESTERS, query="""
SELECT student, semester, to_json({'formula': 'sum(credits x points) / sum(credits)', 'clause': 'averages', 'inputs': map {'courses': CAST(courses AS DOUBLE), 'credits': CAST(credits AS DOUBLE), 'sgpa': sgpa}, 'ruleSetId': 'regular-2022'})::VARCHAR AS explanation FROM semesters"""))
def derivations(spark, sf_dir):
    """Each average with how it came about."""
    from collegium.plans.grading import semesters

    found = N.derivation("sum(credits x points) / sum(credits)", "averages", {k: F.col(k) for k in ("courses", "credits", "sgpa")})
    return semesters(spark, sf_dir).select("student", "semester", as_json(found).alias("explanation"))


@query("rule_set_resolution", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'regular-2022' WHEN 1 THEN 'regular-2022' END AS rule_set, CASE s_suppkey % 3 WHEN 0 THEN 'fallback' WHEN 1 THEN 'pinned' ELSE 'unavailable' END AS status,
  CASE WHEN s_suppkey % 4 = 0 THEN 'not_verified' WHEN s_suppkey % 7 = 0 THEN 'not_active' END AS refusal, 10 AS highest_point, 'cgpa_times_10' AS formulas FROM supplier""")
def rule_set_resolution(spark, sf_dir):
    """The rule set of each result: pinned, the fallback, or none; and what keeps a rule set from use."""
    key = F.col("s_suppkey")
    pinned = F.when(key % 3 == 1, R.RULES.id).when(key % 3 == 2, "lost-2015")
    rule_set, status = N.resolved_rule_set(pinned, list(R.RULE_SETS))
    return T.table(spark, sf_dir, "supplier").select("s_suppkey", rule_set.alias("rule_set"), status.alias("status"), N.usable(key % 7 > 0, key % 4 > 0).alias("refusal"), F.lit(R.RULES.highest_point).alias("highest_point"), F.lit(",".join(R.PERCENTAGE_FORMULAS)).alias("formulas"))


@query("constraint_violations", """
SELECT 'ends_after_it_starts' AS rule, count(*) FILTER (WHERE event_id % 24 <= event_id % 17) AS violations FROM events
UNION ALL SELECT 'publish_requires_verification', count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_partkey % 4 = 0) FROM part
UNION ALL SELECT 'one_active_rule_set', count(*) FROM (SELECT s_suppkey % 8 AS scheme, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS college FROM supplier WHERE s_suppkey % 7 > 0 GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'enabled_only_through_all_gates', count(*) FILTER (WHERE n_nationkey % 2 = 0 AND NOT (n_nationkey % 3 > 0 AND n_nationkey % 5 > 0)) FROM nation""")
def constraint_violations(spark, sf_dir):
    """Rows that break a rule between columns or a partial unique index, each rule by one scan of its table."""
    n, key, s, c = F.col("event_id"), F.col("p_partkey"), F.col("s_suppkey"), F.col("n_nationkey")
    rule = lambda rows, name, bad: rows.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    slots = rule(T.table(spark, sf_dir, "events"), "ends_after_it_starts", ~(n % 24 > n % 17))
    published, verified = key % 3 == 0, key % 4 > 0
    schemes = rule(T.table(spark, sf_dir, "part"), "publish_requires_verification", published & ~verified)
    active = T.table(spark, sf_dir, "supplier").where(s % 7 > 0).groupBy((s % 8).alias("scheme"), F.when(s % 3 > 0, F.col("s_nationkey")).alias("college")).count()
    one = rule(active, "one_active_rule_set", F.col("count") > 1)
    gates = rule(T.table(spark, sf_dir, "nation"), "enabled_only_through_all_gates", (c % 2 == 0) & ~((c % 3 > 0) & (c % 5 > 0)))
    return slots.unionByName(schemes).unionByName(one).unionByName(gates)
