"""Queries over marks: results, averages, histories and plans of students."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions import rules as R
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempts with passed, letter (F unless passed) and points."""
    rows = T.attempts(spark, sf_dir)
    passed = R.heads(F.col("internal"), F.col("external"), F.col("total"), F.lit(True))["passed"]
    rows = rows.withColumn("passed", passed).withColumn("letter", F.when(F.col("passed"), R.grade_of_marks(F.col("total"))).otherwise("F"))
    return rows.withColumn("points", R.points_of(F.col("letter")))


def weighted_mean(weight: Column, value: Column) -> Column:
    """The sum of products over the sum of weights, unrounded; sums of whole numbers, divided once."""
    return F.try_divide(F.sum(weight * value).cast("double"), F.sum(weight).cast("double"))


def semesters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student, semester, courses, credits, sgpa, backlogs, marks: one pass, combined before its only shuffle."""
    return (
        graded(spark, sf_dir)
        .groupBy("student", "semester")
        .agg(
            F.count(F.lit(1)).alias("courses"),
            F.sum("credits").alias("credits"),
            R.half_up(weighted_mean(F.col("credits"), F.col("points"))).alias("sgpa"),
            F.count_if(~F.col("passed")).alias("backlogs"),
            F.sum("total").alias("marks"),
        )
    )


@query("semester_sgpa", S.with_(S.SEMESTERS, query="SELECT student, semester, courses, credits, sgpa FROM semesters"))
def semester_sgpa(spark, sf_dir):
    return semesters(spark, sf_dir).select("student", "semester", "courses", "credits", "sgpa")


@query("round_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor(abs(l_extendedprice / 7) * 100 + 0.5 + 1e-9) / 100 AS two, floor(abs(l_extendedprice / 7) * 10 + 0.5 + 1e-9) / 10 AS one, -(floor(abs(l_extendedprice / -7) * 100 + 0.5 + 1e-9) / 100) AS negative FROM lineitem")
def round_half_up(spark, sf_dir):
    x = F.col("l_extendedprice") / 7
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", R.half_up(x).alias("two"), R.half_up(x, 1).alias("one"), R.half_up(-x).alias("negative"))


KINDS_SQL = """
kinds AS (
  SELECT student, semester, code, line, credits, order_key,
         CASE WHEN line = 7 THEN NULL ELSE line <> 5 END AS has_see,
         CASE WHEN line = 5 THEN internal * 2 ELSE internal END AS internal,
         CASE WHEN line = 5 THEN 0 ELSE external END AS external,
         CASE WHEN line = 5 THEN internal * 2 ELSE total END AS total
  FROM attempts
)"""


@query(
    "course_results",
    S.with_(
        S.ATTEMPTS,
        KINDS_SQL,
        query="""
SELECT student, semester, code, line, order_key, internal, external, total, has_see,
       CASE WHEN has_see IS NULL THEN NULL WHEN internal >= (CASE WHEN has_see THEN 20 ELSE 40 END) THEN 'passed' ELSE 'failed' END AS cie,
       CASE WHEN has_see IS NULL THEN NULL WHEN NOT has_see THEN 'not_applicable' WHEN external >= 17.5 THEN 'passed' ELSE 'failed' END AS see,
       CASE WHEN has_see IS NULL THEN NULL WHEN total >= 40 THEN 'passed' ELSE 'failed' END AS overall,
       CASE WHEN has_see IS NULL THEN NULL WHEN has_see THEN internal >= 20 AND external >= 17.5 AND total >= 40 ELSE internal >= 40 AND total >= 40 END AS passed
FROM kinds""",
    ),
)
def course_results(spark, sf_dir):
    """Heads and outcome of every attempt; with an unknown kind of course all of them stay unknown."""
    rows = T.attempts_with_kinds(spark, sf_dir)
    found = R.heads(F.col("internal"), F.col("external"), F.col("total"), F.col("has_see"))
    known = F.col("has_see").isNotNull()
    return rows.select("student", "semester", "code", "line", "order_key", "internal", "external", "total", "has_see", *[F.when(known, found[k]).alias(k) for k in ("cie", "see", "overall", "passed")])


@query(
    "marks_validation",
    S.with_(
        S.ATTEMPTS,
        query="""
SELECT reason, count(*) AS rows, CAST(min(student) AS BIGINT) AS first_student FROM (
  SELECT student, CASE WHEN NOT regexp_matches(printed_code, '^[A-Za-z][A-Za-z0-9]*$') THEN 'invalid_code'
                       WHEN printed_internal < 0 OR printed_internal > 50 THEN 'internal_out_of_range'
                       WHEN external > 50 THEN 'external_out_of_range'
                       WHEN printed_total <> printed_internal + external THEN 'total_disagrees' ELSE 'ok' END AS reason
  FROM (SELECT *, CASE WHEN line = 1 AND tax = 8 THEN substr(code, 2) ELSE code END AS printed_code,
               CASE WHEN line = 2 AND tax = 7 THEN internal + 40 ELSE internal END AS printed_internal,
               CASE WHEN line = 3 THEN total + 1 WHEN line = 2 AND tax = 7 THEN total + 40 ELSE total END AS printed_total FROM attempts)
) GROUP BY reason""",
    ),
)
def marks_validation(spark, sf_dir):
    """Counts by the first reason for refusing marks, on attempts with planted misprints."""
    rows, line, tax = T.attempts(spark, sf_dir), F.col("line"), F.col("tax")
    code = F.when((line == 1) & (tax == 8), F.substring("code", 2, 99)).otherwise(F.col("code"))
    internal = F.when((line == 2) & (tax == 7), F.col("internal") + 40).otherwise(F.col("internal"))
    total = F.when(line == 3, F.col("total") + 1).when((line == 2) & (tax == 7), F.col("total") + 40).otherwise(F.col("total"))
    reason = F.coalesce(R.marks_refusal(code, internal, F.col("external"), total, F.lit(True)), F.lit("ok"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.min("student").alias("first_student"))


@query("grade_distribution", S.with_(S.GRADED, query="SELECT s.semester, b.letter, count(g.student) AS courses FROM (SELECT DISTINCT semester FROM graded) s CROSS JOIN bands b LEFT JOIN graded g ON g.semester = s.semester AND g.letter = b.letter GROUP BY s.semester, b.letter"))
def grade_distribution(spark, sf_dir):
    """Courses by semester and letter, with empty bands: eight counts in one aggregate, unfolded afterwards."""
    counts = graded(spark, sf_dir).groupBy("semester").agg(*[F.count_if(F.col("letter") == b[0]).alias(b[0]) for b in R.BANDS])
    return counts.unpivot("semester", [F.col(f"`{b[0]}`") for b in R.BANDS], "letter", "courses")


STATUS_SQL = """
coded AS (
  SELECT *, CASE WHEN flag = 'A' AND line_status = 'F' THEN 'DX' WHEN tax = 8 AND line = 1 THEN 'AB' ELSE letter END AS printed,
         CASE WHEN line = 7 THEN NULL ELSE credits END AS known_credits
  FROM graded
)"""


def with_special_grades(spark, sf_dir):
    rows = graded(spark, sf_dir)
    printed = F.when((F.col("flag") == "A") & (F.col("line_status") == "F"), "DX").when((F.col("tax") == 8) & (F.col("line") == 1), "AB").otherwise(F.col("letter"))
    return rows.withColumns({"printed": printed, "known_credits": F.when(F.col("line") != 7, F.col("credits"))})


@query(
    "semester_sgpa_status",
    S.with_(
        S.GRADED,
        STATUS_SQL,
        query="""
SELECT student, semester, count(*) AS courses, CAST(sum(known_credits) AS BIGINT) AS credits,
       CASE WHEN count(*) FILTER (WHERE printed = 'AB') > 0 THEN 'unverified_grade'
            WHEN count(*) FILTER (WHERE printed <> 'DX' AND known_credits IS NULL) > 0 THEN 'missing_credits'
            WHEN count(*) FILTER (WHERE printed <> 'DX') = 0 THEN 'no_counting_course' ELSE 'ok' END AS status,
       CASE WHEN count(*) FILTER (WHERE printed = 'AB') = 0 AND count(*) FILTER (WHERE printed <> 'DX' AND known_credits IS NULL) = 0 AND count(*) FILTER (WHERE printed <> 'DX') > 0
            THEN floor(CAST(sum(known_credits * points) FILTER (WHERE printed <> 'DX') AS DOUBLE) / CAST(sum(known_credits) FILTER (WHERE printed <> 'DX') AS DOUBLE) * 100 + 0.5 + 1e-9) / 100 END AS sgpa
FROM coded GROUP BY student, semester""",
    ),
)
def semester_sgpa_status(spark, sf_dir):
    """A grade of unverified points or a counting course without credits fails the whole semester, with its reason."""
    counts, weight = R.counts_in_average(F.col("printed")), F.col("known_credits")
    grouped = (
        with_special_grades(spark, sf_dir)
        .groupBy("student", "semester")
        .agg(
            F.count(F.lit(1)).alias("courses"),
            F.sum(weight).alias("credits"),
            F.count_if(R.grade_refusal(F.col("printed")).isNotNull()).alias("_refused"),
            F.count_if(counts & weight.isNull()).alias("_missing"),
            F.count_if(counts).alias("_counting"),
            weighted_mean(F.when(counts, weight), F.col("points")).alias("_mean"),
        )
    )
    status = F.when(F.col("_refused") > 0, "unverified_grade").when(F.col("_missing") > 0, "missing_credits").when(F.col("_counting") == 0, "no_counting_course").otherwise("ok")
    return grouped.select("student", "semester", "courses", "credits", status.alias("status"), F.when(status == "ok", R.half_up(F.col("_mean"))).alias("sgpa"))


@query(
    "cgpa_class",
    S.with_(
        S.SEMESTERS,
        query="""
SELECT student, semesters, credits, cgpa, floor(cgpa * 10.0 * 100 + 0.5 + 1e-9) / 100 AS percentage,
       CASE WHEN floor(cgpa * 10.0 * 100 + 0.5 + 1e-9) / 100 >= 70 THEN 'FCD' WHEN floor(cgpa * 10.0 * 100 + 0.5 + 1e-9) / 100 >= 60 THEN 'FC'
            WHEN floor(cgpa * 10.0 * 100 + 0.5 + 1e-9) / 100 >= 50 THEN 'SC' WHEN floor(cgpa * 10.0 * 100 + 0.5 + 1e-9) / 100 >= 40 THEN 'P' ELSE 'none' END AS class
FROM (SELECT student, count(*) AS semesters, CAST(sum(credits) AS BIGINT) AS credits,
             floor(CAST(sum(CAST(floor(sgpa * 100 + 0.5) AS BIGINT) * credits) AS DOUBLE) / (100.0::DOUBLE * CAST(sum(credits) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS cgpa
      FROM semesters GROUP BY student)""",
    ),
)
def cgpa_class(spark, sf_dir):
    """The average over semesters of the rounded semester averages, summed as whole hundredths, and what follows."""
    hundredths = T.whole(F.col("sgpa") * 100)
    mean = F.sum(hundredths * F.col("credits")).cast("double") / (F.lit(100.0) * F.sum("credits").cast("double"))
    rows = semesters(spark, sf_dir).groupBy("student").agg(F.count(F.lit(1)).alias("semesters"), F.sum("credits").alias("credits"), R.half_up(mean).alias("cgpa"))
    return rows.withColumn("percentage", R.percentage_of(F.col("cgpa"))).withColumn("class", R.class_of(F.col("percentage")))


HUNDREDTHS = "CAST(floor(sgpa * 100 + 0.5) AS BIGINT)"


@query(
    "running_cgpa",
    S.with_(
        S.SEMESTERS,
        query=f"""
SELECT student, semester, sgpa, floor(CAST(sum({HUNDREDTHS} * credits) OVER w AS DOUBLE) / (100.0::DOUBLE * CAST(sum(credits) OVER w AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS cgpa_so_far
FROM semesters WINDOW w AS (PARTITION BY student ORDER BY semester ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
)
def running_cgpa(spark, sf_dir):
    """The average so far; a student's rows are at most their semesters."""
    w = W.partitionBy("student").orderBy("semester").rowsBetween(W.unboundedPreceding, 0)
    mean = F.sum(T.whole(F.col("sgpa") * 100) * F.col("credits")).over(w).cast("double") / (F.lit(100.0) * F.sum("credits").over(w).cast("double"))
    return semesters(spark, sf_dir).select("student", "semester", "sgpa", R.half_up(mean).alias("cgpa_so_far"))


@query(
    "semester_history",
    S.with_(
        S.SEMESTERS,
        query="""
SELECT p.student, CAST(n.semester AS BIGINT) AS semester, s.sgpa, s.credits, s.sgpa IS NOT NULL AS graded,
       floor(abs(s.sgpa - b.sgpa) * 100 + 0.5 + 1e-9) / 100 * sign(s.sgpa - b.sgpa) + 0.0::DOUBLE AS delta,
       coalesce(s.sgpa = max(s.sgpa) OVER (PARTITION BY p.student) AND count(s.sgpa) OVER (PARTITION BY p.student) > 1, false) AS highest,
       coalesce(s.sgpa = min(s.sgpa) OVER (PARTITION BY p.student) AND count(s.sgpa) OVER (PARTITION BY p.student) > 1, false) AS lowest
FROM (SELECT DISTINCT student FROM semesters) p CROSS JOIN range(1, 9) n(semester)
LEFT JOIN semesters s ON s.student = p.student AND s.semester = n.semester
LEFT JOIN semesters b ON b.student = p.student AND b.semester = n.semester - 1""",
    ),
)
def semester_history(spark, sf_dir):
    """Eight rows per student; the change is against the semester just before, or unknown. All ties are flagged.

    The spine is folded out of one grouped row per student, so neither a cross join nor a second shuffle is needed.
    """
    by = F.map_from_entries(F.collect_list(F.struct("semester", F.struct("sgpa", "credits"))))
    rows = semesters(spark, sf_dir).groupBy("student").agg(by.alias("by"), F.max("sgpa").alias("top"), F.min("sgpa").alias("low"), F.count("sgpa").alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))).alias("semester"))
    now, before = F.try_element_at("by", F.col("semester")), F.try_element_at("by", F.col("semester") - 1)
    sgpa = now["sgpa"]
    many = F.col("n") > 1
    return rows.select(
        "student",
        "semester",
        sgpa.alias("sgpa"),
        now["credits"].alias("credits"),
        sgpa.isNotNull().alias("graded"),
        R.half_up(sgpa - before["sgpa"]).alias("delta"),
        F.coalesce((sgpa == F.col("top")) & many, F.lit(False)).alias("highest"),
        F.coalesce((sgpa == F.col("low")) & many, F.lit(False)).alias("lowest"),
    )


@query(
    "best_and_worst_semester",
    S.with_(
        S.SEMESTERS,
        query="""
SELECT student, max(semester) FILTER (WHERE up = 1) AS strongest, max(sgpa) FILTER (WHERE up = 1) AS strongest_sgpa,
       max(semester) FILTER (WHERE down = 1) AS weakest, max(sgpa) FILTER (WHERE down = 1) AS weakest_sgpa,
       max(semester) AS latest, max(sgpa) FILTER (WHERE late = 1) AS latest_sgpa
FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY sgpa DESC, semester DESC) AS up,
             row_number() OVER (PARTITION BY student ORDER BY sgpa, semester) AS down, row_number() OVER (PARTITION BY student ORDER BY semester DESC) AS late FROM semesters)
GROUP BY student""",
    ),
)
def best_and_worst_semester(spark, sf_dir):
    """Of tied semesters the later is strongest and the earlier weakest; aggregates, not windows."""
    order = F.struct("sgpa", "semester")
    best = semesters(spark, sf_dir).groupBy("student").agg(F.max(order).alias("b"), F.min(order).alias("w"), F.max(F.struct("semester", "sgpa")).alias("l"))
    return best.select("student", F.col("b.semester").alias("strongest"), F.col("b.sgpa").alias("strongest_sgpa"), F.col("w.semester").alias("weakest"), F.col("w.sgpa").alias("weakest_sgpa"), F.col("l.semester").alias("latest"), F.col("l.sgpa").alias("latest_sgpa"))


@query(
    "semester_statistics",
    S.with_(
        S.GRADED,
        STATUS_SQL,
        query="""
SELECT student, semester, count(*) AS subjects, CAST(coalesce(sum(known_credits), 0) AS BIGINT) AS credits_attempted,
       CAST(coalesce(sum(known_credits) FILTER (WHERE passed AND printed NOT IN ('DX', 'AB')), 0) AS BIGINT) AS credits_earned,
       count(*) FILTER (WHERE known_credits IS NULL) AS credits_unresolved,
       CASE WHEN count(*) FILTER (WHERE known_credits IS NULL) > 0 THEN 'partial' ELSE 'resolved' END AS credit_status,
       count(*) FILTER (WHERE printed = 'DX') AS detained, count(*) FILTER (WHERE printed = 'AB') AS absent,
       count(*) FILTER (WHERE printed NOT IN ('DX', 'AB') AND passed) AS passed, count(*) FILTER (WHERE printed NOT IN ('DX', 'AB') AND NOT passed) AS failed,
       floor(CAST(sum(total) AS DOUBLE) / count(*) * 100 + 0.5 + 1e-9) / 100 AS mean_percentage
FROM coded GROUP BY student, semester""",
    ),
)
def semester_statistics(spark, sf_dir):
    """A semester in one aggregate: sums carry a status, a special letter comes before the marks."""
    plain = ~F.col("printed").isin("DX", "AB")
    unknown = F.count_if(F.col("known_credits").isNull())
    return (
        with_special_grades(spark, sf_dir)
        .groupBy("student", "semester")
        .agg(
            F.count(F.lit(1)).alias("subjects"),
            F.coalesce(F.sum("known_credits"), F.lit(0)).alias("credits_attempted"),
            F.coalesce(F.sum(F.when(plain & F.col("passed"), F.col("known_credits"))), F.lit(0)).alias("credits_earned"),
            unknown.alias("credits_unresolved"),
            F.when(unknown > 0, "partial").otherwise("resolved").alias("credit_status"),
            F.count_if(F.col("printed") == "DX").alias("detained"),
            F.count_if(F.col("printed") == "AB").alias("absent"),
            F.count_if(plain & F.col("passed")).alias("passed"),
            F.count_if(plain & ~F.col("passed")).alias("failed"),
            R.half_up(F.sum("total").cast("double") / F.count(F.lit(1))).alias("mean_percentage"),
        )
    )


@query(
    "degree_statistics",
    S.with_(
        S.SEMESTERS,
        query=f"""
SELECT student, count(*) AS semesters, CAST(sum(courses) AS BIGINT) AS courses, CAST(sum(credits) AS BIGINT) AS credits, CAST(sum(backlogs) AS BIGINT) AS backlogs,
       floor(CAST(sum({HUNDREDTHS} * credits) AS DOUBLE) / (100.0::DOUBLE * CAST(sum(credits) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS cgpa,
       floor(CAST(sum(CAST(floor(CAST(marks AS DOUBLE) / courses * 100 + 0.5 + 1e-9) AS BIGINT)) AS DOUBLE) / 100 / count(*) * 100 + 0.5 + 1e-9) / 100 AS mean_percentage,
       CASE WHEN count(*) = 7 THEN 'official' ELSE 'provisional' END AS basis
FROM semesters GROUP BY student""",
    ),
)
def degree_statistics(spark, sf_dir):
    """The degree from its semesters: sums of sums, and the unweighted mean of semester means."""
    mean = T.whole(F.floor(F.col("marks").cast("double") / F.col("courses") * 100 + 0.5 + 1e-9).cast("double"))
    weighted = F.sum(T.whole(F.col("sgpa") * 100) * F.col("credits")).cast("double") / (F.lit(100.0) * F.sum("credits").cast("double"))
    return (
        semesters(spark, sf_dir)
        .groupBy("student")
        .agg(
            F.count(F.lit(1)).alias("semesters"),
            F.sum("courses").alias("courses"),
            F.sum("credits").alias("credits"),
            F.sum("backlogs").alias("backlogs"),
            R.half_up(weighted).alias("cgpa"),
            R.half_up(F.sum(mean).cast("double") / 100 / F.count(F.lit(1))).alias("mean_percentage"),
            F.when(F.count(F.lit(1)) == 7, "official").otherwise("provisional").alias("basis"),
        )
    )


@query(
    "subject_performance",
    S.with_(
        S.GRADED,
        query="""
SELECT student, code, count(*) AS attempts, CAST(first(points ORDER BY semester, order_key, line, internal, external) AS BIGINT) AS first_point,
       CAST(last(points ORDER BY semester, order_key, line, internal, external) AS BIGINT) AS latest_point, max(semester) AS latest_semester,
       CASE WHEN count(*) = 1 THEN 'single_attempt'
            WHEN last(points ORDER BY semester, order_key, line, internal, external) > first(points ORDER BY semester, order_key, line, internal, external) THEN 'improved'
            WHEN last(points ORDER BY semester, order_key, line, internal, external) < first(points ORDER BY semester, order_key, line, internal, external) THEN 'declined' ELSE 'unchanged' END AS trend
FROM graded GROUP BY student, code""",
    ),
)
def subject_performance(spark, sf_dir):
    """Attempts at a subject, first against latest, as least and greatest of an ordered struct."""
    order = F.struct("semester", "order_key", "line", "internal", "external", "points")
    rows = graded(spark, sf_dir).groupBy("student", "code").agg(F.count(F.lit(1)).alias("attempts"), F.min(order).alias("a"), F.max(order).alias("z"))
    first, latest = F.col("a.points").cast("bigint"), F.col("z.points").cast("bigint")
    trend = F.when(F.col("attempts") == 1, "single_attempt").when(latest > first, "improved").when(latest < first, "declined").otherwise("unchanged")
    return rows.select("student", "code", "attempts", first.alias("first_point"), latest.alias("latest_point"), F.col("z.semester").alias("latest_semester"), trend.alias("trend"))


@query(
    "strengths",
    S.with_(
        S.GRADED,
        query="""
SELECT student, code, CAST(best AS BIGINT) AS best, CASE WHEN n < 5 THEN 'too_few' WHEN best * n >= total + n THEN 'strength' WHEN best * n <= total - n THEN 'weakness' ELSE 'average' END AS kind
FROM (SELECT student, code, best, count(*) OVER (PARTITION BY student) AS n, CAST(sum(best) OVER (PARTITION BY student) AS BIGINT) AS total
      FROM (SELECT student, code, max(points) AS best FROM graded GROUP BY student, code))""",
    ),
)
def strengths(spark, sf_dir):
    """Subjects at least one point above or below the student's mean, among five or more; compared in whole numbers."""
    rows = graded(spark, sf_dir).groupBy("student", "code").agg(F.max("points").cast("bigint").alias("best"))
    w = W.partitionBy("student")
    rows = rows.select("student", "code", "best", F.count(F.lit(1)).over(w).alias("n"), F.sum("best").over(w).alias("t"))
    scaled = F.col("best") * F.col("n")
    kind = F.when(F.col("n") < 5, "too_few").when(scaled >= F.col("t") + F.col("n"), "strength").when(scaled <= F.col("t") - F.col("n"), "weakness").otherwise("average")
    return rows.select("student", "code", "best", kind.alias("kind"))


@query(
    "required_marks",
    S.with_(
        S.ATTEMPTS,
        query="""
SELECT internal, target, status, CASE WHEN status = 'ok' THEN raw END AS raw, CASE WHEN status = 'ok' THEN raw * 0.5::DOUBLE END AS printed,
       CASE WHEN status = 'ok' THEN CASE WHEN needed > 35 THEN 'overall_target' ELSE 'see_minimum' END END AS binding, rows
FROM (SELECT *, CASE WHEN internal < 20 THEN 'ineligible' WHEN raw > 100 THEN 'unreachable' ELSE 'ok' END AS status
      FROM (SELECT internal, CAST(t.target AS BIGINT) AS target, count(*) AS rows, (t.target - internal) / 0.5::DOUBLE AS needed,
                   greatest(0, ceil(greatest(35.0::DOUBLE, (t.target - internal) / 0.5::DOUBLE) - 1e-9)) AS raw
            FROM attempts CROSS JOIN (VALUES (40), (60), (75), (90), (100)) t(target) GROUP BY internal, t.target))""",
    ),
)
def required_marks(spark, sf_dir):
    """What the examination must bring for five targets, by internal marks; targets are folded into the row."""
    rows = T.attempts(spark, sf_dir).groupBy("internal").agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.withColumn("target", F.explode(F.array(*[F.lit(t).cast("bigint") for t in (40, 60, 75, 90, 100)])))
    found = R.required_see(F.col("internal"), F.col("target").cast("double"))
    return rows.select("internal", "target", "rows", *[c.alias(k) for k, c in found.items()])


@query(
    "required_sgpa",
    S.with_(
        S.SEMESTERS,
        query=f"""
SELECT student, cgpa, done, remaining, CASE WHEN remaining = 0 THEN 'insufficient_input' WHEN need > 10 THEN 'unreachable' ELSE 'ok' END AS status,
       CASE WHEN remaining > 0 AND need <= 10 THEN floor(greatest(0.0::DOUBLE, need) * 100 + 0.5 + 1e-9) / 100 END AS value
FROM (SELECT *, (8.0::DOUBLE * (done + remaining) - cgpa * done) / nullif(CAST(remaining AS DOUBLE), 0) AS need
      FROM (SELECT student, CAST(sum(credits) AS BIGINT) AS done, greatest(0, 120 - CAST(sum(credits) AS BIGINT)) AS remaining,
                   floor(CAST(sum({HUNDREDTHS} * credits) AS DOUBLE) / (100.0::DOUBLE * CAST(sum(credits) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS cgpa FROM semesters GROUP BY student))""",
    ),
)
def required_sgpa(spark, sf_dir):
    """The average that the credits up to 120 need for a final 8.0."""
    rows = cgpa_class(spark, sf_dir).select("student", "cgpa", F.col("credits").alias("done"), F.greatest(F.lit(0).cast("bigint"), 120 - F.col("credits")).alias("remaining"))
    found = R.required_sgpa(F.col("cgpa"), F.col("done"), F.col("remaining"), F.lit(8.0))
    return rows.select("student", "cgpa", "done", "remaining", *[c.alias(k) for k, c in found.items()])


@query(
    "attendance_plan",
    S.with_(
        S.ATTENDANCE,
        query="""
SELECT student, subject, attended, conducted, CAST(attended AS DOUBLE) / conducted * 100.0 AS percentage,
       CASE WHEN CAST(attended AS DOUBLE) / conducted * 100.0 >= 85 THEN 'safe' WHEN CAST(attended AS DOUBLE) / conducted * 100.0 >= 75 THEN 'below_requirement' ELSE 'dx_risk' END AS status,
       CAST(greatest(0, floor(attended * 100.0::DOUBLE / 85 - conducted + 1e-9)) AS BIGINT) AS can_miss,
       CAST(CASE WHEN CAST(attended AS DOUBLE) / conducted * 100.0 >= 85 THEN 0 ELSE greatest(0, ceil((85.0::DOUBLE * conducted - 100.0::DOUBLE * attended) / 15.0::DOUBLE - 1e-9)) END AS BIGINT) AS must_attend
FROM attendance""",
    ),
)
def attendance_plan(spark, sf_dir):
    """Percentage, standing, classes that may be missed and that must be attended."""
    a, c = F.col("attended"), F.col("conducted")
    pct = R.attendance_pct(a, c)
    return T.attendance(spark, sf_dir).select("student", "subject", "attended", "conducted", pct.alias("percentage"), R.attendance_status(pct).alias("status"), R.can_miss(a, c).alias("can_miss"), R.must_attend(a, c).alias("must_attend"))


@query("attendance_pooled", S.with_(S.ATTENDANCE, query="SELECT student, CAST(sum(attended) AS BIGINT) AS attended, CAST(sum(conducted) AS BIGINT) AS conducted, CAST(sum(attended) AS DOUBLE) / CAST(sum(conducted) AS DOUBLE) * 100.0 AS percentage, count(*) FILTER (WHERE CAST(attended AS DOUBLE) / conducted * 100.0 < 85) AS at_risk FROM attendance GROUP BY student"))
def attendance_pooled(spark, sf_dir):
    """A student's classes over all subjects, and the subjects below the requirement."""
    below = R.attendance_pct(F.col("attended"), F.col("conducted")) < R.RULES.attendance_required_pct
    pooled = R.attendance_pct(F.sum("attended"), F.sum("conducted"))
    return T.attendance(spark, sf_dir).groupBy("student").agg(F.sum("attended").alias("attended"), F.sum("conducted").alias("conducted"), pooled.alias("percentage"), F.count_if(below).alias("at_risk"))


@query("backlog_summary", "SELECT o_custkey AS student, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'P') AS attempted, count(*) FILTER (WHERE o_orderstatus = 'F') AS cleared, count(*) FILTER (WHERE o_orderstatus <> 'F') AS outstanding FROM orders GROUP BY o_custkey")
def backlog_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    return T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("student")).agg(F.count_if(s == "O").alias("active"), F.count_if(s == "P").alias("attempted"), F.count_if(s == "F").alias("cleared"), F.count_if(s != "F").alias("outstanding"))


@query("graduation_progress", S.with_(S.SEMESTERS, query="SELECT student, CAST(sum(CASE WHEN backlogs = 0 THEN credits ELSE 0 END) AS BIGINT) AS completed, greatest(0, 160 - CAST(sum(CASE WHEN backlogs = 0 THEN credits ELSE 0 END) AS BIGINT)) AS remaining FROM semesters GROUP BY student"))
def graduation_progress(spark, sf_dir):
    """Credits of semesters without a backlog against a requirement of 160."""
    done = F.sum(F.when(F.col("backlogs") == 0, F.col("credits")).otherwise(0))
    return semesters(spark, sf_dir).groupBy("student").agg(done.alias("completed"), F.greatest(F.lit(0).cast("bigint"), 160 - done).alias("remaining"))


@query(
    "data_completeness",
    S.with_(
        S.SEMESTERS,
        query="""
SELECT student, coalesce(string_agg(CASE WHEN k = 'graded' THEN semester END, ',' ORDER BY semester), '') AS graded, coalesce(string_agg(CASE WHEN k = 'pending' THEN semester END, ',' ORDER BY semester), '') AS pending,
       coalesce(string_agg(CASE WHEN k = 'missing' THEN semester END, ',' ORDER BY semester), '') AS missing
FROM (SELECT p.student, CAST(n.semester AS VARCHAR) AS semester, CASE WHEN s.semester IS NULL THEN 'missing' WHEN s.backlogs > 0 THEN 'pending' ELSE 'graded' END AS k
      FROM (SELECT DISTINCT student FROM semesters) p CROSS JOIN range(1, 9) n(semester) LEFT JOIN semesters s ON s.student = p.student AND s.semester = n.semester)
GROUP BY student""",
    ),
)
def data_completeness(spark, sf_dir):
    """Each student's semesters in disjoint lists."""
    rows = semesters(spark, sf_dir).groupBy("student").agg(F.collect_list(F.when(F.col("backlogs") == 0, F.col("semester"))).alias("g"), F.collect_list(F.when(F.col("backlogs") > 0, F.col("semester"))).alias("p"))
    listed = lambda a: F.array_join(F.sort_array(a).cast("array<string>"), ",")
    spine = F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))
    return rows.select("student", listed(F.col("g")).alias("graded"), listed(F.col("p")).alias("pending"), listed(F.array_except(spine, F.array_union("g", "p"))).alias("missing"))


@query("current_semester", S.with_(S.SEMESTERS, query="SELECT student, min(CASE WHEN backlogs > 0 THEN semester END) AS current_semester, max(semester) AS last_semester FROM semesters GROUP BY student"))
def current_semester(spark, sf_dir):
    """The first semester with open courses."""
    return semesters(spark, sf_dir).groupBy("student").agg(F.min(F.when(F.col("backlogs") > 0, F.col("semester"))).alias("current_semester"), F.max("semester").alias("last_semester"))


@query("outcome_counts", S.with_(S.GRADED, STATUS_SQL, query="SELECT student, CASE WHEN printed IN ('DX', 'AB') THEN printed WHEN passed THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS courses FROM coded GROUP BY 1, 2"))
def outcome_counts(spark, sf_dir):
    outcome = F.when(F.col("printed").isin("DX", "AB"), F.col("printed")).when(F.col("passed"), "passed").otherwise("failed")
    return with_special_grades(spark, sf_dir).groupBy("student", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("courses"))


@query("backlog_tristate", S.with_(S.ATTEMPTS, KINDS_SQL, query="SELECT student, count(*) FILTER (WHERE NOT p) AS backlogs, count(*) FILTER (WHERE p) AS cleared, count(*) FILTER (WHERE p IS NULL) AS unknown FROM (SELECT student, CASE WHEN has_see IS NULL THEN NULL WHEN has_see THEN internal >= 20 AND external >= 17.5 AND total >= 40 ELSE internal >= 40 END AS p FROM kinds) GROUP BY student"))
def backlog_tristate(spark, sf_dir):
    """Backlogs, cleared and undetermined courses; unknown is counted apart."""
    p = F.col("passed")
    return course_results(spark, sf_dir).groupBy("student").agg(F.count_if(~p).alias("backlogs"), F.count_if(p).alias("cleared"), F.count_if(p.isNull()).alias("unknown"))


@query("subject_pass_rates", S.with_(S.GRADED, query="SELECT code, count(*) AS attempts, count(*) FILTER (WHERE passed) AS passed, CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS rate, CAST(min(total) AS BIGINT) AS least, CAST(max(total) AS BIGINT) AS most FROM graded GROUP BY code HAVING count(*) >= 10"))
def subject_pass_rates(spark, sf_dir):
    rows = graded(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("passed").alias("passed"), (F.count_if("passed").cast("double") / F.count(F.lit(1))).alias("rate"), F.min("total").alias("least"), F.max("total").alias("most"))
    return rows.where("attempts >= 10")


@query("median_mark", S.with_(S.ATTEMPTS, query="SELECT student, CAST(list_sort(list(total))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS BIGINT) AS median FROM attempts GROUP BY student"))
def median_mark(spark, sf_dir):
    """The upper middle of a student's marks, not an interpolated one."""
    sorted_ = F.sort_array(F.collect_list("total"))
    return T.attempts(spark, sf_dir).groupBy("student").agg(F.element_at(sorted_, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median"))
