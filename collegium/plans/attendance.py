"""Queries over marks of single classes and the counts that they move."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.functions import attendance as A
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

OUTCOME = "CASE {0} WHEN 1 THEN 'attended' WHEN 2 THEN 'missed' END"


def outcome(n):
    return F.when(n == 1, "attended").when(n == 2, "missed")


@query("class_mark_deltas", f"""
SELECT event_id, mark, d_attended, d_conducted, CAST(least(greatest(0, conducted + d_conducted), greatest(0, attended + d_attended)) AS BIGINT) AS attended, CAST(greatest(0, conducted + d_conducted) AS BIGINT) AS conducted FROM (
  SELECT event_id, strftime(ts, '%Y-%m-%d') || ':' || event_type AS mark, event_id % 5 AS attended, event_id % 4 AS conducted,
    CAST(CASE WHEN a = 'attended' THEN 1 ELSE 0 END - CASE WHEN b = 'attended' THEN 1 ELSE 0 END AS BIGINT) AS d_attended,
    CAST(CASE WHEN a IS NULL THEN 0 ELSE 1 END - CASE WHEN b IS NULL THEN 0 ELSE 1 END AS BIGINT) AS d_conducted
  FROM (SELECT *, {OUTCOME.format('event_id % 3')} AS b, {OUTCOME.format('(event_id // 3) % 3')} AS a FROM events))""")
def class_mark_deltas(spark, sf_dir):
    """What changing or undoing a mark adds to the counts, and the counts after it, held between their bounds."""
    n = F.col("event_id")
    rows = T.table(spark, sf_dir, "events").select(n, A.mark_id(F.to_date("ts"), F.col("event_type")).alias("mark"), (n % 5).alias("a"), (n % 4).alias("c"), outcome(n % 3).alias("before"), outcome(F.floor(n / 3) % 3).alias("after"))
    delta = A.count_delta(F.col("before"), F.col("after"))
    attended, conducted = A.apply_delta(F.col("a"), F.col("c"), delta)
    return rows.select("event_id", "mark", delta[0].alias("d_attended"), delta[1].alias("d_conducted"), attended.alias("attended"), conducted.alias("conducted"))


@query("marked_classes", S.with_(S.ATTENDANCE, query="""
SELECT student, subject, CAST(coalesce(a.attended, 0) + CASE WHEN o.value >= 8 THEN 1 ELSE 0 END AS BIGINT) AS attended, CAST(coalesce(a.conducted, 0) + 1 AS BIGINT) AS conducted, a.student IS NULL AS started
FROM (SELECT user_id AS student, event_type AS subject, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) o
LEFT JOIN (SELECT * FROM attendance WHERE student % 2 = 0) a USING (student, subject)"""))
def marked_classes(spark, sf_dir):
    """One more class of each subject: counts move by one, and a subject without a record starts one."""
    last = T.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("student"), F.col("event_type").alias("subject")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    held = T.attendance(spark, sf_dir).where("student % 2 = 0").withColumn("held", F.lit(True))
    rows = last.withColumn("outcome", F.when(F.col("value") >= 8, "attended").otherwise("missed")).join(held, ["student", "subject"], "left")
    attended = F.coalesce("attended", F.lit(0)) + A.attended_of(F.col("outcome"))
    return rows.select("student", "subject", attended.alias("attended"), (F.coalesce("conducted", F.lit(0)) + 1).alias("conducted"), F.col("held").isNull().alias("started"))


@query("marks_of_the_day", """
WITH marks AS (SELECT user_id, strftime(ts, '%Y-%m-%d') || ':' || event_type AS mark, arg_max(CASE WHEN value >= 8 THEN 'attended' ELSE 'missed' END, (ts, event_id)) AS outcome FROM events WHERE event_type <> 'error' GROUP BY ALL),
days AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events),
slots(slot) AS (VALUES ('click'), ('error'), ('view'))
SELECT d.user_id, d.day, s.slot, m.outcome FROM days d, slots s LEFT JOIN marks m ON m.user_id = d.user_id AND m.mark = d.day || ':' || s.slot""")
def marks_of_the_day(spark, sf_dir):
    """Each scheduled class of a day with its mark, null where nothing was said; looked up by the composite key."""
    events = T.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    said = F.when(F.col("value") >= 8, "attended").otherwise("missed")
    marks = events.where("event_type <> 'error'").groupBy("user_id", A.mark_id(F.col("day"), F.col("event_type")).alias("mark")).agg(F.max_by(said, F.struct("ts", "event_id")).alias("outcome"))
    classes = events.select("user_id", "day").distinct().withColumn("slot", F.explode(F.array(*[F.lit(x) for x in ("click", "error", "view")])))
    return classes.withColumn("mark", A.mark_id(F.col("day"), F.col("slot"))).join(marks, ["user_id", "mark"], "left").select("user_id", "day", "slot", "outcome")


@query("stale_marks", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-25' - 14")
def stale_marks(spark, sf_dir):
    """Marks past their retention on a given day."""
    day = F.to_date("ts")
    return T.table(spark, sf_dir, "events").where(A.stale(day, F.lit("2024-01-25").cast("date"))).select("event_id", day.cast("string").alias("day"))
