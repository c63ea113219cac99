"""Queries that order and word what is shown: figures, panels, pages and queues."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions import display as D
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

FIXED = "CAST(floor({0} * {1} + 0.5) / {1} AS DECIMAL(20,{2}))::VARCHAR"


@query("shown_figures", f"""
SELECT p_partkey, {FIXED.format('p_size / 8.0::DOUBLE', 100, 2)} AS gpa, {FIXED.format('p_size / 4.0::DOUBLE', 10, 1)} || '%' AS share,
  p_size % 3 || CASE WHEN p_size % 3 = 1 THEN ' class' ELSE ' classes' END AS classes,
  CASE WHEN p_partkey % 11 = 0 THEN 'noon' ELSE CASE WHEN p_partkey % 24 % 12 = 0 THEN 12 ELSE p_partkey % 24 % 12 END || ':' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 24 < 12 THEN ' am' ELSE ' pm' END END AS clock,
  CASE WHEN p_partkey % 13 = 0 THEN 'soon' ELSE strftime(DATE '2024-01-01' + CAST(p_partkey % 500 AS INTEGER), '%-d %b %Y') END AS day,
  CASE WHEN p_size % 5 = 0 THEN 'Unavailable' ELSE p_size::VARCHAR END AS metric, CASE WHEN p_size % 5 = 0 OR p_size % 5 = 1 THEN 'courses need review' END AS note,
  CASE p_size % 4 WHEN 0 THEN 'no grade or credits' WHEN 1 THEN 'grade' WHEN 2 THEN 'grade or credits' ELSE 'grade, credits or marks' END AS reasons
FROM part""")
def shown_figures(spark, sf_dir):
    """Decimals, percentages, counts, clock times, days, metrics with their notes, and reasons joined by or."""
    key, size = F.col("p_partkey"), F.col("p_size")
    stored = F.concat_ws(":", F.lpad((key % 24).cast("string"), 2, "0"), F.lpad((size % 60).cast("string"), 2, "0"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (key % 500).cast("int")).cast("string")
    status = F.when(size % 5 == 1, "partial").otherwise("resolved")
    value, note = D.metric(F.when(size % 5 != 0, size), status, F.lit("courses need review"), size.cast("string"))
    reasons = F.slice(F.array(F.lit("grade"), F.lit("credits"), F.lit("marks")), F.lit(1), size % 4)
    return T.table(spark, sf_dir, "part").select(
        "p_partkey",
        D.fixed(size / 8, 2).alias("gpa"),
        D.percent(size / 4).alias("share"),
        D.counted(size % 3, "class", "classes").alias("classes"),
        D.clock(F.when(key % 11 == 0, "noon").otherwise(stored)).alias("clock"),
        D.day(F.when(key % 13 == 0, "soon").otherwise(date)).alias("day"),
        value.alias("metric"),
        note.alias("note"),
        D.either(reasons).alias("reasons"),
    )


@query("local_days", "SELECT event_id, strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d') AS day FROM events")
def local_days(spark, sf_dir):
    """The day that a moment falls on five and a half hours east."""
    return T.table(spark, sf_dir, "events").select("event_id", D.local_day(F.col("ts").cast("timestamp"), "Asia/Kolkata").alias("day"))


@query("page_size_clamp", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 20 ELSE least(100, greatest(1, o_orderkey % 150 - 20)) END AS BIGINT) AS page_size FROM orders")
def page_size_clamp(spark, sf_dir):
    """Asked page sizes held between 1 and 100, 20 where none or no number is asked."""
    asked = F.when(F.col("o_orderkey") % 10 == 0, F.lit("many")).otherwise((F.col("o_orderkey") % 150 - 20).cast("string"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.when(asked.try_cast("bigint").isNull(), 20).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), asked.try_cast("bigint")))).cast("bigint").alias("page_size"))


@query("semesters_unknown_last", "SELECT student, semester, place FROM (SELECT c_custkey // 10 AS student, CASE WHEN c_custkey % 3 > 0 THEN 1 + c_custkey % 8 END AS semester, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY coalesce(CASE WHEN c_custkey % 3 > 0 THEN 1 + c_custkey % 8 END, 99), c_custkey) AS place FROM customer)")
def semesters_unknown_last(spark, sf_dir):
    """Files of a student by semester; one that prints none comes last."""
    key = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select(key, F.floor(key / 10).alias("student"), F.when(key % 3 > 0, 1 + key % 8).alias("semester"))
    return rows.select("student", "semester", F.row_number().over(W.partitionBy("student").orderBy(F.coalesce("semester", F.lit(99)), "c_custkey")).alias("place"))


@query("slots_of_a_day", "SELECT user_id, day, string_agg(clock || ' ' || event_type, ', ' ORDER BY clock, event_id) AS slots FROM (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS clock FROM events) GROUP BY ALL")
def slots_of_a_day(spark, sf_dir):
    """A user's slots of each day in the order of their start times; a day of one user is a small group."""
    rows = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").cast("string").alias("day"), F.date_format("ts", "HH:mm").alias("clock"), "event_type")
    slots = F.sort_array(F.collect_list(F.struct("clock", "event_id", "event_type")))
    return rows.groupBy("user_id", "day").agg(F.array_join(F.transform(slots, lambda x: F.concat_ws(" ", x["clock"], x["event_type"])), ", ").alias("slots"))


@query("worst_attendance_first", S.with_(S.ATTENDANCE, query="""
SELECT student, subject, place FROM (
  SELECT student, subject, row_number() OVER (PARTITION BY student ORDER BY attended * 1.0::DOUBLE / conducted, subject) AS place FROM attendance WHERE attended * 100 < 85 * conducted) WHERE place <= 3"""))
def worst_attendance_first(spark, sf_dir):
    """The three subjects of each student that are furthest below the bound; a top-k per student."""
    short = T.attendance(spark, sf_dir).where("attended * 100 < 85 * conducted")
    place = F.row_number().over(W.partitionBy("student").orderBy(F.col("attended") / F.col("conducted"), "subject"))
    return short.withColumn("place", place).where("place <= 3").select("student", "subject", "place")


#: Confidence of a reading by the urgency of its review.
REVIEW = ["unresolved", "low", "medium", "high"]


@query("review_queue", "SELECT p_brand AS stream, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, p_partkey) AS place FROM part QUALIFY place <= 20")
def review_queue(spark, sf_dir):
    """The twenty items of each stream to review first: least sure, then oldest."""
    confidence = F.element_at(F.array(*[F.lit(x) for x in REVIEW]), F.col("p_size") % 4 + 1)
    rank = F.array_position(F.array(*[F.lit(x) for x in REVIEW]), F.col("confidence"))
    rows = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("stream"), F.col("p_partkey").alias("item"), confidence.alias("confidence"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("stream").orderBy(rank, "item"))).where("place <= 20").select("stream", "item", "place")


@query("health_details", """
SELECT event_id, CASE WHEN minutes > 180 THEN 'Last checked ' || minutes || ' minutes ago, past the 180-minute threshold.' WHEN outcome = 'unauthorized' THEN 'Refused by the registry.' WHEN outcome = 'ok' THEN 'Last run completed.'
  ELSE coalesce(detail, 'Last run reported "' || outcome || '".') END AS detail
FROM (SELECT event_id, event_id % 240 AS minutes, CASE WHEN value < 4 THEN 'failed' WHEN value < 6 THEN 'malformed' WHEN value < 7 THEN 'unauthorized' ELSE 'ok' END AS outcome, CASE WHEN event_id % 2 = 0 THEN props END AS detail FROM events)""")
def health_details(spark, sf_dir):
    """What each state of a monitored family is explained by."""
    v, minutes = F.col("value"), F.col("event_id") % 240
    outcome = F.when(v < 4, "failed").when(v < 6, "malformed").when(v < 7, "unauthorized").otherwise("ok")
    late = F.concat(F.lit("Last checked "), minutes.cast("string"), F.lit(" minutes ago, past the 180-minute threshold."))
    said = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    detail = F.when(minutes > 180, late).when(outcome == "unauthorized", "Refused by the registry.").when(outcome == "ok", "Last run completed.").otherwise(F.coalesce(said, F.concat(F.lit('Last run reported "'), outcome, F.lit('".'))))
    return T.table(spark, sf_dir, "events").select("event_id", detail.alias("detail"))
