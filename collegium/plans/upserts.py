"""Queries over headers with children, dimensions, profiles and states that are written again."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.operators import upserts as U
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

SYLLABI = """
held AS (SELECT p_brand AS programme, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 8 END AS semester, p_partkey AS code, p_name AS title, 1 + p_size % 4 AS credits, p_partkey % 3 AS version FROM part WHERE p_partkey % 10 > 0),
came AS (SELECT p_brand AS programme, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 8 END AS semester, p_partkey AS code, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' II' ELSE p_name END AS title, CASE WHEN p_partkey % 9 = 0 THEN 5 ELSE 1 + p_size % 4 END AS credits, 7 AS version FROM part WHERE p_partkey % 4 > 0)"""
KEYS = ["programme", "semester", "code"]


def syllabi(spark, sf_dir):
    """(held, came): headers whose keys may be null, as a syllabus without a semester has it."""
    key = F.col("p_partkey")
    rows = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("programme"), F.when(key % 6 > 0, key % 8).alias("semester"), key.alias("code"), F.col("p_name").alias("title"), (1 + F.col("p_size") % 4).alias("credits"), (key % 3).alias("version"))
    came = rows.where("code % 4 > 0").withColumns({"title": F.when(F.col("code") % 7 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title")), "credits": F.when(F.col("code") % 9 == 0, 5).otherwise(F.col("credits")), "version": F.lit(7).cast("bigint")})
    return rows.where("code % 10 > 0"), came


@query("syllabus_headers", S.with_(SYLLABI, query="""
SELECT programme, semester, code, CASE WHEN action IN ('inserted', 'updated') THEN t2 ELSE t1 END AS title, CASE WHEN action IN ('inserted', 'updated') THEN k2 ELSE k1 END AS credits, CASE WHEN action IN ('inserted', 'updated') THEN 7 ELSE v1 END AS version, action FROM (
  SELECT coalesce(i.programme, c.programme) AS programme, coalesce(i.semester, c.semester) AS semester, coalesce(i.code, c.code) AS code, c.title AS t1, i.title AS t2, c.credits AS k1, i.credits AS k2, c.version AS v1,
    CASE WHEN i.code IS NULL THEN 'kept' WHEN c.code IS NULL THEN 'inserted' WHEN c.title <> i.title OR c.credits <> i.credits THEN 'updated' ELSE 'unchanged' END AS action
  FROM held c FULL OUTER JOIN came i ON c.code = i.code)"""))
def syllabus_headers(spark, sf_dir):
    """Headers written again: only another title or other credits update one, whatever else came in."""
    return U.upsert_headers(*syllabi(spark, sf_dir), KEYS, ["title", "credits", "version"], ["title", "credits"])


def modules(rows, count):
    """Modules 1 to count of each row, with hours."""
    numbers = rows.withColumn("number", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    return numbers.select("code", F.col("number").cast("bigint").alias("number"), (F.col("code") % 5 + F.col("number")).cast("bigint").alias("hours"))


@query("syllabus_modules", S.with_(SYLLABI, query="""
SELECT coalesce(i.code, c.code) AS code, coalesce(i.number, c.number) AS number, CASE WHEN i.code IS NOT NULL THEN i.hours ELSE c.hours END AS hours,
  CASE WHEN i.code IS NOT NULL AND c.code IS NOT NULL THEN 'updated' WHEN i.code IS NOT NULL THEN 'inserted' WHEN coalesce(i.code, c.code) IN (SELECT code FROM came) THEN 'deleted' ELSE 'kept' END AS action
FROM (SELECT code, unnest(range(1, 2 + version)) AS number, code % 5 + number AS hours FROM held) c
FULL OUTER JOIN (SELECT code, unnest(range(1, 2 + code % 4)) AS number, code % 5 + number + 1 AS hours FROM came WHERE code % 11 > 0) i ON c.code = i.code AND c.number = i.number"""))
def syllabus_modules(spark, sf_dir):
    """Children replaced under the headers that came in: absent ones go, one that came in without any loses all."""
    held, came = syllabi(spark, sf_dir)
    incoming = modules(came.where("code % 11 > 0"), 1 + F.col("code") % 4).withColumn("hours", F.col("hours") + 1)
    return U.replace_children(modules(held, 1 + F.col("version")), incoming, came, ["code"], ["number"], ["hours"])


@query("syllabus_topics", S.with_(SYLLABI, query="""
SELECT coalesce(i.code, c.code) AS code, coalesce(i.number, c.number) AS number, coalesce(i.position, c.position) AS position, CASE WHEN i.code IS NOT NULL THEN i.title ELSE c.title END AS title,
  CASE WHEN i.code IS NOT NULL AND c.code IS NOT NULL THEN 'updated' WHEN i.code IS NOT NULL THEN 'inserted' WHEN (coalesce(i.code, c.code), coalesce(i.number, c.number)) IN (SELECT (code, unnest(range(1, 2 + code % 4))) FROM came) THEN 'deleted' ELSE 'kept' END AS action
FROM (SELECT code, number, unnest(range(0, number)) AS position, 'old ' || position AS title FROM (SELECT code, unnest(range(1, 2 + version)) AS number FROM held)) c
FULL OUTER JOIN (SELECT code, number, unnest(range(0, 1 + code % 3)) AS position, 'new ' || position AS title FROM (SELECT code, unnest(range(1, 2 + code % 4)) AS number FROM came)) i ON c.code = i.code AND c.number = i.number AND c.position = i.position"""))
def syllabus_topics(spark, sf_dir):
    """Topics of modules, replaced under each module that came in."""
    held, came = syllabi(spark, sf_dir)
    now = modules(came, 1 + F.col("code") % 4)
    topics = lambda rows, count, word: rows.withColumn("position", F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))).select("code", "number", F.col("position").cast("bigint").alias("position"), F.concat(F.lit(word), F.col("position").cast("string")).alias("title"))
    return U.replace_children(topics(modules(held, 1 + F.col("version")), F.col("number"), "old "), topics(now, 1 + F.col("code") % 3, "new "), now, ["code", "number"], ["position"], ["title"])


@query("option_group_upserts", """
WITH held AS (SELECT p_brand AS slot, p_size % 8 AS semester, max(p_size % 3) AS credits, 'elective' AS kind FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL),
came AS (SELECT p_brand AS slot, p_size % 8 AS semester, CASE WHEN max(p_size % 3) = 0 THEN NULL ELSE max(p_size % 3) END AS credits, CASE WHEN p_size % 8 = 5 THEN 'alternative' ELSE 'elective' END AS kind FROM part WHERE p_partkey % 4 < 3 AND p_size % 8 <> 2 GROUP BY ALL)
SELECT coalesce(i.slot, c.slot) AS slot, coalesce(i.semester, c.semester) AS semester, CASE WHEN action IN ('inserted', 'updated') THEN i.credits ELSE c.credits END AS credits, CASE WHEN action IN ('inserted', 'updated') THEN i.kind ELSE c.kind END AS kind, action
FROM (SELECT c, i, CASE WHEN i.slot IS NULL THEN 'kept' WHEN c.slot IS NULL THEN 'inserted' WHEN c.credits IS DISTINCT FROM i.credits OR c.kind <> i.kind THEN 'updated' ELSE 'unchanged' END AS action FROM held c FULL OUTER JOIN came i ON c.slot = i.slot AND c.semester = i.semester)""")
def option_group_upserts(spark, sf_dir):
    """Option groups compared by credits and kind."""
    rows = T.table(spark, sf_dir, "part").withColumn("semester", F.col("p_size") % 8)
    held = rows.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("slot"), "semester").agg(F.max(F.col("p_size") % 3).alias("credits")).withColumn("kind", F.lit("elective"))
    came = rows.where("p_partkey % 4 < 3 AND semester <> 2").groupBy(F.col("p_brand").alias("slot"), "semester").agg(F.nullif(F.max(F.col("p_size") % 3), F.lit(0)).alias("credits")).withColumn("kind", F.when(F.col("semester") == 5, "alternative").otherwise("elective"))
    return U.upsert_headers(held, came, ["slot", "semester"], ["credits", "kind"], ["credits", "kind"])


@query("option_members", """
WITH held AS (SELECT DISTINCT p_brand AS slot, 'C' || p_partkey AS code, p_size AS credits FROM part WHERE p_partkey % 3 = 0),
came AS (SELECT DISTINCT p_brand AS slot, 'C' || p_partkey AS code, p_size + 1 AS credits FROM part WHERE p_partkey % 4 = 0 AND p_brand <> 'Brand#1')
SELECT coalesce(i.slot, c.slot) AS slot, coalesce(i.code, c.code) AS code, coalesce(i.credits, c.credits) AS credits, CASE WHEN i.code IS NOT NULL AND c.code IS NOT NULL THEN 'updated' WHEN i.code IS NOT NULL THEN 'inserted' WHEN coalesce(i.slot, c.slot) IN (SELECT slot FROM came) THEN 'deleted' ELSE 'kept' END AS action
FROM held c FULL OUTER JOIN came i ON c.slot = i.slot AND c.code = i.code""")
def option_members(spark, sf_dir):
    """Members replaced under the groups that came in."""
    rows = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("slot"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_size").alias("credits"), "p_partkey")
    came = rows.where("p_partkey % 4 = 0 AND slot <> 'Brand#1'").withColumn("credits", F.col("credits") + 1)
    return U.replace_children(rows.where("p_partkey % 3 = 0"), came, came, ["slot"], ["code"], ["credits"])


@query("applicability_upserts", """
SELECT DISTINCT source AS version, CASE WHEN doc_id % 3 > 0 THEN lang END AS programme, CASE WHEN doc_id % 4 > 1 THEN doc_id % 4 END AS stream FROM documents i
WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 5 = 0 AND c.source IS NOT DISTINCT FROM i.source AND CASE WHEN c.doc_id % 3 > 0 THEN c.lang END IS NOT DISTINCT FROM CASE WHEN i.doc_id % 3 > 0 THEN i.lang END AND CASE WHEN c.doc_id % 4 > 1 THEN c.doc_id % 4 END IS NOT DISTINCT FROM CASE WHEN i.doc_id % 4 > 1 THEN i.doc_id % 4 END)""")
def applicability_upserts(spark, sf_dir):
    """Rows inserted where no row has their key yet; absent parts of the key are equal."""
    key = F.col("doc_id")
    rows = T.table(spark, sf_dir, "documents").select(key, F.col("source").alias("version"), F.when(key % 3 > 0, F.col("lang")).alias("programme"), F.when(key % 4 > 1, key % 4).alias("stream"))
    columns = ["version", "programme", "stream"]
    return U.insert_once(rows.where("doc_id % 5 = 0").select(*columns), rows.select(*columns), columns).select(*columns)


@query("profile_upserts", """
SELECT id, CASE WHEN revision IS NOT NULL AND base IS NOT NULL AND base <> revision THEN 'conflict' ELSE 'saved' END AS outcome, CAST(CASE WHEN revision IS NULL THEN 1 WHEN base <> revision THEN revision ELSE revision + 1 END AS BIGINT) AS revision,
  CASE WHEN revision IS NOT NULL AND base <> revision THEN c_mktsegment ELSE CASE WHEN id % 9 > 0 THEN 'NEW' END END AS branch
FROM (SELECT c_custkey AS id, c_mktsegment, CASE WHEN c_custkey % 5 > 0 THEN 1 + c_custkey % 2 END AS revision, CASE WHEN c_custkey % 4 > 0 THEN 1 + c_custkey % 3 END AS base FROM customer)""")
def profile_upserts(spark, sf_dir):
    """A profile written against a base revision: saved, or a conflict that shows what is held."""
    key = F.col("id")
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("branch"))
    current = rows.where("id % 5 > 0").withColumn("revision", 1 + key % 2)
    incoming = rows.select("id", F.when(key % 4 > 0, 1 + key % 3).alias("base"), F.when(key % 9 > 0, "NEW").alias("branch"))
    return U.upsert_profiles(current, incoming, "id", ["branch"])


@query("notification_states", """
SELECT coalesce(c.id, r.id) AS id, coalesce(c.state, 'unread') AS state, coalesce(c.version, r.version) AS version
FROM (SELECT o_orderkey AS id, o_orderkey % 5 AS version FROM orders WHERE o_orderkey % 3 > 0) r
FULL OUTER JOIN (SELECT user_id AS id, arg_max(CASE WHEN value < 5 THEN 'dismissed' ELSE 'read' END, (ts, event_id)) AS state, arg_max(event_id % 7, (ts, event_id)) AS version FROM events GROUP BY user_id) c ON c.id = r.id""")
def notification_states(spark, sf_dir):
    """Records replaced by id with the last state that each was given; an id without a record gets one."""
    records = T.table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.lit("unread").alias("state"), (F.col("o_orderkey") % 5).alias("version"))
    changes = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("value") < 5, "dismissed").otherwise("read").alias("state"), (F.col("event_id") % 7).alias("version"), F.struct("ts", "event_id").alias("at"))
    return U.set_states(records, changes, "id")


@query("all_marked_read", "SELECT CASE o_orderstatus WHEN 'F' THEN 'dismissed' ELSE 'read' END AS state, count(*) AS notices, count(*) FILTER (WHERE o_orderstatus = 'O') AS changed FROM orders GROUP BY 1")
def all_marked_read(spark, sf_dir):
    """Every unread notice read, and how many changed."""
    rows = T.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "dismissed").when(F.col("o_orderstatus") == "O", "unread").otherwise("read").alias("state"))
    rows = U.mark_all_read(rows.withColumn("before", F.col("state")))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("notices"), F.count_if(F.col("before") != F.col("state")).alias("changed"))


@query("runs_started", "SELECT event_type AS family, max(event_id) + 1 AS run, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS day, 'running' AS outcome FROM events GROUP BY event_type")
def runs_started(spark, sf_dir):
    """The ledger row that begins the next run of each family."""
    rows = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family")).agg((F.max("event_id") + 1).alias("run"), F.max(F.to_date("ts")).cast("string").alias("day"))
    return rows.withColumn("outcome", F.lit("running"))


@query("stream_upserts", """
SELECT coalesce(i.stream, c.stream) AS stream, coalesce(i.programme, c.programme) AS programme, coalesce(i.name, c.name) AS name, CASE WHEN i.stream IS NULL THEN 'kept' WHEN c.stream IS NULL THEN 'inserted' WHEN c.name <> i.name THEN 'updated' ELSE 'unchanged' END AS action
FROM (SELECT p_brand AS stream, p_type AS programme, min(p_name) AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL) c FULL OUTER JOIN (SELECT p_brand AS stream, p_type AS programme, min(p_name) AS name FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL) i ON c.stream = i.stream AND c.programme = i.programme""")
def stream_upserts(spark, sf_dir):
    """Streams and their programmes: a known key takes the new name."""
    named = lambda kept: T.table(spark, sf_dir, "part").where(kept).groupBy(F.col("p_brand").alias("stream"), F.col("p_type").alias("programme")).agg(F.min("p_name").alias("name"))
    return U.upsert_headers(named("p_partkey % 2 = 0"), named("p_partkey % 3 = 0"), ["stream", "programme"], ["name"], ["name"])


@query("alias_upserts", """
SELECT coalesce(i.variant, c.variant) AS variant, coalesce(i.canonical, c.canonical) AS canonical, coalesce(i.title, c.title) AS title, coalesce(c.evidence, i.evidence) AS evidence, CASE WHEN i.variant IS NULL THEN 'kept' WHEN c.variant IS NULL THEN 'inserted' WHEN c.title <> i.title THEN 'updated' ELSE 'unchanged' END AS action
FROM (SELECT p_partkey AS variant, p_partkey + 1 AS canonical, p_name AS title, 'v1' AS evidence FROM part WHERE p_partkey % 5 = 1) c
FULL OUTER JOIN (SELECT p_partkey AS variant, p_partkey + 1 AS canonical, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS title, 'v2' AS evidence FROM part WHERE p_partkey % 10 = 1 OR p_partkey % 5 = 2) i ON c.variant = i.variant AND c.canonical = i.canonical""")
def alias_upserts(spark, sf_dir):
    """Aliases written again: title and reason follow, the evidence of the first writing stays."""
    rows = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), (F.col("p_partkey") + 1).alias("canonical"), F.col("p_name").alias("title"), "p_size")
    current = rows.where("variant % 5 = 1").withColumn("evidence", F.lit("v1"))
    incoming = rows.where("variant % 10 = 1 OR variant % 5 = 2").withColumns({"title": F.when(F.col("p_size") % 2 == 0, F.upper("title")).otherwise(F.col("title")), "evidence": F.lit("v2")})
    keys = ["variant", "canonical"]
    written = U.upsert_headers(current, incoming, keys, ["title"], ["title"])
    first = incoming.select(*keys, "evidence").alias("i").join(current.select(*keys, "evidence").alias("c"), keys, "full_outer").select(*keys, F.coalesce("c.evidence", "i.evidence").alias("evidence"))
    return written.join(first, keys).select(*keys, "title", "evidence", "action")
