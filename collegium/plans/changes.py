"""Queries over snapshots, versions, merges, synchronisation and the run ledger."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions.text import content_hash
from collegium.operators import changes as C
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T


def hashed(spark, sf_dir, version):
    """A capture with the hash of its words; the address is not part of an item's identity."""
    return T.snapshot(spark, sf_dir, version).withColumn("hash", content_hash(F.col("family"), F.col("body"))).drop("body")


@query("snapshot_changes", S.with_(S.SNAPSHOTS, query="SELECT coalesce(a.item, b.item) AS item, CASE WHEN a.item IS NULL THEN 'new' WHEN b.item IS NULL THEN 'removed' WHEN a.body = b.body AND a.family = b.family THEN 'unchanged' ELSE 'modified' END AS change FROM v1 a FULL OUTER JOIN v2 b ON a.item = b.item"))
def snapshot_changes(spark, sf_dir):
    return C.detect_changes(hashed(spark, sf_dir, 1), hashed(spark, sf_dir, 2), "item", "hash")


MONITOR_SQL = """
monitored AS (
  SELECT b.item, b.family, CASE WHEN a.item IS NOT NULL AND a.body = b.body THEN 'unchanged' WHEN a.item IS NOT NULL THEN 'updated'
         WHEN EXISTS (SELECT 1 FROM v1 s WHERE s.item = b.supersedes) THEN 'revised' ELSE 'new' END AS change
  FROM v2 b LEFT JOIN v1 a ON a.item = b.item
  UNION ALL SELECT a.item, a.family, 'removed' FROM v1 a WHERE NOT EXISTS (SELECT 1 FROM v2 b WHERE b.item = a.item)
)"""


def monitored(spark, sf_dir):
    return C.monitor_changes(hashed(spark, sf_dir, 1), hashed(spark, sf_dir, 2), "item", "hash", "supersedes")


@query("monitor_changes", S.with_(S.SNAPSHOTS, MONITOR_SQL, query="SELECT item, change FROM monitored"))
def monitor_changes(spark, sf_dir):
    return monitored(spark, sf_dir)


@query("monitor_run_counts", S.with_(S.SNAPSHOTS, MONITOR_SQL, query="SELECT family, count(*) AS discovered, count(*) FILTER (WHERE change = 'new') AS fresh, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'revised') AS revised, count(*) FILTER (WHERE change = 'removed') AS removed FROM monitored GROUP BY family"))
def monitor_run_counts(spark, sf_dir):
    """The ledger row of each family: five conditional counts in one aggregate."""
    c = F.col("change")
    rows = C.monitor_changes(hashed(spark, sf_dir, 1), hashed(spark, sf_dir, 2), "item", "hash", "supersedes", "family")
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("discovered"), *[F.count_if(c == w).alias(n) for w, n in (("new", "fresh"), ("unchanged", "unchanged"), ("updated", "updated"), ("revised", "revised"), ("removed", "removed"))])


@query("same_run_twice", S.with_(S.SNAPSHOTS, query="SELECT 'unchanged' AS change, count(*) AS items FROM v2"))
def same_run_twice(spark, sf_dir):
    """A capture against itself finds nothing new."""
    v2 = hashed(spark, sf_dir, 2)
    return C.monitor_changes(v2, v2.alias("again"), "item", "hash", "supersedes").groupBy("change").agg(F.count(F.lit(1)).alias("items"))


@query("version_log", S.with_(S.SNAPSHOTS, query="""
SELECT item, sha256(family || chr(31) || body) AS hash, min(seen) AS first_seen, max(seen) AS last_seen, max(seen) < '2' AS removed
FROM (SELECT item, family, body, '1' AS seen FROM v1 UNION ALL SELECT item, family, body, '2' FROM v2) GROUP BY item, family, body"""))
def version_log(spark, sf_dir):
    """Every version kept, touched when seen again, removed when not."""
    first = C.append_versions(hashed(spark, sf_dir, 1).limit(0).select("item", "hash", F.lit("0").alias("first_seen"), F.lit("0").alias("last_seen")), hashed(spark, sf_dir, 1), ["item", "hash"], "1")
    return C.append_versions(first, hashed(spark, sf_dir, 2), ["item", "hash"], "2")


@query("document_versions", "SELECT sha256(text) AS sha, count(*) AS refs, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(DISTINCT source) AS sources FROM documents GROUP BY text")
def document_versions(spark, sf_dir):
    """One version per content, with its references."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count_distinct("source").alias("sources"))


CUSTOMERS = """
cur AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 10 <> 0),
inc AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 4 <> 0)"""


def two_states(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return rows.where("id % 10 <> 0"), rows.where("id % 4 <> 0").withColumn("segment", F.when(F.col("id") % 7 != 0, F.col("segment")))


@query("merge_actions", S.with_(CUSTOMERS, query="SELECT coalesce(c.id, i.id) AS id, CASE WHEN i.id IS NOT NULL THEN i.segment ELSE c.segment END AS segment, CASE WHEN i.id IS NOT NULL THEN i.nation ELSE c.nation END AS nation, CASE WHEN c.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' WHEN c.segment IS DISTINCT FROM i.segment OR c.nation IS DISTINCT FROM i.nation THEN 'updated' ELSE 'unchanged' END AS action FROM cur c FULL OUTER JOIN inc i ON c.id = i.id"))
def merge_actions(spark, sf_dir):
    current, incoming = two_states(spark, sf_dir)
    return C.merge(current, incoming, "id", ["segment", "nation"])


@query("updates_become_drafts", S.with_(CUSTOMERS, query="SELECT i.id, CASE WHEN c.id IS NULL THEN 'created' WHEN c.segment IS DISTINCT FROM i.segment THEN 'updated' ELSE 'unchanged' END AS result, CASE WHEN c.id IS NOT NULL AND c.segment IS NOT DISTINCT FROM i.segment THEN 'published' ELSE 'draft' END AS state FROM inc i LEFT JOIN cur c ON c.id = i.id"))
def updates_become_drafts(spark, sf_dir):
    """An announcement whose words change loses its publication."""
    current, incoming = two_states(spark, sf_dir)
    rows = incoming.alias("i").join(current.alias("c"), F.col("i.id") == F.col("c.id"), "left")
    result = F.when(F.col("c.id").isNull(), "created").when(~F.col("c.segment").eqNullSafe(F.col("i.segment")), "updated").otherwise("unchanged")
    return rows.select("i.id", result.alias("result"), F.when(result == "unchanged", "published").otherwise("draft").alias("state"))


@query("field_differences", S.with_(CUSTOMERS, query="SELECT id, field, l AS \"left\", r AS \"right\" FROM (SELECT coalesce(c.id, i.id) AS id, unnest(['segment', 'nation']) AS field, unnest([c.segment, CAST(c.nation AS VARCHAR)]) AS l, unnest([i.segment, CAST(i.nation AS VARCHAR)]) AS r FROM cur c FULL OUTER JOIN inc i ON c.id = i.id) WHERE l IS DISTINCT FROM r"))
def field_differences(spark, sf_dir):
    current, incoming = two_states(spark, sf_dir)
    return C.field_differences(current, incoming, ["id"], ["segment", "nation"])


@query("insert_ignore", S.with_(CUSTOMERS, query="SELECT id, segment FROM inc WHERE id NOT IN (SELECT id FROM cur)"))
def insert_ignore(spark, sf_dir):
    current, incoming = two_states(spark, sf_dir)
    return C.insert_ignore(current, incoming.unionByName(incoming), ["id"]).select("id", "segment")


@query("push_outcomes", "SELECT id, CASE WHEN revision IS NULL AND base IS NOT NULL THEN 'rejected' WHEN revision IS NULL OR revision = base THEN 'applied' ELSE 'conflict' END AS outcome, CAST(CASE WHEN revision IS NULL AND base IS NOT NULL THEN NULL WHEN revision IS NULL THEN 1 WHEN revision = base THEN revision + 1 ELSE revision END AS BIGINT) AS revision FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 1 + c_custkey % 3 END AS base, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1 + c_custkey % 2 END AS revision FROM customer)")
def push_outcomes(spark, sf_dir):
    """Optimistic locking over a batch: each record's base revision against the current one."""
    key = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 11 != 0, 1 + key % 3).alias("base"), F.when(key % 5 != 0, 1 + key % 2).alias("revision"))
    return C.push_outcomes(rows.where("revision IS NOT NULL").select("id", "revision"), rows.select("id", "base"), "id")


@query("pull_plan", "SELECT id, CASE WHEN kr IS NOT NULL AND r <= kr THEN 'nothing' WHEN l IS NOT NULL AND l IS DISTINCT FROM kf THEN 'conflict' WHEN deleted THEN 'delete' ELSE 'upsert' END AS step FROM (SELECT o_orderkey AS id, 2 + o_orderkey % 3 AS r, o_orderstatus = 'F' AS deleted, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderpriority END AS l, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 3 END AS kr, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS kf FROM orders)")
def pull_plan(spark, sf_dir):
    rows, key = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    remote = rows.select(key.alias("id"), (2 + key % 3).alias("revision"), (F.col("o_orderstatus") == "F").alias("deleted"))
    local = rows.where(key % 7 != 0).select(key.alias("id"), F.when(key % 5 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("fingerprint"))
    known = rows.where(key % 6 != 0).select(key.alias("id"), F.lit(3).alias("revision"), F.col("o_orderpriority").alias("fingerprint"))
    return C.pull_plan(remote, local, known, "id")


@query("push_candidates", "SELECT id, action FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 7 <> 0 THEN 'create' WHEN o_orderkey % 7 = 0 AND o_orderkey % 6 <> 0 THEN 'delete' WHEN o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'update' END AS action FROM orders) WHERE action IS NOT NULL")
def push_candidates(spark, sf_dir):
    rows, key = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    local = rows.where(key % 7 != 0).select(key.alias("id"), F.when(key % 5 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("fingerprint"))
    known = rows.where(key % 6 != 0).select(key.alias("id"), F.col("o_orderpriority").alias("fingerprint"))
    return C.push_candidates(local, known, "id")


@query("incremental_pull", "SELECT collection, count(*) AS records, CAST(max(updated) AS VARCHAR) AS cursor FROM (SELECT o_orderstatus AS collection, o_orderdate AS updated FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01') GROUP BY collection")
def incremental_pull(spark, sf_dir):
    """Records strictly after the cursor, which reaches the scan, and each collection's next one."""
    rows = T.table(spark, sf_dir, "orders").where(F.col("o_orderdate") > F.lit("2000-06-01").cast("timestamp_ntz"))
    return rows.groupBy(F.col("o_orderstatus").alias("collection")).agg(F.count(F.lit(1)).alias("records"), F.max("o_orderdate").cast("string").alias("cursor"))


RUNS_SQL = """
runs AS (SELECT event_type AS family, ts, event_id, CASE WHEN value < 4 THEN 'failed' WHEN value < 6 THEN 'malformed' WHEN value < 7 THEN 'unauthorized' ELSE 'ok' END AS outcome,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)"""


def runs(spark, sf_dir):
    """The run ledger: family, started, outcome."""
    v = F.col("value")
    outcome = F.when(v < 4, "failed").when(v < 6, "malformed").when(v < 7, "unauthorized").otherwise("ok")
    return T.table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), "ts", "event_id", outcome.alias("outcome"))


@query("monitor_health", S.with_(RUNS_SQL, query="""
SELECT family, count(*) AS runs, CAST(max(ts) AS VARCHAR) AS last_run, max(outcome) FILTER (WHERE r = 1) AS last_outcome, CAST(max(ts) FILTER (WHERE outcome = 'ok') AS VARCHAR) AS last_success,
       count(*) FILTER (WHERE r < coalesce((SELECT min(x.r) FROM runs x WHERE x.family = runs.family AND x.outcome IN ('ok', 'unauthorized')), 9999999999) AND outcome NOT IN ('ok', 'unauthorized')) AS streak
FROM runs GROUP BY family""").replace("SELECT family, count(*) AS runs", "SELECT family, count(*) AS n_runs"))
def monitor_health(spark, sf_dir):
    """Last run, last success and the failures since the last ok or refusal, per family.

    Greatest structs and a conditional greatest time stand for the window over all runs, so one aggregate that is
    combined before its shuffle finds the last settled run, and a join with that small result counts what is newer.
    """
    rows = runs(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    settled = F.col("outcome").isin("ok", "unauthorized")
    last = rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max("ts").cast("string").alias("last_run"),
        F.max_by("outcome", "at").alias("last_outcome"),
        F.max(F.when(F.col("outcome") == "ok", F.col("ts"))).cast("string").alias("last_success"),
        F.max(F.when(settled, F.col("at"))).alias("settled_at"),
    )
    newer = rows.where(~settled).join(last.select("family", "settled_at"), "family").where(F.col("settled_at").isNull() | (F.col("at") > F.col("settled_at")))
    streak = newer.groupBy("family").agg(F.count(F.lit(1)).alias("streak"))
    return last.join(streak, "family", "left").drop("settled_at").withColumn("streak", F.coalesce("streak", F.lit(0).cast("bigint")))


@query("monitor_states", S.with_(RUNS_SQL, query="""
SELECT e.family, CASE WHEN l.family IS NULL THEN 'never_ran' WHEN date_diff('minute', l.ts, TIMESTAMP '2024-02-10 00:00:00') > 180 THEN 'stale' WHEN l.outcome = 'ok' THEN 'healthy' ELSE l.outcome END AS state
FROM (VALUES ('click'), ('error'), ('view'), ('signup'), ('purchase'), ('archive')) e(family) LEFT JOIN (SELECT * FROM runs WHERE r = 1) l ON l.family = e.family"""))
def monitor_states(spark, sf_dir):
    """Expected families with their state; one that never ran is there too."""
    expected = spark.createDataFrame([(f,) for f in ("click", "error", "view", "signup", "purchase", "archive")], "family string")
    last = runs(spark, sf_dir).groupBy("family").agg(F.max(F.struct("ts", "event_id", "outcome")).alias("m")).select("family", "m.ts", "m.outcome")
    late = F.expr("timestampdiff(MINUTE, date_trunc('MINUTE', ts), timestamp_ntz'2024-02-10 00:00:00')") > 180
    state = F.when(F.col("ts").isNull(), "never_ran").when(late, "stale").when(F.col("outcome") == "ok", "healthy").otherwise(F.col("outcome"))
    return expected.join(last, "family", "left").select("family", state.alias("state"))


@query("outcome_changes", S.with_(RUNS_SQL, query="SELECT family, count(*) AS changes FROM (SELECT family, outcome, lag(outcome) OVER (PARTITION BY family ORDER BY ts, event_id) AS before FROM runs) WHERE before IS DISTINCT FROM outcome GROUP BY family"))
def outcome_changes(spark, sf_dir):
    """A history that grows only when the last element differs: gaps and islands by lag."""
    w = W.partitionBy("family").orderBy("ts", "event_id")
    rows = runs(spark, sf_dir).withColumn("before", F.lag("outcome").over(w))
    return rows.where(~F.col("before").eqNullSafe(F.col("outcome"))).groupBy("family").agg(F.count(F.lit(1)).alias("changes"))


@query("worst_of", S.with_(RUNS_SQL, query="SELECT family, CASE max(CASE outcome WHEN 'failed' THEN 3 WHEN 'malformed' THEN 2 WHEN 'unauthorized' THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'malformed' WHEN 1 THEN 'unauthorized' ELSE 'ok' END AS worst FROM runs WHERE r <= 5 GROUP BY family"))
def worst_of(spark, sf_dir):
    """The worst of each family's last five runs; a top-k per key."""
    w = W.partitionBy("family").orderBy(F.desc("ts"), F.desc("event_id"))
    severity = F.when(F.col("outcome") == "failed", 3).when(F.col("outcome") == "malformed", 2).when(F.col("outcome") == "unauthorized", 1).otherwise(0)
    rows = runs(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 5")
    return rows.groupBy("family").agg(F.max_by("outcome", severity).alias("worst"))


@query("known_items", S.with_(RUNS_SQL, query="SELECT user_id, event_type, CAST(last(value ORDER BY ts, event_id) AS DOUBLE) AS latest, count(*) AS versions FROM events GROUP BY user_id, event_type"))
def known_items(spark, sf_dir):
    """Latest value of each key."""
    rows = T.table(spark, sf_dir, "events")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.count(F.lit(1)).alias("versions"))


@query("conflicts_recorded", "SELECT p_brand AS stream, p_name AS title, count(DISTINCT 1 + p_size % 4) AS readings, string_agg(DISTINCT CAST(1 + p_size % 4 AS VARCHAR), ',' ORDER BY CAST(1 + p_size % 4 AS VARCHAR)) AS credits FROM part GROUP BY p_brand, p_name HAVING count(DISTINCT 1 + p_size % 4) > 1")
def conflicts_recorded(spark, sf_dir):
    """Identities with more than one reading of a value, and the readings."""
    rows = T.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("stream"), F.col("p_name").alias("title")).agg(F.sort_array(F.collect_set((1 + F.col("p_size") % 4).cast("string"))).alias("c"))
    return rows.where(F.size("c") > 1).select("stream", "title", F.size("c").cast("bigint").alias("readings"), F.array_join("c", ",").alias("credits"))
