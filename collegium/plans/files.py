"""Queries over files, positioned text, printed cards and the monitor's stream."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.operators import documents as P
from collegium.operators.syllabi import topics_of
from collegium.plans import changes as C
from collegium.plans import sql as S
from collegium.plans.printed import column, unnested
from collegium.registry import query
from collegium.sources import files as Z
from collegium.sources import tables as T
from collegium.sources.scratch import new_dir
from collegium.streaming import monitor as M


def written_texts(spark, sf_dir, text, name):
    """A folder with one text file for each nation."""
    path = new_dir(spark, name)
    rows = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), text.alias("value"))
    rows.repartition("n").write.partitionBy("n").text(path)
    return path


@query("snapshot_files", """
SELECT n_nationkey AS n, CASE n_nationkey % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'incomplete' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS family, CASE WHEN n_nationkey % 4 > 1 THEN 1 ELSE 0 END AS n_items FROM nation""")
def snapshot_files(spark, sf_dir):
    """Captures as JSON files: what is no JSON and what lacks a field keep a row with their status, never an empty success."""
    n = F.col("n_nationkey")
    item = F.concat(F.lit('{"externalId": "x", "url": "https://a.example", "title": '), F.when(n % 4 == 1, "null").otherwise('"t"'), F.lit("}"))
    text = F.when(n % 4 == 0, "{no json").otherwise(F.concat(F.lit('{"family": "'), F.col("n_name"), F.lit('", "capturedAt": "2024", "items": ['), item, F.lit("]}")))
    found = Z.read_snapshots(spark, written_texts(spark, sf_dir, text, "snapshots"))
    items = Z.snapshot_items(found.select("n", "family", "items", "status")).groupBy("family").agg(F.count(F.lit(1)).alias("n_items"))
    return found.select("n", "status", "family").join(items, "family", "left").select("n", "status", "family", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("stored_blobs", "SELECT n_nationkey % 6 AS content, sha256(CASE WHEN n_nationkey % 6 < 2 THEN '%PDF-' ELSE 'text ' END || (n_nationkey % 6) || chr(10)) AS sha256, count(*) AS files, bool_and(n_nationkey % 6 < 2) AS looks_like_pdf FROM nation GROUP BY n_nationkey % 6")
def stored_blobs(spark, sf_dir):
    """Blobs by content: files with the same bytes are one blob, in a folder by the first digits of its digest."""
    n = F.col("n_nationkey") % 6
    path = written_texts(spark, sf_dir, F.concat(F.when(n < 2, "%PDF-").otherwise("text "), n.cast("string")), "files")
    blobs = Z.read_blobs(spark, path)
    store = new_dir(spark, "blobs")
    Z.write_blobs(blobs, store)
    kept = spark.read.parquet(store).select("sha256", F.trim(F.substring(F.decode("content", "utf-8"), 6, 1)).cast("int").alias("content"))
    files = blobs.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.bool_and("looks_like_pdf").alias("looks_like_pdf"))
    return kept.join(files, "sha256").select("content", "sha256", "files", "looks_like_pdf")


@query("manifest_outcomes", """
WITH known AS (SELECT o_orderkey AS url, 's' || (o_orderkey % 50) AS sha FROM orders WHERE o_orderkey % 5 > 0),
fetched AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'n' || o_orderkey ELSE 's' || (o_orderkey % 50) END AS sha FROM orders WHERE o_orderkey % 6 > 0)
SELECT coalesce(f.url, k.url)::VARCHAR AS url, coalesce(f.sha, k.sha) AS sha256, CASE WHEN f.url IS NULL THEN 'gone' WHEN f.sha IS NULL THEN 'failed' WHEN k.sha = f.sha THEN 'unchanged' WHEN k.sha IS NOT NULL THEN 'changed' WHEN f.sha IN (SELECT sha FROM known) THEN 'duplicate' ELSE 'new' END AS outcome
FROM fetched f FULL OUTER JOIN known k ON f.url = k.url""")
def manifest_outcomes(spark, sf_dir):
    """A download round against the manifest: six outcomes for addresses and contents."""
    key = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(key, key.cast("string").alias("url"), F.concat(F.lit("s"), (key % 50).cast("string")).alias("sha256"))
    fetched = rows.where("o_orderkey % 6 > 0").withColumn("sha256", F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.concat(F.lit("n"), key.cast("string"))).otherwise(F.col("sha256"))).withColumn("status", F.lit("done"))
    return Z.manifest(rows.where("o_orderkey % 5 > 0").select("url", "sha256"), fetched.select("url", "sha256", "status"))


@query("source_refusals", """
SELECT n_name AS family, n_nationkey % 7 = 6 AS permitted, (['not_registered', 'disabled', 'no_permission', 'robots', 'no_adapter', 'not_live', NULL])[n_nationkey % 7 + 1] AS reason FROM nation""")
def source_refusals(spark, sf_dir):
    """The first gate that is shut for each family of notices; one that is not registered is refused."""
    n = F.col("n_nationkey") % 7
    families = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("family"), n.alias("k"))
    k = F.col("k")
    registry = families.where("k > 0").select("family", (k > 1).alias("enabled"), F.when(k > 2, True).alias("permission_recorded"), (k > 3).alias("robots_allow"), F.when(k > 4, "html").alias("adapter"), F.when(k > 5, "live").otherwise("fixture").alias("mode"))
    return Z.refusal(registry, families.select("family"))


@query("owned_collections", "WITH changed AS (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0) SELECT o_custkey AS owner, o_orderkey AS id, CASE WHEN o_custkey IN (SELECT o_custkey FROM changed) THEN 2 ELSE 1 END AS version FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM changed) OR o_orderkey % 2 = 0")
def owned_collections(spark, sf_dir):
    """A collection of which some owners' rows are replaced; the others' stay as they are."""
    path = new_dir(spark, "collection")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"))
    Z.write_collection(rows.withColumn("version", F.lit(1)), path, folder_rows=2000)
    Z.write_collection(rows.where("owner % 3 = 0 AND id % 2 = 0").withColumn("version", F.lit(2)), path)
    return Z.read_collection(spark, path).select("owner", "id", "version")


RUNS = "runs AS (SELECT p_partkey // 40 AS doc, 1 + p_partkey // 20 % 2 AS page, p_partkey // 5 % 4 AS row, p_partkey % 5 AS col, p_name AS text, p_size FROM part)"


def runs(spark, sf_dir):
    """Positioned words: four rows of five on each page, a little out of line and with all sorts of gaps."""
    key = F.col("p_partkey")
    row, col = F.floor(key / 5) % 4, key % 5
    return T.table(spark, sf_dir, "part").select(
        F.floor(key / 40).alias("doc"), (1 + F.floor(key / 20) % 2).cast("int").alias("page"), F.col("p_name").alias("text"),
        (50.0 + col * 90).alias("x"), (700.0 - row * 30 - col * 0.5).alias("y"), F.lit(60.0).alias("width"), F.lit(10.0).alias("height"), (F.col("p_size") * 2).cast("double").alias("confidence"),
    )


@query("printed_lines", S.with_(RUNS, query="SELECT doc, page, CAST(row AS INTEGER) AS line, string_agg(text, ' ' ORDER BY col) AS text, CAST(count(*) AS INTEGER) AS runs FROM runs GROUP BY doc, page, row"))
def printed_lines(spark, sf_dir):
    """Words of a page as lines from its top; a word joins the line whose first word it is level with."""
    return P.lines_of_runs(runs(spark, sf_dir)).select("doc", "page", "line", "text", "runs")


@query("recognised_words", S.with_(RUNS, query="SELECT doc, page, text, 50.0::DOUBLE + col * 90 AS x, 800 - (100.0::DOUBLE + row * 30) AS y, 60.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM runs WHERE col > 0"))
def recognised_words(spark, sf_dir):
    """Recognised words with boxes from the top of a page as runs from its bottom; empty ones go."""
    key = F.col("p_partkey")
    row, col = F.floor(key / 5) % 4, key % 5
    words = T.table(spark, sf_dir, "part").select(F.floor(key / 40).alias("doc"), (1 + F.floor(key / 20) % 2).alias("page"), F.when(col == 0, " ").otherwise(F.col("p_name")).alias("text"), (50.0 + col * 90).alias("x0"), (110.0 + col * 90).alias("x1"), (90.0 + row * 30).alias("y0"), (100.0 + row * 30).alias("y1"), F.lit(800.0).alias("page_height"), F.lit(1.0).alias("confidence"))
    return P.words_to_runs(words).drop("confidence")


@query("page_qualities", S.with_(RUNS, query="SELECT doc, page, count(*) AS words, sum(p_size * 2) AS total, count(*) >= 20 AND avg(p_size * 2) >= 40 AS worth_reviewing FROM runs GROUP BY doc, page"))
def page_qualities(spark, sf_dir):
    """Words and confidence of each page, and whether a review is worth it."""
    return P.page_quality(runs(spark, sf_dir)).select("doc", "page", "words", F.round(F.col("words") * F.col("confidence")).cast("bigint").alias("total"), "worth_reviewing")


@query("card_rows", S.with_(S.ATTEMPTS, query="""
SELECT order_key, line, CASE WHEN tax = 1 THEN NULL ELSE 'Course of ' || flag END AS title, 'BCS' || lpad((part % 900)::VARCHAR, 3, '0') AS code, CASE WHEN tax <> 2 THEN CAST(internal AS INTEGER) END AS internal, CASE WHEN tax <> 2 THEN CAST(external AS INTEGER) END AS external, CASE WHEN tax <> 2 THEN CAST(total AS INTEGER) END AS total, CASE WHEN tax = 3 THEN 'F' ELSE 'P' END AS result, tax <> 2 AS readable FROM attempts WHERE line <> 7"""))
def card_rows(spark, sf_dir):
    """Lines of result cards as rows: the rightmost numbers that add up; others stay, unreadable, with nulls."""
    code = F.concat(F.lit("BCS"), F.lpad((F.col("part") % 900).cast("string"), 3, "0"))
    total = F.when(F.col("tax") == 2, F.col("total") + 1).otherwise(F.col("total"))
    text = F.concat_ws(" ", code, F.when(F.col("tax") != 1, F.concat(F.lit("Course of "), F.col("flag"))), F.col("internal").cast("string"), F.lit("|"), F.col("external").cast("string"), total.cast("string"), F.when(F.col("tax") == 3, "F").otherwise("P"), F.lit("2024-02-01"))
    lines = T.attempts(spark, sf_dir).select("order_key", F.col("line").alias("number"), F.when(F.col("line") == 7, "Semester 5").otherwise(text).alias("text"))
    return P.card_rows(lines).select("order_key", F.col("number").alias("line"), "title", "code", "internal", "external", "total", "result", "readable")


@query("nearest_slots", """
WITH cells AS (SELECT o_custkey AS doc, o_orderkey AS cell, o_orderkey * 37 % 500 AS centre FROM orders), slots AS (SELECT unnest(range(0, 5)) AS slot),
m AS (SELECT doc, cell, slot, greatest(0, slot * 100 - centre, centre - (slot * 100 + 60)) AS gap, slot * 100 AS l FROM cells, slots)
SELECT doc, cell, slot, gap = 0 AS inside FROM m QUALIFY row_number() OVER (PARTITION BY doc, cell ORDER BY gap, l) = 1""")
def nearest_slots(spark, sf_dir):
    """Each cell of a grid with the slot that spans it, else the nearest one."""
    orders = T.table(spark, sf_dir, "orders")
    cells = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("cell"), (F.col("o_orderkey") * 37 % 500).cast("double").alias("centre"))
    slots = orders.select(F.col("o_custkey").alias("doc")).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
    return P.nearest_slot(cells, slots.select("doc", "slot", (F.col("slot") * 100.0).alias("left"), (F.col("slot") * 100.0 + 60).alias("right")))


TOPIC_LINES = ["p_name || ' : of ' || p_type", "p_type || ', ' || p_name || ': prose'", "upper(p_type) || ', ' || upper(p_name) || ': in capitals'", "upper(p_name) || ': again'", "'Vol. ' || p_name || ': a stop'", "'Note: none'", "'See ' || p_brand || '; ' || p_name || ': no heading'", "p_brand || ':'", "'ab: short'", "p_name || p_name || p_name || p_name || p_type || p_name || ': too long'"]


@query("module_topics", f"""
WITH lines AS (SELECT p_partkey AS doc, {unnested(TOPIC_LINES)} FROM part),
heads AS (SELECT *, trim(split_part(text, ':', 1)) AS topic FROM lines),
kept AS (
  SELECT * FROM heads WHERE len(topic) BETWEEN 3 AND 50 AND topic NOT LIKE '%.%' AND topic NOT LIKE '%;%' AND (topic NOT LIKE '%,%' OR topic = upper(topic)) AND regexp_matches(topic, '[A-Za-z]{{3}}') AND NOT starts_with(lower(text), 'note')
  QUALIFY row_number() OVER (PARTITION BY doc, lower(topic) ORDER BY line) = 1)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY line) AS INTEGER) AS place, topic FROM kept""")
def module_topics(spark, sf_dir):
    """Topics of a module: headings before a colon, never prose, in order; of equal ones, in any case, the first stays."""
    lines = F.posexplode(F.array(*[column(x) for x in TOPIC_LINES])).alias("n", "text")
    return topics_of(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), lines), ["doc"])


WRAPS = "SELECT p_partkey AS doc, p_partkey % 4 AS form, p_name, p_type FROM part"


@query("wrapped_lines", f"""
WITH d AS ({WRAPS}),
lines AS (
  SELECT doc, 1 AS o, 'CODE' || doc || ' ' || p_name || CASE form WHEN 0 THEN ' ' || p_type || ' C' WHEN 1 THEN ' ' || p_type ELSE '' END || ' 39 66' || CASE WHEN form = 1 THEN ' late' ELSE '' END AS text, CASE form WHEN 0 THEN 6 WHEN 1 THEN 6 ELSE 4 END AS runs FROM d
  UNION ALL SELECT doc, 2, p_type, 1 FROM d WHERE form IN (2, 3) UNION ALL SELECT doc, 3, 'NEXT row', 2 FROM d)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY o) - 1 AS INTEGER) AS line, text, CAST(runs AS INTEGER) AS runs FROM lines""")
def wrapped_lines(spark, sf_dir):
    """Rows whose cells go on in rows below: those under columns of the line above, but not its first one, join it."""
    rows = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_partkey") % 4).alias("form"), "p_name", "p_type")
    run = lambda text, x, y, width: F.struct(text.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(width)).alias("width"))
    form, name, kind = F.col("form"), F.col("p_name"), F.col("p_type")
    cells = [
        run(F.concat(F.lit("CODE"), F.col("doc").cast("string")), 20, 700, 60), run(name, 100, 699, 80), run(F.lit("39"), 220, 700, 15), run(F.lit("66"), 260, 700, 15),
        run(F.when(form < 2, kind), 100, 688, 80), run(F.when(form == 0, "C"), 100, 676, 10), run(F.when(form == 1, "late"), 263, 676, 20),  # wrapped, twice, in two columns
        run(F.when(form == 2, kind), 150, 688, 80), run(F.when(form == 3, kind), 21, 688, 80),  # under no column, under the first one
        run(F.lit("NEXT"), 20, 660, 40), run(F.lit("row"), 60.5 + 5, 660, 20), run(F.lit("  "), 300, 650, 90),
    ]
    runs = rows.select("doc", F.inline(F.array(*cells))).where("text IS NOT NULL").withColumns({"page": F.lit(1), "height": F.lit(10.0)})
    return P.lines_of_runs(runs).select("doc", "line", "text", "runs")


@query("better_readings", "SELECT o_custkey AS doc, arg_max(o_orderkey, (o_orderkey % 5, -(o_orderkey % 3), o_orderkey % 11, -o_orderkey)) AS reading FROM orders GROUP BY o_custkey")
def better_readings(spark, sf_dir):
    """Of several readings of a document, that with most rows, then fewest dropped, then most words."""
    key = F.col("o_orderkey")
    return P.better_reading(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), key.alias("reading"), (key % 5).alias("rows"), (key % 3).alias("dropped"), (key % 11).alias("words")))


@query("listener_deliveries", """
WITH listeners AS (SELECT user_id, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 4)
SELECT e.event_id, count(l.event_id) AS delivered FROM events e LEFT JOIN listeners l ON l.user_id = e.user_id WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def listener_deliveries(spark, sf_dir):
    """Events routed to the listeners of their user, of whom the first four are held and later ones refused."""
    events = T.table(spark, sf_dir, "events")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    held = events.where("event_type = 'view'").withColumn("nth", nth).where("nth <= 4").groupBy("user_id").agg(F.count(F.lit(1)).alias("delivered"))
    return events.where("event_type = 'purchase'").join(held, "user_id", "left").select("event_id", F.coalesce("delivered", F.lit(0)).alias("delivered"))


def watched(spark, sf_dir):
    """The ledger of a monitor that has seen two captures, each in files of many tasks, and was started again between them."""
    path, ledger, progress = (new_dir(spark, name) for name in ("captures", "ledger", "progress"))
    for version in (1, 2):
        items = T.snapshot(spark, sf_dir, version)
        family = F.concat(F.lit("f"), (F.floor(F.col("item") / 100) % 5).cast("string")).alias("family")
        rows = items.select(family, F.col("item").cast("string").alias("item"), "url", "body", F.col("supersedes").cast("string").alias("supersedes"), F.lit(f"2024-01-0{version}T00:00:00Z").alias("captured"))
        rows.withColumnRenamed("url", "title").write.mode("append").json(path)
        M.start_monitor(M.read_captures(spark, path), ledger, progress, parts=4).awaitTermination()
    return M.read_ledger(spark, ledger)


@query("streamed_changes", S.with_(S.SNAPSHOTS, C.MONITOR_SQL, query="""
SELECT 'f' || (item // 100 % 5) AS family, item::VARCHAR AS item, change, capture FROM (SELECT item, 'new' AS change, 1 AS capture FROM v1 UNION ALL SELECT item, change, 2 FROM monitored)"""))
def streamed_changes(spark, sf_dir):
    """Two captures of the documents through the stateful monitor: new, unchanged, updated, revised and removed items."""
    return watched(spark, sf_dir).select("family", "item", "change", F.dayofmonth("captured").alias("capture"))


@query("streamed_versions", S.with_(S.SNAPSHOTS, query="""
SELECT 'f' || (coalesce(b.item, a.item) // 100 % 5) AS family, coalesce(b.item, a.item)::VARCHAR AS item, CASE WHEN a.item IS NULL THEN 2 ELSE 1 END AS first_seen, b.item IS NOT NULL AS there FROM v1 a FULL OUTER JOIN v2 b ON a.item = b.item"""))
def streamed_versions(spark, sf_dir):
    """Each item as the stream's ledger leaves it: when it was seen first, and whether it is still there."""
    return M.latest_versions(watched(spark, sf_dir)).select("family", "item", F.dayofmonth("first_seen").alias("first_seen"), "there")


@query("captures_by_day", "SELECT event_type AS family, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS captures FROM events GROUP BY ALL")
def captures_by_day(spark, sf_dir):
    """Captures of each family and day; the same aggregate runs over a stream with a watermark."""
    captures = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), F.col("ts").cast("timestamp").alias("captured"))
    return M.daily_counts(captures).select("family", F.to_date("day.start").cast("string").alias("day"), "captures")
