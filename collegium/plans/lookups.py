"""Point lookups, public lists, nested projections, one owner's records and what may leave the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T


def as_json(struct: Column) -> Column:
    """A struct as JSON text, absent values as null."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def visible(presentation: Column, state: Column) -> Column:
    """Whether a document may be listed or opened by anybody."""
    return presentation.isin("host", "link") & state.isin("validated", "extracted")


def published_and_verified(publication: Column, verified: Column) -> Column:
    """The gate that lists, counts and lookups of announcements share."""
    return (publication == "published") & (verified == "verified")


@query("list_universities", "SELECT r_regionkey AS id, r_name AS name, lower(left(r_name, 3)) AS short_name FROM region WHERE r_regionkey <> 3 ORDER BY r_name")
def list_universities(spark, sf_dir):
    """The active ones by name."""
    return T.table(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lower(F.left("r_name", F.lit(3))).alias("short_name")).orderBy("name")


@query("list_branches", "SELECT c_mktsegment AS code, count(*) AS students FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment ORDER BY c_mktsegment")
def list_branches(spark, sf_dir):
    """The active branches by name."""
    return T.table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("code")).agg(F.count(F.lit(1)).alias("students")).orderBy("code")


@query("list_colleges", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_suppkey % 4 = 0 AS is_autonomous FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 ORDER BY s_name")
def list_colleges(spark, sf_dir):
    """Published and active, by name."""
    key = F.col("s_suppkey")
    return T.table(spark, sf_dir, "supplier").where((key % 3 > 0) & (key % 5 > 0)).select(key.cast("string").alias("id"), F.col("s_name").alias("name"), (key % 4 == 0).alias("is_autonomous")).orderBy("name")


@query("find_subject_by_id", "SELECT p_partkey AS id, p_name AS title, p_brand AS stream FROM part WHERE p_partkey = 77")
def find_subject_by_id(spark, sf_dir):
    """A point lookup; the key reaches the scan."""
    return T.table(spark, sf_dir, "part").where(F.col("p_partkey") == 77).limit(1).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("stream"))


@query("list_sources", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS authority FROM nation ORDER BY n_regionkey, n_name")
def list_sources(spark, sf_dir):
    return T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("authority")).orderBy("authority", "name")


@query("find_source", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey = 7")
def find_source(spark, sf_dir):
    return T.table(spark, sf_dir, "nation").where(F.col("n_nationkey") == 7).limit(1).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


PUBLIC_SQL = """
stored AS (SELECT o_orderkey AS id, o_orderdate AS discovered, CASE o_orderkey % 4 WHEN 0 THEN 'hidden' WHEN 1 THEN 'host' WHEN 2 THEN 'link' ELSE 'refused' END AS presentation,
  CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'extracted' ELSE 'quarantined' END AS state FROM orders)"""


def stored(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    presentation = F.element_at(F.array(*[F.lit(x) for x in ("hidden", "host", "link", "refused")]), (key % 4 + 1).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "extracted").otherwise("quarantined")
    return T.table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderdate").alias("discovered"), presentation.alias("presentation"), state.alias("state"))


@query("public_documents", S.with_(PUBLIC_SQL, query="SELECT id, CAST(CAST(discovered AS DATE) AS VARCHAR) AS discovered FROM stored WHERE presentation IN ('host', 'link') AND state IN ('validated', 'extracted') ORDER BY stored.discovered DESC, id"))
def public_documents(spark, sf_dir):
    """Documents that may be listed, newest first; equal days by id."""
    rows = stored(spark, sf_dir).where(visible(F.col("presentation"), F.col("state")))
    return rows.orderBy(F.desc("discovered"), "id").select("id", F.to_date("discovered").cast("string").alias("discovered"))


@query("find_public_document", S.with_(PUBLIC_SQL, query="SELECT id, state FROM stored WHERE id IN (401, 402, 403, 404) AND presentation IN ('host', 'link') AND state IN ('validated', 'extracted')"))
def find_public_document(spark, sf_dir):
    """Lookups that find nothing where a document is not to be seen."""
    rows = stored(spark, sf_dir).where(F.col("id").isin(401, 402, 403, 404))
    return rows.where(visible(F.col("presentation"), F.col("state"))).select("id", "state")


ANNOUNCED_SQL = "announced AS (SELECT notice, title, CASE WHEN notice % 3 = 0 THEN 'draft' ELSE 'published' END AS publication, CASE WHEN notice % 4 = 0 THEN 'unverified' ELSE 'verified' END AS verification FROM notices)"


def announced(spark, sf_dir) -> DataFrame:
    key = F.col("notice")
    return T.notices(spark, sf_dir).select("notice", "title", F.when(key % 3 == 0, "draft").otherwise("published").alias("publication"), F.when(key % 4 == 0, "unverified").otherwise("verified").alias("verification"))


@query("published_announcements", S.with_(S.NOTICES, ANNOUNCED_SQL, query="SELECT notice, title FROM announced WHERE publication = 'published' AND verification = 'verified'"))
def published_announcements(spark, sf_dir):
    return announced(spark, sf_dir).where(published_and_verified(F.col("publication"), F.col("verification"))).select("notice", "title")


@query("find_published_announcement", S.with_(S.NOTICES, ANNOUNCED_SQL, query="SELECT notice, title FROM announced WHERE notice IN (13, 15, 16, 17) AND publication = 'published' AND verification = 'verified'"))
def find_published_announcement(spark, sf_dir):
    rows = announced(spark, sf_dir).where(F.col("notice").isin(13, 15, 16, 17))
    return rows.where(published_and_verified(F.col("publication"), F.col("verification"))).select("notice", "title")


@query("scheme_provenance", """
SELECT s_suppkey AS id, to_json({'sourceUrl': 'https://source.example/' || s_suppkey, 'sourceClause': CASE WHEN s_suppkey % 3 > 0 THEN 'clause ' || s_nationkey END, 'verifiedAt': strftime(DATE '2023-01-01' + CAST(s_suppkey AS INTEGER), '%Y-%m-%d'), 'verifiedBy': NULL::VARCHAR})::VARCHAR AS provenance FROM supplier""")
def scheme_provenance(spark, sf_dir):
    """Where a scheme's values come from, as one nested value of each row."""
    key = F.col("s_suppkey")
    provenance = F.struct(
        F.concat(F.lit("https://source.example/"), key.cast("string")).alias("sourceUrl"),
        F.when(key % 3 > 0, F.concat(F.lit("clause "), F.col("s_nationkey").cast("string"))).alias("sourceClause"),
        F.date_add(F.lit("2023-01-01").cast("date"), key.cast("int")).cast("string").alias("verifiedAt"),
        F.lit(None).cast("string").alias("verifiedBy"),
    )
    return T.table(spark, sf_dir, "supplier").select(key.alias("id"), as_json(provenance).alias("provenance"))


RULE_SETS_SQL = "sets AS (SELECT s_suppkey AS id, s_suppkey % 8 AS scheme, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS college, s_suppkey % 5 AS version, s_suppkey % 7 > 0 AS active, s_suppkey % 4 > 0 AS verified FROM supplier)"


def rule_sets(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    return T.table(spark, sf_dir, "supplier").select(key.alias("id"), (key % 8).alias("scheme"), F.when(key % 3 > 0, F.col("s_nationkey")).alias("college"), (key % 5).alias("version"), (key % 7 > 0).alias("active"), (key % 4 > 0).alias("verified"))


@query("active_rule_set_of_scheme", S.with_(RULE_SETS_SQL, query="SELECT scheme, min(id) AS id FROM sets WHERE active AND verified GROUP BY scheme"))
def active_rule_set_of_scheme(spark, sf_dir):
    """The first active and verified rule set of each scheme."""
    return rule_sets(spark, sf_dir).where("active AND verified").groupBy("scheme").agg(F.min("id").alias("id"))


@query("rule_set_of_college", S.with_(RULE_SETS_SQL, query="""
SELECT scheme, id, to_json({'formulaIds': {'sgpa': 'weighted', 'cgpa': 'weighted', 'percentage': 'times_ten_less_' || version}, 'thresholds': {'cieMax': CAST(50 AS DOUBLE), 'seeMinPct': 35 + version / 2.0::DOUBLE}, 'collegeId': college})::VARCHAR AS rules
FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY college IS NULL, version DESC, id) AS r FROM sets WHERE active AND (college IS NULL OR college = 5)) WHERE r = 1"""))
def rule_set_of_college(spark, sf_dir):
    """The rule set of each scheme for one college: its own before that of all, with nested formulas and thresholds."""
    rows = rule_sets(spark, sf_dir).where(F.col("active") & (F.col("college").isNull() | (F.col("college") == 5)))
    first = rows.groupBy("scheme").agg(F.min(F.struct(F.col("college").isNull().alias("common"), (-F.col("version")).alias("newest"), "id", "version", "college")).alias("m"))
    rules = F.struct(
        F.struct(F.lit("weighted").alias("sgpa"), F.lit("weighted").alias("cgpa"), F.concat(F.lit("times_ten_less_"), F.col("m.version").cast("string")).alias("percentage")).alias("formulaIds"),
        F.struct(F.lit(50).cast("double").alias("cieMax"), (35 + F.col("m.version") / 2).alias("seeMinPct")).alias("thresholds"),
        F.col("m.college").alias("collegeId"),
    )
    return first.select("scheme", "m.id", as_json(rules).alias("rules"))


@query("read_profile", S.with_(S.PROFILES, query="SELECT * FROM profiles WHERE student = 44"))
def read_profile(spark, sf_dir):
    """The one row of an owner; the predicate reaches the scan."""
    return T.owned(T.profiles(spark, sf_dir), 44).limit(1)


@query("read_one_record", "SELECT o_orderkey AS id, 'orders' AS collection, 1 + o_orderkey % 9 AS revision, o_orderstatus = 'F' AS deleted, to_json({'orderPriority': o_orderpriority, 'totalPrice': CAST(floor(o_totalprice) AS BIGINT)})::VARCHAR AS data FROM orders WHERE o_orderkey = 311 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 311)")
def read_one_record(spark, sf_dir):
    """One record as synchronisation sends it: its bookkeeping, and its declared columns under their field names."""
    rows = T.table(spark, sf_dir, "orders").where(F.col("o_orderkey") == 311)
    data = F.struct(F.col("o_orderpriority").alias("orderPriority"), F.floor("o_totalprice").alias("totalPrice"))
    return rows.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("collection"), (1 + F.col("o_orderkey") % 9).alias("revision"), (F.col("o_orderstatus") == "F").alias("deleted"), as_json(data).alias("data"))


#: Constraints by what their violation is told as, in order of precedence.
REASONS = [
    ("attendance_attended_within_conducted", "Classes attended cannot be more than classes held."),
    ("timetable_slot_ends_after_it_starts", "A timetable slot has to end after it starts."),
    ("duplicate key", "A record like this already exists."),
    ("result_subjects_belong_to_their_result", "That subject does not belong to one of your results."),
    ("foreign key", "That record refers to something that does not exist."),
]
INVALID = "That record was not valid and was not saved."


@query("rejection_reasons", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Classes attended cannot be more than classes held.' WHEN 1 THEN 'A timetable slot has to end after it starts.' WHEN 2 THEN 'A record like this already exists.'
 WHEN 3 THEN 'That subject does not belong to one of your results.' WHEN 4 THEN 'That record refers to something that does not exist.' ELSE 'That record was not valid and was not saved.' END AS reason FROM events""")
def rejection_reasons(spark, sf_dir):
    """What a refused write is told as, by the constraint that its message names."""
    n = F.col("event_id") % 7
    names = F.array(*[F.lit(k) for k, _ in REASONS])
    message = F.when(n < 5, F.concat(F.lit("violates "), F.element_at(names, F.least(n + 1, F.lit(5)).cast("int")), F.lit(" on row "), F.col("event_id").cast("string"))).when(n == 5, "timeout")
    told = F.coalesce(*[F.when(F.contains(message, F.lit(k)), F.lit(text)) for k, text in REASONS], F.lit(INVALID))
    return T.table(spark, sf_dir, "events").select("event_id", told.alias("reason"))


@query("matching_context", S.with_(S.PROFILES, query="SELECT student, branch, college, semester FROM profiles"))
def matching_context(spark, sf_dir):
    """All that the worker which matches notices may see of a student."""
    return T.profiles(spark, sf_dir).select("student", "branch", "college", "semester")


@query("course_context", "SELECT o_custkey AS student, o_orderkey AS course, o_orderstatus = 'O' AS backlog FROM orders WHERE o_orderstatus <> 'F'")
def course_context(spark, sf_dir):
    """Enrolled and owed courses that are not deleted, without anything else of the student."""
    return T.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("course"), (F.col("o_orderstatus") == "O").alias("backlog"))


@query("courses_of_addressees", "SELECT o_custkey AS student, count(*) AS courses FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY o_custkey")
def courses_of_addressees(spark, sf_dir):
    """Courses of a list of students, the list being a table: a semi-join, not a long IN."""
    asked = T.table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("o_custkey"))
    return T.table(spark, sf_dir, "orders").join(asked, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("student")).agg(F.count(F.lit(1)).alias("courses"))


@query("student_audience", S.with_(S.PROFILES, query="""
SELECT p.student, p.branch, p.college, p.semester, coalesce(e.enrolled, '') AS enrolled, coalesce(b.owed, '') AS owed
FROM profiles p LEFT JOIN (SELECT o_custkey AS student, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS enrolled FROM orders JOIN profiles q ON q.student = o_custkey WHERE o_orderkey % 10 > 0 AND 1 + o_orderkey % 8 = q.semester GROUP BY o_custkey) e ON e.student = p.student
LEFT JOIN (SELECT o_custkey AS student, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS owed FROM orders WHERE o_orderkey % 10 > 0 AND o_orderstatus = 'P' GROUP BY o_custkey) b ON b.student = p.student"""))
def student_audience(spark, sf_dir):
    """A profile with the courses of its current semester and those that are still owed, from one pass over the records."""
    who = T.profiles(spark, sf_dir)
    key = F.col("o_orderkey")
    records = T.table(spark, sf_dir, "orders").where(key % 10 > 0).select(F.col("o_custkey").alias("student"), key.alias("course"), (1 + key % 8).alias("taken"), (F.col("o_orderstatus") == "P").alias("owed"))
    held = records.join(who.select("student", "semester"), "student").groupBy("student")
    listed = lambda kept: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.col("course")))), lambda x: x.cast("string")), ",")
    held = held.agg(listed(F.col("taken") == F.col("semester")).alias("enrolled"), listed(F.col("owed")).alias("owed"))
    return who.join(held, "student", "left").select(*who.columns, F.coalesce("enrolled", F.lit("")).alias("enrolled"), F.coalesce("owed", F.lit("")).alias("owed"))


@query("delivered_events", "SELECT event_id, to_json({'kind': event_type, 'at': strftime(ts, '%Y-%m-%d')})::VARCHAR AS payload FROM events WHERE event_type IN ('signup', 'purchase')")
def delivered_events(spark, sf_dir):
    """What goes to a client: the event without the user whom it is addressed to."""
    rows = T.table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase")).drop("user_id")
    return rows.select("event_id", as_json(F.struct(F.col("event_type").alias("kind"), F.to_date("ts").cast("string").alias("at"))).alias("payload"))


@query("owner_export", """
SELECT c_custkey AS owner, to_json({'profile': {'name': c_name, 'branch': c_mktsegment}, 'records': coalesce(r.records, [])})::VARCHAR AS document
FROM customer LEFT JOIN (SELECT o_custkey, list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey) AS records FROM orders GROUP BY o_custkey) r ON r.o_custkey = c_custkey""")
def owner_export(spark, sf_dir):
    """Everything of each owner as one nested document; an owner without records has an empty list."""
    record = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    held = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(record)).alias("records"))
    rows = T.table(spark, sf_dir, "customer").join(held, "c_custkey", "left")
    empty = F.array().cast("array<struct<id:bigint,status:string>>")
    document = F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("branch")).alias("profile"), F.coalesce("records", empty).alias("records"))
    return rows.select(F.col("c_custkey").alias("owner"), as_json(document).alias("document"))


@query("account_cleared", "SELECT user_id, event_type, count(*) AS n FROM events WHERE NOT starts_with(user_id || '/', '1') GROUP BY ALL")
def account_cleared(spark, sf_dir):
    """What a store of collections holds after every key with a prefix has been deleted."""
    scope = F.concat(F.col("user_id").cast("string"), F.lit("/"))
    return T.table(spark, sf_dir, "events").where(~F.startswith(scope, F.lit("1"))).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
