"""Queries over public notices: classification, audiences, feeds and delivery."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions import text as X
from collegium.operators.applicability import applicable_classes, applicable_pairs, axis, lenient_relevance, verdict, verdict_counts
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

CATEGORY_SQL = r"""CASE WHEN regexp_matches(title, '(?i)\btime\s*table\b|\bexamination\s+schedule\b') THEN 'exam_timetable'
 WHEN regexp_matches(title, '(?i)\bresults?\s+(announced|declared|published)\b|\bannouncement\s+of\s+results?\b') THEN 'result'
 WHEN regexp_matches(title, '(?i)\bre-?valuation\b|\bre-?totall?ing\b|\bphoto\s*cop(y|ies)\b') THEN 'revaluation'
 WHEN regexp_matches(title, '(?i)\bexam(ination)?\s+(registration|application)\b|\bapply\s+online\b') THEN 'registration'
 WHEN regexp_matches(title, '(?i)\bacademic\s+calendar\b|\bcalendar\s+of\s+events\b') THEN 'academic_calendar'
 WHEN regexp_matches(title, '(?i)\bregulations?\b|\bordinance\b') THEN 'regulation'
 WHEN regexp_matches(title, '(?i)\bscheme\s+of\s+teaching\b|\bscheme\s*(&|and)\s*syllabus\b') THEN 'scheme'
 WHEN regexp_matches(title, '(?i)\bsyllabus\b|\bsyllabi\b') THEN 'syllabus'
 WHEN regexp_matches(title, '(?i)\bexamination\b|\bexam\b') THEN 'examination'
 WHEN regexp_matches(title, '(?i)\bcircular\b|\bnotification\b|\bnotice\b') THEN 'administration' ELSE 'unresolved' END"""
HIGH_SQL = r"regexp_matches(title, '(?i)\brevised\b|\bpostponed\b|\bpreponed\b|\brescheduled\b|\bcancell?ed\b|\blast\s+date\b|\bdeadline\b|\bon\s+or\s+before\b|\bclosing\s+date\b')"
CLASSED = f"""
classed AS (
  SELECT *, CASE WHEN {HIGH_SQL} OR category IN ('exam_timetable', 'result', 'revaluation', 'registration') THEN 'high'
                 WHEN category IN ('academic_calendar', 'regulation', 'scheme', 'syllabus', 'examination') THEN 'medium' ELSE 'low' END AS importance
  FROM (SELECT *, {CATEGORY_SQL} AS category FROM notices)
)"""
AXES = ["branch", "college", "semester"]
NOW = "2024-02-20"
PRIORITY_SQL = f"""CASE WHEN deadline >= DATE '{NOW}' AND deadline - DATE '{NOW}' <= 2 THEN 'urgent'
 WHEN category IN ('exam_timetable', 'result', 'revaluation', 'registration') THEN 'important' WHEN category IN ('administration', 'unresolved') THEN 'informational' ELSE 'normal' END"""


def classed(spark, sf_dir):
    # Through a generator, so that Catalyst does not copy the patterns into every use of the category.
    rows = T.notices(spark, sf_dir).withColumn("category", F.explode(F.array(X.category_of(F.col("title")))))
    return rows.withColumn("importance", X.importance_of(F.col("category"), F.col("title")))


def priority(category, deadline):
    left = F.datediff(deadline, F.lit(NOW).cast("date"))
    return F.when(left.between(0, 2), "urgent").when(category.isin(X.IMPORTANCE["high"]), "important").when(category.isin("administration", "unresolved"), "informational").otherwise("normal")


@query("notice_classification", S.with_(S.NOTICES, CLASSED, query="SELECT notice, title, category, importance FROM classed"))
def notice_classification(spark, sf_dir):
    return classed(spark, sf_dir).select("notice", "title", "category", "importance")


def signal_sql(pattern):
    """The phrases of one rule that occur, white space folded, joined."""
    found = [rf"nullif(trim(regexp_replace(regexp_extract(title, '(?i){p}', 0), '\s+', ' ', 'g')), '')" for p in re.split(r"(?<=\\b)\|(?=\\b)", pattern)]
    return f"WHEN regexp_matches(title, '(?i){pattern}') THEN concat_ws('; ', {', '.join(found)})"


ALL_SIGNALS_SQL = " ".join(signal_sql(p) for p in re.findall(r"regexp_matches\(title, '\(\?i\)(.*)'\) THEN", CATEGORY_SQL))


@query("notice_signals", S.with_(S.NOTICES, query=f"SELECT notice, CASE {ALL_SIGNALS_SQL} ELSE '' END AS signal FROM notices"))
def notice_signals(spark, sf_dir):
    """The words that fired, joined, for every notice by all ten rules."""
    return T.notices(spark, sf_dir).select("notice", F.array_join(X.signals_of(F.col("title")), "; ").alias("signal"))


@query("unresolved_texts", f"""
SELECT role, count(*) FILTER (WHERE category = 'unresolved') AS turns, CAST(coalesce(sum(length(text)) FILTER (WHERE category = 'unresolved'), 0) AS BIGINT) AS chars, count(*) FILTER (WHERE category <> 'unresolved') AS resolved
FROM (SELECT role, text, {CATEGORY_SQL.replace('title', 'text')} AS category FROM (SELECT role, CASE WHEN conv_id % 4 = 0 THEN text || ' Circular, with a time table' WHEN conv_id % 4 = 1 THEN text || ' syllabi' ELSE text END AS text FROM conversations)) GROUP BY role""")
def unresolved_texts(spark, sf_dir):
    """Turns of conversations by role, some with planted notices: what the rules leave unresolved, and what they don't."""
    key = F.col("conv_id") % 4
    text = F.when(key == 0, F.concat("text", F.lit(" Circular, with a time table"))).when(key == 1, F.concat("text", F.lit(" syllabi"))).otherwise(F.col("text"))
    rows = T.table(spark, sf_dir, "conversations").select("role", text.alias("text")).withColumn("open", X.category_of(F.col("text")) == "unresolved")
    return rows.groupBy("role").agg(F.count_if("open").alias("turns"), F.coalesce(F.sum(F.when(F.col("open"), F.length("text"))), F.lit(0)).cast("bigint").alias("chars"), F.count_if(~F.col("open")).alias("resolved"))


VERDICT_SQL = """CASE WHEN n.unreadable_scope THEN 'unresolved'
 WHEN lower(trim(n.branch)) <> lower(trim(p.branch)) OR n.college <> p.college OR n.semester <> p.semester THEN 'not_applicable'
 WHEN (n.branch IS NOT NULL AND p.branch IS NULL) OR (n.college IS NOT NULL AND p.college IS NULL) OR (n.semester IS NOT NULL AND p.semester IS NULL) THEN 'unresolved' ELSE 'applicable' END"""


@query("applicability_counts", S.with_(S.NOTICES, S.PROFILES, query=f"SELECT verdict, count(*) AS pairs FROM (SELECT {VERDICT_SQL} AS verdict FROM notices n CROSS JOIN profiles p) GROUP BY verdict"))
def applicability_counts(spark, sf_dir):
    """Verdicts over all pairs of a notice and a user, from counts of their kinds."""
    found = verdict_counts(T.notices(spark, sf_dir), T.profiles(spark, sf_dir), AXES)
    return found.groupBy("verdict").agg(F.sum(F.col("users") * F.col("notices")).alias("pairs"))


@query("notice_audiences", S.with_(S.NOTICES, S.PROFILES, query=f"SELECT n.notice, count(*) FILTER (WHERE v = 'applicable') AS applicable, count(*) FILTER (WHERE v = 'unresolved') AS unresolved, count(*) FILTER (WHERE v = 'not_applicable') AS excluded FROM (SELECT n.notice, {VERDICT_SQL} AS v FROM notices n CROSS JOIN profiles p) n GROUP BY n.notice"))
def notice_audiences(spark, sf_dir):
    """The audience of every notice, by joining each back to its kind."""
    rows = T.notices(spark, sf_dir)
    kinds = verdict_counts(rows, T.profiles(spark, sf_dir), AXES).groupBy(*AXES, "unreadable_scope").agg(*[F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("users"))), F.lit(0)).alias(n) for v, n in (("applicable", "applicable"), ("unresolved", "unresolved"), ("not_applicable", "excluded"))])
    on = [rows[a].eqNullSafe(kinds[a]) for a in [*AXES, "unreadable_scope"]]
    return rows.join(kinds, on).select("notice", "applicable", "unresolved", "excluded")


@query("applicable_classes", S.with_(S.NOTICES, S.PROFILES, f"""
c AS (SELECT *, concat_ws('|', coalesce(lower(trim(branch)), '*'), coalesce(college, '*'), coalesce(semester::VARCHAR, '*')) AS class FROM notices WHERE NOT unreadable_scope),
links AS (SELECT n.class, n.notice, p.student FROM c n CROSS JOIN profiles p WHERE {VERDICT_SQL} = 'applicable')""", query="""
SELECT class, notice, NULL::BIGINT AS student, (SELECT count(*) FROM links l WHERE l.notice = c.notice) AS links FROM c
UNION ALL SELECT class, NULL, student, count(*) FROM links WHERE class <> '*|*|*' GROUP BY class, student"""))
def applicable_classes_query(spark, sf_dir):
    """Whom all notices are for, whichever axes they target: their classes with links, and the users' membership."""
    return applicable_classes(T.notices(spark, sf_dir), T.profiles(spark, sf_dir), AXES, "notice", "student")


@query("applicable_pairs", S.with_(S.NOTICES, S.PROFILES, f"""
n AS (SELECT *, min(notice) OVER (PARTITION BY lower(trim(branch)), college, semester) AS notice_class FROM notices WHERE NOT unreadable_scope),
p AS (SELECT *, min(student) OVER (PARTITION BY lower(trim(branch)), college, semester) AS user_class FROM profiles),
links AS (SELECT n.notice_class, p.user_class, n.notice, p.student FROM n CROSS JOIN p WHERE {VERDICT_SQL} = 'applicable')""", query="""
SELECT 'pair' AS kind, notice_class, user_class, NULL::BIGINT AS notice, NULL::BIGINT AS student, count(*) AS links FROM links GROUP BY notice_class, user_class
UNION ALL SELECT 'notice', notice_class, NULL, notice, NULL, coalesce(links, 0) FROM n LEFT JOIN (SELECT notice, count(*) AS links FROM links GROUP BY notice) USING (notice)
UNION ALL SELECT 'user', NULL, user_class, NULL, student, coalesce(links, 0) FROM p LEFT JOIN (SELECT student, count(*) AS links FROM links GROUP BY student) USING (student)"""))
def applicable_pairs_query(spark, sf_dir):
    """All pairs of a notice and a user whom it is for, as pairs of their classes with both sides' membership and links."""
    return applicable_pairs(T.notices(spark, sf_dir), T.profiles(spark, sf_dir), AXES, "notice", "student")


@query("one_user_feed", S.with_(S.NOTICES, S.PROFILES, query=f"SELECT n.notice, {VERDICT_SQL} AS verdict FROM notices n CROSS JOIN profiles p WHERE p.student = 10"))
def one_user_feed(spark, sf_dir):
    """All verdicts for one user; the user's single row meets every notice."""
    one = T.owned(T.profiles(spark, sf_dir), 10).select("student", *[F.col(a).alias(f"held_{a}") for a in AXES])
    found = verdict({a: axis(F.col(a), F.col(f"held_{a}")) for a in AXES}, F.col("unreadable_scope"))
    return T.notices(spark, sf_dir).join(F.broadcast(one.limit(1)), F.lit(True)).select("notice", found.alias("verdict"))


@query(
    "lenient_relevance",
    S.with_(S.NOTICES, S.PROFILES, query="""
SELECT n.notice, CASE WHEN n.college <> p.college OR lower(n.branch) <> lower(p.branch) OR n.semester <> p.semester THEN 'not_relevant'
  WHEN n.semester IS NOT NULL THEN 'semester' WHEN n.branch IS NOT NULL THEN 'branch' WHEN n.college IS NOT NULL THEN 'college' ELSE 'global' END AS relevance
FROM notices n CROSS JOIN profiles p WHERE p.student = 7"""),
)
def lenient(spark, sf_dir):
    """Unlike the verdict, what the student has not said passes."""
    one = T.owned(T.profiles(spark, sf_dir), 7).select(*[F.col(a).alias(f"held_{a}") for a in AXES])
    found = lenient_relevance({a: (F.col(a), F.col(f"held_{a}")) for a in ("college", "branch", "semester")})
    return T.notices(spark, sf_dir).join(F.broadcast(one.limit(1)), F.lit(True)).select("notice", found.alias("relevance"))


@query("notice_priority", S.with_(S.NOTICES, CLASSED, query=f"SELECT notice, {PRIORITY_SQL} AS priority, CAST(deadline - DATE '{NOW}' AS BIGINT) AS days_left, coalesce(deadline < DATE '{NOW}', false) AS passed FROM classed"))
def notice_priority(spark, sf_dir):
    now = F.lit(NOW).cast("date")
    return classed(spark, sf_dir).select("notice", priority(F.col("category"), F.col("deadline")).alias("priority"), F.datediff("deadline", now).cast("bigint").alias("days_left"), F.coalesce(F.col("deadline") < now, F.lit(False)).alias("passed"))


@query("feed_page", S.with_(S.NOTICES, query="SELECT notice, title, CAST(published AS VARCHAR) AS published FROM notices WHERE notice % 2 = 0 ORDER BY notices.published DESC NULLS LAST, notice DESC LIMIT 20 OFFSET 40"))
def feed_page(spark, sf_dir):
    """The third page of published notices; notice breaks ties, so pages don't overlap."""
    rows = T.notices(spark, sf_dir).where("notice % 2 = 0").select("notice", "title", "published")
    return rows.orderBy(F.desc_nulls_last("published"), F.desc("notice")).offset(40).limit(20).withColumn("published", F.col("published").cast("string"))


@query("inbox_top", S.with_(S.NOTICES, CLASSED, query="SELECT notice, importance, CAST(published AS VARCHAR) AS published FROM classed ORDER BY CASE importance WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, classed.published DESC, notice LIMIT 50"))
def inbox_top(spark, sf_dir):
    """The fifty most important, newest first: a top-k without a full sort."""
    rank = F.when(F.col("importance") == "high", 0).when(F.col("importance") == "medium", 1).otherwise(2)
    return classed(spark, sf_dir).orderBy(rank, F.desc("published"), "notice").limit(50).select("notice", "importance", F.col("published").cast("string").alias("published"))


@query("student_feed_order", S.with_(S.NOTICES, CLASSED, S.PROFILES, query=f"""
SELECT notice, relevance, priority, CAST(published AS VARCHAR) AS published FROM (
  SELECT n.notice, n.published, {PRIORITY_SQL} AS priority, CASE WHEN n.college <> p.college OR lower(n.branch) <> lower(p.branch) OR n.semester <> p.semester THEN 1 ELSE 0 END AS relevance
  FROM classed n CROSS JOIN (SELECT branch, college, semester FROM profiles WHERE student = 10) p) f
ORDER BY relevance, CASE priority WHEN 'urgent' THEN 0 WHEN 'important' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, f.published DESC, notice LIMIT 100"""))
def student_feed_order(spark, sf_dir):
    """Relevant first, most pressing first, newest first."""
    one = T.owned(T.profiles(spark, sf_dir), 10).select(*[F.col(a).alias(f"held_{a}") for a in AXES])
    rows = classed(spark, sf_dir).join(F.broadcast(one.limit(1)), F.lit(True))
    irrelevant = (lenient_relevance({a: (F.col(a), F.col(f"held_{a}")) for a in ("college", "branch", "semester")}) == "not_relevant").cast("int")
    rows = rows.select("notice", irrelevant.alias("relevance"), priority(F.col("category"), F.col("deadline")).alias("priority"), "published")
    rank = F.when(F.col("priority") == "urgent", 0).when(F.col("priority") == "important", 1).when(F.col("priority") == "normal", 2).otherwise(3)
    return rows.orderBy("relevance", rank, F.desc("published"), "notice").limit(100).withColumn("published", F.col("published").cast("string"))


@query("category_facets", S.with_(S.NOTICES, CLASSED, query="SELECT category, count(*) AS notices, count(deadline) AS dated FROM classed GROUP BY category ORDER BY notices DESC, category"))
def category_facets(spark, sf_dir):
    return classed(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("notices"), F.count("deadline").alias("dated")).orderBy(F.desc("notices"), "category")


@query("optional_filters", S.with_(S.NOTICES, query="SELECT notice, title FROM notices WHERE branch = 'BUILDING' AND semester = 3"))
def optional_filters(spark, sf_dir):
    """A predicate for each argument that is given; none for college."""
    return filtered(T.notices(spark, sf_dir), branch="BUILDING", semester=3, college=None).select("notice", "title")


def filtered(df, **wanted):
    """The rows that equal every argument but None; resolved here, so that each predicate can reach the scan."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


@query("targeted_notices", S.with_(S.NOTICES, query="SELECT notice FROM notices WHERE branch IS NOT NULL OR college IS NOT NULL OR semester IS NOT NULL"))
def targeted_notices(spark, sf_dir):
    return T.notices(spark, sf_dir).where(F.coalesce(*[F.col(a).cast("string") for a in AXES]).isNotNull()).select("notice")


@query("muted_inbox", S.with_(S.NOTICES, CLASSED, query="SELECT category, importance, count(*) AS notices FROM classed WHERE importance <> 'low' AND category NOT IN ('syllabus', 'scheme') GROUP BY category, importance"))
def muted_inbox(spark, sf_dir):
    """An importance floor and muted categories."""
    rank = F.create_map(*[F.lit(x) for pair in (("low", 0), ("medium", 1), ("high", 2)) for x in pair])
    muted = F.array(F.lit("syllabus"), F.lit("scheme"))
    rows = classed(spark, sf_dir).where((rank[F.col("importance")] >= 1) & ~F.array_contains(muted, F.col("category")))
    return rows.groupBy("category", "importance").agg(F.count(F.lit(1)).alias("notices"))


@query("word_search", "SELECT p_partkey AS notice, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_type), 'eco')")
def word_search(spark, sf_dir):
    """Every word of the query must occur."""
    return T.table(spark, sf_dir, "part").where(X.all_words_in("RED eco", F.col("p_name"), F.col("p_type"))).select(F.col("p_partkey").alias("notice"), "p_name")


@query("fan_out_new", S.with_(S.NOTICES, S.PROFILES, query=f"""
SELECT n.notice, count(*) AS created FROM notices n CROSS JOIN profiles p
WHERE {VERDICT_SQL} = 'applicable' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.student AND o.o_orderkey % 2000 = n.notice) GROUP BY n.notice"""))
def fan_out_new(spark, sf_dir):
    """Deliveries of all notices that are not held yet, so that a second run creates nothing.

    Users come from counts of their kinds, less the held pairs that apply, so that no pair is formed but held ones.
    """
    rows, users = T.notices(spark, sf_dir), T.profiles(spark, sf_dir)
    held = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student"), (F.col("o_orderkey") % 2000).alias("notice")).distinct()
    held = held.join(rows, "notice").join(users.select("student", *[F.col(a).alias(f"held_{a}") for a in AXES]), "student")
    applies = verdict({a: axis(F.col(a), F.col(f"held_{a}")) for a in AXES}, F.col("unreadable_scope")) == "applicable"
    held = held.where(applies).groupBy("notice").agg(F.count(F.lit(1)).alias("held"))
    kinds = verdict_counts(rows, users, AXES).where("verdict = 'applicable'")
    on = [rows[a].eqNullSafe(kinds[a]) for a in [*AXES, "unreadable_scope"]]
    counted = rows.join(kinds, on).select("notice", "users").join(held, "notice", "left")
    return counted.select("notice", (F.col("users") - F.coalesce("held", F.lit(0))).alias("created")).where("created > 0")


@query("unread_counts", "SELECT user_id AS student, count(*) FILTER (WHERE s = 'unread') AS unread, count(*) AS total FROM (SELECT user_id, CASE WHEN value < 5 THEN 'read' WHEN value < 6 THEN 'dismissed' ELSE 'unread' END AS s FROM events) GROUP BY user_id")
def unread_counts(spark, sf_dir):
    state = F.when(F.col("value") < 5, "read").when(F.col("value") < 6, "dismissed").otherwise("unread")
    return T.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("student")).agg(F.count_if(state == "unread").alias("unread"), F.count(F.lit(1)).alias("total"))


@query("read_state_join", S.with_(S.NOTICES, query="SELECT n.notice, CASE WHEN r.notice IS NULL THEN 'unread' WHEN r.version <> n.notice % 3 THEN 'unread' ELSE r.state END AS state FROM notices n LEFT JOIN (SELECT s_suppkey AS notice, s_nationkey % 3 AS version, CASE WHEN s_acctbal > 5000 THEN 'read' ELSE 'dismissed' END AS state FROM supplier) r ON r.notice = n.notice"))
def read_state_join(spark, sf_dir):
    """Unread unless a record says otherwise for the same version."""
    seen = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("notice"), (F.col("s_nationkey") % 3).alias("version"), F.when(F.col("s_acctbal") > 5000, "read").otherwise("dismissed").alias("state"))
    rows = T.notices(spark, sf_dir).select("notice").join(seen, "notice", "left")
    return rows.select("notice", F.when(F.col("version").isNull() | (F.col("version") != F.col("notice") % 3), "unread").otherwise(F.col("state")).alias("state"))


@query("next_event", S.with_(S.NOTICES, query=f"SELECT branch, CAST(min(deadline) AS VARCHAR) AS next_deadline, count(*) AS ahead FROM notices WHERE deadline >= DATE '{NOW}' GROUP BY branch"))
def next_event(spark, sf_dir):
    rows = T.notices(spark, sf_dir).where(F.col("deadline") >= F.lit(NOW).cast("date"))
    return rows.groupBy("branch").agg(F.min("deadline").cast("string").alias("next_deadline"), F.count(F.lit(1)).alias("ahead"))


@query("holiday_overlap", S.with_(S.NOTICES, query="SELECT n.notice, h.name FROM notices n JOIN (VALUES ('winter', DATE '2024-01-05', DATE '2024-01-09'), ('founders', DATE '2024-02-10', DATE '2024-02-10'), ('spring', DATE '2024-03-01', DATE '2024-03-20')) h(name, a, b) ON n.published BETWEEN h.a AND h.b"))
def holiday_overlap(spark, sf_dir):
    """Dates within holidays: the ranges are unfolded into days, so the join is by equality."""
    days = spark.createDataFrame([("winter", "2024-01-05", "2024-01-09"), ("founders", "2024-02-10", "2024-02-10"), ("spring", "2024-03-01", "2024-03-20")], "name string, a string, b string")
    days = days.select("name", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("published"))
    return T.notices(spark, sf_dir).join(F.broadcast(days), "published").select("notice", "name")


@query("latest_per_family", "SELECT family, notice, CAST(published AS VARCHAR) AS published FROM (SELECT p_brand AS family, p_partkey AS notice, DATE '2024-01-01' + CAST(p_partkey % 120 AS INTEGER) AS published, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 120 DESC, p_partkey DESC) AS r FROM part) WHERE r = 1")
def latest_per_family(spark, sf_dir):
    """Latest row per key as a greatest struct: one aggregate in place of a window."""
    rows = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 120).cast("int")).alias("published"), F.col("p_partkey").alias("notice"))
    return rows.groupBy("family").agg(F.max(F.struct("published", "notice")).alias("m")).select("family", "m.notice", F.col("m.published").cast("string").alias("published"))


@query("calendar_first_import", "SELECT term, importer, imported FROM (SELECT c_nationkey AS term, c_custkey AS importer, c_custkey % 50 AS imported, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50 DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def calendar_first_import(spark, sf_dir):
    """The greatest import of each term; of ties the first, as a window ranks them."""
    w = W.partitionBy("term").orderBy(F.desc("imported"), "importer")
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("term"), F.col("c_custkey").alias("importer"), (F.col("c_custkey") % 50).alias("imported"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
