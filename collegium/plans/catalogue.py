"""Queries over the catalogue: courses, aliases, options, totals, and its invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.operators import quality as Q
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

COURSES = "courses AS (SELECT 'C' || p_partkey AS code, p_partkey AS key, p_brand AS stream, p_name AS title, 1 + p_size % 4 AS credits, 1 + p_partkey % 8 AS semester, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS programme FROM part)"
ALIASES = "aliases AS (SELECT 'C' || p_partkey AS variant, 'C' || (p_partkey + 1) AS canonical FROM part WHERE p_partkey % 50 = 1 UNION ALL SELECT 'C' || p_partkey, 'C' || (p_partkey + 1) FROM part WHERE p_partkey % 100 = 2)"


def courses(spark, sf_dir):
    key = F.col("p_partkey")
    return T.table(spark, sf_dir, "part").select(
        F.concat(F.lit("C"), key.cast("string")).alias("code"),
        key.alias("key"),
        F.col("p_brand").alias("stream"),
        F.col("p_name").alias("title"),
        (1 + F.col("p_size") % 4).alias("credits"),
        (1 + key % 8).alias("semester"),
        F.when(key % 9 != 0, F.col("p_type")).alias("programme"),
    )


def aliases(spark, sf_dir):
    """variant, canonical; every hundredth canonical is a variant itself, a chain that must be reported."""
    key = F.col("p_partkey")
    rows = T.table(spark, sf_dir, "part").where((key % 50 == 1) | (key % 100 == 2))
    return rows.select(F.concat(F.lit("C"), key.cast("string")).alias("variant"), F.concat(F.lit("C"), (key + 1).cast("string")).alias("canonical"))


@query("canonical_codes", S.with_(COURSES, ALIASES, query="SELECT c.code, coalesce(a.canonical, c.code) AS canonical FROM courses c LEFT JOIN aliases a ON a.variant = c.code"))
def canonical_codes(spark, sf_dir):
    """One hop from a variant to its canonical code."""
    known = aliases(spark, sf_dir)
    return courses(spark, sf_dir).select("code").join(known, F.col("code") == known["variant"], "left").select("code", F.coalesce("canonical", "code").alias("canonical"))


@query("alias_partners", S.with_(ALIASES, query="SELECT code, string_agg(partner, ',' ORDER BY partner) AS partners FROM (SELECT variant AS code, canonical AS partner FROM aliases UNION SELECT canonical, variant FROM aliases UNION SELECT variant, variant FROM aliases) GROUP BY code"))
def alias_partners(spark, sf_dir):
    """A code's partners in both directions, itself included where it is a variant."""
    a = aliases(spark, sf_dir)
    both = a.select(F.col("variant").alias("code"), F.col("canonical").alias("partner")).unionByName(a.select(F.col("canonical").alias("code"), F.col("variant").alias("partner"))).unionByName(a.select(F.col("variant").alias("code"), F.col("variant").alias("partner")))
    return both.groupBy("code").agg(F.array_join(F.sort_array(F.collect_set("partner")), ",").alias("partners"))


@query("alias_chains", S.with_(ALIASES, query="SELECT a.variant, a.canonical, b.canonical AS beyond FROM aliases a JOIN aliases b ON a.canonical = b.variant"))
def alias_chains(spark, sf_dir):
    a = aliases(spark, sf_dir)
    b = a.select(F.col("variant").alias("canonical"), F.col("canonical").alias("beyond"))
    return a.join(b, "canonical").select("variant", "canonical", "beyond")


@query("dangling_aliases", S.with_(COURSES, ALIASES, query="SELECT variant, canonical FROM aliases WHERE canonical NOT IN (SELECT code FROM courses WHERE credits > 1) AND canonical NOT IN (SELECT code FROM courses WHERE semester = 3)"))
def dangling_aliases(spark, sf_dir):
    """Canonical codes in neither of two lists: two anti-joins."""
    known = courses(spark, sf_dir)
    missing = aliases(spark, sf_dir).join(known.where("credits > 1").select(F.col("code").alias("canonical")), "canonical", "left_anti")
    return missing.join(known.where("semester = 3").select(F.col("code").alias("canonical")), "canonical", "left_anti").select("variant", "canonical")


@query("unmatched_syllabi", S.with_(COURSES, ALIASES, query="SELECT 'C' || ps AS code FROM (SELECT DISTINCT l_partkey + 1 AS ps FROM lineitem WHERE l_partkey % 5 = 0) WHERE NOT EXISTS (SELECT 1 FROM courses c WHERE c.code = 'C' || ps AND c.credits <> 2) AND NOT EXISTS (SELECT 1 FROM aliases a JOIN courses c ON c.code = a.canonical AND c.credits <> 2 WHERE a.variant = 'C' || ps)"))
def unmatched_syllabi(spark, sf_dir):
    """Syllabi whose code is no course, directly or through an alias: the codes are expanded once, then one anti-join."""
    known = courses(spark, sf_dir).where("credits <> 2").select("code")
    through = aliases(spark, sf_dir).join(known, F.col("canonical") == F.col("code")).select(F.col("variant").alias("code"))
    wanted = T.table(spark, sf_dir, "lineitem").where("l_partkey % 5 = 0").select(F.concat(F.lit("C"), (F.col("l_partkey") + 1).cast("string")).alias("code")).distinct()
    return wanted.join(known.unionByName(through), "code", "left_anti")


@query("contradicting_credits", S.with_(COURSES, query="SELECT a.code AS left_code, b.code AS right_code, a.credits AS left_credits, b.credits AS right_credits FROM courses a JOIN courses b ON a.stream = b.stream AND a.title = b.title AND coalesce(a.programme, '') = coalesce(b.programme, '') AND a.semester = b.semester AND a.key < b.key AND a.credits <> b.credits"))
def contradicting_credits(spark, sf_dir):
    """Courses of one identity, nulls equal, with different credits: a hash join on null-safe keys."""
    a, b = courses(spark, sf_dir).alias("a"), courses(spark, sf_dir).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("stream", "title", "programme", "semester")]
    rows = a.join(b, [*on, F.col("a.key") < F.col("b.key"), F.col("a.credits") != F.col("b.credits")])
    return rows.select(F.col("a.code").alias("left_code"), F.col("b.code").alias("right_code"), F.col("a.credits").alias("left_credits"), F.col("b.credits").alias("right_credits"))


@query("orphan_lines", "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY l_orderkey")
def orphan_lines(spark, sf_dir):
    kept = T.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey").join(kept, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("credit_basis", S.with_(COURSES, query="SELECT credits, count(*) AS courses, count(DISTINCT stream) AS streams FROM courses GROUP BY credits ORDER BY courses DESC, credits"))
def credit_basis(spark, sf_dir):
    return courses(spark, sf_dir).groupBy("credits").agg(F.count(F.lit(1)).alias("courses"), F.count_distinct("stream").alias("streams")).orderBy(F.desc("courses"), "credits")


@query("duplicate_identities", S.with_(COURSES, query="SELECT stream, title, coalesce(programme, '') AS programme, count(*) AS rows FROM courses GROUP BY stream, title, coalesce(programme, '') HAVING count(*) > 1"))
def duplicate_identities(spark, sf_dir):
    return courses(spark, sf_dir).groupBy("stream", "title", F.coalesce("programme", F.lit("")).alias("programme")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@query("many_titles", S.with_(COURSES, query="SELECT stream, count(DISTINCT title) AS titles FROM courses GROUP BY stream HAVING count(DISTINCT title) > 1"))
def many_titles(spark, sf_dir):
    return courses(spark, sf_dir).groupBy("stream").agg(F.count_distinct("title").alias("titles")).where("titles > 1")


@query("option_groups", S.with_(COURSES, query="SELECT stream, semester, count(*) AS members, string_agg(code, ',' ORDER BY key) AS codes FROM courses WHERE credits = 3 GROUP BY stream, semester HAVING count(*) >= 2"))
def option_groups(spark, sf_dir):
    """Elective slots with a choice, their members in order."""
    rows = courses(spark, sf_dir).where("credits = 3").groupBy("stream", "semester").agg(F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list(F.struct("key", "code"))).alias("m"))
    return rows.where("members >= 2").select("stream", "semester", "members", F.array_join("m.code", ",").alias("codes"))


@query("groups_without_choice", S.with_(COURSES, query="SELECT s.stream, s.semester, count(c.code) AS members FROM (SELECT DISTINCT stream, semester FROM courses) s LEFT JOIN courses c ON c.stream = s.stream AND c.semester = s.semester AND c.credits = 3 GROUP BY s.stream, s.semester HAVING count(c.code) < 2"))
def groups_without_choice(spark, sf_dir):
    """Slots with fewer than two members, empty ones too: a conditional count over all rows, not a join."""
    return courses(spark, sf_dir).groupBy("stream", "semester").agg(F.count_if(F.col("credits") == 3).alias("members")).where("members < 2")


@query("double_slots", "SELECT l_partkey, l_suppkey, count(DISTINCT l_linenumber) AS slots FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_linenumber) > 1")
def double_slots(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_linenumber").alias("slots")).where("slots > 1")


@query("semester_totals", S.with_(COURSES, query="SELECT semester, computed, printed, CASE WHEN printed IS NULL THEN 'skip' WHEN printed = computed THEN 'pass' ELSE 'fail' END AS result FROM (SELECT semester, CAST(sum(credits) AS BIGINT) AS computed FROM (SELECT DISTINCT ON (title) title, semester, credits FROM courses ORDER BY title, key) GROUP BY semester) LEFT JOIN (SELECT * FROM (VALUES (1, CAST(40 AS BIGINT)), (2, 22), (3, NULL), (5, 12)) p(semester, printed)) USING (semester)"))
def semester_totals(spark, sf_dir):
    """Credits of the first course of each title, by semester, against what is printed."""
    first = courses(spark, sf_dir).groupBy("title").agg(F.min(F.struct("key", "semester", "credits")).alias("m"))
    computed = first.groupBy(F.col("m.semester").alias("semester")).agg(F.sum("m.credits").alias("computed"))
    printed = spark.createDataFrame([(1, 40), (2, 22), (3, None), (5, 12)], "semester bigint, printed bigint")
    return Q.reconcile(computed, printed, "semester")


@query("subject_index", S.with_(COURSES, query="""
SELECT title, count(*) AS sightings, min(k) AS first_seen, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min_by(credits, (rank * 1000000000 + k)) AS credits, count(DISTINCT stream) > 1 AS conflict
FROM (SELECT title, key AS k, 'catalogue' AS source, credits, stream, 0 AS rank FROM courses WHERE key % 2 = 0
      UNION ALL SELECT title, key, 'card', credits, stream, 1 FROM courses WHERE key % 3 = 0
      UNION ALL SELECT title, key, 'timetable', CAST(NULL AS INTEGER), stream, 2 FROM courses WHERE key % 5 = 0) GROUP BY title""").replace("min_by(credits, (rank * 1000000000 + k))", "min_by(credits, CASE WHEN credits IS NOT NULL THEN rank * 1000000000 + k END)"))
def subject_index(spark, sf_dir):
    """Sources folded per subject: which saw it, the credits of the best source that has any, and conflicts."""
    c = courses(spark, sf_dir)
    part = lambda rows, source, credits, rank: rows.select("title", "key", F.lit(source).alias("source"), credits.cast("int").alias("credits"), "stream", F.lit(rank).alias("rank"))
    rows = part(c.where("key % 2 = 0"), "catalogue", F.col("credits"), 0).unionByName(part(c.where("key % 3 = 0"), "card", F.col("credits"), 1)).unionByName(part(c.where("key % 5 = 0"), "timetable", F.lit(None), 2))
    best = F.min(F.when(F.col("credits").isNotNull(), F.struct("rank", "key", "credits")))
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("sightings"), F.min("key").alias("first_seen"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), best["credits"].alias("credits"), (F.count_distinct("stream") > 1).alias("conflict"))


@query("first_wins", S.with_(COURSES, query="SELECT title, code FROM (SELECT title, code, row_number() OVER (PARTITION BY title ORDER BY key) AS r FROM courses) WHERE r = 1"))
def first_wins(spark, sf_dir):
    return courses(spark, sf_dir).groupBy("title").agg(F.min_by("code", "key").alias("code"))


@query("set_difference", "SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set_difference(spark, sf_dir):
    used = T.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("part"))
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(used, "part", "left_anti")


@query("enrolled_and_backlog", "SELECT student, kind, count(*) AS courses FROM (SELECT o_custkey AS student, 'enrolled' AS kind FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 'backlog' FROM orders WHERE o_orderstatus <> 'F') GROUP BY student, kind")
def enrolled_and_backlog(spark, sf_dir):
    """UNION ALL of both lists; an open order is on each."""
    o = T.table(spark, sf_dir, "orders")
    part = lambda where, kind: o.where(where).select(F.col("o_custkey").alias("student"), F.lit(kind).alias("kind"))
    return part("o_orderstatus = 'O'", "enrolled").unionByName(part("o_orderstatus <> 'F'", "backlog")).groupBy("student", "kind").agg(F.count(F.lit(1)).alias("courses"))


@query("coverage_counts", S.with_(COURSES, query="SELECT stream, semester, count(*) AS courses, count(programme) AS placed, count(*) FILTER (WHERE credits >= 3) AS heavy, count(*) FILTER (WHERE credits = 1) AS light, count(*) FILTER (WHERE programme IS NULL) AS unplaced, count(*) FILTER (WHERE title LIKE 'red%') AS red FROM courses GROUP BY stream, semester"))
def coverage_counts(spark, sf_dir):
    return courses(spark, sf_dir).groupBy("stream", "semester").agg(F.count(F.lit(1)).alias("courses"), F.count("programme").alias("placed"), F.count_if(F.col("credits") >= 3).alias("heavy"), F.count_if(F.col("credits") == 1).alias("light"), F.count_if(F.col("programme").isNull()).alias("unplaced"), F.count_if(F.col("title").like("red%")).alias("red"))


@query("three_way_document_minimum", "SELECT n_name AS nation, min(o_orderkey) AS first_order, count(*) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def three_way_document_minimum(spark, sf_dir):
    n, c, o = (T.table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("orders"))


@query("source_or_operator", "SELECT coalesce(s_name, 'operator') AS source, count(*) AS lines FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON s_suppkey = l_suppkey GROUP BY 1")
def source_or_operator(spark, sf_dir):
    known = T.table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select("s_suppkey", "s_name")
    rows = T.table(spark, sf_dir, "lineitem").select("l_suppkey").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.groupBy(F.coalesce("s_name", F.lit("operator")).alias("source")).agg(F.count(F.lit(1)).alias("lines"))


@query("page_beyond_count", "SELECT o_orderkey, l_linenumber, o_pages FROM (SELECT o_orderkey, 1 + o_orderkey % 5 AS o_pages FROM orders) JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > o_pages")
def page_beyond_count(spark, sf_dir):
    """An equi-join with an inequality left over: references to pages that a document doesn't have."""
    docs = T.table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 5).alias("o_pages"))
    lines = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(docs, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") > F.col("o_pages"))).select("o_orderkey", "l_linenumber", "o_pages")


CHECKS = ["attended_within_conducted", "credits_known", "price_positive", "segment_known", "total_adds_up", "unique_line"]


@query("invariants", S.with_(S.ATTEMPTS, S.ATTENDANCE, """
bad AS (
  SELECT 'total_adds_up' AS c, CAST(student AS VARCHAR) AS what FROM attempts WHERE internal + external <> (CASE WHEN line = 3 AND tax = 8 THEN total + 1 ELSE total END)
  UNION ALL SELECT 'attended_within_conducted', CAST(student AS VARCHAR) FROM attendance WHERE attended > conducted
  UNION ALL SELECT 'credits_known', CAST(student AS VARCHAR) FROM attempts WHERE line = 7 AND tax = 0
  UNION ALL SELECT 'price_positive', CAST(p_partkey AS VARCHAR) FROM part WHERE p_retailprice <= 900.5
  UNION ALL SELECT 'segment_known', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 = 0
  UNION ALL SELECT 'unique_line', l_orderkey || '|' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
)""", query="""
SELECT k.c AS "check", coalesce(n, 0) AS violations, coalesce(n, 0) = 0 AS passed, coalesce(e, '') AS examples FROM (VALUES ('attended_within_conducted'), ('credits_known'), ('price_positive'), ('segment_known'), ('total_adds_up'), ('unique_line')) k(c)
LEFT JOIN (SELECT c, count(*) AS n FROM bad GROUP BY c) a ON a.c = k.c
LEFT JOIN (SELECT c, string_agg(what, ', ' ORDER BY what) AS e FROM (SELECT c, what, row_number() OVER (PARTITION BY c ORDER BY what) AS r FROM (SELECT DISTINCT c, what FROM bad)) WHERE r <= 5 GROUP BY c) b ON b.c = k.c"""))
def invariants(spark, sf_dir):
    """Six invariants with planted violations, each a count and its first five examples."""
    a = T.attempts(spark, sf_dir)
    total = F.when((F.col("line") == 3) & (F.col("tax") == 8), F.col("total") + 1).otherwise(F.col("total"))
    found = [
        Q.violations(a, {"total_adds_up": (F.col("internal") + F.col("external") != total, F.col("student")), "credits_known": ((F.col("line") == 7) & (F.col("tax") == 0), F.col("student"))}),
        Q.violations(T.attendance(spark, sf_dir), {"attended_within_conducted": (F.col("attended") > F.col("conducted"), F.col("student"))}),
        Q.violations(T.table(spark, sf_dir, "part"), {"price_positive": (F.col("p_retailprice") <= 900.5, F.col("p_partkey"))}),
        Q.violations(T.profiles(spark, sf_dir), {"segment_known": (F.col("branch").isNull() & (F.col("student") % 5 == 0), F.col("student"))}),
        Q.duplicates(T.table(spark, sf_dir, "lineitem"), "unique_line", ["l_orderkey", "l_linenumber"]),
    ]
    return Q.report(CHECKS, found)
