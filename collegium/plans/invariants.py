"""The catalogue's invariants by area, over planted rows that break each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.operators import quality as Q
from collegium.plans import sql as S
from collegium.registry import query
from collegium.sources import tables as T

TABLES = """
versions AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN upper(md5('v' || p_partkey)) ELSE sha256('v' || p_partkey) END AS sha, CASE WHEN p_partkey % 25 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime, CASE WHEN p_partkey % 30 > 0 THEN 'p1' ELSE '' END AS parser, 10 + p_size AS pages FROM part),
refs AS (SELECT p_partkey AS version, CASE WHEN p_partkey % 60 < 2 THEN 'shared' || (p_partkey // 60) ELSE 'u' || p_partkey END AS url FROM part WHERE p_partkey % 20 <> 7),
applies AS (SELECT p_partkey AS id, (['stream', 'programme', 'common'])[p_partkey % 3 + 1] AS scope, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 15 > 0 THEN 's' END AS stream,
  CASE WHEN p_partkey % 33 = 1 THEN '21a' WHEN p_partkey % 33 = 4 THEN 'BMATS101 Mathematics' WHEN p_partkey % 3 = 1 AND p_partkey % 12 <> 1 THEN p_name WHEN p_partkey % 18 = 2 THEN p_name END AS programme FROM part),
courses AS (SELECT p_partkey AS id, 'C' || (CASE WHEN p_partkey % 70 = 1 THEN p_partkey - 1 ELSE p_partkey END) AS code, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_name END AS title, (['table', 'slot', 'alternative'])[p_partkey % 3 + 1] AS basis,
  CASE WHEN p_partkey % 21 = 1 THEN NULL WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 26 = 2 THEN 'Z' ELSE 'C' || (p_partkey - p_partkey % 3) END AS related, CASE WHEN p_partkey % 35 = 4 THEN 9 ELSE 3 END AS credits, p_partkey + CASE WHEN p_partkey % 50 = 3 THEN 1000000000 ELSE 0 END AS version, 5 + p_partkey % 20 AS page FROM part)"""


def tables(spark, sf_dir):
    """versions, refs, applies and courses, planted with rows that break a rule."""
    part = T.table(spark, sf_dir, "part")
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    tag = F.concat(F.lit("v"), key.cast("string"))
    code = lambda n: F.concat(F.lit("C"), n.cast("string"))
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % 3 + 1).cast("int"))
    versions = part.select(key.alias("id"), F.when(key % 40 == 0, F.upper(F.md5(tag))).otherwise(F.sha2(tag, 256)).alias("sha"), F.when(key % 25 == 0, "text/html").otherwise("application/pdf").alias("mime"), F.when(key % 30 > 0, "p1").otherwise("").alias("parser"), (10 + size).alias("pages"))
    refs = part.where("p_partkey % 20 <> 7").select(key.alias("version"), F.when(key % 60 < 2, F.concat(F.lit("shared"), F.floor(key / 60).cast("string"))).otherwise(F.concat(F.lit("u"), key.cast("string"))).alias("url"))
    programme = F.when(key % 33 == 1, "21a").when(key % 33 == 4, "BMATS101 Mathematics").when((key % 3 == 1) & (key % 12 != 1), name).when(key % 18 == 2, name)
    applies = part.select(key.alias("id"), pick("stream", "programme", "common").alias("scope"), F.when((key % 3 == 0) & (key % 15 > 0), "s").alias("stream"), programme.alias("programme"))
    related = F.when((key % 21 == 1) | (key % 3 == 0), F.lit(None)).when(key % 26 == 2, "Z").otherwise(code(key - key % 3))
    courses = part.select(
        key.alias("id"), code(F.when(key % 70 == 1, key - 1).otherwise(key)).alias("code"), F.when(key % 17 == 0, "  ").otherwise(name).alias("title"), pick("table", "slot", "alternative").alias("basis"),
        related.alias("related"), F.when(key % 35 == 4, 9).otherwise(3).alias("credits"), (key + F.when(key % 50 == 3, 1000000000).otherwise(0)).alias("version"), (5 + key % 20).alias("page"),
    )
    return versions, refs, applies, courses


def _reported(checks: dict[str, str], *parts: str) -> str:
    """The SQL of a report over queries that give what breaks each check."""
    bad = " UNION ALL ".join(f"SELECT '{c}' AS c, what::VARCHAR AS what FROM ({q}) q(what)" for c, q in checks.items())
    names = ", ".join(f"('{c}')" for c in checks)
    return S.with_(*parts, f"bad AS ({bad})", query=f"""SELECT k.c AS "check", coalesce(n, 0) AS violations, coalesce(n, 0) = 0 AS passed, coalesce(e, '') AS examples FROM (VALUES {names}) k(c) LEFT JOIN (SELECT c, count(*) AS n FROM bad GROUP BY c) a ON a.c = k.c
LEFT JOIN (SELECT c, string_agg(what, ', ' ORDER BY what) AS e FROM (SELECT c, what, row_number() OVER (PARTITION BY c ORDER BY what) AS r FROM (SELECT DISTINCT c, what FROM bad)) WHERE r <= 5 GROUP BY c) b ON b.c = k.c""")


def missing(rows, known, on, check, what):
    """check, what of rows that no known row matches."""
    return rows.join(known, on, "left_anti").select(F.lit(check).alias("check"), what.cast("string").alias("what"))


DOCUMENT_CHECKS = {
    "hash_form": "SELECT sha FROM versions WHERE NOT regexp_full_match(sha, '[0-9a-f]{64}')",
    "mime_is_pdf": "SELECT id FROM versions WHERE mime <> 'application/pdf'",
    "parser_recorded": "SELECT id FROM versions WHERE parser = ''",
    "referenced": "SELECT id FROM versions WHERE id NOT IN (SELECT version FROM refs)",
    "address_has_one_version": "SELECT url FROM refs GROUP BY url HAVING count(DISTINCT version) > 1",
}


@query("document_invariants", _reported(DOCUMENT_CHECKS, TABLES))
def document_invariants(spark, sf_dir):
    """Form of hashes, types, parsers, references and addresses of stored documents."""
    versions, refs, _, _ = tables(spark, sf_dir)
    rows = Q.violations(versions, {"hash_form": (~F.col("sha").rlike("^[0-9a-f]{64}$"), F.col("sha")), "mime_is_pdf": (F.col("mime") != "application/pdf", F.col("id")), "parser_recorded": (F.col("parser") == "", F.col("id"))})
    orphans = missing(versions, refs.select(F.col("version").alias("id")), "id", "referenced", F.col("id"))
    shared = refs.groupBy("url").agg(F.count_distinct("version").alias("n")).where("n > 1").select(F.lit("address_has_one_version").alias("check"), F.col("url").alias("what"))
    return Q.report(list(DOCUMENT_CHECKS), [rows, orphans, shared])


APPLICABILITY_CHECKS = {
    "stream_is_named": "SELECT id FROM applies WHERE scope = 'stream' AND stream IS NULL",
    "programme_is_named": "SELECT id FROM applies WHERE scope = 'programme' AND programme IS NULL",
    "common_names_no_programme": "SELECT id FROM applies WHERE scope = 'common' AND programme IS NOT NULL",
    "programme_is_no_serial": "SELECT id FROM applies WHERE regexp_full_match(programme, '[0-9]+[A-Za-z]?')",
    "programme_is_no_course": "SELECT id FROM applies WHERE regexp_matches(programme, '^1?B[A-Z]{2,7}[0-9]{3}')",
}


@query("applicability_invariants", _reported(APPLICABILITY_CHECKS, TABLES))
def applicability_invariants(spark, sf_dir):
    """Scopes of documents with their targets; serial numbers and courses taken for programmes."""
    scope, stream, programme, what = (F.col(c) for c in ("scope", "stream", "programme", "id"))
    rows = Q.violations(tables(spark, sf_dir)[2], {
        "stream_is_named": ((scope == "stream") & stream.isNull(), what),
        "programme_is_named": ((scope == "programme") & programme.isNull(), what),
        "common_names_no_programme": ((scope == "common") & programme.isNotNull(), what),
        "programme_is_no_serial": (programme.rlike("^[0-9]+[A-Za-z]?$"), what),
        "programme_is_no_course": (programme.rlike("^1?B[A-Z]{2,7}[0-9]{3}"), what),
    })
    return Q.report(list(APPLICABILITY_CHECKS), [rows])


COURSE_CHECKS = {
    "title_is_printed": "SELECT code FROM courses WHERE trim(title) = ''",
    "related_course_exists": "SELECT code FROM courses WHERE basis <> 'table' AND related IS NOT NULL AND related NOT IN (SELECT code FROM courses)",
    "slot_credits_agree": "SELECT c.code FROM courses c JOIN (SELECT code, min(credits) AS credits FROM courses GROUP BY code) s ON s.code = c.related WHERE c.basis = 'slot' AND c.credits <> s.credits",
    "version_exists": "SELECT code FROM courses WHERE version NOT IN (SELECT id FROM versions)",
    "one_row_for_each_code": "SELECT code FROM courses GROUP BY code HAVING count(*) > 1",
    "basis_names_its_course": "SELECT code FROM courses WHERE basis <> 'table' AND related IS NULL",
    "page_within_document": "SELECT c.code FROM courses c JOIN versions v ON v.id = c.version WHERE c.page > v.pages",
    "credits_within_bounds": "SELECT code FROM courses WHERE credits > 8",
}


@query("course_invariants", _reported(COURSE_CHECKS, TABLES))
def course_invariants(spark, sf_dir):
    """Titles, related courses, credits, versions, identities and pages of the catalogue's courses."""
    versions, _, _, courses = tables(spark, sf_dir)
    code, related = F.col("code"), F.col("related")
    named = (F.col("basis") != "table") & related.isNull()
    rows = Q.violations(courses, {"title_is_printed": (F.trim("title") == "", code), "basis_names_its_course": (named, code), "credits_within_bounds": (F.col("credits") > 8, code)})
    known = courses.groupBy(code.alias("related")).agg(F.min("credits").alias("slot_credits"))
    lost = missing(courses.where((F.col("basis") != "table") & related.isNotNull()), known, "related", "related_course_exists", code)
    slots = Q.violations(courses.where("basis = 'slot'").join(known, "related"), {"slot_credits_agree": (F.col("credits") != F.col("slot_credits"), code)})
    unknown = missing(courses, versions.select(F.col("id").alias("version")), "version", "version_exists", code)
    pages = Q.violations(courses.join(versions.select(F.col("id").alias("version"), "pages"), "version"), {"page_within_document": (F.col("page") > F.col("pages"), code)})
    return Q.report(list(COURSE_CHECKS), [rows, lost, slots, unknown, Q.duplicates(courses, "one_row_for_each_code", ["code"]), pages])


SYLLABUS_TABLES = """
syllabi AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 19 > 0),
modules AS (SELECT p_partkey * 10 + n AS id, p_partkey AS syllabus, CASE WHEN p_partkey % 23 = 0 AND n = 2 THEN 1 ELSE n END AS number, CASE WHEN p_partkey % 29 > 0 THEN 3 END AS page FROM part, unnest(range(1, 3)) AS x(n)),
topics AS (SELECT p_partkey * 10 + 1 + p_partkey % 31 // 30 * 5 AS module, p_partkey % 37 AS position, CASE WHEN p_partkey % 41 > 0 THEN 'p1' ELSE ' ' END AS parser FROM part)"""
SYLLABUS_CHECKS = {
    "module_has_a_syllabus": "SELECT id FROM modules WHERE syllabus NOT IN (SELECT id FROM syllabi)",
    "topic_has_a_module": "SELECT module FROM topics WHERE module NOT IN (SELECT id FROM modules)",
    "provenance_is_recorded": "SELECT id FROM modules WHERE page IS NULL UNION ALL SELECT module FROM topics WHERE trim(parser) = ''",
    "position_counts_from_one": "SELECT module FROM topics WHERE position < 1",
    "one_module_for_each_number": "SELECT syllabus || '|' || number FROM modules GROUP BY syllabus, number HAVING count(*) > 1",
}


@query("syllabus_invariants", _reported(SYLLABUS_CHECKS, SYLLABUS_TABLES))
def syllabus_invariants(spark, sf_dir):
    """Parents, provenance and order of modules and topics."""
    key = F.col("p_partkey")
    part = T.table(spark, sf_dir, "part")
    syllabi = part.where("p_partkey % 19 > 0").select(key.alias("syllabus"))
    n = F.col("n")
    modules = part.select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select((key * 10 + n).alias("id"), key.alias("syllabus"), F.when((key % 23 == 0) & (n == 2), 1).otherwise(n).alias("number"), F.when(key % 29 > 0, 3).alias("page"))
    topics = part.select((key * 10 + 1 + F.floor(key % 31 / 30) * 5).alias("module"), (key % 37).alias("position"), F.when(key % 41 > 0, "p1").otherwise(" ").alias("parser"))
    module = F.col("module")
    return Q.report(list(SYLLABUS_CHECKS), [
        missing(modules, syllabi, "syllabus", "module_has_a_syllabus", F.col("id")),
        missing(topics, modules.select(F.col("id").alias("module")), "module", "topic_has_a_module", module),
        Q.violations(modules, {"provenance_is_recorded": (F.col("page").isNull(), F.col("id"))}),
        Q.violations(topics, {"provenance_is_recorded": (F.trim("parser") == "", module), "position_counts_from_one": (F.col("position") < 1, module)}),
        Q.duplicates(modules, "one_module_for_each_number", ["syllabus", "number"]),
    ])


OPTION_TABLES = """
groups AS (SELECT p_partkey AS id, 'S' || p_partkey AS slot, CASE WHEN p_partkey % 2 = 0 THEN 'elective_slot' ELSE 'alternative' END AS kind FROM part WHERE p_partkey % 5 = 0),
members AS (SELECT p_partkey - p_partkey % 5 AS grp, CASE WHEN p_partkey % 45 = 1 THEN 'S' || (p_partkey - 1) WHEN p_partkey % 55 = 2 THEN 'M' || (p_partkey - 1) WHEN p_partkey % 65 = 3 THEN 'shared' ELSE 'M' || p_partkey END AS code FROM part WHERE p_partkey % 5 > 0 AND (p_partkey // 5 % 11 > 0 OR p_partkey % 5 = 1))"""
OPTION_CHECKS = {
    "two_choices_at_least": "SELECT slot FROM groups g WHERE (SELECT count(*) FROM members m WHERE m.grp = g.id) < 2",
    "slot_is_no_option_of_itself": "SELECT slot FROM groups g JOIN members m ON m.grp = g.id WHERE g.kind = 'elective_slot' AND m.code = g.slot",
    "member_once": "SELECT grp || '|' || code FROM members GROUP BY grp, code HAVING count(*) > 1",
    "member_of_one_slot": "SELECT code FROM members GROUP BY code HAVING count(DISTINCT grp) > 1",
}


@query("option_invariants", _reported(OPTION_CHECKS, OPTION_TABLES))
def option_invariants(spark, sf_dir):
    """Choices of option groups: enough of them, none of itself, none twice, none in two slots."""
    key = F.col("p_partkey")
    part = T.table(spark, sf_dir, "part")
    groups = part.where("p_partkey % 5 = 0").select(key.alias("grp"), F.concat(F.lit("S"), key.cast("string")).alias("slot"), F.when(key % 2 == 0, "elective_slot").otherwise("alternative").alias("kind"))
    text = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    code = F.when(key % 45 == 1, text("S", key - 1)).when(key % 55 == 2, text("M", key - 1)).when(key % 65 == 3, "shared").otherwise(text("M", key))
    members = part.where((key % 5 > 0) & ((F.floor(key / 5) % 11 > 0) | (key % 5 == 1))).select((key - key % 5).alias("grp"), code.alias("code"))
    counted = groups.join(members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp", "left")
    return Q.report(list(OPTION_CHECKS), [
        Q.violations(counted, {"two_choices_at_least": (F.coalesce("n", F.lit(0)) < 2, F.col("slot"))}),
        Q.violations(groups.join(members, "grp"), {"slot_is_no_option_of_itself": ((F.col("kind") == "elective_slot") & (F.col("code") == F.col("slot")), F.col("slot"))}),
        Q.duplicates(members, "member_once", ["grp", "code"]),
        members.groupBy("code").agg(F.count_distinct("grp").alias("n")).where("n > 1").select(F.lit("member_of_one_slot").alias("check"), F.col("code").alias("what")),
    ])


ALIAS_TABLES = """
aliases AS (SELECT 'A' || p_partkey AS variant, 'A' || (CASE WHEN p_partkey % 26 = 0 THEN p_partkey ELSE p_partkey + 1 END) AS canonical, CASE WHEN p_partkey % 7 = 0 THEN 'short' ELSE 'printed on page ' || p_partkey || ' of the scheme' END AS reason FROM part WHERE p_partkey % 13 < 2),
known AS (SELECT 'A' || p_partkey AS code FROM part WHERE p_partkey % 4 > 0)"""
ALIAS_CHECKS = {
    "alias_of_another": "SELECT variant FROM aliases WHERE variant = canonical",
    "one_canonical": "SELECT variant FROM aliases GROUP BY variant HAVING count(DISTINCT canonical) > 1",
    "no_chain": "SELECT a.variant FROM aliases a JOIN aliases b ON b.variant = a.canonical AND a.variant <> b.variant",
    "evidence_is_told": "SELECT variant FROM aliases WHERE length(trim(reason)) < 20",
    "canonical_exists": "SELECT variant FROM aliases WHERE canonical NOT IN (SELECT code FROM known)",
}


@query("alias_invariants", _reported(ALIAS_CHECKS, ALIAS_TABLES))
def alias_invariants(spark, sf_dir):
    """Aliases of themselves, of several codes, in chains, without evidence, and of codes that nobody knows."""
    key = F.col("p_partkey")
    text = lambda n: F.concat(F.lit("A"), n.cast("string"))
    part = T.table(spark, sf_dir, "part")
    reason = F.when(key % 7 == 0, "short").otherwise(F.concat(F.lit("printed on page "), key.cast("string"), F.lit(" of the scheme")))
    aliases = part.where("p_partkey % 13 < 2").select(text(key).alias("variant"), text(F.when(key % 26 == 0, key).otherwise(key + 1)).alias("canonical"), reason.alias("reason"))
    variant = F.col("variant")
    onward = aliases.select(variant.alias("canonical"), variant.alias("beyond"))
    return Q.report(list(ALIAS_CHECKS), [
        Q.violations(aliases, {"alias_of_another": (variant == F.col("canonical"), variant), "evidence_is_told": (F.length(F.trim("reason")) < 20, variant)}),
        aliases.groupBy("variant").agg(F.count_distinct("canonical").alias("n")).where("n > 1").select(F.lit("one_canonical").alias("check"), variant.alias("what")),
        Q.violations(aliases.join(onward, "canonical"), {"no_chain": (variant != F.col("beyond"), variant)}),
        missing(aliases, part.where("p_partkey % 4 > 0").select(text(key).alias("canonical")), "canonical", "canonical_exists", variant),
    ])


CONFLICT_TABLES = """
conflicts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN o_orderkey % 14 > 0 THEN 'kept the later reading' END AS resolution FROM orders WHERE o_orderkey % 2 = 0),
readings AS (SELECT o_orderkey AS conflict, o_orderkey + CASE WHEN o_orderkey % 22 = 0 THEN 1000000000 ELSE 0 END AS version FROM orders WHERE o_orderkey % 10 > 0)"""
CONFLICT_CHECKS = {
    "readings_are_kept": "SELECT id FROM conflicts WHERE id NOT IN (SELECT conflict FROM readings)",
    "version_of_reading_exists": "SELECT conflict FROM readings WHERE version NOT IN (SELECT o_orderkey FROM orders)",
    "resolution_is_told": "SELECT id FROM conflicts WHERE status <> 'open' AND resolution IS NULL",
}


@query("conflict_invariants", _reported(CONFLICT_CHECKS, CONFLICT_TABLES))
def conflict_invariants(spark, sf_dir):
    """Recorded conflicts: their readings, these readings' versions, and how they were resolved."""
    key = F.col("o_orderkey")
    orders = T.table(spark, sf_dir, "orders")
    conflicts = orders.where("o_orderkey % 2 = 0").select(key.alias("conflict"), F.when(key % 3 > 0, "resolved").otherwise("open").alias("status"), F.when(key % 14 > 0, "kept the later reading").alias("resolution"))
    readings = orders.where("o_orderkey % 10 > 0").select(key.alias("conflict"), (key + F.when(key % 22 == 0, 1000000000).otherwise(0)).alias("version"))
    return Q.report(list(CONFLICT_CHECKS), [
        missing(conflicts, readings.select("conflict"), "conflict", "readings_are_kept", F.col("conflict")),
        missing(readings, orders.select(key.alias("version")), "version", "version_of_reading_exists", F.col("conflict")),
        Q.violations(conflicts, {"resolution_is_told": ((F.col("status") != "open") & F.col("resolution").isNull(), F.col("conflict"))}),
    ])
