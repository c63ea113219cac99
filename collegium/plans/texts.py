"""Queries over pages and documents as text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.functions import text as X
from collegium.operators.schemes import codes_in_cell
from collegium.registry import query
from collegium.sources import tables as T


@query("page_titles", "SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS title FROM pages")
def page_titles(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    for entity, char in X.ENTITIES:
        title = F.replace(title, F.lit(entity), F.lit(char))
    return T.table(spark, sf_dir, "pages").select("page_id", F.trim(title).alias("title"))


PAGE_TEXTS = r"""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest
FROM pages"""


@query("page_texts", PAGE_TEXTS)
def page_texts(spark, sf_dir):
    """The visible text of each page, as a digest."""
    return T.table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@query("page_links", "SELECT page_id, CAST(pos AS BIGINT) AS pos, href FROM (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages))")
def page_links(spark, sf_dir):
    """Anchors in their order on the page."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return T.table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query("link_validation", "SELECT reason, count(*) AS links FROM (SELECT CASE WHEN href = '' THEN 'empty' WHEN r > 1 THEN 'duplicate' WHEN regexp_matches(href, '^(https?://|/)') THEN 'valid' ELSE 'not_http' END AS reason FROM (SELECT href, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS r FROM (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)))) GROUP BY reason")
def link_validation(spark, sf_dir):
    """Links kept or refused, with the reason; of equal links on a page the first is kept."""
    nth = F.row_number().over(W.partitionBy("page_id", "href").orderBy("pos"))
    rows = page_links(spark, sf_dir).withColumn("nth", nth)
    reason = F.when(F.col("href") == "", "empty").when(F.col("nth") > 1, "duplicate").when(F.col("href").rlike("^(https?://|/)"), "valid").otherwise("not_http")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("links"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g') AS path, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|\.)example\.com$') AS allowed FROM pages")
def url_parts(spark, sf_dir):
    """Host, path as identity, and whether the host is on the list of allowed ones."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return T.table(spark, sf_dir, "pages").select("page_id", host.alias("host"), X.url_path(F.col("url")).alias("path"), host.rlike(r"(^|\.)example\.com$").alias("allowed"))


@query("private_addresses", "SELECT ip, a = 10 OR a = 127 OR a = 0 OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) AS private FROM (SELECT s_suppkey % 256 AS a, s_nationkey * 10 AS b, (s_suppkey % 256) || '.' || (s_nationkey * 10) || '.1.' || (s_suppkey % 200) AS ip FROM supplier)")
def private_addresses(spark, sf_dir):
    key = F.col("s_suppkey")
    ip = F.concat_ws(".", (key % 256).cast("string"), (F.col("s_nationkey") * 10).cast("string"), F.lit("1"), (key % 200).cast("string"))
    return T.table(spark, sf_dir, "supplier").select(ip.alias("ip")).select("ip", X.private_address(F.col("ip")).alias("private"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 2) AS shard, sha256(doc_id || chr(31) || coalesce(source, '')) AS item FROM documents")
def content_hashes(spark, sf_dir):
    sha = F.sha2("text", 256)
    return T.table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), F.substring(sha, 1, 2).alias("shard"), X.content_hash(F.col("doc_id"), F.col("source")).alias("item"))


@query("subject_keys", r"SELECT p_partkey, upper(regexp_replace(p_name || ' ' || p_type, '\s+', '', 'g')) AS key, lower(trim(p_brand)) = 'brand#1' AS first_brand FROM part")
def subject_keys(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", X.subject_key(F.concat_ws(" ", "p_name", "p_type")).alias("key"), X.same_name(F.col("p_brand"), F.lit(" BRAND#1 ")).alias("first_brand"))


@query("years_in_pages", r"SELECT page_id, CAST(coalesce(nullif(regexp_extract(html, '(?i)(20\d\d)\s*scheme', 1), ''), nullif(regexp_extract(url, '(20\d\d)', 1), ''), nullif(regexp_extract(html, '(20\d\d)', 1), '')) AS INTEGER) AS year FROM (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN html || ' in 2021, the 2022  Scheme' ELSE html END AS html FROM pages)")
def years_in_pages(spark, sf_dir):
    """The year of each page; a planted scheme's year comes before any other."""
    html = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" in 2021, the 2022  Scheme"))).otherwise(F.col("html"))
    rows = T.table(spark, sf_dir, "pages").withColumn("html", html)
    return rows.select("page_id", X.year_of(F.col("html"), F.col("url")).alias("year"))


@query("strict_dates", "SELECT p_partkey, CAST(TRY_CAST('2024-' || lpad(CAST(1 + p_partkey % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + p_size % 31 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS day FROM part")
def strict_dates(spark, sf_dir):
    """Calendar dates that exist; 30 February is null."""
    text = F.concat(F.lit("2024-"), F.lpad((1 + F.col("p_partkey") % 13).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + F.col("p_size") % 31).cast("string"), 2, "0"))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.try_to_date(text, "yyyy-MM-dd").cast("string").alias("day"))


@query("initials", """
WITH t AS (SELECT DISTINCT p_name, p_type, p_name || ' of the ' || p_type || ' e-waste (T/L) & IPR' AS title FROM part),
w AS (SELECT title, string_split_regex(x, '[^A-Za-z0-9&]+') AS w FROM t, unnest([title, replace(title, '(T/L)', ' ')]) AS u(x)),
n AS (SELECT DISTINCT title, upper(array_to_string(list_transform(list_filter(w, lambda x: x <> '' AND (k OR lower(x) NOT IN ('of', 'the', '&'))), lambda x: CASE WHEN len(x) > 1 AND x = upper(x) THEN x ELSE x[1] END), '')) AS name FROM w, unnest([true, false]) AS u(k))
SELECT title, string_agg(name, ',' ORDER BY name) AS initials FROM n GROUP BY title""")
def initials(spark, sf_dir):
    """What each title can be shortened to: acronyms whole, hyphens split, with and without joining words and brackets."""
    title = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" e-waste (T/L) & IPR"))
    rows = T.table(spark, sf_dir, "part").select(title.alias("title")).distinct()
    return rows.select("title", F.array_join(F.sort_array(X.initialisms(F.col("title"))), ",").alias("initials"))


@query("compound_codes", """
SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN ['BCS' || n, 'BIS' || n || 'A'] WHEN 1 THEN ['BCS' || n] WHEN 2 THEN ['BETCK' || n] WHEN 3 THEN ['BCS' || n || 'x'] ELSE [] END) AS code
FROM (SELECT p_partkey, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS n FROM part)""")
def compound_codes(spark, sf_dir):
    """Codes of a cell: several about slashes, one that spaces break, one of a shared tail; other words name none."""
    key, n = F.col("p_partkey"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    cell = F.when(key % 5 == 0, F.concat(F.lit("BCS"), n, F.lit("/BIS"), n, F.lit("A"))).when(key % 5 == 1, F.concat(F.lit("BCS "), n)).when(key % 5 == 2, F.concat(F.lit("BETCK/PLCK"), n)).when(key % 5 == 3, F.concat(F.lit("BCS"), n, F.lit("x"))).otherwise(F.concat(F.lit("Bus "), n))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.explode(codes_in_cell(cell)).alias("code"))


@query("distinct_codes_in_text", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+|[A-Z][a-z]'))) AS BIGINT) AS codes FROM documents")
def distinct_codes_in_text(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+|[A-Z][a-z]"), F.lit(0)))).cast("bigint").alias("codes"))


@query("coerced_numbers", "SELECT event_id, TRY_CAST(nullif(trim(regexp_extract(props, '\"k\": ([0-9]+)', 1)), '') AS BIGINT) AS k, CASE WHEN value > 10 THEN value END AS large FROM events")
def coerced_numbers(spark, sf_dir):
    """A number out of text, or null; never an error."""
    k = X.text_or_null(F.regexp_extract("props", r'"k": ([0-9]+)', 1)).try_cast("bigint")
    return T.table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(F.col("value") > 10, F.col("value")).alias("large"))


@query("json_payloads", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS payload FROM events")
def json_payloads(spark, sf_dir):
    """A JSON object read and one written."""
    return T.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("payload"))


