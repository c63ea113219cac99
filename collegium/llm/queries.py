"""The queries of the operators, with the contracts' columns, and their SQL.

What null values, empty texts, repeated rows, empty tables and clashing columns give is said by the operator that each
query calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from collegium.llm.audit import filter_audit
from collegium.llm.clustering import CENTROIDS, ROUNDS, cluster
from collegium.llm.common import read_documents, read_labels
from collegium.llm.exact_dedup import exact_dedup
from collegium.llm.fingerprints import document_fingerprints
from collegium.llm.line_dedup import WORDS_AN_EDIT, line_report
from collegium.llm.mixing import mix_report
from collegium.llm.packing import pack
from collegium.llm.quality import fit_quality, score_quality
from collegium.llm.simhash import near_dedup
from collegium.llm.suffix_dedup import suffix_report
from collegium.llm.token_files import token_report
from collegium.llm.topk import top_scores
from collegium.llm.toxicity import fit_toxicity, score_toxicity
from collegium.llm.vectors import read_embeddings

QUERIES = {}
ORACLE_SQL = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and where its first block goes."""
    return mix_report(read_documents(spark, sf_dir))


ORACLE_SQL["op1_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffled
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST(weight AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY (2.0::DOUBLE * source_size) / CAST(weight AS DOUBLE), source NULLS LAST) AS k FROM s
), l AS (
  SELECT k, most / w AS stops_at, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER before, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(most, w * (SELECT level FROM l WHERE stops_at > level ORDER BY k LIMIT 1)) AS target FROM r
), p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT source, CAST(floor(target + 0.5) AS BIGINT) AS words, CAST(ceil(floor(target + 0.5) / 1024) AS BIGINT) AS blocks,
         CAST(coalesce(sum(floor(target + 0.5)) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below
  FROM t
), c AS (SELECT CAST(sum(blocks) AS BIGINT) AS slots, CAST(sum(words) AS DOUBLE) AS words FROM n),
k AS (
  SELECT k.slot, list_sum(list_transform(range(0, 52), lambda j: CAST((k.slot >> j) & 1 AS DOUBLE) * power(2.0::DOUBLE, -(j + 1)))) AS u
  FROM c, unnest(range(0, c.slots)) AS k(slot)
), g AS (
  SELECT n.source, n.blocks, k.slot, row_number() OVER (PARTITION BY n.source ORDER BY k.slot) - 1 AS rank
  FROM k, c, n WHERE n.words > 0 AND k.u >= n.below / c.words AND k.u < (n.below + n.words) / c.words
), s1 AS (
  SELECT g.source, g.rank, g.slot / CAST(greatest(c.slots, 1) AS DOUBLE) AS at FROM g, c WHERE g.rank < g.blocks
), s2 AS (
  SELECT n.source, r.rank, (r.rank + 0.5::DOUBLE) / CAST(n.blocks AS DOUBLE) AS at
  FROM n LEFT JOIN (SELECT source, count(*) AS got FROM g GROUP BY source) h ON h.source IS NOT DISTINCT FROM n.source, unnest(range(coalesce(h.got, 0), n.blocks)) AS r(rank)
), w AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
e AS (
  SELECT p.doc_id, p.source, p.start, p.start + e.epoch * p.source_size AS f, least(p.start + e.epoch * p.source_size + p.size, p.words) AS l
  FROM p, (VALUES (0), (1)) e(epoch) WHERE p.size > 0
), x AS (
  SELECT doc_id, source, start, unnest(range(f // 1024, (l - 1) // 1024 + 1)) AS rank FROM e WHERE l > f
), y AS (
  SELECT x.doc_id, x.source, x.start, min(w.at) AS at FROM x JOIN w ON w.source IS NOT DISTINCT FROM x.source AND w.rank = x.rank GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(greatest(0, least(p.size, p.words - p.start)) + greatest(0, least(p.size, p.words - p.source_size - p.start)) AS BIGINT) AS taken, y.at
FROM p LEFT JOIN y ON p.size > 0 AND y.doc_id IS NOT DISTINCT FROM p.doc_id AND y.source IS NOT DISTINCT FROM p.source AND y.start = p.start
"""


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document and the row that stays."""
    return exact_dedup(read_documents(spark, sf_dir))


ORACLE_SQL["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and its component."""
    return near_dedup(read_documents(spark, sf_dir))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; ids as the library gives them."""
    return pack(read_documents(spark, sf_dir), special=True)


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written as ORC and read back; ids as the library gives them."""
    return token_report(read_documents(spark, sf_dir), special=True)


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document; null and empty texts, repeated and null ids have a row like any other."""
    docs = read_documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, read_labels(spark, sf_dir)))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document; null and empty texts, repeated and null ids have a row like any other."""
    docs = read_documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, read_labels(spark, sf_dir)))


@_query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the canonical text of each document and of its edited text."""
    return document_fingerprints(read_documents(spark, sf_dir))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that an equal or near line precedes."""
    return line_report(read_documents(spark, sf_dir), an_edit=WORDS_AN_EDIT)


@_query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each document that a recurring string of 400 bytes covers."""
    return suffix_report(read_documents(spark, sf_dir))


@_query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after five rounds; cluster() says what odd rows give."""
    return cluster(read_embeddings(spark, sf_dir))


def _rounds(k: int, rounds: int) -> str:
    """The rounds of clustering, one after the other: a<i> assigns, c<i + 1> are the centroids that follow."""
    out = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        out.append(f"""
d{i} AS (
  SELECT k.vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept k, c{i} c),
a{i} AS MATERIALIZED (SELECT vec_id, v, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) = 1)""")
        if i < rounds:
            out.append(f"""
m{i} AS (
  SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(0, 64)) AS j FROM a{i}) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v
  FROM c{i} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{i} GROUP BY c) m ON m.c = c.c)""")
    return ",".join(out)


ORACLE_SQL["op11_centroid_clustering"] = f"""
WITH {_rounds(CENTROIDS, ROUNDS)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c
"""


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove by source, order and step; filter_audit() says what odd rows give."""
    return filter_audit(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


ORACLE_SQL["op12_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), m AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT filter_order, step, substring(filter_order, step, 1) AS own, substring(filter_order, 1, step - 1) AS earlier FROM o, unnest(range(1, 6)) AS i(step)),
r AS (
  SELECT m.part, s.filter_order, s.step, m.n, m.good, m.toxic, contains(m.fails, s.own) AS failing, length(translate(m.fails, s.earlier, '')) < length(m.fails) AS gone, m.fails = s.own AS only_this
  FROM m, s
), h AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, substring(any_value(filter_order), CAST(step AS INTEGER), 1) AS own,
         CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (only_this), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM h
"""


@_query
def op13_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of each twentieth vector by inner product; top_scores() says what odd rows give."""
    return top_scores(read_embeddings(spark, sf_dir))


ORACLE_SQL["op13_top_scores"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM p WINDOW best AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY rank <= 20
"""
