"""Document fingerprints against a plain version."""

import hashlib
import unicodedata

from pyspark.sql import functions as F

from collegium.llm import fingerprints
from collegium.llm.common import by_id, may_be_among
from collegium.llm.fingerprints import canonical, document_fingerprints, false_matches

ODD = [None, "", "a", "ab", "abc", "ABC", " a\t\nB ", "a b", "É", "É", "ﬁx", "FIX", "Straße", "STRASSE", "x" * 5000, "🙂🙂🙂", "é" * 7]


def same(a, b):
    def folded(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())

    return float(folded(a) == folded(b))


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), same(text, edited), same(text, following))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_chars int, digest string")
    found = document_fingerprints(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found} == expected(rows) and len(found) == len(rows)
    texts, prints = dict(rows), {r.doc_id: r.fingerprint for r in found}
    for a in list(prints)[:40]:
        for b in prints:
            assert (prints[a] == prints[b]) == bool(same(texts[a] or "", texts[b] or ""))


def test_table_and_odd_texts(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    check(spark, list(enumerate(ODD)))
    check(spark, [(7, "one text alone")])
    assert document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "b"), (None, "a"), (3, "x"), (3, "x"), (3, "y")]
    found = document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.near_next for r in found) == [0, 0, 0, 0, 1] and len(found) == 5


def test_equal_digests_of_different_bytes_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    digests = spark.createDataFrame([(1, "d"), (2, "d"), (3, "e")], "doc_id long, digest string")
    assert false_matches(docs, digests).count() == 0
    for longs in (1 << 19, 1):
        assert false_matches(docs, spark.createDataFrame([(i, "d") for i in (1, 2, 3)], "doc_id long, digest string"), map_longs=longs).count() == 0

    def short(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [canonical(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["d"] * len(texts)), pa.array(texts, pa.binary())], names=["digest", "canonical"])

    monkeypatch.setattr(fingerprints, "_canonicals", short)
    assert [r.digest for r in false_matches(docs, spark.createDataFrame([(i, "d") for i in (1, 2, 3)], "doc_id long, digest string")).collect()] == ["d"]


def test_many_rows_of_one_id(spark):
    """Rows without an id, and rows of one id, are dealt to several tasks; each still meets the next one."""
    rows = [(None, f"none {i % 900}") for i in range(3000)] + [(5, f"five {i % 700}") for i in range(3000)] + [(9, "same text")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tables as small as this end up in one task
    try:
        assert by_id(docs, descending=True).groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0] < 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = document_fingerprints(docs).collect()
    assert len(found) == len(rows) and len({r.fingerprint for r in found}) == 1601
    # Of equal rows in a row, all but the last are like the next one.
    assert sum(r.near_next for r in found) == 8000 - 1601


def test_map_lets_no_wanted_row_go(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("b"))
    wanted = rows.where("a < 40").distinct()
    for longs in (1 << 19, 64, 1):
        kept = may_be_among(rows, wanted, ["a", "b"], longs)
        assert kept.columns == ["a", "b"] and kept.where("a < 40").count() == 200
    assert may_be_among(rows, wanted, ["a", "b"]).count() == 200
    assert may_be_among(rows, wanted.where("false"), ["a", "b"]).count() == 0
