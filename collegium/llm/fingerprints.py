"""Document fingerprints: a wide digest of the canonical text, held against the bytes where it recurs."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.llm.common import MAP_LONGS, by_id, materialise, may_be_among, slices


def canonical(text: str) -> bytes:
    """NFKC, case folded, runs of white space one space and none at the ends, in UTF-8."""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not unicodedata.is_normalized("NFKC", text):  # folding can leave a sequence that composes
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split()).encode()


def edit(text: str, following: str) -> str:
    """text with its last third (of code points) replaced by the first as many of the following text, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _row(doc_id, text: str, own: bytes, following: str, after: bytes) -> tuple:
    edited = edit(text, following)
    changed = canonical(edited)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        xxhash.xxh3_128_hexdigest(own),
        hashlib.sha256(own).hexdigest(),
        xxhash.xxh3_128_hexdigest(changed),
        hashlib.sha256(changed).hexdigest(),
        float(own == changed),
        float(own == after),
    )


NAMES = ["doc_id", "n_chars", "edited_sha256", "digest", "sha", "edited_digest", "edited_sha", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, digest string, sha string, edited_digest string, edited_sha string, near_edited double, near_next double"
EDGES = f"{SCHEMA}, part int, first string, last string"


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its sorted partition; the last has no values yet, but carries its text."""
    part, before, first = TaskContext.get().partitionId(), None, None
    names = [*NAMES, "part", "first", "last"]
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own = canonical(text)
            if before is None:
                first = text
            else:
                rows.append((*_row(*before, text, own), part, first, None))
                first = None
            before = (doc_id, text, own)
        yield _table(rows, names)
    if before is not None:
        yield _table([(before[0], *[None] * (len(NAMES) - 1), part, first, before[1])], names)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "last", "following")]
        yield _table([_row(i, text, canonical(text), following, canonical(following)) for i, text, following in zip(*columns)], NAMES)


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of NAMES: every text and its edited text, digested, in descending order of ids.

    Texts are shuffled once, into ranges of ids. Within a range each row meets the next one; a range's last row
    meets the first of the range that follows (the last row of all the first of all) afterwards, for which one text
    or two of each range are kept. Null ids come last; rows that repeat an id are ordered by a
    hash of their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    inside = materialise(by_id(rows, descending=True).mapInArrow(_in_turn, EDGES), "inside")
    firsts = inside.where("first IS NOT NULL").select("part", F.col("first").alias("following"))
    lasts = inside.where("last IS NOT NULL").select("doc_id", "part", "last")
    # One narrow row for each range of ids goes through this window.
    turn = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())))
    across = lasts.join(turn, "part").drop("part").join(firsts.withColumnRenamed("part", "next"), "next").mapInArrow(_across, SCHEMA)
    return inside.where("last IS NULL").select(*NAMES).unionByName(across)


def _canonicals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [canonical(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(x) for x in texts], pa.string()), pa.array(texts, pa.binary())], names=["digest", "canonical"])


def false_matches(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text", map_longs: int = MAP_LONGS) -> DataFrame:
    """The digests under which canonical texts differ, by comparing the bytes of all rows that share one.

    digests has doc_id and digest. Equal bytes have equal least and greatest, which are combined before the shuffle,
    so that no group of copies, however large, comes together. Only texts whose digest recurs are read again, and by
    chance some others: digests, then ids, are looked up in a map of 64 * map_longs bits, so that nothing is joined on
    a digest or an id that many rows hold.
    """
    again = materialise(digests.groupBy("digest").count().where("count > 1").select("digest"), "recurring")
    ids = may_be_among(digests, again, ["digest"], map_longs).select("doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = may_be_among(rows, ids, ["doc_id"], map_longs)
    texts = rows.select("text").mapInArrow(_canonicals, "digest string, canonical binary")
    texts = may_be_among(texts, again, ["digest"], map_longs)
    ends = texts.groupBy("digest").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    return ends.where("low <> high").select("digest")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the 128-bit xxhash of the canonical text; where that stands for different bytes, the SHA-256
    of the canonical text follows it. The digest is exact: its likeness is 1 for equal canonical texts, else 0.
    Null text is empty, and a single row is its own next one. An empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    found = materialise(with_following(docs, id_col, text_col), "digests")
    false = materialise(false_matches(docs, found.select("doc_id", "digest"), id_col, text_col), "false")

    def told_apart(rows: DataFrame, digest: str, sha: str, out: str) -> DataFrame:
        marks = false.select(F.col("digest").alias("_digest"))
        rows = rows.join(marks, rows[digest] == marks["_digest"], "left")
        return rows.withColumn(out, F.when(F.col("_digest").isNull(), F.col(digest)).otherwise(F.concat_ws("-", digest, sha))).drop("_digest")

    found = told_apart(told_apart(found, "digest", "sha", "fingerprint"), "edited_digest", "edited_sha", "edited_fingerprint")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
