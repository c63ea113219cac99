"""Statistics of whole texts, for the classifiers: one pass over the bytes of a text, none over its characters in Python."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import slices

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SPACES = b" \t\n\x0b\x0c\r"
SENTENCE = b".,;:'\"()-?"
BANGS = b"!"
SYMBOLS = bytes(c for c in range(33, 127) if c not in UPPER + LOWER + DIGITS + SENTENCE + BANGS)

NAMES = [
    "n_words", "n_bytes", "word_bytes", "upper", "digits", "sentence", "bangs", "symbols", "other_bytes",
    "line_words", "repeated_lines", "distinct_words", "repeated_triples", "longest_word", "symbol_words", "title_words",
]
SCHEMA = ", ".join(f"{n} double" for n in NAMES)


def share(raw: bytes, of: bytes, total: int) -> float:
    return (len(raw) - len(raw.translate(None, of))) / total


def text_statistics(raw: bytes) -> tuple[float, ...]:
    """The values of NAMES; rates are shares of bytes, words or lines, and 0 in a text without any."""
    words = raw.split()
    if not words:
        return (0.0, float(len(raw)), *[0.0] * (len(NAMES) - 2))
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    known = sum(share(raw, x, size) for x in (UPPER, LOWER, DIGITS, SENTENCE, BANGS, SYMBOLS, SPACES))
    marked = len(raw) - len(raw.translate(None, SYMBOLS))
    return (
        float(n),
        float(size),
        sum(map(len, words)) / n,
        share(raw, UPPER, size),
        share(raw, DIGITS, size),
        share(raw, SENTENCE, size),
        share(raw, BANGS, size),
        share(raw, SYMBOLS, size),
        max(0.0, 1 - known),
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / n,
        1 - len(set(triples)) / max(1, len(triples)),
        float(max(map(len, words))),
        min(1.0, marked / n),
        sum(map(bytes.istitle, words)) / n,
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.array([text_statistics(x.as_py() or b"") for x in batch.column("_text")], float).reshape(-1, len(NAMES))
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(values[:, i]) for i in range(len(NAMES)))], names=[*(n for n, _ in kept), *NAMES])


def statistics(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of keep and those of NAMES for each row; null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("binary").alias("_text"))
    kept = rows.drop("_text")
    return rows.mapInArrow(_statistics, ", ".join([*(f"{n} {t}" for n, t in kept.dtypes), SCHEMA]))


def id_remainder(id_col, modulus: int):
    """crc32 of an id as text, modulo `modulus`; of a null id, that of the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label and text of the labelled rows to learn from, about `bound` of them at most.

    Rows with crc32(id) mod modulus equal to held_out are left out before anything is read from them. Which of more
    than bound rows stay depends on a hash of the id alone.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("double").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(id_remainder(F.col("_id"), modulus) != held_out).dropDuplicates(["_id"])
    kept = min(1.0, bound / max(1, known.count()))
    known = known.where(F.shiftrightunsigned(F.xxhash64("_id", F.lit("sample")), 1) / float(1 << 63) < kept)
    # At most about `bound` narrow rows (16 bytes each) go to the tasks that read the texts.
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id").select(F.col("_id").cast("long").alias("doc_id"), "label", F.coalesce("text", F.lit("")).alias("text"))


def both_labels(rows: DataFrame) -> tuple[int, int]:
    """Rows with label 0, rows with label 1."""
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    return n - int(ones or 0), int(ones or 0)


def stable_seed(name: str) -> int:
    return zlib.crc32(name.encode()) % 10_000
