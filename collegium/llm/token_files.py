"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.llm.common import by_id, keep, shared_dir, slices
from collegium.llm.tokens import BYTE_BPE, encoder, tokenizer_path

#: Appended to each document.
END = 2
SCHEMA = "doc_id long, skip long, n_tokens long, ids array<int>"


def _encode(path: str, end: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, skip = encoder(path, True, special).encode, np.array([end], "<u4").tobytes(), 0
        for batch in slices(batches):
            found = [encode(x) + tail for x in batch.column("text").to_pylist()]
            ends = skip + np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64)
            ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array((ends - skip).astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends[:-1]), pa.array(np.diff(ends)), lists], names=["doc_id", "skip", "n_tokens", "ids"])
            skip = int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, special: bool = False) -> None:
    """Writes doc_id, skip (ids before it in its file), n_tokens and ids (with the end id) in ascending doc_id order.

    Texts are range-partitioned by doc_id and encoded where they land, so that ids are not shuffled; each partition
    becomes a file, numbered in the order. Stripes can be read in parallel; their indexes and the Bloom filter on
    doc_id prune look-ups. Null text is empty, null ids come first, rows that repeat an id are ordered by a hash of
    their text and may go on in the next file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = by_id(rows).mapInArrow(_encode(tokenizer or tokenizer_path(BYTE_BPE), end, special), SCHEMA)
    options = {"compression": "lz4", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes)}
    encoded.write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, as the files have them."""
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"))
    # The files' sizes come from two narrow columns; no ids are read for them. A row for each file goes through this
    # window's one task.
    files = rows.groupBy("file").agg(F.max(F.col("skip") + F.col("n_tokens")).alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Two longs for each file, of which there are as many as the write had partitions.
    return rows.join(F.broadcast(files), "file").select("doc_id", (F.col("before") + F.col("skip")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column("ids")
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_report(docs: DataFrame, special: bool = False) -> DataFrame:
    """Writes the token files into the shared folder, reads them and gives doc_id, start, n_tokens and ids_crc32.

    One row per row of docs: null text is empty, null ids come first, rows that repeat an id have a row each, other
    columns (whatever their names) are ignored, an empty table gives no rows. The files go when the driver's Python ends.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    keep(spark, path)
    write_token_files(docs, path, special=special)
    return read_token_files(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
