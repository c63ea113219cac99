"""Filter interaction audit: what each of five filters removes at each place of each order.

Duplicates, which one of the filters needs, are found by partition refinement.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import materialise, slices

#: The filters' letters; the bit of the i-th is 1 << i.
FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
#: Filter A fails texts of fewer words than this; B those whose distinct words are fewer than so many of a hundred; C
#: those with more capitals than so many of a hundred code points; D those with any of the marks.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
A_TO_Z = bytes(range(ord("A"), ord("Z") + 1))

#: Bytes of a text's first block, and how many times as far as the one before each later block reaches.
FIRST_BLOCK, WIDER = 256, 16
#: Bits of the map of classes that texts are read again for: 4 MB, whatever the number of classes.
CLASS_BITS = 1 << 25
MARKED = "doc_id long, part string, mask int, n long, blocks array<long>"
CLASS = ["n", "blocks"]


def own_mask(raw: bytes, n: int) -> int:
    """The filters but E that a text of n code points fails."""
    words = raw.split()
    mask = BIT["A"] * (len(words) < LEAST_WORDS)
    mask |= BIT["B"] * (100 * len(set(words)) < DISTINCT * len(words))
    mask |= BIT["C"] * (100 * (len(raw) - len(raw.translate(None, A_TO_Z))) > CAPITALS * n)
    return mask | BIT["D"] * (len(raw.translate(None, MARKS)) < len(raw))


def block_hashes(raw: bytes, further: int = 0, bits: int = 64) -> list[int]:
    """Hashes of a text's successive blocks, each wider than the one before, and `further` ones of the whole text."""
    found, at, end = [], 0, FIRST_BLOCK
    while at < len(raw):
        found.append(xxhash.xxh3_64_intdigest(raw[at:end]))
        at, end = end, end * WIDER
    found += [xxhash.xxh3_64_intdigest(raw, seed) for seed in range(1, further + 1)]
    return [(x >> (64 - bits)) - (1 << 63 if bits == 64 else 0) for x in found]


def _marks(further: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = pc.utf8_length(batch.column("text")).cast(pa.int64())
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            masks = [own_mask(raw, size) for raw, size in zip(raws, n.to_pylist())]
            blocks = pa.array([block_hashes(raw, further, bits) for raw in raws], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), n, blocks], names=["doc_id", "part", "mask", "n", "blocks"])

    return run


def _class_bit(n: int, blocks: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array([n, *blocks], np.int64).tobytes()) % CLASS_BITS


def _class_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_class_bit(n, b) + 1 for n, b in zip(batch.column("n").to_pylist(), batch.column("blocks").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["bit"])


def _texts_of(wanted: dict[int, bytes], further: int, bits: int):
    """The texts whose class may be wanted; a map of bits never misses one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = pc.utf8_length(batch.column("text")).to_pylist()
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            classes = [block_hashes(raw, further, bits) for raw in raws]
            keep = []
            for n, blocks in zip(sizes, classes):
                part, bit = divmod(_class_bit(n, blocks), 1 << 15)
                keep.append(part + 1 in wanted and bool(wanted[part + 1][bit >> 3] >> (bit & 7) & 1))
            rows = [(n, b, raw) for n, b, raw, k in zip(sizes, classes, raws, keep) if k]
            n, blocks, raws = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(raws, pa.binary())], names=["n", "blocks", "text"])

    return run


def refined(marked: DataFrame) -> DataFrame:
    """The rows of marked whose class two or more rows share: equal code-point length and equal block hashes.

    A pass splits the classes by the next block and drops rows that are alone, until the longest text that is left has
    no further block. Classes are counted before the shuffle; a class of many rows meets its count in as many tasks
    as adaptive skew handling makes.
    """
    left, depth = marked, 0
    while True:
        block = [F.coalesce(F.get("blocks", F.lit(i)), F.lit(0)).alias(f"block{i}") for i in range(depth)]
        keys = ["n", *[f"block{i}" for i in range(depth)]]
        rows = left.select("*", *block)
        shared = materialise(rows.groupBy(*keys).count().where("count > 1").select(*keys), "shared")
        left = materialise(rows.join(shared, keys, "left_semi").select(*marked.columns), "left")
        longest = left.agg(F.max(F.size("blocks"))).head()[0]
        if not longest or depth >= longest:
            return left
        depth += 1


def false_classes(rows: DataFrame, left: DataFrame, further: int, bits: int) -> DataFrame:
    """The classes whose texts are not all the same, by the texts themselves.

    Which classes are left goes to the scan as a map of CLASS_BITS bits, so that other texts stay where they are; equal
    texts are combined before the shuffle, so a group of copies is one row for each task.
    """
    bit = left.select(*CLASS).distinct().mapInArrow(_class_bits, "bit long")
    found = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    wanted = {r.part: bytes(r.bits) for r in found}
    texts = rows.select("text").mapInArrow(_texts_of(wanted, further, bits), "n long, blocks array<long>, text binary")
    return texts.groupBy(*CLASS, "text").agg(F.lit(1).alias("one")).groupBy(*CLASS).count().where("count > 1")


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bits: int = 64) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, and those of them that a label marks.

    E fails a row if a row with a smaller id has the same text anywhere in the table. See filter_audit for odd rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = materialise(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")), "labelled")
    further = 0
    while True:
        marked = materialise(rows.mapInArrow(_marks(further, bits), MARKED).join(known, "doc_id", "left"), "marked")
        left = refined(marked)
        if false_classes(rows, left, further, bits).limit(1).count() == 0:
            break
        further += 1  # different texts shared a class: one hash more of the whole text tells them apart
    least = materialise(left.groupBy(*CLASS).agg(F.min("doc_id").alias("least")), "least")
    cell = ["part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    later = left.join(least, CLASS).where(F.col("doc_id") > F.col("least")).select(*cell)
    every = marked.select(*cell, F.lit(1).alias("n")).unionByName(later.select("*", F.lit(-1).alias("n")))
    every = every.unionByName(later.select("part", (F.col("mask") + F.lit(BIT["E"])).alias("mask"), "good", "toxic", F.lit(1).alias("n")))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bits: int = 64) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty and fails A; a null part is the empty string. E needs a smaller id, so rows that repeat the
    least id of their text pass it, and so do rows without an id, which fail no other row either. A document with
    several label rows is good or toxic if one of them says so. Other columns are ignored; no documents give no rows.
    bits: of a block's hash, for tests.
    """
    cells = audited(docs, labels, id_col, text_col, part_col, bits)
    # At most 2^5 cells of a part come together; each part has a row for each order and step from here on.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(BIT[o[i]]).alias("own"), F.lit(sum(BIT[x] for x in o[:i])).alias("before")) for o in orders for i in range(len(o))])
    rows = parts.select("part", "cells", F.inline(steps))
    own, before = F.col("own"), F.col("before")

    def total(field: str, holds, times=lambda mask: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda so_far, c: so_far + F.when(holds(c["mask"]), c[field] * times(c["mask"])).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(own) > 0
    gone = lambda m: m.bitwiseAND(before) > 0
    here = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # Of all orders, a share of one in as many as the filters that a document fails puts this one first of these.
        total("n", fails, lambda m: (F.lit(len(orders)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )
