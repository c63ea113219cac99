"""Packing documents into sequences by cutting-stock column generation over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from collegium.llm.common import materialise, running_total, slices
from collegium.llm.tokens import WORD_BPE, encoder, tokenizer_path

#: Tokens of a sequence, the id behind each document, tokens that a length class spans.
LENGTH, END, GRID = 2048, 1, 8
#: The linear program ends when it is within a sequence of its lower bound, or within this share of it.
GAP = 1e-4
BUCKET_ROWS = 2_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, length: int, end: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path, False, special).encode, np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encode(text) + tail)
                total = len(ids) // 4
                for at in range(0, total, length):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), total))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Documents cut into full sequences and a remainder; null text is empty, so it is the end id alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or tokenizer_path(WORD_BPE), length, end, special), PIECES)


@dataclass
class Pattern:
    """So many sequences (copies), each with items[k] pieces of class k."""

    items: np.ndarray
    copies: int


def best_pattern(price: np.ndarray, units: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of capacity with the highest price, by dynamic programming; each class as often as wanted."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = units <= c
        value = np.where(fits, price + best[np.maximum(c - units, 0)], -1.0)
        k = int(value.argmax())
        best[c], choice[c] = (value[k], k) if value[k] > best[c - 1] else (best[c - 1], -1)
    items, c = np.zeros(len(units), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            items[choice[c]] += 1
            c -= units[choice[c]]
    return float(best[capacity]), items


def linear_program(counts: np.ndarray, units: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as columns, copies, bound): sequences for counts[k] pieces of units[k] each, in fractions.

    The revised simplex method; a knapsack prices the column that enters. With the best column's price v, the prices
    divided by v allow no column, so total / v bounds the optimum from below (as does the sum of units). The program
    ends by that bound, never by a number of columns. Counts are raised by less than a thousandth, each by another
    amount, so that no step is idle and the method can't cycle.
    """
    classes = len(units)
    basis = np.diag(capacity // units).astype(float)
    inverse = np.diag(1.0 / (capacity // units))
    copies = inverse @ (counts + 1e-3 * (1 + np.arange(classes)) / (classes + 1))
    bound = float(counts @ units) / capacity
    while True:
        value, entering = best_pattern(inverse.sum(axis=0), units, capacity)
        total = float(copies.sum())
        bound = max(bound, total / max(value, 1.0))
        if value <= 1 + 1e-9 or total - bound <= max(1.0, gap * bound):
            return basis, copies, bound
        step = inverse @ entering
        grows = step > 1e-9
        ratio = np.full(classes, np.inf)
        ratio[grows] = copies[grows] / step[grows]
        leaving = int(ratio.argmin())
        pivot = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, pivot)
        inverse[leaving] = pivot
        copies -= step * ratio[leaving]
        copies[leaving] = ratio[leaving]
        copies = np.maximum(copies, 0)
        basis[:, leaving] = entering


def cutting_stock(counts: np.ndarray, units: np.ndarray, capacity: int, gap: float = GAP) -> list[Pattern]:
    """Patterns that hold counts[k] pieces of units[k] each, in few sequences of capacity.

    The linear program's copies are rounded down, and what is left, less than a sequence for each class, is packed
    first-fit decreasing. The work depends on the number of classes, not of documents.
    """
    classes = len(units)
    if not classes:
        return []
    basis, copies, _ = linear_program(counts, units, capacity, gap)
    whole = np.floor(copies + 1e-9).astype(np.int64)
    found = [Pattern(basis[:, j].astype(np.int64), int(n)) for j, n in enumerate(whole) if n]
    left = np.maximum(counts - basis.astype(np.int64) @ whole, 0)
    bins: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-units, kind="stable"):
        for _ in range(int(left[k])):
            at = next((i for i, (free, _) in enumerate(bins) if free >= units[k]), None)
            if at is None:
                bins.append((capacity, np.zeros(classes, np.int64)))
                at = len(bins) - 1
            bins[at][1][k] += 1
            bins[at] = (bins[at][0] - int(units[k]), bins[at][1])
    merged: dict[bytes, Pattern] = {}
    for _, items in bins:
        merged.setdefault(items.tobytes(), Pattern(items, 0)).copies += 1
    return found + list(merged.values())


def seats(patterns: list[Pattern], units: np.ndarray) -> dict[int, np.ndarray]:
    """By units of a class: rows (ranks before, pieces of the class in a sequence, first sequence) for each pattern."""
    table: dict[int, list] = {int(u): [] for u in units}
    before, first = np.zeros(len(units), np.int64), 0
    for p in patterns:
        for k in np.flatnonzero(p.items):
            table[int(units[k])].append((before[k], p.items[k], first))
            before[k] += p.items[k] * p.copies
        first += p.copies
    return {u: np.array(rows, np.int64) for u, rows in table.items()}


def _seated(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units, rank = batch.column("units").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(units), np.int64)
            for u in np.unique(units):
                mine, rows = np.flatnonzero(units == u), table[int(u)]
                at = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[at, 2] + (rank[mine] - rows[at, 0]) // rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is cut at multiples of length only; its remainder stays whole. Lengths are rounded up to the grid,
    so that patterns cover length / grid classes whatever the table's size, and only their histogram reaches the
    driver. Pieces of a class are ranked by a hash, in buckets that split a class of any share, and a piece's rank
    tells its pattern and sequence. Rows that repeat a doc_id, or have none, are documents of their own; null text is
    empty and gives the end id alone; other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    cut = pieces(docs, tokenizer, length, end, id_col, text_col, special)
    shuffled = F.shiftrightunsigned(F.xxhash64("doc_id", "start", "ids_crc32"), 1)
    cut = materialise(cut.withColumn("units", F.ceil(F.col("length") / grid).cast("int")).withColumn("shuffled", shuffled), "pieces")
    histogram = {r["units"]: r["n"] for r in cut.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}
    units = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[u] for u in units.tolist()], np.int64)
    table = seats(cutting_stock(counts, units, length // grid), units)
    buckets = max(1, int(counts.sum()) // BUCKET_ROWS)
    order = ["shuffled", "doc_id", "start", "length", "ids_crc32"]
    ranked = cut.withColumn("bucket", F.floor(F.col("shuffled") / float(1 << 63) * buckets))
    ranked = running_total(ranked, ["units"], "bucket", order, F.lit(1), "rank")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", "rank"]
    seated = ranked.select(*columns).mapInArrow(_seated(table), f"{PIECES}, units int, rank long, sequence_id long")
    before = W.partitionBy("sequence_id").orderBy(F.desc("units"), "rank").rowsBetween(W.unboundedPreceding, -1)  # a sequence holds 2,048 pieces at most
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("units", "rank")
