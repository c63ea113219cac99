"""Suffix-array dedup: depth-limited radix passes over suffixes find every window that recurs.

Each pass refines the groups of the one before by a longer piece of the suffixes in it, and drops what is alone:

1. the anchor, a k-gram that the content of a window alone chooses (its least k-gram by hash), so that equal
   windows have it at the same place; neighbouring windows with one anchor form a range and are one row;
2. the whole range: where one recurs, all its windows do;
3. bins of BIN neighbouring windows about an anchor: by what they share, then by all that they span;
4. single windows, for the few bins at the ends of repeated passages.

Every pass is a count by key that is combined before the shuffle, so no group of copies comes together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import keyed_copy, materialise, slices
from collegium.llm.lines import mixed

WINDOW, GRAM, BIN = 400, 128, 16
#: Window starts of a text that are looked at together; longer texts are taken in parts.
PART = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MASK = (1 << 64) - 1


BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


class Anchors:
    """ranges(raw) gives (hash, anchor, first, last) of the ranges of window starts with one anchor."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM, part: int = PART) -> None:
        self.window, self.gram, self.part = window, gram, part
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = min(max(n, 1 << 16, 2 * len(self.powers)), max(n, self.part + self.window))
            self.powers, self.inverses = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (BASE, INVERSE))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """A hash of the k-gram that starts at each byte."""
        n, k = len(at), self.gram
        self._grow(n)
        before = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[at] * self.inverses[:n], out=before[1:])
        return mixed((before[k:] - before[:-k]) * self.powers[: n - k + 1])

    def ranges(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole = np.frombuffer(raw, np.uint8)
        starts = len(whole) - self.window + 1
        found = [self._part(whole[s : s + self.part + self.window - 1], s) for s in range(0, starts, self.part)]
        if not found:
            return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _part(self, at: np.ndarray, offset: int):
        hashes = self.hashes(at)
        placed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_least(placed, self.window - self.gram + 1) & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
        anchor = place[first]
        return hashes[anchor], anchor + offset, first + offset, last + offset


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, from running minima forth and back within blocks of span."""
    n = len(values)
    padded = np.full(-(-n // span) * span, MASK, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], forth[span - 1 : n])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


RANGES = "doc_id long, text_key long, anchor_hash long, anchor int, lo int, hi int, span_hash long"


def _ranges(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window, gram)
        for batch in slices(batches):
            ids, keys, columns, spans = [], [], [], []
            for doc_id, key, raw in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_key", "raw"))):
                hashes, anchor, lo, hi = anchors.ranges(raw)
                ids += [doc_id] * len(hashes)
                keys += [key] * len(hashes)
                columns.append((hashes.view(np.int64), anchor, lo, hi))
                view = memoryview(raw)
                # Where the anchor stands in the span is part of it: equal spans are equal from the anchor's view.
                spans += [_signed(xxhash.xxh64_intdigest(view[a : b + window], c - a)) for a, b, c in zip(lo.tolist(), hi.tolist(), anchor.tolist())]
            if ids:
                hashes, anchor, lo, hi = (np.concatenate(x) for x in zip(*columns))
                arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(hashes), *(pa.array(x.astype(np.int32)) for x in (anchor, lo, hi)), pa.array(spans, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "anchor_hash", "anchor", "lo", "hi", "span_hash"])

    return run


#: What tells rows apart whose result can differ: the id (0 for none) and a hash of the text.
KEY = ["doc_id", "text_key"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit(""))
    given = F.col(id_col).cast("long")
    return docs.select(F.coalesce(given, F.lit(0)).alias("doc_id"), F.xxhash64(raw).alias("text_key"), raw.cast("binary").alias("raw"), given.alias("given_id"))


CONTENTS = "doc_id long, text_key long, anchor_hash long, anchor int, lo int, hi int, open boolean, content binary"


def _contents(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, key, raw, wanted in zip(*(batch.column(n).to_pylist() for n in (*KEY, "raw", "wanted"))):
                rows += [(doc_id, key, w["anchor_hash"], w["anchor"], w["lo"], w["hi"], w["open"], raw[w["lo"] : w["hi"] + window]) for w in wanted]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            names = ["doc_id", "text_key", "anchor_hash", "anchor", "lo", "hi", "open", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    return run


BINS = "doc_id long, text_key long, lo int, p0 int, p1 int, open boolean, core long, whole long"


def _bins(window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, key, mark, anchor, lo, hi, is_open, content in zip(*(c.to_pylist() for c in batch.columns)):
                for b in range((anchor - hi) // size, (anchor - lo) // size + 1):
                    last = anchor - size * b  # the last start of the bin; its windows all hold what starts there
                    p0, p1 = max(last - size + 1, lo), min(last, hi)
                    seed = (mark + b * int(BASE)) & MASK
                    # In each of the bin's windows, so in the content even where the range holds a part of the bin.
                    core = xxhash.xxh64_intdigest(content[last - lo : last - size + 1 - lo + window], seed)
                    whole = xxhash.xxh64_intdigest(content[p0 - lo : p1 - lo + window], (seed + (last - p0) * size + (last - p1)) & MASK)
                    rows.append((doc_id, key, lo, p0, p1, is_open, _signed(core), _signed(whole)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["doc_id", "text_key", "lo", "p0", "p1", "open", "core", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    return run


WINDOWS = "doc_id long, text_key long, p0 int, open boolean, digest binary"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            ids, keys, places, opens, digests = [], [], [], [], []
            for doc_id, key, lo, content, wanted in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_key", "lo", "content", "wanted"))):
                for w in wanted:
                    for p in range(w["p0"], w["p1"] + 1):
                        ids.append(doc_id)
                        keys.append(key)
                        places.append(p)
                        opens.append(w["open"])
                        digests.append(xxhash.xxh3_128_digest(content[p - lo : p - lo + window]))
            arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(opens, pa.bool_()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "p0", "open", "digest"])

    return run


def _merged(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for starts in batch.column("starts").to_pylist():
                spans: list[list[int]] = []
                for s in sorted((x["p0"], x["p1"]) for x in starts):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1] + window)
                    else:
                        spans.append([s[0], s[1] + window])
                out.append([x for s in spans for x in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "text_key", "spans"])

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, size: int = BIN) -> DataFrame:
    """KEY and spans of the rows (of _rows) that hold a window of `window` bytes that recurs anywhere.

    spans lists begin and end (bytes) of each maximal run that such windows cover.
    """
    ranges = materialise(rows.select(*KEY, "raw").mapInArrow(_ranges(window, gram), RANGES), "ranges")
    again = ranges.groupBy("anchor_hash").count().where("count > 1").select("anchor_hash")
    # Written before they are counted, so that an anchor with many rows can be split by the join.
    ranges = materialise(ranges.join(again, "anchor_hash"), "recurring")
    one = F.struct(*KEY, "anchor", "lo", "hi")
    spans = materialise(ranges.groupBy("anchor_hash", "span_hash").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "spans")
    found = ranges.join(spans.where("n > 1").select("anchor_hash", "span_hash"), ["anchor_hash", "span_hash"])
    found = found.select(*KEY, F.col("lo").alias("p0"), F.col("hi").alias("p1"))

    # Ranges that are alone, among others with their anchor, go on; of equal ranges, one goes with them.
    alone = spans.where("n = 1").select("anchor_hash").distinct()
    left = spans.join(alone, "anchor_hash").select("anchor_hash", "one.*", (F.col("n") == 1).alias("open"))
    wanted = materialise(left.groupBy(*KEY).agg(F.collect_list(F.struct("anchor_hash", "anchor", "lo", "hi", "open")).alias("wanted")), "wanted")
    contents = rows.select(*KEY, "raw").join(wanted.hint("shuffle_hash"), KEY)
    contents = materialise(contents.mapInArrow(_contents(window), CONTENTS), "contents")

    bins = materialise(contents.mapInArrow(_bins(window, size), BINS), "bins")
    member = F.struct(*KEY, "lo", "p0", "p1", "open")
    equal = materialise(bins.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("one")), "equal")
    whole = bins.where("open").join(equal.where("n > 1").select("core", "whole"), ["core", "whole"]).select(*KEY, "p0", "p1")
    cores = equal.groupBy("core").agg(F.sum("n").alias("members"), F.max((F.col("n") == 1) & F.col("one.open")).alias("unsettled"))
    cores = cores.where("members > 1 AND unsettled").select("core")

    # One bin of each kind under a core that is not settled gives its windows; those of kinds that recur are known.
    kinds = equal.join(cores, "core").select("one.*", "n")
    wanted = kinds.groupBy(*KEY, "lo").agg(F.collect_list(F.struct("p0", "p1", ((F.col("n") == 1) & F.col("open")).alias("open"))).alias("wanted"))
    last = contents.dropDuplicates([*KEY, "lo"]).join(materialise(wanted, "wanted"), [*KEY, "lo"])
    last = materialise(last.select(*KEY, "lo", "content", "wanted").mapInArrow(_windows(window), WINDOWS), "windows")
    twice = last.groupBy("digest").count().where("count > 1").select("digest")
    single = last.where("open").join(twice, "digest").select(*KEY, "p0", F.col("p0").alias("p1"))

    starts = found.unionByName(whole).unionByName(single).groupBy(*KEY).agg(F.collect_set(F.struct("p0", "p1")).alias("starts"))
    return starts.mapInArrow(_merged(window), "doc_id long, text_key long, spans array<int>")


def without_spans(raw: bytes, spans: list[int]) -> tuple[bytes, int]:
    """A text without its spans, and how many bytes these had."""
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw) - len(out)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean, kept_share double"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for given, raw, spans in zip(*(batch.column(n).to_pylist() for n in ("given_id", "raw", "spans"))):
            kept, removed = without_spans(raw, spans or [])
            rows.append((given, len(raw), removed, len(spans or []) // 2, hashlib.sha256(kept).hexdigest(), removed > 0, len(kept) / len(raw) if raw else 1.0))
        types = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.float64()]
        names = [x.split()[0] for x in REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)


def suffix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, size: int = BIN) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay), whether
    anything goes (repeated) and the share of bytes that stays (kept_share, 1 for an empty text).

    Every byte goes that a window covers which also starts anywhere else, in the same text or another. Null text is
    empty; texts shorter than a window stay as they are. Rows that repeat id and text recur in each other, so they
    lose all their windows. An empty table gives no rows, and other columns, whatever their names, are ignored. Texts are copied once, in
    buckets by KEY; both joins with them move the other side only.
    """
    rows = keyed_copy(_rows(docs, id_col, text_col), KEY, "documents", F.octet_length("raw"))
    spans = materialise(repeated_spans(rows, window, gram, size), "found")
    return rows.join(spans.hint("shuffle_hash"), KEY, "left").select("given_id", "raw", "spans").mapInArrow(_report, REPORT)
