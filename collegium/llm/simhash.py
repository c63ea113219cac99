"""SimHash near-dedup: fingerprints that differ in few bits meet on variants half the radius away."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import materialise, slices
from collegium.llm.components import connected_components
from collegium.llm.line_dedup import copy_of

BITS = 64
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Variants that a task expands at a time.
VARIANTS = 1 << 20
#: Hashes whose bits are counted at a time.
HASHES = 1 << 15


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a text in UTF-8: A-Z lower-cased, words joined by a space."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(words) - width])] if len(words) > width else [0]
    ends = ends[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, len(ends))


def fingerprint(raw: bytes | None) -> int:
    """The SimHash of a text as a signed 64-bit integer; a bit is 1 if over half of the hashes have it. No word: 0."""
    hashes = shingle_hashes(raw or b"")
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [fingerprint(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (a long) for each row; null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def flips(width: int, most: int) -> list[int]:
    """All masks with at most `most` (0 to 2) of the lowest `width` bits set, fewest first."""
    one = [1 << i for i in range(width)] if most else []
    two = [a | b for i, a in enumerate(one) for b in one[:i]] if most > 1 else []
    return [0, *one, *two]


def prefix_bits(fingerprints: int, half: int = RADIUS // 2) -> int:
    """Leading bits of a variant that are its shuffle key, so that a key gets about VARIANTS / 2 variants."""
    variants = fingerprints * sum(math.comb(BITS, k) for k in range(half + 1))
    return min(30, max(4, math.ceil(math.log2(max(1, 2 * variants / VARIANTS)))))


class Ball:
    """Collisions among the variants of fingerprints, all of those within `half` flips, in bounded memory.

    A row is (near, left, fp): near is fp with its flips in the first `bits` bits made, left the flips that remain
    for the others.
    """

    STEP = 4

    def __init__(self, bits: int, half: int = RADIUS // 2, radius: int = RADIUS) -> None:
        self.bits, self.half, self.radius = bits, half, radius
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def low(self, width: int, left: int) -> np.ndarray:
        if (width, left) not in self.masks:
            self.masks[width, left] = np.array(flips(width, left), np.uint64)
        return self.masks[width, left]

    def links(self, near: np.ndarray, left: np.ndarray, fp: np.ndarray, bits: int | None = None) -> list[np.ndarray]:
        """Pairs of fingerprints, as arrays (n, 2), that join all that share a variant."""
        bits = self.bits if bits is None else bits
        width = BITS - bits
        if len(np.unique(fp)) < 2:
            return []
        if sum(int((left == k).sum()) * len(self.low(width, k)) for k in range(self.half + 1)) > VARIANTS and width > self.STEP:
            return self._split(near, left, fp, bits)
        variant, owner = [], []
        for k in range(self.half + 1):
            mine = np.flatnonzero(left == k)
            variant.append((near[mine, None] ^ self.low(width, k)[None, :]).ravel())
            owner.append(np.repeat(mine, len(self.low(width, k))))
        variant, owner = np.concatenate(variant), np.concatenate(owner)
        order = np.argsort(variant)
        variant = variant[order]
        same = np.flatnonzero(variant[1:] == variant[:-1])
        a, b = fp[owner[order[same]]], fp[owner[order[same + 1]]]
        near_enough = np.bitwise_count(a ^ b) <= self.radius  # holds for any two that share a variant
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[near_enough & (a != b)]
        return [spanning(pairs)] if len(pairs) else []

    def _split(self, near: np.ndarray, left: np.ndarray, fp: np.ndarray, bits: int) -> list[np.ndarray]:
        """A large key is cut by the next STEP bits, one value at a time."""
        below = BITS - bits - self.STEP
        found = []
        for value in range(1 << self.STEP):
            differ = ((near >> np.uint64(below)) & np.uint64((1 << self.STEP) - 1)) ^ np.uint64(value)
            used = np.bitwise_count(differ).astype(left.dtype)
            mine = used <= left
            found += self.links(near[mine] ^ (differ[mine] << np.uint64(below)), left[mine] - used[mine], fp[mine], bits + self.STEP)
        return found


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least, member) with the components of the given ones, at most one for each node."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, at[:, 0], low)
        np.minimum.at(new, at[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[member]], nodes[member]], axis=1)


def _links(bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(bits, radius // 2, radius)
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(key, fp, left):
            near = (fp & np.uint64((1 << (BITS - bits)) - 1)) | (key.astype(np.uint64) << np.uint64(BITS - bits))
            found = ball.links(near, left, fp)
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
            pairs = spanning(pairs) if len(pairs) else pairs
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(np.int64)) for i in (0, 1)], names=["u", "v"])

        for batch in batches:  # sorted by key: what precedes the last key is complete
            held.append(tuple(batch.column(n).to_numpy() for n in ("key", "fp", "left")))
            rows += batch.num_rows
            if rows < VARIANTS // 256:
                continue
            key, fp, left = (np.concatenate(x) for x in zip(*held))
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield out(key[:done], fp[:done].view(np.uint64), left[:done])
            held, rows = [(key[done:], fp[done:], left[done:])], len(key) - done
        if held:
            key, fp, left = (np.concatenate(x) for x in zip(*held))
            yield out(key, fp.view(np.uint64), left)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) whose components are those of fingerprints (column fp) at most `radius` bits apart, even, to 4.

    Meet in the middle: every fingerprint emits all variants within radius / 2 flips, and two fingerprints are
    linked if they share a variant; any two that do are at most radius apart, so a chain through those that share
    one loses no link. The leading bits of a variant are the shuffle key. Only the flips in these are made before
    the shuffle, the others by the task that gets the key, so that some 50 rows are shuffled for 2,081 variants.
    """
    half = radius // 2
    bits = prefix_bits(distinct.count(), half)
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(half - m.bit_count()).cast("byte").alias("left")) for m in flips(bits, half)])
    top = F.shiftrightunsigned("fp", BITS - bits)
    rows = distinct.select("fp", F.explode(masks).alias("flip")).select(top.bitwiseXOR(F.col("flip.mask").cast("long")).alias("key"), "fp", "flip.left")
    edges = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(bits, radius), "u long, v long")
    return edges.distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id (least doc_id of its component).

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id never names a component unless
    it is alone there (then null). Rows that repeat a doc_id have a row each. Copies share a fingerprint, and only
    distinct fingerprints are compared; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(materialise(fingerprint_links(distinct.select("fp"), radius), "links"))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raws = [x or b"" for x in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), pa.array([copy_of(x) for x in raws], pa.int64()), pa.array([fingerprint(x) for x in raws], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "fp"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row of docs for each component of near_dedup: that with the least id, null last.

    Rows that share an id are told apart by a hash of their texts, of which the least stays; of rows that repeat id and
    text, one stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    prints = materialise(rows.mapInArrow(_prints, "doc_id long, copy long, fp long"), "fingerprints")
    none = F.col("doc_id").isNull().alias("_none")
    named = prints.groupBy("fp", "doc_id", "copy").agg(F.count(F.lit(1)).alias("_rows"))
    named = named.select("fp", F.struct(none, F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("copy").alias("_copy"), "_rows").alias("least"))
    distinct = materialise(named.groupBy("fp").agg(F.min("least").alias("least")), "distinct")
    roots = connected_components(materialise(fingerprint_links(distinct.select("fp"), radius), "links"))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = materialise(member.agg(F.min("least").alias("least")).select("least.*"), "kept")
    identity = {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_none": F.col(id_col).cast("long").isNull(), "_copy": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    # The one time that texts move: rows meet a narrow list whose size follows the table's.
    once = docs.withColumns(identity).join(kept.hint("shuffle_hash"), list(identity))
    if not kept.where("_rows > 1").limit(1).count():
        return once.select(*docs.columns)
    repeated = once.where("_rows > 1").dropDuplicates(list(identity))
    return once.where("_rows = 1").select(*docs.columns).unionByName(repeated.select(*docs.columns))
