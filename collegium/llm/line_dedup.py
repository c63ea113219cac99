"""Line dedup: lines meet on shingles of which the edits of near lines spare one, and the earliest stays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import MAP_LONGS, materialise, scope, slices
from collegium.llm.lines import BINS, FACTORS, Block, blocks, mixed, sketch_distance

#: Words of a line for near matches at least; shorter lines match when equal only.
LEAST_WORDS = 5
#: Words of the longer line for each edit that two near lines may be apart, a likeness of 0.8; ONE_EDIT: one in all.
WORDS_AN_EDIT, ONE_EDIT = 5, 0
#: Of so many documents one, or of a smaller table about so many, has its shingles counted; cells of the map of counts.
SHARE, SAMPLE, CELLS = 16, 2_000, 1 << 23
#: Lines that a task remembers to have emitted.
REMEMBERED = 200_000
#: Bits of a shingle's id and of a line's tag with a flag, whole bytes; a row of packed keys is both and the line's words.
KEY_BITS, TAG_BITS = 40, 48
ROW = KEY_BITS // 8 + TAG_BITS // 8 + 2
#: Bits of a shingle's count in the map; with KEY_BITS they leave 19 for the lines of a block, which has less than 1 MB.
COUNT_BITS = 5
#: Keys, about, that a task packs at a time, and parts of packed keys for each shuffle partition.
PACKED, PARTS = 1 << 18, 4

#: Earlier lines of a key, besides the earliest, that a line is held against first, and pairs compared at a time.
DRAWN, COMPARED = 3, 1 << 16

#: What tells rows apart: whether there is an id, the id (0 for none) and a hash of the text.
KEY = ["given", "_id", "copy"]
#: Shingles tried beyond one for each edit and one more, as multiples of the edits; the last is always enough.
STEPS = [0.8, 0.95, 1.1, 1.3, 1.6, 2.0]
KEYS = "given boolean, _id long, copy long"
LINES = f"{KEYS}, line int, words int, tag long, digest binary, sketch binary"


def bound(words: int, an_edit: int = WORDS_AN_EDIT) -> int:
    """The edits within which a line is near, by the words of the longer of both."""
    return words // an_edit if an_edit else 1


def reach(words: int, an_edit: int = WORDS_AN_EDIT) -> int:
    """The most edits within which a line of so many words is near to any other, longer ones included."""
    return words // (an_edit - 1) if an_edit else 1


def copy_of(raw: bytes) -> int:
    """Tells rows apart that repeat an id with different texts; the same as Spark's xxhash64 of the text."""
    value = xxhash.xxh64_intdigest(raw, 42)
    return value - (1 << 64) if value >> 63 else value


def _short(tags: np.ndarray) -> np.ndarray:
    """Tags as they are stored and shuffled."""
    return (tags >> np.uint64(65 - TAG_BITS)).view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in KEY]
        for block in blocks(batch.column("raw").to_pylist()):
            digests = [xxhash.xxh3_128_digest(block.content(i)) for i in range(len(block.doc))]
            sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS // 4), len(block.doc), [None, pa.py_buffer(block.sketches().tobytes())])
            columns = [*(pa.array(x[block.doc]) for x in keys), pa.array(block.line.astype(np.int32)), pa.array(block.words.astype(np.int32)), pa.array(_short(block.tags()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), sketches.cast(pa.binary())], names=[*KEY, "line", "words", "tag", "digest", "sketch"])


def edits_to_harm(chosen: np.ndarray, first: np.ndarray, words: np.ndarray, most: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted line, the edits that it takes at least to harm all its chosen shingles, counted up to most + 1.

    One edit harms those at three places in a row, so going from the left, each edit starts at the next unharmed one.
    """
    size = len(chosen)
    following = np.full(size + 1, size)
    following[:size] = np.minimum.accumulate(np.where(chosen, np.arange(size), size)[::-1])[::-1]
    edits = np.zeros(len(first), np.int64)
    line = np.flatnonzero(wanted)
    place = first[line]
    while len(line):
        place = following[np.minimum(place, size)]
        inside = place < first[line] + words[line]
        line, place = line[inside], place[inside] + 3
        edits[line] += 1
        going = edits[line] <= most[line]
        line, place = line[going], place[going]
    return edits


def shingle_ids(found: np.ndarray) -> np.ndarray:
    """Ids of KEY_BITS bits; different shingles may share one, and all that follows takes them for one shingle."""
    return found >> np.uint64(64 - KEY_BITS)


def rarest_first(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers that put ids in one order for all lines: by the counts of their cells, then by themselves."""
    return counts[(ids & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(KEY_BITS) | ids


def keys(block: Block, counts: np.ndarray, an_edit: int = WORDS_AN_EDIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, lines, early): the least shingles of each line that reach() edits can't harm all; near lines share one.

    Shingles are in the order of rarest_first(). Of two near lines, take the one whose keys end first in this order. One
    of its keys is unharmed, so it is a shingle of the other line and comes before the end of that line's keys: it is one
    of them. Early are those that bound() edits of the line itself can't harm all. By the same reason, near lines share
    one that is early in each of them whose own bound is the pair's.
    """
    words, first = block.words, block.first
    most = words // (an_edit - 1) if an_edit else np.ones_like(words)
    own = words // an_edit if an_edit else most
    found = shingle_ids(block.shingles())
    line = np.repeat(np.arange(len(words)), words)
    order = np.argsort(line.astype(np.uint64) << np.uint64(KEY_BITS + COUNT_BITS) | rarest_first(found, counts))
    turn = np.empty(len(found), np.int64)
    turn[order] = np.arange(len(found)) - np.repeat(first, words)
    size = least_enough(turn, first, words, most, words > 0)
    fewer = own < most
    size_early = np.where(fewer, least_enough(turn, first, words, own, fewer), size)
    taken = order[turn[order] < np.repeat(size, words)[order]]
    keys, line, early = found[taken], line[taken], turn[taken] < np.repeat(size_early, words)[taken]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    return keys[once], line[once], early[once]


def least_enough(turn: np.ndarray, first: np.ndarray, words: np.ndarray, most: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted line, how many of its first shingles (by turn) there are to be for `most` edits not to harm all.

    Any number that the edits can't harm will do; a few steps find one near the least.
    """
    enough = np.minimum(words, 3 * most + 1)
    size, open_ = np.minimum(enough, most + 1 + (STEPS[0] * most).astype(np.int64)), wanted.copy()
    for step in STEPS[1:]:
        spared = edits_to_harm(turn < np.repeat(size, words), first, words, most, open_ & (size < enough)) > most
        open_ &= ~spared & (size < enough)
        if not open_.any():
            break
        size = np.where(open_, np.minimum(enough, most + 1 + (step * most).astype(np.int64)), size)
    return size


def _new_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray]]:
    """The lines that may have near ones, with their tags, by block; a task gives a line once, as far as it remembers."""
    seen: set[int] = set()
    for batch in slices(batches):
        for block in blocks(batch.column("raw").to_pylist()):
            block = block.of(block.words >= LEAST_WORDS)
            tags = block.tags()
            new = np.zeros(len(tags), bool)
            for i, tag in enumerate(tags.tolist()):
                if tag not in seen:
                    new[i] = True
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(tag)
            if new.any():
                yield block.of(new), tags[new]


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, _ in _new_lines(batches):
        yield pa.RecordBatch.from_arrays([pa.array(shingle_ids(block.shingles()).view(np.int64))], names=["key"])


def packed(key: np.ndarray, tag: np.ndarray, words: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, keys): keys with their tags and words, ROW bytes each, those of a part in one value.

    Single rows of a key would take some 17 bytes shuffled and as many steps of a sort; parts are by hash.
    """
    part = (((mixed(key) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    low = lambda x, n: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]
    rows = np.concatenate([low(key, KEY_BITS // 8), low(tag, TAG_BITS // 8), low(np.minimum(words, 65535), 2)], axis=1)[order]
    counts = np.bincount(part, minlength=parts)
    given = np.flatnonzero(counts)
    ends = np.concatenate([[0], np.cumsum(counts[given])]) * ROW
    values = pa.Array.from_buffers(pa.binary(), len(given), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(given.astype(np.int32)), values], names=["part", "keys"])


def unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, tags, words) of packed rows; words are 65535 at most, which near lines' words stay near with."""
    rows = np.frombuffer(b"".join(values), np.uint8).reshape(-1, ROW)
    ends, out = np.cumsum([0, KEY_BITS // 8, TAG_BITS // 8, 2]), []
    for a, b in zip(ends[:-1], ends[1:]):
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, : b - a] = rows[:, a:b]
        out.append(wide.view("<i8").ravel())
    return tuple(out)


def _keys(shared, an_edit: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint8)
        held, size = [], 0
        for block, tags in _new_lines(batches):
            found, line, early = keys(block, counts, an_edit)
            held.append((found, _short(tags)[line] << 1 | early, block.words[line]))
            size += len(found)
            if size >= PACKED:
                yield packed(*(np.concatenate(x) for x in zip(*held)), parts)
                held, size = [], 0
        if size:
            yield packed(*(np.concatenate(x) for x in zip(*held)), parts)

    return run


def _met(an_edit: int):
    """Of a part's keys and tags, each once, those whose key has another tag with words that let their lines be near."""

    def run(table: pa.Table) -> pa.Table:
        key, tag, words = unpacked(table.column("keys").to_pylist())
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        order = order[again]
        key, tag, words = key[order], tag[order], words[order]
        order = np.lexsort((tag, words, key))
        key, tag, words = key[order], tag[order], words[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        key, tag, words = key[once], tag[once], words[once]
        # Of a key's lines by their words, none is nearer in words than a neighbour.
        fits = (key[1:] == key[:-1]) & (words[1:] - words[:-1] <= (words[1:] // an_edit if an_edit else 1))
        found = np.zeros(len(key), bool)
        found[1:] |= fits
        found[:-1] |= fits
        return pa.table({"key": key[found], "tag": tag[found]})

    return run


def common_shingles(rows: DataFrame) -> np.ndarray:
    """How often shingles recur in a share of the documents, in powers of two, for each cell that ids are hashed to.

    It only sets an order, in which chance may put a rare shingle late. The share is fixed, so that what counts as
    common doesn't become more as the table grows; the map's size is fixed too.
    """
    share = max(1, min(SHARE, rows.count() // SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("raw"), F.lit(share)) == 0).mapInArrow(_shingles, "key long")
    found = some.groupBy("key").count().where("count > 1").groupBy(F.col("key").bitwiseAND(CELLS - 1).cast("int").alias("cell"))
    found = found.agg(F.least(F.floor(F.log2(F.max("count"))), F.lit((1 << COUNT_BITS) - 1)).cast("byte").alias("log")).toArrow()
    counts = np.zeros(CELLS, np.uint8)
    counts[found.column("cell").to_numpy()] = found.column("log").to_numpy()
    return counts


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether lists of words are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[same + 1 :] == b[same + 1 :]
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[same + 1 :] == shorter[same:]


def distance(a: list[bytes], b: list[bytes]) -> int:
    """Words inserted, deleted or replaced between two lines: a column of the table of distances is the bits of integers."""
    if not a:
        return len(b)
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, last, edits = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for word in b:
        equal = places.get(word, 0)
        flat = (((equal & up) + up) ^ up) | equal | down
        right, left = down | every & ~(flat | up), flat & up
        edits += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | every & ~(flat | right), right & flat
    return edits


def near_lines(a: list[bytes], b: list[bytes], an_edit: int = WORDS_AN_EDIT) -> bool:
    most = bound(max(len(a), len(b)), an_edit)
    if min(len(a), len(b)) < LEAST_WORDS or abs(len(a) - len(b)) > most:
        return False
    if one_edit(a, b):
        return True
    if most < 2 or max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > most:
        return False
    return distance(a, b) <= most


def _place_bits(keys: list[np.ndarray], line: np.ndarray) -> np.ndarray:
    """The bits that stand for lines of rows (columns of KEY) in a map of MAP_LONGS longs."""
    given, one, copy = (x.astype(np.int64).view(np.uint64) for x in keys)
    return mixed((one + given) * FACTORS[1] + copy * FACTORS[0] + line.astype(np.uint64)) & np.uint64(64 * MAP_LONGS - 1)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.unique(_place_bits([batch.column(n).to_numpy(zero_copy_only=False) for n in KEY], batch.column("line").to_numpy()))
        at, first = np.unique(bit >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(bit) else bit
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])


def _texts(shared):
    """The lines that a map of bits lets through, with their places: all that are wanted, and by chance some that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in slices(batches):
            keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in KEY]
            for block in blocks(batch.column("raw").to_pylist()):
                bit = _place_bits([x[block.doc] for x in keys], block.line)
                some = np.flatnonzero(bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                columns = [*(pa.array(x[block.doc[some]]) for x in keys), pa.array(block.line[some].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([block.content(i) for i in some], pa.binary())], names=[*KEY, "line", "content"])

    return run


def _bounds(words: np.ndarray, an_edit: int) -> np.ndarray:
    return words // an_edit if an_edit else np.ones_like(words)


def _alike(an_edit: int):
    """Of pairs given with their sketches, those that may be near; what Held does with the lines of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, BINS // 4) for n in ("sketch", "other_sketch"))
            longer = np.maximum(batch.column("words").to_numpy(), batch.column("other_words").to_numpy())
            found = pa.array(sketch_distance(a, b) <= 2 * _bounds(longer, an_edit))
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(found) for n in ("turn", "other_turn")], names=["turn", "other_turn"])

    return run


@dataclass
class Held:
    """The lines of a part's keys, by key and turn; start is where a line's key begins."""

    key: np.ndarray
    turn: np.ndarray
    words: np.ndarray
    early: np.ndarray
    open_: np.ndarray
    sketch: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Held:
        columns = [table.column(n).to_numpy() for n in ("key", "turn", "words", "early", "open")]
        order = np.lexsort((columns[1], columns[0]))
        key = columns[0][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS // 4)[order]
        return cls(*(x[order] for x in columns), sketch, np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)))

    def pairs(self, a: np.ndarray, b: np.ndarray, an_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, apart): of places of lines and of earlier ones, those whose lengths and sketches let them be near."""
        most = _bounds(np.maximum(self.words[a], self.words[b]), an_edit)
        fits = (np.abs(self.words[a] - self.words[b]) <= most) & (self.turn[b] < self.turn[a])
        a, b, most = a[fits], b[fits], most[fits]
        apart = sketch_distance(self.sketch[a], self.sketch[b])
        found = apart <= 2 * most
        return a[found], b[found], apart[found]

    def table(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        a, b, apart = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else [()] * 3))
        return pa.table({"turn": self.turn[a], "other_turn": self.turn[b], "apart": apart.astype(np.int32)})


def _few(an_edit: int):
    """For each line the likeliest, by sketches, of the earliest line of each key and of DRAWN earlier ones."""

    def run(table: pa.Table) -> pa.Table:
        held, found = Held.of(table), []
        every = np.arange(len(held.key))
        for at in range(0, len(every), COMPARED):
            a = every[at : at + COMPARED]
            a = a[a > held.start[a]]
            before = (a - held.start[a]).astype(np.uint64)
            for draw in range(DRAWN + 1):
                by = mixed(held.turn[a].astype(np.uint64) * FACTORS[0] + held.key[a].astype(np.uint64) + np.uint64(draw)) if draw else np.zeros_like(before)
                found.append(held.pairs(a, held.start[a] + (by % before).astype(np.int64), an_edit))
        out = held.table(found)
        order = np.lexsort((out["other_turn"].to_numpy(), out["apart"].to_numpy(), out["turn"].to_numpy()))
        turn = out["turn"].to_numpy()[order]
        return out.take(pa.array(order[np.concatenate([[True], turn[1:] != turn[:-1]])[: len(turn)]]))

    return run


def _every(an_edit: int):
    """All pairs of an open line and an earlier one of its key that may be near.

    The key is early in each of both whose own bound is the pair's. Lines are held against those one place earlier, two
    places, and so on, so that memory stays bounded however many lines a key has.
    """

    def run(table: pa.Table) -> pa.Table:
        held, found = Held.of(table), []
        own, lag, rest = _bounds(held.words, an_edit), 0, np.flatnonzero(held.open_)
        while len(rest):
            lag += 1
            rest = rest[rest - lag >= held.start[rest]]
            for at in range(0, len(rest), COMPARED):
                a = rest[at : at + COMPARED]
                b = a - lag
                fits = (held.early[a] | (own[a] < own[b])) & (held.early[b] | (own[b] < own[a]))
                found.append(held.pairs(a[fits], b[fits], an_edit))
        out = held.table(found)
        return out.group_by(["turn", "other_turn"]).aggregate([("apart", "min")]).rename_columns(["turn", "other_turn", "apart"])

    return run


def _verify(an_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [near_lines(a.split(), b.split(), an_edit) for a, b in zip(batch.column("content").to_pylist(), batch.column("other").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("turn").filter(pa.array(found, pa.bool_()))], names=["turn"])

    return run


def identity(doc_id, text) -> dict:
    """The columns of KEY."""
    return {"given": doc_id.isNotNull(), "_id": F.coalesce(doc_id.cast("long"), F.lit(0)), "copy": F.xxhash64(F.coalesce(text, F.lit("")))}


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns(identity(F.col(id_col).cast("long"), F.col(text_col))).select(*KEY, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def _contents(rows: DataFrame, likely: DataFrame, pairs: DataFrame) -> DataFrame:
    """turn, content (words joined by a space) of the lines in pairs, each read in the document that has it first.

    Texts are read again where they are, and what a map of bits of fixed size lets through is all that moves.
    """
    turns = pairs.select("turn").unionByName(pairs.select(F.col("other_turn").alias("turn"))).distinct()
    wanted = materialise(likely.select("turn", "first").join(turns, "turn").select("first.*", "turn"), "wanted")
    marks = wanted.select(*KEY, "line").mapInArrow(_marks, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(MAP_LONGS, np.int64)
    bits[marks.column("at").to_numpy()] = marks.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits.tobytes())
    met = rows.mapInArrow(_texts(shared), f"{KEYS}, line int, content binary").join(wanted.hint("shuffle_hash"), [*KEY, "line"])
    found = materialise(met.dropDuplicates([*KEY, "line"]).select("turn", "content"), "contents")
    shared.destroy()
    return found


def repeated_lines(rows: DataFrame, an_edit: int = ONE_EDIT) -> DataFrame:
    """All lines with a word of rows with the columns of KEY and raw: KEY, line, digest and `dropped`.

    Texts are scanned four times where they are; see line_report for what is dropped.
    """
    lines = materialise(rows.mapInArrow(_lines, LINES), "lines")
    place = F.struct(*KEY, "line")
    kinds = lines.groupBy("digest").agg(F.min(place).alias("first"), *[F.any_value(c).alias(c) for c in ("words", "tag", "sketch")])
    kinds = materialise(kinds, "kinds")
    with scope(rows.sparkSession, but_last=True):
        near = materialise(_near(rows, kinds, an_edit), "near")
    firsts = kinds.select("digest", "first").join(near, "digest", "left")
    dropped = (place != F.col("first")) | F.coalesce("near", F.lit(False))
    return lines.select(*KEY, "line", "digest").join(firsts, "digest").select(*KEY, "line", "digest", dropped.alias("dropped"))


def _near(rows: DataFrame, kinds: DataFrame, an_edit: int) -> DataFrame:
    """digest and near (true) of the kinds of lines that a near one precedes."""
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows).tobytes())
    emitted = rows.select("raw").mapInArrow(_keys(shared, an_edit, parts), "part int, keys binary")
    met = materialise(emitted.groupBy("part").applyInArrow(_met(an_edit), "key long, tag long"), "met")
    shared.destroy()
    met = met.select("key", F.shiftright("tag", 1).alias("tag"), (F.col("tag").bitwiseAND(1) == 1).alias("early"))
    # A line's turn stands for its place in the order of all, so that what is shuffled by key and by pair is narrow.
    # Different lines of one tag, should there be any, all stay: each has a turn, and words decide.
    likely = kinds.join(met.select("tag").distinct(), "tag").repartitionByRange("first").sortWithinPartitions("first")
    likely = materialise(likely.withColumn("turn", F.monotonically_increasing_id()), "likely")
    # Most near lines are near to the likeliest of a few that their keys draw. What is not is held against all earlier ones.
    few = _held(met, likely.withColumn("open", F.lit(True)), _few(an_edit), parts).groupBy("turn").agg(F.min(F.struct("apart", "other_turn")).alias("other"))
    near = _verified(rows, likely, materialise(few.select("turn", "other.other_turn"), "pairs"), an_edit)
    rest = likely.join(near.withColumn("near", F.lit(True)), "turn", "left").withColumn("open", F.col("near").isNull())
    every = _held(met, rest, _every(an_edit), parts).select("turn", "other_turn").distinct()
    near = near.unionByName(_verified(rows, likely, materialise(every, "pairs"), an_edit))
    return likely.join(near, "turn", "left_semi").select("digest", F.lit(True).alias("near"))


def _held(met: DataFrame, likely: DataFrame, compare, parts: int) -> DataFrame:
    """(turn, other_turn, apart) of pairs that compare finds among the lines of a key; a pair may come once for each key.

    Pairs are made and dropped by the block where a part's keys are; only those that sketches let through are rows.
    """
    lines = met.join(likely.select("tag", "turn", "words", "sketch", "open"), "tag").drop("tag")
    dealt = lines.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(compare, "turn long, other_turn long, apart int")


def _verified(rows: DataFrame, likely: DataFrame, pairs: DataFrame, an_edit: int) -> DataFrame:
    """The turns of pairs whose line is near the other, by their words; hashes alone decide nothing."""
    contents = _contents(rows, likely, pairs)
    both = pairs.join(contents, "turn").join(contents.select(F.col("turn").alias("other_turn"), F.col("content").alias("other")), "other_turn")
    return materialise(both.select("turn", "content", "other").mapInArrow(_verify(an_edit), "turn long").distinct(), "near")


def dropped_lines(rows: DataFrame, an_edit: int = ONE_EDIT) -> DataFrame:
    """KEY and the sorted numbers of the lines that go, for documents that lose any."""
    return repeated_lines(rows, an_edit).where("dropped").groupBy(*KEY).agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", an_edit: int = ONE_EDIT) -> DataFrame:
    """docs with the lines cut out of the texts that line_report drops; other columns and rows stay as they are.

    docs are read several times where they are; rows move once, to meet the numbers of the lines that go.
    """
    gone = materialise(dropped_lines(_rows(docs, id_col, text_col), an_edit), "dropped")
    keyed = docs.withColumns(identity(F.col(id_col).cast("long"), F.col(text_col))).select(*KEY, F.struct(*docs.columns).alias("row"))
    rows = keyed.join(gone.hint("shuffle_hash"), KEY, "left")
    kept = F.array_join(F.filter(F.split(F.col("row")[text_col], "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("row")[text_col]).otherwise(kept)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", an_edit: int = ONE_EDIT) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with a word), n_dropped, dropped (numbers of lines, from 0).

    A line is its words; blank lines are never dropped. Lines are in the order of doc_id (null first), then number;
    a line is dropped if an equal one or, with LEAST_WORDS words or more in both, a near one comes before it
    anywhere, whether that one stays or not. Near: at most bound() words inserted, deleted or
    replaced, which is one, or with an_edit one for each so many words of the longer line. Rows that repeat both id
    and text are one document with several rows; if only the id repeats, a hash of the text orders them. Null text
    is empty, an empty table gives no rows, and other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    by_doc = dropped_lines(rows, an_edit)
    every = materialise(rows.mapInArrow(_counts, f"{KEYS}, n_lines long"), "counts")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    doc_id = F.when(F.col("given"), F.col("_id")).alias("doc_id")
    return every.join(by_doc, KEY, "left").select(doc_id, "n_lines", F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts = [sum(1 for line in raw.split(b"\n") if line and not line.isspace()) for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in KEY), pa.array(counts, pa.int64())], names=[*KEY, "n_lines"])
