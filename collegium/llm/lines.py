"""The lines and words of texts as arrays, so that hashing and counting words costs no Python step for each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text, about, that are looked at together; a longer line is taken alone.
BLOCK = 1 << 19
#: Bins of a line's sketch, two bits each, and how many lines are counted at a time.
BINS, SKETCHED = 128, 1 << 13
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_INVERSE = np.uint64(pow(int(FACTORS[0]), -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse, n at least."""
    global _powers
    if len(_powers[0]) < n:
        found = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK + (BLOCK >> 2)) - 1, x)])) for x in (FACTORS[0], _INVERSE))
        if n > 4 * BLOCK:
            return found
        _powers = found
    return _powers


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much two arrays of sketches differ in sum, row by row."""
    out = np.zeros(len(a), np.int64)
    for shift in (0, 2, 4, 6):
        out += np.abs((a >> shift & 3).astype(np.int8) - (b >> shift & 3).astype(np.int8)).sum(axis=1, dtype=np.int64)
    return out


@dataclass
class Block:
    """Lines that have a word: their document (place among the texts given), number, words, tag and bytes."""

    raw: bytes
    doc: np.ndarray
    line: np.ndarray
    words: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    def content(self, i: int) -> bytes:
        """The words of line i, joined by a space."""
        return b" ".join(self.raw[self.begin[i] : self.end[i]].split())

    def tags(self) -> np.ndarray:
        """A hash of each line's words."""
        if not len(self.first):
            return np.empty(0, np.uint64)
        place = np.arange(len(self.hashes)) - np.repeat(self.first, self.words)
        return mixed(np.add.reduceat(self.hashes * powers(int(self.words.max()))[0][place], self.first) + self.words.astype(np.uint64))

    def sketches(self) -> np.ndarray:
        """How many words of a line fall into each bin, 3 at most, four bins to a byte.

        An edit changes one word, so it takes one from a bin and adds one to another: lines k edits apart have sketches
        that differ by 2 k in sum at most. Many small bins tell long lines apart better than few large ones.
        """
        out = np.empty((len(self.first), BINS // 4), np.uint8)
        for a in range(0, len(out), SKETCHED):
            words = self.words[a : a + SKETCHED]
            hashes = self.hashes[self.first[a] : self.first[a] + words.sum()]
            at = np.repeat(np.arange(len(words)), words) * BINS + (hashes & np.uint64(BINS - 1)).astype(np.int64)
            counts = np.minimum(np.bincount(at, minlength=len(words) * BINS), 3).astype(np.uint8).reshape(-1, BINS // 4, 4)
            out[a : a + SKETCHED] = counts[:, :, 0] | counts[:, :, 1] << 2 | counts[:, :, 2] << 4 | counts[:, :, 3] << 6
        return out

    def shingles(self) -> np.ndarray:
        """A hash for each word with its neighbours, where the ends of the line count as words."""
        left, right = np.zeros_like(self.hashes), np.ones_like(self.hashes)
        left[1:], right[:-1] = self.hashes[:-1], self.hashes[1:]
        left[self.first] = 0
        right[self.first + self.words - 1] = 1
        return mixed(left * FACTORS[0] + self.hashes * FACTORS[1] + right * FACTORS[2])

    def of(self, keep: np.ndarray) -> Block:
        """The block with some of its lines only."""
        words = np.repeat(keep, self.words)
        counts = self.words[keep]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts
        return Block(self.raw, self.doc[keep], self.line[keep], counts, first, self.begin[keep], self.end[keep], self.hashes[words])


def blocks(raws: list[bytes], size: int = BLOCK) -> Iterator[Block]:
    """The lines of texts, in order, in blocks of about so many bytes."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for doc, raw in enumerate(raws):
        line, at = 0, 0
        while at < len(raw):
            cut = len(raw)
            if cut - at > size:
                cut = raw.rfind(b"\n", at, at + size)
                if cut < 0:
                    cut = raw.find(b"\n", at)
                cut = cut if cut >= 0 else len(raw)
            piece = raw[at:cut]
            pieces.append((doc, line, piece))
            held += len(piece)
            line, at = line + piece.count(b"\n") + 1, cut + 1
            if held >= size:
                yield _block(pieces)
                pieces, held = [], 0
    if pieces:
        yield _block(pieces)


def _block(pieces: list[tuple[int, int, bytes]]) -> Block:
    raw = b"\n".join(x for _, _, x in pieces) + b"\n"
    at = np.frombuffer(raw, np.uint8)
    space = _SPACE[at]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Block(raw, none, none, none, none, none, none, np.empty(0, np.uint64))
    # A word's hash is a polynomial of its bytes, from sums of powers up to its ends.
    up, down = powers(len(at))
    sums = np.cumsum(_BYTES[at] * up[: len(at)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mixed((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))
    before = np.searchsorted(starts, np.flatnonzero(at == 10))  # words before the end of each line
    counts = np.diff(before, prepend=0)
    rows = np.flatnonzero(counts)
    words = counts[rows]
    first = (before - counts)[rows]
    lines_before = np.concatenate([[0], np.cumsum([x.count(b"\n") + 1 for _, _, x in pieces])[:-1]])
    piece = np.searchsorted(lines_before, rows, side="right") - 1
    doc = np.array([d for d, _, _ in pieces])[piece]
    line = rows - lines_before[piece] + np.array([n for _, n, _ in pieces])[piece]
    return Block(raw, doc, line, words, first, starts[first], ends[first + words - 1], hashes)
