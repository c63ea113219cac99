"""Encoding texts with the public tokenizers, through a memory of the chunks between spaces."""

from __future__ import annotations

import os
import re
from array import array

#: Chunks that a Python worker remembers.
REMEMBERED = 1_000_000

#: Letters that normalise to themselves and whose lower case is one letter, then ASCII marks other than apostrophes.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _shown() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible ones as themselves, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


SHOWN = _shown()

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


class _Whole(Exception):
    """A chunk whose ids depend on what stands beside it."""


class Encoder(dict):
    """encode(text) gives the ids of a text as little-endian unsigned 32-bit integers.

    The tokenizers pre-split at spaces, so a text's ids are those of its chunks in order, and most chunks recur.
    `keeps_space` says whether a space belongs to the chunk behind it (byte-level) or is dropped (word-level).
    With keeps_space, a text with white space beside a space or at its ends, where the pre-splitting looks
    further, is encoded whole. With `special`, as the library does by default, the strings of special tokens in a
    text give their ids, and such a text is encoded whole; else they count as ordinary text.

    The dictionary holds chunks with their ids, and a look-up adds what it lacks. Chunks are remembered in two
    generations: a full one becomes the old one, from which what recurs is taken over.
    """

    def __init__(self, path: str, keeps_space: bool, remembered: int = REMEMBERED, special: bool = False) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.keeps_space, self.remembered = keeps_space, remembered
        self.old: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, text: str) -> bytes:
        for added in self.added:
            if added in text:
                return self._ids(text)
        chunks = text.split(" ")
        try:
            if not self.keeps_space:
                return b"".join(map(self.__getitem__, chunks))
            if not chunks[0] or chunks[0][-1].isspace():
                return self._ids(text)
            return self._first(chunks.pop(0)) + b"".join(map(self.__getitem__, chunks))
        except _Whole:
            return self._ids(text)

    def _first(self, chunk: str) -> bytes:
        """The ids of a text's or a line's first chunk, which has no space before it."""
        ids = self.firsts.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
            if len(self.firsts) < self.remembered // 10:
                self.firsts[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._simple(chunk)
        if ids is None:
            if self.keeps_space and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
                raise _Whole
            ids = self._ids(f" {chunk}" if self.keeps_space else chunk)
        if len(self) >= self.remembered // 2:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _simple(self, chunk: str) -> bytes | None:
        """The ids of a chunk of Latin letters, with ASCII marks behind them or not, or of such chunks on two lines.

        The pre-splitting makes one word of the letters and one of the marks, so the model is asked directly. None
        for any other chunk.
        """
        match = SIMPLE(chunk)
        if match is None:
            above, line, below = chunk.partition("\n")
            if not line or SIMPLE(above) is None or SIMPLE(below) is None:
                return None
            return self[above] + self._mark(line) + self._first(below) if self.keeps_space else self[above] + self[below]
        word, mark = match.groups()
        if mark:
            return self[word] + self._mark(mark)
        shown = word if self.keeps_space else word.lower()
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(SHOWN)
        return array("I", [t.id for t in self.tokenize(f"\u0120{shown}" if self.keeps_space else shown)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            ids = self._ids(mark)
            if len(self.marks) < self.remembered // 10:
                self.marks[mark] = ids
        return ids


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool, special: bool = False) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    if (path, keeps_space, special) not in _encoders:
        _encoders[path, keeps_space, special] = Encoder(path, keeps_space, special=special)
    return _encoders[path, keeps_space, special]
