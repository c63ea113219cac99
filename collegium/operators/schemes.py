"""Courses out of a scheme's positioned tables: codes with titles and credits, alternatives, electives and refusals.

One document's runs are a group, bounded by some sheets; a code is held against the cells of its own page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collegium.functions.timetables import HEADING_LENGTH, PAGE_SEMESTER, ROMAN, WHOLE_NUMBER
from collegium.operators.code_cells import joined_codes
from collegium.operators.documents import median_height

# How schemes print codes, departments and alternatives, and the bounds within which a row is read.
COURSE_CODE = r"^B[A-Z]{2,7}\d{3}[A-Za-z]?$"
COMPOUND_CODES = r"^B[A-Z]{2,7}\d{3}[A-Za-z]?(?:/B[A-Z]{2,7}\d{3}[A-Za-z]?)+$"
SHARED_TAIL = r"^B([A-Z]{2,6})((?:/[A-Z]{2,6})+)(\d{3}[A-Za-z]?)$"
DEPARTMENT_CELL = r"(?i)^(TD|PSB)\b[^:]{0,14}:"
ALTERNATIVE = r"(?i)^OR$"
PROGRAMME = r"(?i)B\.?E\.?\s+in\s+(.+)"
SCHEME_YEAR = r"(?i)Scheme\s+of\s+Teaching\s+and\s+Examinations\s*(20\d{2})"
MOST_CREDITS, ROW_CELLS, SHARED_CELLS, COLUMN_CELLS = 10, 6, 4, 3
TITLE_BAND = 1.6

ROWS = "doc long, page int, code string, title string, credits int, semester int, slot string, alternative_to string, reason string, programme string, scheme_year string"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
RUN = ["page", "text", "x", "y", "height"]


@dataclass
class Cell:
    text: str
    x: float
    y: float


@dataclass
class Found:
    page: int
    code: str
    title: str
    credits: int | None = None
    semester: int | None = None
    slot: str | None = None
    alternative_to: str | None = None
    reason: str | None = None

    @property
    def number(self) -> str:
        return re.search(r"\d{3}", self.code)[0]

    @property
    def prefix(self) -> str:
        return re.match(r"[A-Z]*", self.code)[0]


def codes_in(cell: str) -> list[str]:
    """The codes of a cell: one, also where it is broken by spaces, several about slashes, or the last of a shared tail."""
    tight = re.sub(r"\s+", "", cell)
    if re.search(COURSE_CODE, cell) or re.search(COURSE_CODE, tight):
        return [tight]
    if re.search(COMPOUND_CODES, cell):
        return cell.split("/")
    shared = re.search(SHARED_TAIL, cell)
    return [f"B{shared[1]}{shared[3]}"] if shared else []


def codes_in_cell(cell: Column) -> Column:
    """The same as codes_in, of a Column: an array."""
    tight = F.regexp_replace(cell, r"\s+", "")
    tail = F.concat(F.lit("B"), F.regexp_extract(cell, SHARED_TAIL, 1), F.regexp_extract(cell, SHARED_TAIL, 3))
    return F.when(tight.rlike(COURSE_CODE), F.array(tight)).when(cell.rlike(COMPOUND_CODES), F.split(cell, "/")).when(cell.rlike(SHARED_TAIL), F.array(tail)).otherwise(F.array().cast("array<string>"))


def is_number(cell: Cell) -> bool:
    return bool(re.search(WHOLE_NUMBER, cell.text))


def is_title(cell: Cell) -> bool:
    return not (is_number(cell) or re.search(DEPARTMENT_CELL, cell.text) or re.search(COURSE_CODE, cell.text) or re.search(ALTERNATIVE, cell.text))


def joined(cells: list[Cell]) -> str:
    return " ".join(" ".join(c.text for c in cells).split())


class Page:
    """One page's cells, with what its headings say of them."""

    def __init__(self, number: int, cells: list[Cell], band: float) -> None:
        self.number, self.cells, self.band = number, cells, band
        named = (re.search(PAGE_SEMESTER, c.text) for c in cells if len(c.text) <= HEADING_LENGTH)
        self.semester = next((ROMAN.index(m[1].upper()) + 1 for m in named if m), None)
        self.department = min((c.x for c in cells if re.search(DEPARTMENT_CELL, c.text)), default=float("inf"))
        self.codes = [c for c in cells if codes_in(c.text)]

    def level(self, cell: Cell) -> list[Cell]:
        return sorted((c for c in self.cells if c is not cell and abs(c.y - cell.y) <= self.band), key=lambda c: c.x)

    def column_credits(self, cell: Cell) -> int | None:
        """The one number of the rightmost column that stands halfway between this code's neighbours."""
        places = Counter(round(c.x) for c in self.cells if is_number(c))
        column = max((x for x, n in places.items() if n >= COLUMN_CELLS), default=None)
        above = min((c.y for c in self.codes if c.y > cell.y), default=None)
        below = max((c.y for c in self.codes if c.y < cell.y), default=None)
        if column is None or (above is None and below is None):
            return None
        up = (above - cell.y if above is not None else cell.y - below) / 2
        down = (cell.y - below if below is not None else above - cell.y) / 2
        inside = [c for c in self.cells if round(c.x) == column and cell.y - down <= c.y <= cell.y + up and is_number(c)]
        return int(inside[0].text) if len(inside) == 1 else None

    def title(self, cell: Cell, right: float) -> str:
        """Words right of a code, on its line or wrapped under it, up to its first number or the departments."""
        below = max((c.y for c in self.codes if c.y < cell.y - self.band), default=float("-inf"))
        floor = max(cell.y - TITLE_BAND * self.band, below + self.band)
        words = [c for c in self.cells if floor <= c.y <= cell.y + self.band and cell.x < c.x < min(self.department, right) and is_title(c)]
        return joined(sorted(words, key=lambda c: (-c.y, c.x)))

    def read(self, cell: Cell) -> list[Found]:
        """The courses of a code's row, or why it is none."""
        codes, row = codes_in(cell.text), self.level(cell)
        right = [c for c in row if c.x > cell.x]
        refused = Found(self.number, codes[0], joined([c for c in right if is_title(c)]))
        numbers = [c for c in right if is_number(c)]
        if self.semester is None:
            return [replace(refused, reason="no_semester")]
        if len(numbers) < ROW_CELLS:
            return [replace(refused, reason="elective_option")]
        credits = int(numbers[-1].text)
        if credits > MOST_CREDITS:
            credits = self.column_credits(cell)
        if credits is None or credits > MOST_CREDITS:
            return [replace(refused, reason="no_credits")]
        title = self.title(cell, numbers[0].x)
        if not title:
            return [replace(refused, title="", reason="no_title")]
        left = next((codes_in(c.text)[0] for c in row if c.x < cell.x and codes_in(c.text)), None)
        heads = None if left == codes[0] else left
        return [Found(self.number, code, title, credits, self.semester, alternative_to=codes[0] if i else heads) for i, code in enumerate(codes)]

    def alternatives(self) -> list[Found]:
        """Codes above and below the word or, whose line holds the credits that both share."""
        out = []
        plain = [c for c in self.codes if re.search(COURSE_CODE, c.text)]
        for marker in (c for c in self.cells if re.search(ALTERNATIVE, c.text)):
            above = min((c for c in plain if c.y > marker.y), key=lambda c: c.y, default=None)
            below = max((c for c in plain if c.y < marker.y), key=lambda c: c.y, default=None)
            numbers = [int(c.text) for c in self.level(marker) if is_number(c)]
            if self.semester and above and below and len(numbers) >= SHARED_CELLS and numbers[-1] <= MOST_CREDITS:
                for option, partner in ((above, below), (below, above)):
                    beside = [c for c in self.level(option) if option.x < c.x < self.department and is_title(c)]
                    out.append(Found(self.number, option.text, joined(beside), numbers[-1], self.semester, alternative_to=partner.text))
        return out


def inherited(refused: Found, slots: list[Found]) -> Found:
    """An elective with the credits of the slot (a code that ends in x) of its number; unsettled where slots disagree."""
    same = [s for s in slots if s.number == refused.number]
    if len({(s.credits, s.semester) for s in same}) != 1:
        return replace(refused, reason="slots_disagree") if len(same) > 1 else refused
    slot = next((s for s in same if s.prefix == refused.prefix), same[0])
    return replace(refused, title=refused.title or refused.code, credits=slot.credits, semester=slot.semester, slot=slot.code, reason=None)


def _rows(doc: int, page: list[int], text: list[str], x: list[float], y: list[float], height: list[float]) -> list[tuple]:
    """The rows of one document, whose runs are lists of equal length."""
    runs = [(n, t.strip(), a, b, h) for n, t, a, b, h in zip(page, text, x, y, height) if t.strip()]
    band = median_height([h for *_, h in runs])
    cells: dict[int, list[Cell]] = {}
    for n, t, a, b, _ in runs:
        cells.setdefault(int(n), []).append(Cell(t, a, b))
    pages = [Page(n, cells[n], band) for n in sorted(cells)]
    read = [f for p in pages for c in p.codes for f in p.read(c)]
    courses, refused = [f for f in read if not f.reason], [f for f in read if f.reason]
    known = {(f.code, f.semester) for f in courses}
    options: dict[tuple, Found] = {}
    for option in (f for p in pages for f in p.alternatives()):
        if (option.code, option.semester) not in known:
            options.setdefault((option.code, option.semester), option)
    slots = [f for f in [*courses, *options.values()] if f.code.lower().endswith("x")]
    settled = [inherited(f, slots) for f in refused]
    told = {code for code, _ in options}
    left = [f for f in settled if not f.reason or f.code not in told]
    heading = lambda pattern: next((m[1].strip() for _, t, *_ in runs if (m := re.search(pattern, t)) and m[1].strip()), None)
    programme, year = heading(PROGRAMME), heading(SCHEME_YEAR)
    return [(doc, f.page, f.code, f.title, f.credits, f.semester, f.slot, f.alternative_to, f.reason, programme, year) for f in [*courses, *left, *options.values()]]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [r for doc in zip(*[batch[c] for c in ("doc", *RUN)]) for r in _rows(*doc)]
        yield pd.DataFrame(rows, columns=NAMES).astype({"credits": "Int32", "semester": "Int32"})


def scheme_rows(runs: DataFrame) -> DataFrame:
    """runs(doc, page, text, x, y, width, height) as courses; a code that is none has a reason: no_semester,
    elective_option, no_credits, no_title or slots_disagree. Codes that are printed in pieces are joined first.

    Python gets documents by the batch, a row each, as a call for every document costs more than reading it."""
    docs = joined_codes(runs).groupBy("doc").agg(F.collect_list(F.struct(*RUN)).alias("runs"))
    return docs.select("doc", *[F.col("runs")[c].alias(c) for c in RUN]).mapInPandas(_batches, ROWS)
