"""Which kind of academic document a text is: weighted signals, a floor and a margin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collegium.functions.text import bound

# Fixed values: (pattern, weight) of the signals of each kind, the signal that a scheme needs, the least total, the margin.
SIGNALS = {
    "result": [(r"(?i)university\s+seat\s+number", 3), (r"(?i)provisional\s+results?", 3), (r"(?i)internal\s+marks", 3), (r"(?i)external\s+marks", 3), (r"(?i)announced\s*/?\s*updated", 2), (r"(?i)\bP\s*->\s*PASS\b", 2)],
    "academic_calendar": [
        (r"(?i)academic\s+calendar", 4), (r"(?i)calendar\s+of\s+events", 4), (r"(?i)commencement\s+of\s+(the\s+)?(class|semester|term)", 3), (r"(?i)last\s+working\s+day", 3),
        (r"(?i)(registration|enrol?ment)\s+(of|for|last|closes|deadline|date)", 2), (r"(?i)\b(odd|even)\s+semester\b", 2), (r"\b20\d{2}\s*[-–—/]\s*(20)?\d{2}\b", 1),
    ],
    "college_timetable": [(r"(?is)monday.*tuesday|tuesday.*wednesday", 4), (r"(?i)\bw\.?\s*e\.?\s*f\.?\b", 2), (r"(?i)\b\d{1,2}[:.]\d{2}\s*(am|pm)?\s*[-–—to]+\s*\d{1,2}[:.]\d{2}", 3), (r"(?i)time\s*table", 2), (r"(?i)\b(lunch|break|recess)\b", 1)],
    "course_scheme": [(r"(?i)scheme\s+of\s+teaching(\s+and\s+examinations?)?", 4), (r"(?i)teaching\s+hours?\s*/?\s*week", 3), (r"(?i)course\s+code", 2), (r"(?i)\bcredits?\b", 1), (r"(?i)choice\s+based\s+credit\s+system", 2), (r"(?i)outcome\s+based\s+education", 2)],
    "exam_timetable": [(r"(?is)time\s*table\s+for\s+.*examination|examination.*time\s*table", 4), (r"(?i)\bdraft\s+time\s*table\b", 3), (r"(?i)\bdate\s*,\s*day\b", 3), (r"(?i)registrar\s*\(\s*evaluation\s*\)", 3)],
    "question_paper": [(r"(?is)\bmarks\b.*\bmodule\b|\bmodule\s*-?\s*[1-5]\b", 3), (r"(?i)answer\s+any\s+(one|two|five|full)", 4), (r"\bUSN\b", 1), (r"(?i)max\.?\s*marks", 3)],
}
READ = ["result", "academic_calendar", "college_timetable", "course_scheme"]
LEAST, MARGIN = 6, 2


def score(text: Column, kind: str) -> Column:
    """The sum of the weights of a kind's signals that occur; a scheme without its heading has none."""
    total = sum((F.when(text.rlike(p), w).otherwise(0) for p, w in SIGNALS[kind][1:]), F.when(text.rlike(SIGNALS[kind][0][0]), SIGNALS[kind][0][1]).otherwise(0))
    return F.when(text.rlike(SIGNALS[kind][0][0]), total).otherwise(0) if kind == "course_scheme" else total


def document_type(text: Column) -> tuple[Column, Column]:
    """(type, reason): the kind a text is, or unsupported with why: empty, a question paper, too little, or too close.

    An examination's timetable settles it once it reaches the floor, as its signals occur nowhere else.
    """
    held = bound(F.struct(F.trim(text).alias("text"), *[score(text, k).alias(k) for k in SIGNALS]), ranked)
    held = bound(held, decided)
    return held["type"], held["reason"]


def ranked(scores: Column) -> Column:
    """scores (a struct, with the text) with the best two of the kinds that are read; of equal ones the one listed first."""
    order = F.reverse(F.array_sort(F.array(*[F.struct(scores[k].alias("total"), F.lit(-i).alias("earlier"), F.lit(k).alias("kind")) for i, k in enumerate(READ)])))
    return F.struct(scores.alias("scores"), F.slice(order, 1, 2).alias("order"))


def decided(held: Column) -> Column:
    scores, best, second = held["scores"], F.get(held["order"], F.lit(0)), F.get(held["order"], F.lit(1))
    reason = (
        F.when(scores["text"] == "", "empty")
        .when(scores["exam_timetable"] >= LEAST, F.lit(None))
        .when(scores["question_paper"] >= LEAST, "question_paper")
        .when(best["total"] < LEAST, "too_little")
        .when(best["total"] - second["total"] < MARGIN, "too_close")
    )
    kind = F.when(scores["exam_timetable"] >= LEAST, "exam_timetable").otherwise(best["kind"])
    return F.struct(F.when(reason.isNotNull(), "unsupported").otherwise(kind).alias("type"), reason.alias("reason"))
