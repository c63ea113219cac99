"""What documents, links and cells say of themselves, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collegium.functions.text import bound

# The patterns of links, documents, calendars and sessions as they are printed.
RANGE = r"(?i)\b([1-8])\s*(?:st|nd|rd|th)?\s*(?:-|to|–|—)\s*([1-8])\b"
FIRST_YEAR = r"(?i)\bI\s*(?:&|and)\s*II\b|\bfirst\s*year\b"
COMMON = r"(?i)\bstream\b|\bcommon\b|\bcycle\b|\bI\s*(?:&|and)\s*II\b"
LABEL_IS_A_COURSE = r"^1?B[A-Z]{2,7}\d{3}[A-Za-z]?\b"
ANY_CODE = r"\b(1?B[A-Z]{2,7}\d{3}[A-Z]?)\b"
MODEL_PAPER = r"(?i)model\s+question\s+paper"
EFFECT_FROM = r"(?i)with\s+effect\s+from\s+(\d{4}(?:-\d{2})?)"
SEMESTER_PHRASE = r"(?i)\b(first|second|third|fourth|fifth|sixth|seventh|eighth)(?:\s*/\s*\w+)?\s+semester\b"
DEGREE_EXAM = r"(?i)degree\s+examination"
MAX_MARKS = r"(?i)max\.?\s*marks\s*:?\s*(\d{2,3})"
LATER_FAMILY = "1B"
CALENDAR_CATEGORIES = [
    ("EXAM_PERIOD", r"\b(exams?|examinations?|practicals?|viva)\b"),
    ("REGISTRATION", r"\b(registrations?|enrol?ments?|admissions?)\b"),
    ("LAST_WORKING_DAY", r"\blast\s+working\s+day\b"),
    ("SEMESTER_START", r"\b(commencement|begins?|start(s|ing)?)\b.*\b(classes|class|semesters?|terms?|sessions?)\b|\b(classes|class|semesters?|terms?)\b.*\bcommencement\b"),
    ("HOLIDAY", r"\b(holidays?|vacations?|breaks?|recess)\b"),
    ("ACADEMIC_PERIOD", r"\b(teaching|instructions?|internal assessments?|tests?)\b"),
]
SESSION = r"(?i)(\d{1,2})[.:](\d{2})\s*(am|pm)?\s*(?:to|–|-|—)\s*(\d{1,2})[.:](\d{2})\s*(am|pm)"
SLOT = r"(?i)(\d{1,2})[:.](\d{2})\s*(a\.?m\.?|p\.?m\.?)?\s*(?:[-–—]|to)\s*(\d{1,2})[:.](\d{2})\s*(a\.?m\.?|p\.?m\.?)?"
PROGRAMMES = {"csbs": "Computer Science & Business System"}
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def semester_range(text: Column) -> tuple[Column, Column]:
    """(from, to) of the semesters that a link names; nulls where it names none."""
    low, high = (first(text, RANGE, g).cast("int") for g in (1, 2))
    year = low.isNull() & text.rlike(FIRST_YEAR)
    return F.when(year, 1).otherwise(low), F.when(year, 2).otherwise(high)


def document_kind(text: Column, url: Column) -> Column:
    both = F.concat_ws(" ", text, url)
    return (
        F.when(both.rlike(r"(?i)\bstream\b") & both.rlike(r"(?i)\bprogram"), "programme_index")
        .when(both.rlike(r"(?i)\bsyll"), "syllabus")
        .when(both.rlike(r"(?i)\bsch(eme)?\b"), "scheme")
        .otherwise("unclassified")
    )


def scheme_year(text: Column, url: Column) -> Column:
    """A year before the word scheme or syllabus, else one that files the address, else any in the text."""
    return F.coalesce(first(text, r"(?i)\b(20\d{2})\s*(?:scheme|syllabus)"), first(url, r"(?i)/pdf/(20\d{2})[a-z_]"), first(text, r"\b(20\d{2})\b"))


def programme_of(label: Column) -> Column:
    """A row's label where it names a programme: not a stream or common part, and not a course."""
    return F.when(label.isNotNull() & ~label.rlike(COMMON) & ~label.rlike(LABEL_IS_A_COURSE), label)


def label_column(cells: Column) -> Column:
    """The place (from 0) of the header cell that names a table's rows: neither their number nor their documents; -1 without."""
    letters = lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z]", ""))
    names = F.transform(cells, lambda c, i: F.when((F.trim(c) != "") & ~letters(c).isin("slno", "sno") & ~c.rlike(r"(?i)\bscheme\b|\bsyllab"), i))
    return F.coalesce(F.array_min(F.filter(names, lambda i: i.isNotNull())), F.lit(-1))


def codes_in(text: Column) -> Column:
    """All course codes of a text, each once, in the order found."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ANY_CODE), F.lit(1)))


def speaks_for_scheme(codes: Column) -> Column:
    """Whether a document names codes and none of the later family."""
    return (F.size(codes) > 0) & ~F.exists(codes, is_later_family)


def is_later_family(code: Column) -> Column:
    return F.startswith(code, F.lit(LATER_FAMILY))


def official_label(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PROGRAMMES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(name)))


def programme_match(name: Column) -> tuple[Column, Column]:
    """(match, error) of a programme that somebody names: an alias exactly, else a part of a label.

    An empty name is refused, and so is an acronym that is no alias, as labels are spelled out.
    """
    official, plain = official_label(name), F.trim(name)
    error = F.when(official.isNotNull(), F.lit(None)).when(plain == "", "empty").when(plain.rlike("^[A-Z]{2,6}$"), "unknown_alias")
    return F.when(error.isNull(), F.coalesce(official, plain)), error


def calendar_category(title: Column) -> Column:
    """The first category that a row's words show; a date that has no name stays OTHER_ACADEMIC."""
    out = None
    for name, pattern in CALENDAR_CATEGORIES:
        hit = title.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("OTHER_ACADEMIC")


def to_24(hour: Column, minute: Column, pm: Column) -> Column:
    return F.concat_ws(":", F.lpad((hour.cast("int") % 12 + F.when(pm, 12).otherwise(0)).cast("string"), 2, "0"), minute)


def session_times(text: Column) -> tuple[Column, Column]:
    """(start, end) of an examination's session; a start without am or pm takes the end's."""
    g = lambda k: first(text, SESSION, k)
    end = F.lower(g(6))
    start = F.coalesce(F.lower(g(3)), end)
    return F.when(end.isNotNull(), to_24(g(1), g(2), start == "pm")), F.when(end.isNotNull(), to_24(g(4), g(5), end == "pm"))


def clock_of(hour: Column, minute: Column, marked: Column) -> Column:
    """A printed time as HH:MM; without am or pm, hours before 8 are of the afternoon. Null for no time of a day."""
    h = F.when((marked == "pm") & (hour < 12), hour + 12).when((marked == "am") & (hour == 12), 0).when(marked.isNull() & (hour < 8), hour + 12).otherwise(hour)
    return F.when((minute <= 59) & (hour <= 23) & (h <= 23), F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")))


def slot_times(text: Column) -> tuple[Column, Column]:
    """(start, end) of a class: a start without am or pm is the later of both readings that comes before the end."""
    said = F.regexp_replace(text, r"\s+", " ")
    said = bound(said, lambda said: F.array(*[F.regexp_extract(said, SLOT, k) for k in range(1, 7)]))

    def read(groups: Column) -> Column:
        group = lambda k: F.when(groups[k - 1] != "", groups[k - 1])
        number = lambda k: group(k).cast("int")
        mark = lambda k: F.replace(F.lower(group(k)), F.lit("."), F.lit(""))
        begins = lambda marked: clock_of(number(1), number(2), marked)
        return F.struct(begins(mark(3)).alias("said"), F.array(begins(F.lit("am")), begins(F.lit("pm"))).alias("either"), mark(3).isNotNull().alias("marked"), clock_of(number(4), number(5), mark(6)).alias("end"))

    def chosen(r: Column) -> Column:
        start = F.when(r["marked"], r["said"]).otherwise(F.array_max(F.filter(r["either"], lambda t: t < r["end"])))
        return F.struct(start.alias("start"), r["end"].alias("end"))

    found = bound(bound(said, read), chosen)
    fits = lambda r: F.when(r["start"] < r["end"], r)
    found = bound(found, fits)
    return found["start"], found["end"]


def is_weekday(value: Column) -> Column:
    return F.coalesce(value.isin(WEEKDAYS), F.lit(False))


def timetable_entry(code: Column, activity: Column, title: Column) -> Column:
    """How a slot is shown: a course by its title with the code as detail, else its activity; only courses have attendance."""
    named = F.nullif(F.nullif(title, F.lit("")), code)
    return F.when(
        code.isNull(),
        F.struct(F.coalesce(activity, F.lit("")).alias("name"), F.coalesce(activity, F.lit("")).alias("short_name"), F.lit(None).cast("string").alias("detail"), F.lit(False).alias("is_course"), F.lit(None).cast("string").alias("attendance_code")),
    ).otherwise(F.struct(F.coalesce(named, code).alias("name"), code.alias("short_name"), F.when(named.isNotNull(), code).alias("detail"), F.lit(True).alias("is_course"), code.alias("attendance_code")))


def exam_relevance(event: dict[str, Column], audience: dict[str, Column]) -> Column:
    """enrolled, backlog, unresolved or not_applicable: scheme and semester first, then exactly the codes named.

    event has scheme, semester, codes; audience has scheme, semester, enrolled, owed. Another semester's examination
    still concerns who owes one of its courses. A cell of the student's own column that names no code is unresolved.
    """
    apart = lambda k: F.coalesce(event[k] != audience[k], F.lit(False))
    owed = F.arrays_overlap(event["codes"], audience["owed"])
    return (
        F.when(apart("scheme"), "not_applicable")
        .when(apart("semester"), F.when(owed, "backlog").otherwise("not_applicable"))
        .when(F.arrays_overlap(event["codes"], audience["enrolled"]), "enrolled")
        .when(owed, "backlog")
        .when(F.size(event["codes"]) == 0, "unresolved")
        .otherwise("not_applicable")
    )
