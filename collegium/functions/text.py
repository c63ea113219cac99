"""Text functions as Columns: keys, tags, addresses, dates and ordered classifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notice categories in order of precedence, each with the phrases that it is recognised by.
CATEGORIES = [
    ("exam_timetable", [r"\btime\s*table\b", r"\bexamination\s+schedule\b"]),
    ("result", [r"\bresults?\s+(announced|declared|published)\b", r"\bannouncement\s+of\s+results?\b"]),
    ("revaluation", [r"\bre-?valuation\b", r"\bre-?totall?ing\b", r"\bphoto\s*cop(y|ies)\b"]),
    ("registration", [r"\bexam(ination)?\s+(registration|application)\b", r"\bapply\s+online\b"]),
    ("academic_calendar", [r"\bacademic\s+calendar\b", r"\bcalendar\s+of\s+events\b"]),
    ("regulation", [r"\bregulations?\b", r"\bordinance\b"]),
    ("scheme", [r"\bscheme\s+of\s+teaching\b", r"\bscheme\s*(&|and)\s*syllabus\b"]),
    ("syllabus", [r"\bsyllabus\b", r"\bsyllabi\b"]),
    ("examination", [r"\bexamination\b", r"\bexam\b"]),
    ("administration", [r"\bcircular\b", r"\bnotification\b", r"\bnotice\b"]),
]
# Words of a change and of a deadline, and the importance of categories otherwise.
CHANGE = r"\brevised\b|\bpostponed\b|\bpreponed\b|\brescheduled\b|\bcancell?ed\b"
DEADLINE = r"\blast\s+date\b|\bdeadline\b|\bon\s+or\s+before\b|\bclosing\s+date\b"
IMPORTANCE = {"high": ["exam_timetable", "result", "revaluation", "registration"], "medium": ["academic_calendar", "regulation", "scheme", "syllabus", "examination"]}
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for a row however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def category_of(text: Column) -> Column:
    """The first category with a phrase in the text; unresolved, not 'other', if none has."""
    out = None
    for name, phrases in CATEGORIES:
        hit = text.rlike(any_case("|".join(phrases)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unresolved")


def signals_of(text: Column) -> Column:
    """The words that made the category, as they stand in the text, one for each phrase that occurs."""
    out = None
    for _, phrases in CATEGORIES:
        found = F.filter(F.array(*[F.regexp_extract(text, any_case(p), 0) for p in phrases]), lambda x: x != "")
        found = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
        hit = text.rlike(any_case("|".join(phrases)))
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out.otherwise(F.array().cast("array<string>"))


def importance_of(category: Column, text: Column) -> Column:
    """A change or deadline makes any notice high; else its category decides."""
    return F.when(text.rlike(any_case(CHANGE)) | text.rlike(any_case(DEADLINE)), "high").when(category.isin(IMPORTANCE["high"]), "high").when(category.isin(IMPORTANCE["medium"]), "medium").otherwise("low")


def subject_key(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"\s+", ""))


def same_name(a: Column, b: Column) -> Column:
    """Equal but for case and outer space; false, not unknown, if either is null."""
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))


def strip_tags(html: Column) -> Column:
    """The text of HTML: scripts, styles, comments and tags go, entities are decoded, space is folded."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def url_path(url: Column) -> Column:
    """The path without outer slashes, null for an address that can't be read."""
    return F.when(url.rlike("^[a-z]+://[^/]+"), F.regexp_replace(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+|/+$", ""))


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a unit separator; null and empty parts are equal."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def year_of(text: Column, url: Column) -> Column:
    """A year after the word scheme in the text, else any in the address, else any in the text."""
    first = lambda c, p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    return F.coalesce(first(text, r"(?i)(20\d\d)\s*scheme", 1), first(url, r"(20\d\d)", 1), first(text, r"(20\d\d)", 1)).cast("int")


def private_address(ip: Column) -> Column:
    """Whether an IPv4 address is of a range that is not public; anything unreadable counts as private."""
    n = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    bad = ~ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.exists(n, lambda x: x > 255)
    return F.coalesce(bad | (a == 0) | (a == 10) | (a == 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224), F.lit(True))


def all_words_in(query: str, *columns: Column) -> Column:
    """Whether every word of the query is contained in the columns, in any case; true for an empty query."""
    text, out = F.lower(F.concat_ws(" ", *columns)), F.lit(True)
    for word in query.lower().split():
        out = out & F.contains(text, F.lit(word))
    return out


# Roman figures of semesters, and the course codes that examinations print.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII"]
EXAM_CODE = r"1?B[A-Z]{2,7}\d{3}[A-Za-z]?"
LEGACY_CODE = r"\d{2}[A-Z]{2,6}\d{2,3}[A-Za-z]?"
WILDCARD_CODE = r"[0-9A-Z]*\*+[0-9A-Z*]*"


def academic_year(text: Column) -> Column:
    """Two years that follow each other, as 2026-27; null for any other pair."""
    pair = r"\b(20\d{2})\s*[-–—/]\s*(?:20)?(\d{2})\b"
    start, end = F.regexp_extract(text, pair, 1).try_cast("int"), F.regexp_extract(text, pair, 2).try_cast("int")
    return F.when(end == start - 1999, F.concat(start.cast("string"), F.lit("-"), F.lpad(end.cast("string"), 2, "0")))


def semester_of(text: Column) -> Column:
    """1 to 8, in Arabic figures after the word or else in Roman ones before it."""
    arabic = F.regexp_extract(text, r"(?i)\b(?:semester|sem)\s*[:\-–]?\s*([1-8])\b", 1).try_cast("int")
    roman = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(F.regexp_extract(text, r"(?i)\b([IVX]{1,4})\s*(?:st|nd|rd|th)?\s*semester\b", 1)))
    return F.coalesce(arabic, F.nullif(roman, F.lit(0)).cast("int"))


def exam_codes(cell: Column) -> Column:
    """The parts of a cell about slashes, without blank ones."""
    return F.filter(F.transform(F.split(cell, "/"), lambda part: F.trim(F.regexp_replace(part, r"\s+", " "))), lambda part: part != "")


def exam_cell_kind(cell: Column) -> Column:
    """pattern (with wildcards in any part, never expanded), code, alternatives (codes about slashes) or other."""
    parts = exam_codes(cell)
    coded = lambda part: part.rlike(f"^{EXAM_CODE}$") | part.rlike(f"^{LEGACY_CODE}$")
    return F.when(F.exists(parts, lambda part: part.rlike(f"^{WILDCARD_CODE}$")), "pattern").when((F.size(parts) == 0) | ~F.forall(parts, coded), "other").when(F.size(parts) > 1, "alternatives").otherwise("code")


# Joining words that initials may leave out.
JOINING = ["of", "and", "the", "for", "in", "to", "with", "a", "an", "&"]


def initialisms(title: Column) -> Column:
    """What a title can be shortened to: an array of two to four names in capitals.

    A word gives its first letter, a word in capitals all of it, a word with hyphens each part. Joining words count in
    one name and not in another, and words in brackets likewise. A single letter is no name.
    """

    def names(text: Column) -> list[Column]:
        words = F.filter(F.split(F.regexp_replace(text, "[^A-Za-z0-9&-]+", "-"), "-"), lambda w: w != "")
        short = lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)), w).otherwise(F.substring(w, 1, 1))
        kept = F.filter(words, lambda w: ~F.lower(w).isin(JOINING))
        return [F.upper(F.array_join(F.transform(x, short), "")) for x in (kept, words)]

    found = names(title) + names(F.regexp_replace(title, r"\([^)]*\)", " "))
    return F.array_distinct(F.filter(F.array(*found), lambda name: F.length(name) >= 2))


def join_reasons(reasons: Column) -> Column:
    """a, b or c; the usual reason where there is none."""
    n = F.size(reasons)
    several = F.concat(F.array_join(F.slice(reasons, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" or "), F.element_at(reasons, F.greatest(n, F.lit(1))))
    return F.when(n == 0, "no grade or credits").when(n == 1, F.get(reasons, F.lit(0))).otherwise(several)


RESULT_ROW = "id string, subjectCode string, subjectTitle string, internal double, external double, total double, resultStatus string, announcedOn string, gradeLetter string, gradePoint double, credits double, hasSee boolean, provenance string, catalogueCode string"


def normalised_result(raw: Column) -> Column:
    """An untrusted result row in JSON with every field there: a struct.

    What is no number, no finite one or no text of its field is null, never zero; blank text is null; a title falls back
    on the code; provenance is catalogue or else manual. What is no object gives a row of nulls.
    """
    fields = [f.split(" ") for f in RESULT_ROW.split(", ")]
    path = lambda name: F.get_json_object(raw, f"$.{name}")
    # Types are those of the JSON: a number in quotes is text, which is told by the quote that stands before it.
    quoted = lambda name: raw.rlike(rf'"{name}"\s*:\s*"')
    text = lambda name: F.when(quoted(name), F.nullif(F.trim(path(name)), F.lit("")))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    number = lambda name: F.when(~quoted(name), finite(path(name).try_cast("double")))
    values = {name: number(name) if kind == "double" else F.when(~quoted(name), path(name).try_cast("boolean")) if kind == "boolean" else text(name) for name, kind in fields}
    values |= {"id": F.coalesce(F.when(quoted("id"), path("id")), F.lit("")), "subjectTitle": F.coalesce(F.when(quoted("subjectTitle"), path("subjectTitle")), text("subjectCode"), F.lit("")), "provenance": F.when(text("provenance") == "catalogue", "catalogue").otherwise("manual")}
    return F.struct(*[values[name].alias(name) for name, _ in fields])
