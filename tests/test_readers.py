"""Readers of printed documents on small ones: empty, headless, of two pages, with equal codes and odd cells."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from collegium.functions import calendars, text
from collegium.operators import class_timetables, code_cells, documents, exam_timetables, syllabi

RUN = "doc long, page int, text string, x double, y double, width double, height double"


def runs(spark, *cells):
    """Cells (text, x, y[, width[, page[, doc]]]) as runs ten units high."""
    rows = []
    for cell in cells:
        said, x, y, width, page, doc = (*cell, 40.0, 1, 1)[: len(cell)] + (40.0, 1, 1)[len(cell) - 3 :] if len(cell) < 6 else cell
        rows.append((doc, page, said, float(x), float(y), float(width), 10.0))
    return spark.createDataFrame(rows, RUN)


def lines(spark, *pages, doc=1):
    return spark.createDataFrame([(doc, p, n, t) for p, page in enumerate(pages, 1) for n, t in enumerate(page)], "doc long, page int, line int, text string")


def test_syllabus_over_pages_with_equal_codes(spark):
    one = ["I Semester", "Course Title: Physics", "Course Code: BPHYS102", "Credits 01 Exam Hours 100", "Course objectives:", "Know what a laser is and does", "Module-1 (8 Hours)", "Laser and Optical Fibers:", "LASER : Characteristic properties"]
    two = ["Fiber Losses, Applications: the back of a sentence", "laser: again", "Module-2", "8 Hrs of waves", "Superposition: two waves", "Text Books: none", "Superfluous: after the end"]
    three = ["Course Code: BPHYS102", "Semester 2", None, "Sl. NO Experiments", "Total Marks 30"]
    found = {r.block: r for r in syllabi.syllabus_courses(lines(spark, one, two, three)).collect()}
    assert [(r.code, r.title, r.semester) for r in found.values()] == [("BPHYS102", "Physics", 1), ("BPHYS102", None, 2)]
    first = found[0]
    assert (first.credits, first.credits_state, first.exam_hours, first.exam_hours_state, first.total_marks_state) == (1, "resolved", 100, "ambiguous", "unavailable")
    assert first.objectives == ["Know what a laser is and does"] and first.outcomes == []
    assert [(m.number, m.title, m.hours, m.topics) for m in first.modules] == [(1, "Laser and Optical Fibers", 8, ["LASER"]), (2, None, 8, ["Superposition"])]
    assert first.modules[0].content.startswith("Laser and Optical Fibers: LASER") and found[1].modules == [] and found[1].total_marks is None


def test_syllabus_of_nothing(spark):
    assert syllabi.syllabus_courses(lines(spark, [None], ["no label here"], ["Course Code", "not a code"])).count() == 0
    assert syllabi.syllabus_courses(lines(spark, ["x"]).where("false")).count() == 0


def test_labels_too_close_begin_no_block(spark):
    page = ["Course Code: BCS101", *["line"] * 4, "Course Code again", "line", "Course Code: BCS102", *["line"] * 7]
    found = syllabi.blocks_of(lines(spark, page)).groupBy("block").agg(F.count("*").alias("n")).collect()
    assert len(found) == 2


HEAD = [("2022 Scheme", 100, 720, 300), ("III - Semester", 110, 700, 80), ("V Semester", 310, 700, 80), ("2.00pm to 5.00pm", 110, 680, 80)]


def test_exam_timetable_of_two_pages(spark):
    cells = [*HEAD, ("23-01-2026", 20, 640), ("BCS301", 120, 641), ("--", 320, 640), ("24/02/2026 Tue", 20, 640, 40, 2), ("B**301 / BCS302", 118, 639, 60, 2), ("BCS501/18CS51", 330, 640, 40, 2), ("31.13.2026", 20, 600), ("BCS999", 120, 600)]
    found = exam_timetables.exam_events(runs(spark, *cells)).orderBy("exam_date", "semester").collect()
    assert [(r.exam_date, r.weekday, r.semester, r.scheme, r.start, r.kind, r.codes) for r in found] == [
        ("2026-01-23", None, 3, "2022", "14:00", "code", ["BCS301"]),
        ("2026-02-24", "Tue", 3, "2022", "14:00", "pattern", []),
        ("2026-02-24", "Tue", 5, "2022", None, "alternatives", ["BCS501", "18CS51"]),
    ]


@pytest.mark.parametrize("cells, warning, n", [([(" ", 1, 1)], "nothing_read", 0), ([("III - Semester", 110, 700), ("23-01-2026", 20, 640), ("BCS301", 120, 640)], "no_columns", 0), (HEAD, "no_rows", 0), ([*HEAD, ("23-01-2026", 20, 640), ("B**301", 120, 640)], "patterns", 1), ([*HEAD, ("23-01-2026", 20, 640), ("--", 120, 640)], None, 0)])
def test_exam_warnings(spark, cells, warning, n):
    assert [(r.warning, r.n) for r in exam_timetables.exam_warnings(runs(spark, *cells)).collect()] == ([(warning, n)] if warning else [])


def test_exam_cells(spark):
    cells = {"BCS301": "code", "21CS42 / BCS401": "alternatives", "B**301": "pattern", "B**301 or so": "other", " / ": "other", "BCS301 / open": "other", "": "other"}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.k for r in df.select("c", text.exam_cell_kind(F.col("c")).alias("k")).collect()} == cells


GRID = [("9:00", 100, 730), ("to", 105, 720, 10), ("9:55", 100, 710), ("10:00", 200, 730), ("to", 205, 720, 10), ("10:55", 200, 710), ("11:15 - 12:10", 300, 730, 60)]


def test_class_timetable_with_times_in_parts(spark):
    cells = [*GRID, ("Mon", 20, 640), ("CNL-B1/CSL-B2", 102, 650, 140), ("OJAS", 100, 630), ("TEJOMAYI", 200, 630), ("TOC", 305, 650), ("LH-302", 305, 630), ("Tuesday", 20, 600), ("Mini project", 100, 601, 60), ("CN", 300, 599)]
    cells += [("BCS501 Computer Networks(T/L)", 20, 500, 120), ("New Faculty", 220, 500), ("BCS502 Theory of Computation", 20, 486, 120), ("BCS503 Computer Networks Lab", 20, 472, 120), ("BCS504 Total Organic Carbon", 20, 458, 120), ("BCS586 Mini project", 20, 444, 100), ("New Faculty", 220, 444), ("BCS505 Circuit Simulation Lab", 20, 430, 120)]
    read = class_timetables.timetable_classes(runs(spark, *cells)).collect()
    found = sorted((r.day, r.start, r.end, r.spans, r.initials, r.batch or "", r.room or "", r.code or "", r.resolution) for r in read)
    assert found == [
        ("Mon", "09:00", "10:55", 2, "CNL", "B1", "OJAS", "BCS503", "initialism"),
        ("Mon", "09:00", "10:55", 2, "CSL", "B2", "TEJOMAYI", "BCS505", "initialism"),
        ("Mon", "11:15", "12:10", 1, "TOC", "", "LH-302", "", "ambiguous"),
        ("Tue", "09:00", "09:55", 1, "Mini project", "", "", "BCS586", "declared"),
        ("Tue", "11:15", "12:10", 1, "CN", "", "", "BCS501", "initialism"),
    ]
    assert {r.warning for r in class_timetables.grid_warnings(runs(spark, *cells)).collect()} == {"ambiguous", "partial"}


def test_class_timetables_of_nothing(spark):
    assert class_timetables.timetable_classes(runs(spark, ("Mon", 20, 640), ("DBMS", 100, 640))).count() == 0
    assert {r.warning for r in class_timetables.grid_warnings(runs(spark, ("Mon", 20, 640))).collect()} == {"no_times"}
    assert {r.warning for r in class_timetables.grid_warnings(runs(spark, (" ", 20, 640))).collect()} == {"nothing_read"}


def test_initialisms(spark):
    titles = {"Theory of Computation": {"TC", "TOC"}, "Research Methodology and IPR": {"RMIPR", "RMAIPR"}, "E-waste Management": {"EWM"}, "Computer Networks(T/L)": {"CN", "CNTL"}, "x": set(), "": set()}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.t: set(r.i) for r in df.select("t", text.initialisms(F.col("t")).alias("i")).collect()} == titles


def test_calendar_dates_and_warnings(spark):
    rows = ["Note: 01-01-2026", "1 Jul 2026 to 15-07-2026 Mid vacation", "07 Sep Commencement of classes", "30 Feb 2026 no day", "12/08/2026", "Ref no 5 dt 1/1/2026", " "]
    docs = spark.createDataFrame([(d, n, t) for d in (1, 2) for n, t in enumerate(rows if d == 1 else [*rows, "Academic year 2026-27"])], "doc long, line int, text string")
    read = calendars.calendar_documents(docs)
    found = [(r.doc, r.title, r.start, r.end, r.category) for r in calendars.calendar_lines(read).where("readable").orderBy("doc", "line").collect()]
    span = ("Mid vacation", "2026-07-01", "2026-07-15", "HOLIDAY")
    assert found == [(1, *span), (2, *span), (2, "Commencement of classes", "2026-09-07", None, "SEMESTER_START")]
    assert {(r.doc, r.warning, r.n) for r in calendars.calendar_warnings(read).collect()} == {(1, "no_semester", 1), (1, "no_year", 1), (1, "unreadable", 1), (2, "no_semester", 1), (2, "unreadable", 1)}


def test_conflicts_of_first_and_last_calendar(spark):
    saved = spark.createDataFrame([(1, 5, "2026-27", 1), (2, 5, "2026-27", 2), (3, 5, "2026-27", 3), (4, None, None, 1), (5, None, None, 2), (6, 6, None, 1)], "doc long, semester int, academic_year string, imported int")
    events = [(1, 0, "a", "HOLIDAY", "d1"), (1, 1, "b", "HOLIDAY", "d9"), (2, 0, "a", "HOLIDAY", "d5"), (3, 0, "c", "HOLIDAY", "d2"), (3, 1, "o", "OTHER_ACADEMIC", "d3"), (1, 2, "o", "OTHER_ACADEMIC", "d4"), (4, 0, "x", "EXAM_PERIOD", "d1"), (5, 0, "y", "EXAM_PERIOD", "d1")]
    found = calendars.calendar_conflicts(saved, spark.createDataFrame(events, "doc long, line int, title string, category string, start string")).collect()
    assert [tuple(r) for r in found] == [(5, "2026-27", 3, "c", "HOLIDAY", "d1", "d2")]


def test_wrapped_rows(spark):
    cells = [("BPOPS103", 20, 700, 50), ("PRINCIPLES OF", 100, 700, 80), ("39", 200, 700, 10), ("PROGRAMMING", 100, 688, 80), ("C", 101, 676, 8), ("late", 203, 676, 20), ("Legend", 60, 664, 40), ("BNEXT101", 20, 640, 50), ("A B", 100, 641, 1), ("C", 101.5, 640, 5)]
    found = documents.lines_of_runs(runs(spark, *cells)).orderBy("line").collect()
    assert [r.text for r in found] == ["BPOPS103 PRINCIPLES OF PROGRAMMING C 39 late", "Legend", "BNEXT101 A BC"]


def test_codes_in_pieces(spark):
    cells = [("BCS", 50, 700, 20), ("401", 70.2, 700, 20), ("BIS", 200, 700, 20), ("501", 221, 700, 20), ("BME101", 300, 700, 40), ("A", 340, 700, 8), ("BAE402/", 50, 650), ("BAS402", 52, 638), ("BAE403/", 50, 600), ("BAS403", 90, 590), (" ", 1, 1)]
    found = code_cells.joined_codes(runs(spark, *cells)).collect()
    assert sorted((r.text, r.x, r.y, round(r.width, 1)) for r in found if r.text.strip()) == [
        ("501", 221.0, 700.0, 20.0), ("A", 340.0, 700.0, 8.0), ("BAE402/BAS402", 50.0, 644.0, 40.0), ("BAE403/", 50.0, 600.0, 40.0), ("BAS403", 90.0, 590.0, 40.0), ("BCS401", 50.0, 700.0, 40.2), ("BIS", 200.0, 700.0, 20.0), ("BME101", 300.0, 700.0, 40.0),
    ]
    assert len(found) == 9
