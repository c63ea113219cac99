"""Steps over timetables stay dealt out by document, however few bytes they are, and look for a cell's form once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from collegium.operators import class_timetables as C


@pytest.fixture(scope="module")
def runs(spark):
    cells = [(h, 100 + 110 * s, 720) for s, h in enumerate(["9.00 - 10.00", "10:00-11:00"])]
    cells += [("Mon", 20, 690), ("DBMS LH-1", 110, 690), ("OS B2 / DBMS B1", 220, 690), ("Tue", 20, 660), ("Value added A-12", 110, 660), ("CN", 220, 660)]
    cells += [("BCS403 Database Management Systems DBMS Dr. Anita Rao 3+0+2", 20, 560), ("BCS303 Operating Systems OS Prof. John Paul 2+0+2", 20, 530)]
    rows = [(doc, 1, t, float(x), float(y), 60.0, 10.0) for doc in range(12) for t, x, y in cells]
    return spark.createDataFrame(rows, "doc long, page int, text string, x double, y double, width double, height double")


def test_steps_keep_their_parts(spark, runs):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = C.runs_in_rows(runs)
    held = cells.localCheckpoint()
    rows = C.rows_of(held).localCheckpoint()
    slots = C.time_slots(held, rows).localCheckpoint()
    grid = C.grid_cells(held, rows, slots)
    for step in (cells, C.rows_of(held), C.time_slots(held, rows), grid, C.dictionary_of(held, rows)):
        assert step.rdd.getNumPartitions() >= parts
        assert step.select("doc").distinct().count() == 12


def test_classes_of_every_document(runs):
    found = C.timetable_classes(runs).where("doc = 7").select("day", "start", "initials", "batch", "room", "code")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("Mon", "09:00", "DBMS", None, "LH-1", "BCS403"), ("Mon", "10:00", "DBMS", "B1", None, "BCS403"), ("Mon", "10:00", "OS", "B2", None, "BCS303"),
        ("Tue", "09:00", "Value added", None, "A-12", None), ("Tue", "10:00", "CN", None, None, None),
    ], key=str)


def test_a_cell_is_split_once(spark):
    df = spark.createDataFrame([("DBMS LH-1",), ("os LAB(b1+B2) LH-2",), ("CN-T",), ("",)], "text string")
    found = df.select("text", F.inline(C.entries_of(F.col("text"))))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(text") <= 3
    got = {(r.text, r.wanted, r.batch, r.room) for r in found.collect()}
    assert got == {("DBMS LH-1", "DBMS", None, "LH-1"), ("os LAB(b1+B2) LH-2", "os LAB(b1+B2)", None, "LH-2"), ("CN-T", "CN", None, None), ("", "", None, None)}
