"""Columns that name a costly part several times compute it once: patterns are counted in the optimised plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.functions import declarations as D
from collegium.functions import document_types as K
from collegium.operators import documents as P


def patterns(df, name="regexp_extract("):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(name)


def test_slot_times_match_a_group_once_for_each_result(spark):
    texts = ["9:00 - 10:00", "1:30 to 2.30", "12.00  -  1:00 p.m.", "11:15 am – 12:10 pm", "8:00 - 7:00", "07:59 - 08:00", "25:00 - 26:00", "9:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    begins, ends = D.slot_times(F.col("text"))
    found = df.select("text", begins.alias("start"), ends.alias("end"))
    assert patterns(found) <= 12
    want = [("09:00", "10:00"), ("13:30", "14:30"), ("12:00", "13:00"), ("11:15", "12:10"), ("08:00", "19:00"), ("07:59", "08:00"), (None, None), (None, None), (None, None), (None, None)]
    assert [(r.start, r.end) for r in found.collect()] == want


def test_card_rows_read_a_line_once(spark):
    df = spark.createDataFrame([(1, "BCS301 Some Title 20 | 30 50 P 2024-02-01"), (2, "none 1 2 3"), (3, None), (4, "BCS302 9 20 30 51 F")], "n int, text string")
    found = P.card_rows(df)
    assert patterns(found) <= 6 and patterns(found, "regexp_extract_all(") <= 1
    got = [(r.n, r.code, r.title, r.internal, r.total, r.result, str(r.announced), r.readable) for r in found.orderBy("n").collect()]
    assert got == [(1, "BCS301", "Some Title", 20, 50, "P", "2024-02-01", True), (4, "BCS302", None, None, None, "F", "None", False)]


def test_document_types_look_for_a_signal_once(spark):
    df = spark.createDataFrame([("Provisional Results and University Seat Number",), ("",), ("USN",), (None,)], "text string")
    kind, reason = K.document_type(F.col("text"))
    found = df.select(kind.alias("kind"), reason.alias("reason"))
    signals = sum(map(len, K.SIGNALS.values())) + 1
    assert patterns(found, "rlike(") + patterns(found, " rlike ") <= 2 * signals
    assert [tuple(r) for r in found.collect()] == [("result", None), ("unsupported", "empty"), ("unsupported", "too_little"), ("unsupported", "too_little")]
