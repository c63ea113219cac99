"""Signals of every notice by all rules."""

from collegium import registry

SF = "/root/testdata/sf0.001"


def test_every_category_has_signals(spark):
    from collegium.sources import tables as T

    notices = T.notices(spark, SF).count()
    rows = registry.queries()["notice_signals"](spark, SF).collect()
    assert len(rows) == notices
    said = {r.signal.lower() for r in rows}
    assert {"academic calendar", "regulations", "scheme of teaching", "syllabus", "examination registration", "circular"} <= said
