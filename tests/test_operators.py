"""Merges, applicability, invariants, files, streams and parsers on small inputs."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from collegium.functions import text as X
from collegium.operators import applicability as A
from collegium.operators import changes as C
from collegium.operators import documents as D
from collegium.operators import quality as Q
from collegium.operators.syllabi import topics_of
from collegium.sources import files
from collegium.streaming import monitor


def test_axis_matrix(spark):
    """Every combination of two axes, against the order of precedence."""
    states = {"match": ("A", " a "), "miss": ("A", "b"), "unknown": ("A", None), "not_targeted": (None, "b")}
    rows = [(x, y, *states[x], *states[y], u) for x, y, u in itertools.product(states, states, (True, False))]
    df = spark.createDataFrame(rows, "x string, y string, t1 string, h1 string, t2 string, h2 string, u boolean")
    axes = {"one": A.axis(F.col("t1"), F.col("h1")), "two": A.axis(F.col("t2"), F.col("h2"))}
    for r in df.select("x", "y", "u", axes["one"].alias("a"), A.verdict(axes, F.col("u")).alias("v")).collect():
        want = "unresolved" if r.u else "not_applicable" if "miss" in (r.x, r.y) else "unresolved" if "unknown" in (r.x, r.y) else "applicable"
        assert r.v == want and r.a == r.x


def test_courses_are_a_disjunction(spark):
    df = spark.createDataFrame([([], ["X"], "applicable"), (["x"], ["X"], "applicable"), (["y", "z"], ["X"], "not_applicable")], "c array<string>, h array<string>, want string")
    got = df.select("want", A.verdict({"a": A.axis(F.lit(None).cast("string"), F.lit("q"))}, F.lit(False), F.col("c"), F.col("h")).alias("v")).collect()
    assert all(r.want == r.v for r in got)


def test_pairs_by_pattern_equal_the_plain_loop(spark):
    notices = [(i, a, b, u) for i, (a, b, u) in enumerate(itertools.product(["x", "Y", None], ["1", "2", None], [True, False]))]
    users = [(i, a, b) for i, (a, b) in enumerate(itertools.product(["X", "y", None], ["1", "2", None]))]
    n = spark.createDataFrame(notices, "notice int, p string, q string, unreadable_scope boolean")
    u = spark.createDataFrame(users, "user int, p string, q string")
    same = lambda t, h: t is None or (h is not None and t.lower() == h.lower())
    want = {(i, j) for i, a, b, bad in notices for j, c, d in users if not bad and same(a, c) and same(b, d)}
    rows = A.applicable_classes(n, u, ["p", "q"], "notice", "user").collect()
    told = [(r["class"], r.notice, r.links) for r in rows if r.notice is not None]
    members = [(r["class"], r.user) for r in rows if r.user is not None]
    assert {i for c, i, _ in told if c == "*|*"} == {i for i, a, b, bad in notices if not bad and a is None and b is None}
    pairs = {(i, j) for c, i, _ in told for d, j in members if c == d} | {(i, j) for c, i, _ in told if c == "*|*" for j, _, _ in users}
    assert pairs == want and all(links == sum(i == k for k, _ in want) for _, i, links in told)
    total = A.verdict_counts(n, u, ["p", "q"]).where("verdict = 'applicable'").agg(F.sum(F.col("users") * F.col("notices"))).first()[0]
    assert total == len(want)


def test_golden_monitor_run(spark):
    """Eleven items known; then twelve decisions: 1 new, 9 unchanged, 1 updated, 1 revised, 1 removed, as a capture of 12."""
    known = spark.createDataFrame([(f"i{k}", f"h{k}") for k in range(11)], "item string, hash string")
    second = [(f"i{k}", f"h{k}", None) for k in range(9)] + [("i9", "changed", None), ("n1", "a", "i3"), ("n2", "b", "unknown")]
    captured = spark.createDataFrame(second, "item string, hash string, supersedes string")
    got = dict(C.monitor_changes(known, captured, "item", "hash", "supersedes").groupBy("change").count().collect())
    assert got == {"unchanged": 9, "updated": 1, "revised": 1, "new": 1, "removed": 1}


def test_versions_are_revived(spark):
    log = spark.createDataFrame([("a", "1", "d1", "d1", False), ("b", "1", "d1", "d2", True)], "item string, hash string, first_seen string, last_seen string, removed boolean")
    seen = spark.createDataFrame([("b", "1"), ("c", "9"), ("c", "9")], "item string, hash string")
    got = {(r.item, r.hash): (r.first_seen, r.last_seen, r.removed) for r in C.append_versions(log, seen, ["item", "hash"], "d3").collect()}
    assert got == {("a", "1"): ("d1", "d1", True), ("b", "1"): ("d1", "d3", False), ("c", "9"): ("d3", "d3", False)}


def test_merge_and_differences_with_nulls(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, None, 2)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, None, 1), (4, "z", 3)], "id int, s string, n int")
    assert {r.id: (r.s, r.n, r.action) for r in C.merge(a, b, "id", ["s", "n"]).collect()} == {1: ("x", None, "unchanged"), 2: (None, 1, "updated"), 3: (None, 2, "kept"), 4: ("z", 3, "inserted")}
    assert {(r.id, r.field) for r in C.field_differences(a, b, ["id"], ["s", "n"]).collect()} == {(2, "s"), (3, "n"), (4, "s"), (4, "n")}


def test_report_of_invariants(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(20)], "k int, v int")
    got = {r.check: (r.violations, r.passed, r.examples) for r in Q.report(["odd", "none", "twice"], [Q.violations(df, {"odd": (F.col("v") == 1, F.col("k")), "none": (F.col("k") < 0, F.col("k"))}), Q.duplicates(df, "twice", ["v"])]).collect()}
    assert got["none"] == (0, True, "") and got["odd"][0] == 9 and len(got["odd"][2].split(", ")) == 5 and got["twice"] == (2, False, "0, 1")


def test_classification(spark):
    rows = [("Revised Time  Table", "exam_timetable", "high"), ("Scheme and Syllabus", "scheme", "medium"), ("Circular, last date 3 May", "administration", "high"), ("Tender", "unresolved", "low"), ("Results declared", "result", "high")]
    df = spark.createDataFrame(rows, "t string, c string, i string")
    got = df.select("*", X.category_of(F.col("t")).alias("gc"), X.signals_of(F.col("t")).alias("s")).withColumn("gi", X.importance_of(F.col("gc"), F.col("t"))).collect()
    assert all((r.gc, r.gi) == (r.c, r.i) for r in got) and got[0].s == ["Time Table"]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(X.strip_tags(F.lit("<b>a&amp;b</b><script>x<y</script> <!-- c -->\n&lt;i&gt;"))) == "a&b <i>"
    assert value(X.url_path(F.lit("https://a.example/x/y/?q=1"))) == "x/y" and value(X.url_path(F.lit("no address"))) is None
    assert [value(X.private_address(F.lit(ip))) for ip in ("10.0.0.1", "8.8.8.8", "172.20.1.1", "300.1.1.1", "x", "100.64.0.1")] == [True, False, True, True, True, True]
    assert value(X.content_hash(F.lit(None), F.lit("a"))) == value(X.content_hash(F.lit(""), F.lit("a")))


def test_snapshots_are_never_an_empty_success(spark, tmp_path):
    item = {"externalId": "e", "url": "u", "title": "t", "body": "b", "audience": {"branch": "CS", "courses": ["A"], "unresolvedScope": False}}
    (tmp_path / "good.json").write_text(json.dumps({"family": "f", "capturedAt": "2024", "note": "", "items": [item]}))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "short.json").write_text(json.dumps({"family": "f", "items": [{"externalId": "e"}]}))
    rows = files.read_snapshots(spark, f"file://{tmp_path}")
    assert {r.file: r.status for r in rows.collect()} == {"good.json": "ok", "bad.json": "malformed", "short.json": "incomplete"}
    assert [r.audience.courses for r in files.snapshot_items(rows).collect()] == [["A"]]


def test_blobs_and_manifest(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    blobs = files.read_blobs(spark, f"file://{tmp_path}")
    assert sorted((r.kind, r.looks_like_pdf) for r in blobs.collect()) == [("other", False), ("pdf", True), ("pdf", True)]
    files.write_blobs(blobs, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    known = spark.createDataFrame([("u1", "s1"), ("u2", "s2"), ("u3", "s3")], "url string, sha256 string")
    fetched = spark.createDataFrame([("u1", "s1", 200), ("u2", "s9", 200), ("u4", "s1", 200), ("u5", "s5", 200), ("u6", None, 500)], "url string, sha256 string, status int")
    assert {r.url: r.outcome for r in files.manifest(known, fetched).collect()} == {"u1": "unchanged", "u2": "changed", "u3": "gone", "u4": "duplicate", "u5": "new", "u6": "failed"}


def test_owners_are_replaced_alone(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    files.write_collection(spark.createDataFrame([("a", 1), ("b", 2)], "owner string, v int"), path)
    files.write_collection(spark.createDataFrame([("b", 3)], "owner string, v int"), path)
    held = lambda: {(r.owner, r.v) for r in files.read_collection(spark, path).collect()}
    assert held() == {("a", 1), ("b", 3)} and {r.owner for r in files.without_owners(spark, path, "b").collect()} == {"a"}
    # A job that dies before its marker changes nothing; what it left goes with what was replaced.
    spark.createDataFrame([("a", 9, 0, 7)], "owner string, v int, bucket int, _version int").write.mode("append").partitionBy("bucket", "_version").parquet(path)
    assert held() == {("a", 1), ("b", 3)}
    assert files.vacuum_collection(spark, path) == 2 and held() == {("a", 1), ("b", 3)}


def test_buckets_of_a_collection_change_alone(spark, tmp_path):
    path = f"file://{tmp_path}/many"
    files.write_collection(spark.createDataFrame([(f"o{k}", k) for k in range(60)], "owner string, v int"), path, folder_rows=10)
    files.write_collection(spark.createDataFrame([("o7", 700), ("new", 1)], "owner string, v int"), path)
    assert {(r.owner, r.v) for r in files.read_collection(spark, path).collect()} == {(f"o{k}", 700 if k == 7 else k) for k in range(60)} | {("new", 1)}
    assert len({p.name for p in (tmp_path / "many").iterdir() if p.name.startswith("bucket=")}) == 6
    assert len(list((tmp_path / "many").glob("bucket=*/_version=2"))) <= 2


def test_gates(spark):
    registry = spark.createDataFrame([("a", True, True, True, "x", "live"), ("b", False, True, True, "x", "live"), ("c", True, True, True, "x", "fixture")], "family string, enabled boolean, permission_recorded boolean, robots_allow boolean, adapter string, mode string")
    families = spark.createDataFrame([(f,) for f in "abcd"], "family string")
    assert {r.family: r.reason for r in files.refusal(registry, families).collect()} == {"a": None, "b": "disabled", "c": "not_live", "d": "not_registered"}


def test_stream_equals_batch_and_delivers_once(spark, tmp_path):
    for k in range(4):
        rows = [{"family": "f", "item": f"i{n}", "title": f"Time Table {n % 7}", "body": f"b{(n + k) % 3}", "captured": f"2024-01-0{k + 1}T00:00:00"} for n in range(20)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    source, ledger = f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"
    for _ in range(2):
        monitor.start_monitor(monitor.read_captures(spark, source), ledger, f"file://{tmp_path}/state", parts=3).awaitTermination()
    changes = [(r.item, r.change, r.captured.day) for r in monitor.read_ledger(spark, ledger).collect()]
    assert sorted(changes) == sorted((f"i{n}", "new" if k == 0 else "updated", k + 1) for k in range(4) for n in range(20))
    latest = monitor.latest_versions(monitor.read_ledger(spark, ledger))
    assert latest.count() == 20 and latest.where("there AND day(first_seen) = 1 AND day(last_change) = 4").count() == 20
    with pytest.raises(ValueError):
        monitor.start_monitor(monitor.read_captures(spark, source), ledger, f"file://{tmp_path}/s2", minutes=2)


def test_second_capture_of_the_monitor(spark, tmp_path):
    """Two captures, the monitor started again between them: one new, nine unchanged, one updated, one revised, one removed."""
    (tmp_path / "in").mkdir()
    item = lambda n, day, body="b", supersedes=None: {"family": "f", "item": f"i{n}", "title": "t", "body": body, "supersedes": supersedes, "captured": f"2024-01-0{day}T00:00:00"}
    first = [item(n, 1) for n in range(11)]
    second = [item(n, 2) for n in range(9)] + [item(9, 2, "changed"), item(11, 2), item(12, 2, supersedes="i10")]
    third = [item(n, 3) for n in range(12)] + [item(13, 3, supersedes="i12"), item(0, 3), item(12, 3, supersedes="i3")]
    for k, rows in enumerate((first, second, third)):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        monitor.start_monitor(monitor.read_captures(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state", parts=5).awaitTermination()
    counts = {(r.day, r.change): r.n for r in monitor.read_ledger(spark, f"file://{tmp_path}/out").groupBy(F.dayofmonth("captured").alias("day"), "change").agg(F.count("*").alias("n")).collect()}
    assert {c: n for (day, c), n in counts.items() if day == 1} == {"new": 11}
    assert {c: n for (day, c), n in counts.items() if day == 2} == {"new": 1, "unchanged": 9, "updated": 1, "revised": 1, "removed": 1}
    # Item 10 comes back as new, 9 changes back, 12 was known and so revises nothing, 13 revises it.
    assert {c: n for (day, c), n in counts.items() if day == 3} == {"new": 1, "unchanged": 11, "updated": 1, "revised": 1}


def test_daily_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"family": "f", "item": str(n), "title": "t", "body": "b", "captured": f"2024-01-0{1 + n % 2}T05:00:00"}) for n in range(6)))
    q = monitor.daily_counts(monitor.read_captures(spark, f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.captures for r in spark.table("daily").collect()) == [3, 3]


def test_lines_compare_with_the_first_run(spark):
    """A slow drift of y stays one line only within half a height of its first run."""
    runs = [(1, 1, "a", 0.0, 100.0, 5.0, 10.0), (1, 1, "b", 10.0, 97.0, 5.0, 10.0), (1, 1, "c", 20.0, 94.0, 5.0, 10.0), (1, 1, "d", 30.0, 91.0, 5.0, 10.0), (1, 2, "z", 0.0, 5.0, 1.0, 0.0)]
    df = spark.createDataFrame(runs, "doc long, page int, text string, x double, y double, width double, height double")
    assert [(r.page, r.line, r.text) for r in D.lines_of_runs(df).orderBy("page", "line").collect()] == [(1, 0, "a b"), (1, 1, "c d"), (2, 0, "z")]


def test_card_rows(spark):
    lines = [("BXXX401 CORE COURSE ONE 38 21 59 P 2024-07-01",), ("BXXX402 A 2 TITLE | 40 23 63 | P",), ("Total marks 100",), ("BXXX403 BROKEN 40 23 64 F",)]
    got = {r.code: r for r in D.card_rows(spark.createDataFrame(lines, "text string")).collect()}
    assert set(got) == {"BXXX401", "BXXX402", "BXXX403"}
    assert (got["BXXX401"].internal, got["BXXX401"].total, got["BXXX401"].result, str(got["BXXX401"].announced), got["BXXX401"].title) == (38, 59, "P", "2024-07-01", "CORE COURSE ONE")
    assert got["BXXX402"].total == 63 and not got["BXXX403"].readable and got["BXXX403"].total is None


def test_slots_topics_and_readings(spark):
    cells = spark.createDataFrame([(1, "p", 5.0), (1, "q", 12.0), (1, "r", 40.0)], "doc int, cell string, centre double")
    slots = spark.createDataFrame([(1, "s1", 0.0, 10.0), (1, "s2", 14.0, 20.0)], "doc int, slot string, left double, right double")
    assert {r.cell: (r.slot, r.inside) for r in D.nearest_slot(cells, slots).collect()} == {"p": ("s1", True), "q": ("s1", False), "r": ("s2", False)}
    lines = ["Graphs: of all kinds", "trees, and more: prose", "TREES, WOODS: in capitals", "GRAPHS : again", "Ex. 2: a stop", "Note: none", "Sorting:", "ab: short"]
    topics = topics_of(spark.createDataFrame([(1, n, t) for n, t in enumerate(lines)], "doc int, n int, text string"), ["doc"])
    assert [(r.place, r.topic) for r in topics.orderBy("place").collect()] == [(1, "Graphs"), (2, "TREES, WOODS"), (3, "Sorting")]
    readings = spark.createDataFrame([(1, 1, 5, 1, 90), (1, 2, 5, 0, 80), (2, 1, 3, 0, 9), (2, 2, 3, 0, 9)], "doc int, reading int, rows int, dropped int, words int")
    assert {r.doc: r.reading for r in D.better_reading(readings).collect()} == {1: 2, 2: 1}
    words = spark.createDataFrame([(1, 1, "w", 0.0, 10.0, 5.0, 20.0, 100.0, 50.0)] * 20, "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double, page_height double, confidence double")
    assert D.page_quality(words).first().worth_reviewing and D.words_to_runs(words).first().y == 80.0
