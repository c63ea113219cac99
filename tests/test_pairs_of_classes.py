"""Pairs of classes with membership hold every pair of a notice and a user, everybody's notices among them."""

from __future__ import annotations

from collegium.operators.applicability import applicable_pairs


def test_every_pair_comes_out_of_classes(spark):
    notices = [(1, "A", None, None, False), (2, " a", None, None, False), (3, None, "7", 5, False), (4, None, None, None, False), (5, None, None, None, True), (6, "Z", None, None, False)]
    users = [(10, "A", "7", 5), (11, "a ", "7", 5), (12, None, "7", 5), (13, "B", "8", 5), (14, None, None, None)]
    axes = ["branch", "college", "semester"]
    n = spark.createDataFrame(notices, "notice long, branch string, college string, semester long, unreadable_scope boolean")
    u = spark.createDataFrame(users, "student long, branch string, college string, semester long")
    rows = applicable_pairs(n, u, axes, "notice", "student").collect()
    norm = lambda v: None if v is None else str(v).strip().lower()
    want = {(a[0], b[0]) for a in notices if not a[4] for b in users if all(norm(t) is None or norm(t) == norm(h) for t, h in zip(a[1:4], b[1:4]))}
    of = {kind: [r for r in rows if r.kind == kind] for kind in ("pair", "notice", "user")}
    got = [(x.notice, y.student) for p in of["pair"] for x in of["notice"] for y in of["user"] if x.notice_class == p.notice_class and y.user_class == p.user_class]
    assert len(got) == len(set(got)) and set(got) == want and sum(p.links for p in of["pair"]) == len(want)
    assert {r.notice: r.links for r in of["notice"]} == {k: sum(a == k for a, _ in want) for k in (1, 2, 3, 4, 6)}
    assert {r.student: r.links for r in of["user"]} == {k: sum(b == k for _, b in want) for k in (10, 11, 12, 13, 14)}
