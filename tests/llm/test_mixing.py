"""Mixing against plain targets, and the schedule's evenness."""

import re

from collegium.llm.mixing import mix, mix_report, mixed_documents, schedule, sized, source_targets
from collegium.llm.common import materialise


def plain_targets(sizes):
    """{source: target} by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in sizes if s not in stopped)
        level = (total - sum(2 * sizes[s] for s in stopped)) / free if free else 0
        over = {s for s in sizes if s not in stopped and 2 * sizes[s] <= weight[s] * level}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in sizes}
        stopped |= over


def rows_of(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None, "src1"), (901, "", None), (902, "one two\x0bthree é x", None), (903, "w", "ä"), (None, "q r s", "Z"), (904, "tiny", ""), (904, "tiny", ""), (905, "x " * 50000, "src0")]
    return rows


def test_report(spark):
    rows = rows_of(spark)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, taken int")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    targets = plain_targets(sizes)
    found = mix_report(docs).collect()
    assert len(found) == len(rows) and sorted(map(tuple, found), key=str) == sorted(map(tuple, mix_report(docs).collect()), key=str)
    took, of = {}, {i: s for i, _, s in rows}
    for r in found:
        assert r.taken <= 2 * r.size and r.source_size == sizes[of[r.doc_id]] and abs(r.target - targets[of[r.doc_id]]) < 1e-6
        took[of[r.doc_id]] = took.get(of[r.doc_id], 0) + r.taken
    assert all(abs(took[s] - targets[s]) <= 0.5 for s in sizes)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mix_report(docs).collect())) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]


def test_schedule_is_even_and_complete(spark):
    docs = spark.createDataFrame(rows_of(spark), "doc_id long, text string, source string")
    targets = materialise(source_targets(sized(docs)), "t")
    slots = schedule(targets, 64).collect()
    needs = {r.no: -(-r.words // 64) for r in targets.collect()}
    ranks = {}
    for s in slots:
        ranks.setdefault(s.no, []).append((s.at, s.rank))
    assert {k: sorted(r for _, r in v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in needs.items() if n}
    largest = max(needs, key=needs.get)
    at = [a for a, _ in sorted(ranks[largest])]
    n = len(at)
    assert all(abs(sum(a < x / 10 for a in at) / n - x / 10) < 0.05 for x in range(1, 10))


def test_blocks_hold_every_word_of_the_mix(spark):
    docs = spark.createDataFrame(rows_of(spark), "doc_id long, text string, source string")
    _, parts = mix(docs, 128)
    assert {r.s for r in parts.groupBy("no", "rank").sum("taken").withColumnRenamed("sum(taken)", "s").collect()} >= {128}
    assert parts.where("skip < 0 or taken <= 0 or skip + taken > size").count() == 0


def test_the_mix_is_in_the_schedules_order(spark):
    """Read in order, every tenth of the mix holds each large source in about its share."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed_documents(docs).select("source", "text").collect()]
    total = sum(n for _, n in rows)
    share = {s: sum(n for x, n in rows if x == s) / total for s in {s for s, _ in rows}}
    places = {(r.source, r.at) for r in mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").where("at IS NOT NULL").collect()}
    assert all(0 <= at < 1 for _, at in places)
    for source in [s for s in share if share[s] > 0.1]:
        seen = got = 0
        for k, (s, n) in enumerate(rows, 1):
            seen, got = seen + n, got + n * (s == source)
            if k % (len(rows) // 10) == 0:
                assert abs(got / seen - share[source]) < 0.12, (source, k)
