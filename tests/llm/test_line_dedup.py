"""Line dedup against a version that compares all lines."""

import random

from collegium.llm.line_dedup import line_report, one_edit


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def split(text):
    """Words by the ASCII white space that bytes.split knows."""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def expected(rows):
    lines = []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines += [(i, k, w) for k, x in enumerate((text or "").split("\n")) if (w := split(x))]
    out = {i: [0, []] for i, _ in rows}
    seen = []
    for i, k, w in lines:
        out[i][0] += 1
        if any(w == v or (len(w) >= 5 and len(v) >= 5 and abs(len(v) - len(w)) < 2 and distance(v, w) <= 1) for v in seen):
            out[i][1].append(k)
        seen.append(w)
    return {i: (n, len(gone), gone) for i, (n, gone) in out.items()}


def found(docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_report(docs).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, line int")


def test_random_lines(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = []
    for i in rng.sample(range(1000), 80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 1)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(lines)))
    assert found(frame(spark, rows)) == expected(rows)


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c d e\na b c d e"), (5, "a b c d f"), (6, "a b c d"), (None, "a b c d e f"), (8, "é " * 4 + "x"), (9, "é " * 4 + "y"), (10, "w " * 3000 + "\nend of it all now")]
    assert found(frame(spark, rows)) == expected(rows)
    assert line_report(frame(spark, rows).where("false")).count() == 0
    twice = line_report(frame(spark, [(1, "p q"), (1, "p q"), (2, "p q")])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in twice) == [(1, 0), (1, 0), (2, 1)]


def test_table_exact_lines(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    assert found(frame(spark, rows)) == expected(rows)


def test_one_edit():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert one_edit(a, b) == (distance(a, b) <= 1)
