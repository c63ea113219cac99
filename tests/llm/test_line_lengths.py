"""Line dedup where the edits follow the line's length, against a version that compares all lines."""

import random

from collegium.llm.line_dedup import WORDS_AN_EDIT, line_report, near_lines
from tests.llm.test_line_dedup import distance, frame, split


def likely_expected(rows):
    """expected(), with as many edits as a likeness of 0.8 allows in the longer line."""
    out, seen = {}, []
    for i, text in sorted(rows):
        gone, n = [], 0
        for k, x in enumerate(text.split("\n")):
            w = split(x)
            n += 1
            if any(w == v or (len(w) >= 5 and len(v) >= 5 and distance(v, w) <= max(len(v), len(w)) // 5) for v in seen):
                gone.append(k)
            seen.append(w)
        out[i] = (n, len(gone), gone)
    return out


def near(docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_report(docs, an_edit=WORDS_AN_EDIT).collect()}


def test_edits_follow_the_length(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows, base = [], []
    for i in range(120):
        lines = []
        for _ in range(3):
            n = rng.randint(5, 60)
            w = list(rng.choice(base)) if base and rng.random() < 0.7 else [rng.choice(words[:20] if rng.random() < 0.3 else words) for _ in range(n)]
            base.append(w)
            for _ in range(rng.randint(0, len(w) // 4 + 1)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            w = w or ["x"]
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    assert near(frame(spark, rows)) == likely_expected(rows)
    plain = "a b c d e f g h i j".split()
    two = [(1, " ".join(plain)), (2, " ".join(["X", *plain[1:-1], "Y"])), (3, " ".join(["X", "Z", *plain[2:-1], "Q"]))]
    assert [r[1] for _, r in sorted(near(frame(spark, two)).items())] == [0, 1, 1]


def test_near_lines():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(1, 14))] for _ in range(2))
        assert near_lines(a, b) == (min(len(a), len(b)) >= 5 and distance(a, b) <= max(len(a), len(b)) // 5)


def test_query_follows_the_length(spark, tmp_path):
    """The registered query and the pipeline's stage, at two edits in ten words."""
    import corpus_pipeline
    from collegium.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "X b c d e f g h i Y"), (3, "X Z c d e f g h i Q")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_dropped for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 1, 1]
    assert [r.text for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()] == ["a b c d e f g h i j", "", ""]
