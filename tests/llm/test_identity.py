"""The pipeline's stages on rows whose ids are null or repeated."""

from collections import Counter

from collegium.llm.mixing import mix_report, mixed_documents
from collegium.llm.simhash import one_of_each


def text(seed):
    return " ".join(f"{seed}{k * k % 97}" for k in range(80))


def test_simhash_keeps_one_row_of_each_component(spark):
    a, b, c, d, e = (text(x) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (4, c), (4, d), (5, c), (6, e), (6, e), (None, e), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, one_of_each(docs).collect()))
    assert kept == Counter([(None, a), (None, b), (4, c), (4, d), (6, e), (7, None)])
    near = spark.createDataFrame([(1, "p q r s"), (2, "P q r s"), (2, "x y z w v")], "doc_id long, text string")
    assert Counter(map(tuple, one_of_each(near).collect())) == Counter([(1, "p q r s"), (2, "x y z w v")])


def test_mix_takes_rows_that_share_an_id_as_often_as_the_report_says(spark):
    rows = [(1, text("a"), "s"), (1, text("b"), "s"), (1, text("b"), "s"), (1, text("b"), "t"), (None, text("c"), "t"), (None, text("d"), None), (None, text("d"), None), (2, text("e") + " f", "s"), (3, text("g"), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r.taken for r in mix_report(docs).collect())
    mixed = mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in mixed) == taken
    whole = Counter((r.doc_id, r.text, r.source) for r in mixed)
    assert all(n <= 2 * Counter(rows)[x] for x, n in whole.items() if x in rows)
