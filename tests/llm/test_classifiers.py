"""Quality and toxicity: rules against plain Python, held-out accuracy, and tables without much to learn from."""

from __future__ import annotations

import math
import zlib

import pytest

from collegium.llm import queries
from collegium.llm.quality import RuleModel, fit_quality, score_quality, tree_rules
from collegium.llm.statistics import NAMES, id_remainder, statistics, text_statistics
from collegium.llm.toxicity import Features, fit_toxicity, score_toxicity, without_toxic

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "held_out", "score", "predicted"]


def area(rows: list[tuple[float, int]]) -> float:
    """The chance that a row with label 1 scores above one with label 0, ties counting half."""
    ones = [s for s, y in rows if y]
    zeros = [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(
    ("sf_dir", "query", "label", "modulus", "held_out"),
    [
        (SF, "op4_quality", "quality", 4, 2),
        (SF, "op9_toxicity", "toxic", 3, 1),
        ("/root/testdata/sf0.1", "op9_toxicity", "toxic", 3, 1),
    ],
)
def test_held_out_rows_are_ranked(spark, sf_dir, query, label, modulus, held_out):
    rows = queries.QUERIES[query](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held_out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert area([(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]) >= 0.9


def test_rules_as_columns(spark):
    debug = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 3.0)
     If (feature 2 <= 1.5E0)
      Predict: 0.0
     Else (feature 2 > 1.5E0)
      Predict: 1.0
    Else (feature 0 > 3.0)
     Predict: 1.0
"""
    rules = tree_rules(debug)
    assert rules == [((0, True, 3.0),), ((0, True, 3.0), (2, True, 1.5)), ((0, True, 3.0), (2, False, 1.5)), ((0, False, 3.0),)]
    model = RuleModel(rules, [0.5, -1.0, 2.0, 0.25], -0.1)
    docs = spark.createDataFrame([(1, "a b"), (2, "aaa bbb"), (3, "a b c d e"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in statistics(docs).withColumn("score", model.score()).collect()}
    for doc_id, text in docs.collect():
        x = text_statistics(text.encode())
        margin = -0.1 + sum(w for rule, w in zip(rules, model.weights) if all(x[k] <= v if below else x[k] > v for k, below, v in rule))
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_statistics_of_odd_texts():
    for raw in (b"", b" \n", b"x", b"\n\nx\n", b"A!B?" * 1000, "ÄÖ ü　".encode(), b"\x00\xff"):
        values = text_statistics(raw)
        assert len(values) == len(NAMES) and all(math.isfinite(v) for v in values)
    one = dict(zip(NAMES, text_statistics(b"One two\nOne two\n")))
    assert (one["n_words"], one["repeated_lines"], one["distinct_words"], one["title_words"]) == (4, 0.5, 0.5, 0.5)


def test_features_near_second_person():
    f = Features(["vile ", "rotte"])
    x = dict(zip(("hits_per_word", "hits", "distinct_hits", "near", "second"), f.features("you vile rotten vileness " + "calm " * 40 + "vile")))
    assert (x["hits"], x["distinct_hits"]) == (3, 2)  # vileness is no hit, as the unit is a whole word
    assert x["near"] == pytest.approx(2 / 3)
    assert f.features("") == f.features(" \n") == (0.0,) * 12


@pytest.mark.parametrize(("fit", "score", "label"), [(fit_quality, score_quality, "quality"), (fit_toxicity, score_toxicity, "toxic")])
def test_odd_tables(spark, fit, score, label):
    schema = "doc_id long, text string, score string, label string, held_out string, _text string, n_words string, features string"
    rows = [(1, "a"), (None, "b"), (3, None), (4, ""), (4, "twice"), (4, "twice"), (5, "long " * 100_000), (6, "　\x00ü!")]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], schema)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    one_label = spark.createDataFrame([(i, 1) for i in (1, 3, 4, 5, 6, None)], f"doc_id long, {label} int")
    for labels in (none, one_label):
        model = fit(docs, labels)
        out = score(docs, model)
        assert out.columns == COLUMNS
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r.score <= 1 for r in got)
        assert score(docs.limit(0), model).collect() == []
    assert fit(docs.limit(0), one_label) is not None


def test_stage_keeps_rows_and_columns(spark):
    schema = "doc_id long, text string, score double, _row string, _key string"
    docs = spark.createDataFrame([(1, "fine", 2.0, "r", "k"), (1, "fine", 2.0, "r", "k"), (None, None, None, None, None)], schema)
    model = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)


def test_remainder_of_ids(spark):
    rows = spark.createDataFrame([(0,), (7,), (-3,), (None,)], "doc_id long")
    got = rows.select("doc_id", id_remainder(rows["doc_id"], 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 for r in got)
