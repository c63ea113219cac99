"""The stages of corpus_pipeline.py on the small table, each held against plain counts over its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from collegium.llm.line_dedup import near_lines
from tests.llm.test_line_dedup import split
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import expected as plain_simhash
from tests.llm.test_tokens import check_packing

WORD = r"[^\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs.collect(), docs.columns, stage(spark, docs, SF).cache()))
        docs = out[-1][3]
    return out


def test_names_and_columns(steps):
    assert [s[0] for s in steps] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    assert all(s[3].columns == s[2] for s in steps[:-1])


def test_toxicity_keeps_rows_as_they_are(spark, steps):
    from collegium.llm.toxicity import fit_toxicity, score_toxicity

    _, before, _, after = steps[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wrong = {r.doc_id for r in score_toxicity(docs, fit_toxicity(docs, labels)).where("predicted = 1").collect()}
    assert sorted(after.collect()) == sorted(r for r in before if r.doc_id not in wrong)


def test_line_dedup(steps):
    _, before, _, after = steps[1]
    gone, seen = defaultdict(set), []
    for i, text in sorted((r.doc_id, r.text) for r in before):
        for k, line in enumerate(text.split("\n")):
            words = [w.encode() for w in split(line)]
            if words and any(words == v or near_lines(v, words) for v in seen):  # near_lines is held against distances elsewhere
                gone[i].add(k)
            if words:
                seen.append(words)
    texts = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id]) for r in before}
    assert {r.doc_id: r.text for r in after.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_simhash(steps):
    _, before, _, after = steps[2]
    kept = {i for i, _, least in plain_simhash([(r.doc_id, r.text) for r in before]) if i == least}
    assert sorted(after.collect()) == sorted(r for r in before if r.doc_id in kept)


def test_mixing(steps):
    _, before, _, after = steps[3]
    size = lambda t: len(re.findall(WORD, t))
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r.text)
    targets, texts = plain_targets(sizes), {r.doc_id: r.text for r in before}
    took, times = Counter(), defaultdict(list)
    for r in after.collect():
        took[r.source] += size(r.text)
        times[r.doc_id].append(r.text)
        assert r.text == texts[r.doc_id] or re.findall(WORD, texts[r.doc_id])[: size(r.text)] == r.text.split(" ")
    assert all(abs(took[s] - targets[s]) <= 1 for s in sizes) and max(map(len, times.values())) <= 2


def test_packing(steps):
    _, before, _, after = steps[4]
    texts = Counter(r.doc_id for r in before)
    once = [r for r in before if texts[r.doc_id] == 1]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts)
    check_packing([r for r in rows if texts[r.doc_id] == 1], [(r.doc_id, r.text) for r in once], gapless=False)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (2, "a b c", None, "s", 5, 3), (2, "a b c", None, "s", 5, 3), (3, "x " * 9000, "en", "s", 18000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0, name
    assert docs.select("doc_id").distinct().count() >= 2


def test_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
