"""Both classifiers' queries against plain Python over whole small tables."""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pytest
from pyspark.ml.linalg import Vectors

from collegium.llm.quality import fit_quality, score_quality
from collegium.llm.statistics import NAMES, text_statistics
from collegium.llm.toxicity import FEATURES, LEAST_TEXTS, LEAST_Z, NEAR, SECOND_PERSON, fit_toxicity, learn_lexicons, score_toxicity, toxic_features, units_of

SF = "/root/testdata/sf0.01"


def hits_of(low, units):
    """{place: word} of lexicon units by trying every place; a unit with a space behind it is a whole word."""
    found = {}
    for at in range(len(low)):
        if at and low[at - 1].isalnum():
            continue
        for unit in sorted(units, key=lambda u: len(u.rstrip())):
            word = unit.rstrip()
            end = at + len(word)
            if low.startswith(word, at) and not (unit.endswith(" ") and end < len(low) and low[end].isalnum()):
                found[at] = word
    return found


def plain_features(text, lexicon):
    words, low = text.split(" ") if text else [], text.lower()
    hits = hits_of(low, lexicon)
    seconds = sorted(hits_of(low, [f"{w} " for w in SECOND_PERSON]))
    near = sum(any(abs(s - at) <= NEAR for s in seconds) for at in hits)
    raw = text.encode()
    return {
        "hits_per_word": len(hits) / len(words), "hits": len(hits), "distinct_hits": len(set(hits.values())), "near_second_person": near / max(1, len(hits)), "second_person": len(seconds) / len(words),
        "shouting": sum(bool(re.search("[A-Z]", w)) and w.upper() == w for w in words) / len(words), "bangs": text.count("!") / len(raw), "n_words": len(words),
        "obfuscated": len(re.findall(r"(?=[A-Za-z][0-9@$!*#%][A-Za-z])", text)) / len(words), "capitals": sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / len(raw),
    }


def test_features_by_trying_every_place(spark):
    lexicon = ["vile ", "rotte", "fool ", "fool"]
    texts = ["You vile rotten fools! A f00l and a fo0l", "vile", "REVILE vile vilest YOUR fool your", "calm words of du and dich rotten", "rotte rotter unrotten tu ROTTEN!!", "A1b2c3 x@y z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxic_features(rows, lexicon).collect():
        for name, value in plain_features(texts[r.doc_id], lexicon).items():
            assert r[name] == pytest.approx(value), (texts[r.doc_id], name)


def test_lexicons_by_counting(spark):
    texts = ["bad awful word"] * 6 + ["good day word"] * 40 + ["bad day"]
    rows = [(k % 3, float(k < 6), t) for k, t in enumerate(texts)]
    found = learn_lexicons(spark.createDataFrame(rows, "part long, label double, text string"))
    for f in range(4):
        kept = [(y, units_of(t)) for part, y, t in rows if part != f]
        ones, n = sum(y for y, _ in kept), len(kept)
        want = []
        for unit in set().union(*(u for _, u in kept)):
            a, both = sum(y for y, u in kept if unit in u), sum(unit in u for _, u in kept)
            mean = both * ones / n
            if a >= LEAST_TEXTS and (a - mean) / math.sqrt(mean * (1 - ones / n)) >= LEAST_Z:
                want.append(unit)
        assert found[f] == sorted(want)


def test_toxicity_scores_by_the_fitted_parts(spark):
    """Each score is the calibrated probability that the fitted trees give the row's features, one row at a time."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    scored = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    steps, values = (x.toArray().tolist() for x in (model.calibration.boundaries, model.calibration.predictions))
    for r in toxic_features(docs, model.lexicon).limit(150).collect():
        raw = model.trees.predictProbability(Vectors.dense([r[n] for n in FEATURES]))[1]
        k = bisect_left(steps, raw)
        if k == 0 or k == len(steps):
            want = values[0 if k == 0 else -1]
        else:
            want = values[k] if steps[k] == raw else values[k - 1] + (values[k] - values[k - 1]) * (raw - steps[k - 1]) / (steps[k] - steps[k - 1])
        assert scored[r.doc_id].score == pytest.approx(min(1.0, max(0.0, want))), r.doc_id
        assert scored[r.doc_id].predicted == int(scored[r.doc_id].score >= 0.7)
    assert len(scored) == docs.count()


def test_quality_scores_by_the_rules(spark):
    """Each score is the logistic sum of the weights of the rules that a text's statistics meet."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in score_quality(docs, model).collect():
        x = dict(enumerate(text_statistics((texts[r.doc_id] or "").encode())))
        margin = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(x[k] <= v if below else x[k] > v for k, below, v in rule))
        assert len(x) == len(NAMES) and r.score == pytest.approx(1 / (1 + math.exp(-margin)))


def test_equal_texts_have_equal_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = spark.createDataFrame([(1, "same words here"), (2, "same words here"), (None, "same words here"), (3, None), (4, "")], "doc_id long, text string")
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        rows = score(twice, fit(docs, labels)).collect()
        assert len({r.score for r in rows if r.doc_id not in (3, 4)}) == 1 and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
