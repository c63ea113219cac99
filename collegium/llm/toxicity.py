"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collegium.llm.common import materialise, slices
from collegium.llm.statistics import BANGS, LOWER, SENTENCE, SYMBOLS, UPPER, both_labels, id_remainder, labelled, share, stable_seed

#: Labelled rows to fit on at most, about; the folds and the threshold of `predicted`.
BOUND, MODULUS, HELD_OUT, THRESHOLD = 20_000, 3, 1, 0.7
#: The standard score that a unit of the lexicon needs, texts that must hold it, lengths of word beginnings. All units
#: that reach these are taken; as the labelled sample is bounded, so is their number.
LEAST_Z, LEAST_TEXTS, BEGINNINGS = 6.0, 3, (5, 6, 7, 8)
#: Parts of the labelled sample; each is described and scored by what the others teach.
FOLDS = 3
#: Characters within which a second-person word is near.
NEAR = 60
TREES, DEPTH = 20, 3

#: Second-person words of the four languages.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "tus"]

FEATURES = ["hits_per_word", "hits", "distinct_hits", "near_second_person", "second_person", "capitals", "shouting", "sentence", "bangs", "symbols", "obfuscated", "n_words"]

_word = re.compile(r"[^\W_]+")


def units_of(text: str) -> set[str]:
    """The words of a text in lower case, each followed by a space, and their beginnings without one."""
    words = set(_word.findall(text.lower()))
    return {f"{w} " for w in words} | {w[:n] for w in words for n in BEGINNINGS if len(w) > n}


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: Counter = Counter()
        for part, label, text in zip(*(batch.column(n).to_pylist() for n in ("part", "label", "text"))):
            counts.update((part, bool(label), unit) for unit in units_of(text))
        parts, labels, units = zip(*counts) if counts else ((), (), ())
        columns = [pa.array(units, pa.string()), pa.array(parts, pa.int64()), pa.array(labels, pa.bool_()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", "part", "toxic", "n"])


def learn_lexicons(rows: DataFrame, folds: int = FOLDS) -> list[list[str]]:
    """The words and word beginnings that label 1 holds far more often: without part 0, 1 and so on, and of all parts.

    Rows have part, label and text. A part without both labels in the others has an empty lexicon.
    """
    totals = {(r.part, r.label): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    counts = rows.select("part", "label", "text").mapInArrow(_unit_counts, "unit string, part long, toxic boolean, n long")
    without = [F.lit(True) if f == folds else F.col("part") != f for f in range(folds + 1)]
    seen = [F.coalesce(F.sum(F.when(kept & (F.col("toxic") == label), F.col("n"))), F.lit(0)).alias(f"{'ba'[label]}{f}") for f, kept in enumerate(without) for label in (True, False)]
    found = []
    for f in range(folds + 1):
        zeros, ones = (sum(n for (part, label), n in totals.items() if label == y and part != f) for y in (0.0, 1.0))
        if not zeros or not ones:
            found.append(F.lit(False))
            continue
        rate = ones / (ones + zeros)
        mean = (F.col(f"a{f}") + F.col(f"b{f}")) * rate
        found.append((F.col(f"a{f}") >= LEAST_TEXTS) & ((F.col(f"a{f}") - mean) / F.sqrt(mean * (1 - rate)) >= LEAST_Z))
    sure = counts.groupBy("unit").agg(*seen).select("unit", F.array(*[F.coalesce(x, F.lit(False)) for x in found]).alias("found"))
    units = sure.where(F.exists("found", lambda x: x)).collect()
    return [sorted(r.unit for r in units if r.found[f]) for f in range(folds + 1)]


class Features:
    """features(text) gives the values of FEATURES for a lexicon."""

    def __init__(self, lexicon: list[str]) -> None:
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for unit in SECOND_PERSON:
            self.words.add_word(unit, (len(unit), True, False))
        for unit in lexicon:
            self.words.add_word(unit.rstrip(), (len(unit.rstrip()), unit.endswith(" "), True))
        self.words.make_automaton()
        letters = np.zeros(256, bool)
        letters[list(UPPER + LOWER)] = True
        inside = np.zeros(256, bool)
        inside[list(b"0123456789@$!*#%")] = True
        self.letters, self.inside = letters, inside

    def obfuscated(self, raw: bytes) -> int:
        """Places where a digit or sign stands between two letters."""
        at = np.frombuffer(raw, np.uint8)
        letters = self.letters[at]
        return int((letters[:-2] & self.inside[at[1:-1]] & letters[2:]).sum()) if len(at) > 2 else 0

    def features(self, text: str) -> tuple[float, ...]:
        raw = text.encode()
        words = raw.split()
        if not words:
            return (0.0,) * len(FEATURES)
        low = text.lower()
        hits: dict[int, str] = {}
        seconds: list[int] = []
        for last, (size, whole, toxic) in self.words.iter(low):
            at = last - size + 1
            if at and low[at - 1].isalnum() or whole and last + 1 < len(low) and low[last + 1].isalnum():
                continue
            if toxic:
                hits[at] = low[at : last + 1]
            else:
                seconds.append(at)
        n, size = len(words), len(raw)
        near = 0
        if hits and seconds:
            places = np.array(sorted(seconds))
            at = np.array(sorted(hits))
            right = np.searchsorted(places, at)
            gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(at - places[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        return (
            len(hits) / n,
            float(len(hits)),
            float(len(set(hits.values()))),
            near / max(1, len(hits)),
            len(seconds) / n,
            share(raw, UPPER, size),
            sum(map(bytes.isupper, words)) / n,
            share(raw, SENTENCE, size),
            share(raw, BANGS, size),
            share(raw, SYMBOLS, size),
            self.obfuscated(raw) / n,
            float(n),
        )


def _features(lexicon: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon).features
        for batch in slices(batches):
            values = np.array([features(x) for x in batch.column("_text").to_pylist()], float).reshape(-1, len(FEATURES))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(values[:, i]) for i in range(len(FEATURES)))], names=[*(n for n, _ in kept), *FEATURES])

    return run


def toxic_features(docs: DataFrame, lexicon: list[str], *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of keep and those of FEATURES for each row; null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([*rows.drop("_text").schema.fields, *(T.StructField(n, T.DoubleType()) for n in FEATURES)])
    return rows.mapInArrow(_features(lexicon), schema)


@dataclass
class ToxicModel:
    """With trees None, every text scores `base`."""

    lexicon: list[str] = field(default_factory=list)
    trees: Any = None
    calibration: Any = None
    base: float = 0.0

    def score(self, featured: DataFrame) -> DataFrame:
        """Adds score, the calibrated probability of label 1, to rows with the columns of FEATURES."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(self.base))
        raw = _probability(self.trees, featured)
        if self.calibration is None:
            return raw.withColumnRenamed("raw", "score")
        calibrated = self.calibration.transform(raw)
        return calibrated.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated")))).drop("raw", "calibrated")


def _probability(trees, featured: DataFrame) -> DataFrame:
    found = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
    return found.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _fitted(rows: DataFrame):
    """Trees learned from rows with label and the columns of FEATURES; None without both labels."""
    if not all(both_labels(rows)):
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=stable_seed("toxicity")).fit(vectors)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND, modulus: int = MODULUS, held_out: int = HELD_OUT, folds: int = FOLDS) -> ToxicModel:
    """Learns the lexicon, the trees and the calibration from a labelled sample, about `bound` rows at most.

    Cross-fitted, so that every row teaches all three and none is judged by what it taught: a part's features come
    from the lexicon of the other parts, and its raw scores, which the calibration is fitted to, from trees of the
    other parts. The lexicon and the trees of all parts score other texts. Null text is empty; without both labels the
    score is constant (the share of label 1); parts without both labels in the others don't calibrate. Rows that repeat
    an id are all labelled by it, and stand in one part.
    """
    rows = materialise(labelled(docs, labels, "toxic", modulus, held_out, bound).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(folds))), "toxic")
    zeros, ones = both_labels(rows)
    if not zeros or not ones:
        return ToxicModel(base=ones / max(1, zeros + ones))
    lexicons = learn_lexicons(rows, folds)
    parts = [toxic_features(rows.where(F.col("part") == f), lexicons[f], "label", "part") for f in range(folds)]
    featured = materialise(reduce(DataFrame.unionByName, parts), "features")
    model = ToxicModel(lexicons[folds], _fitted(featured))
    others = [(f, _fitted(featured.where(F.col("part") != f))) for f in range(folds)]
    scored = [_probability(trees, featured.where(F.col("part") == f)).select("label", "raw") for f, trees in others if trees]
    if scored:
        scored = materialise(reduce(DataFrame.unionByName, scored), "raw")
        if all(both_labels(scored)):
            model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(scored)
    return model


def without_toxic(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below THRESHOLD, scored where they are read, so that no text is shuffled.

    Rows that repeat an id, or have none, are judged each by its own text; all columns stay as they are.
    """
    whole = docs.select(F.col(id_col).alias("_key"), F.struct("*").alias("_row"), F.col(text_col).alias("_words"))
    scored = model.score(toxic_features(whole, model.lexicon, "_row", id_col="_key", text_col="_words"))
    return scored.where(F.col("score") < THRESHOLD).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null and empty texts have all features 0.

    Rows that repeat an id, or have none, have a row each; other columns are ignored; an empty table gives no rows.
    """
    found = model.score(toxic_features(docs, model.lexicon, id_col=id_col, text_col=text_col))
    held_out = (id_remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
