"""Quality classifier: a sparse ensemble of conjunctive rules, scored as Spark column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import materialise
from collegium.llm.statistics import NAMES, both_labels, id_remainder, labelled, stable_seed, statistics

#: Labelled rows to fit on at most, about; trees and their depth; lasso strength; the folds and the threshold of `predicted`.
BOUND, TREES, DEPTH, LASSO = 20_000, 16, 3, 0.0005
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7

#: (index of a statistic, whether it is at most the value, value)
Test = tuple[int, bool, float]
Rule = tuple[Test, ...]


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 over the columns of NAMES."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            margin = margin + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def holds(rule: Rule) -> Column:
    """The rule as a condition on the columns of NAMES."""
    out = F.lit(True)
    for k, below, value in rule:
        out = out & ((F.col(NAMES[k]) <= value) if below else (F.col(NAMES[k]) > value))
    return out


def tree_rules(debug: str) -> list[Rule]:
    """The paths from the root to every node of each tree, from a forest's toDebugString."""
    path: list[tuple[int, Test]] = []
    found: dict[Rule, None] = {}
    for line in debug.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (-?[\d.E+-]+)\)", line)
        if m:
            deep = len(m[1])
            path = [x for x in path if x[0] < deep] + [(deep, (int(m[2]), m[3] == "<=", float(m[4])))]
            found[tuple(sorted({t for _, t in path}))] = None
    return list(found)


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Learns from rows with the columns of NAMES and `label`; with one label only, the score is that label's."""
    zeros, ones = both_labels(rows)
    if not zeros or not ones:
        return RuleModel([], [], 20.0 if ones else -20.0)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).select("label", "features", *NAMES)
    forest: RandomForestClassificationModel = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=stable_seed("quality")).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel([], [], 20.0 if ones > zeros else -20.0)
    tested = rows.select("label", *[holds(r).cast("double").alias(f"rule{i}") for i, r in enumerate(rules)])
    tested = VectorAssembler(inputCols=[f"rule{i}" for i in range(len(rules))], outputCol="features").transform(tested).select("label", "features")
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100, standardization=False).fit(tested.cache())
    tested.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(model.intercept))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND, modulus: int = MODULUS, held_out: int = HELD_OUT) -> RuleModel:
    """Rules and weights from a labelled sample, about `bound` rows at most; null text is empty.

    Labels without an id or a value other than 0 and 1 are left out, and of labels that repeat an id one counts; rows
    that repeat an id are learned from each. Without both labels (or rows) the score is constant.
    """
    rows = labelled(docs, labels, "quality", modulus, held_out, bound)
    return fit(materialise(statistics(rows, "label"), "quality"))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null and empty texts score like any without words.

    Rows that repeat an id, or have none, have a row each; other columns are ignored; an empty table gives no rows.
    """
    return statistics(docs, id_col=id_col, text_col=text_col).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"),
        model.score().alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
