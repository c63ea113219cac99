"""Line dedup's pairs are made by the block, and what a step has shuffled goes once it is written."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from collegium.llm import line_dedup
from collegium.llm.common import materialise
from collegium.llm.lines import blocks
from tests.llm.test_line_dedup import frame
from tests.llm.test_line_lengths import likely_expected, near


def held(lines, key=1):
    block = next(blocks(["\n".join(" ".join(x) for x in lines).encode()]))
    n = len(lines)
    columns = {"key": [key] * n, "turn": range(n), "words": block.words.astype(np.int32), "early": [True] * n, "open": [True] * n}
    return pa.table({**{k: list(v) for k, v in columns.items()}, "sketch": [x.tobytes() for x in block.sketches()]})


def group(rng, n, edits, words=40):
    base = [f"b{k}" for k in range(words)]
    out = []
    for i in range(n):
        line = list(base)
        for at in rng.sample(range(words), edits):
            line[at] = f"x{i}_{at}"
        out.append(line)
    return out


def test_lines_of_a_key_that_are_not_near_make_no_rows():
    # Of 300 lines of one key that are 10 edits from their base, some 20 from each other: 44,850 pairs.
    lines = group(random.Random(1), 300, 10)
    assert line_dedup._every(5)(held(lines)).num_rows < 450
    assert line_dedup._few(5)(held(lines)).num_rows <= 300


def test_all_that_may_be_near_are_rows():
    rng = random.Random(2)
    lines = group(rng, 30, 3) + group(rng, 30, 10)
    found = line_dedup._every(5)(held(lines))
    pairs = set(zip(found["turn"].to_pylist(), found["other_turn"].to_pylist()))
    encoded = [[w.encode() for w in x] for x in lines]
    expected = {(i, j) for i in range(60) for j in range(i) if line_dedup.near_lines(encoded[i], encoded[j])}
    assert expected <= pairs and len(expected) > 400
    few = line_dedup._few(5)(held(lines))
    assert few["turn"].to_pylist()[:29] == list(range(1, 30)) and max(few["turn"].value_counts().field(1).to_pylist()) == 1


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    lines = group(rng, 40, 3) + group(rng, 40, 5, 30) + group(rng, 40, 2, 9)
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(x) for x in lines[at : at + 2])) for i, at in enumerate(range(0, len(lines), 2))]
    assert near(frame(spark, rows)) == likely_expected(rows)


def test_shuffle_files_go_with_the_step(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())}
    before = files()
    found = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not [f for f in files() - before if f.startswith("shuffle_")]
    assert found.count() == 7
