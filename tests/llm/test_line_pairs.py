"""Line dedup's pairs: sketches part long lines that are not near, packed keys lose none that may be."""

import random

import numpy as np
import pyarrow as pa

from collegium.llm import line_dedup
from collegium.llm.lines import blocks


def alike(a, b):
    """Whether the sketches of two lines let them be near, by the step that makes pairs."""
    block = next(blocks(["\n".join(" ".join(x) for x in (a, b)).encode()]))
    sketch = [x.tobytes() for x in block.sketches()]
    columns = {"turn": [1], "other_turn": [0], "words": [len(b)], "other_words": [len(a)], "sketch": [sketch[1]], "other_sketch": [sketch[0]]}
    return sum(x.num_rows for x in line_dedup._alike(5)(iter([pa.RecordBatch.from_pydict(columns)])))


def test_long_lines_that_are_not_near_make_no_pair():
    rng, words = random.Random(3), [f"w{k}" for k in range(5000)]
    line = lambda n: [x for _ in range(n // 2) for x in (rng.choice(words), "|")]
    assert sum(alike(line(120), line(120)) for _ in range(200)) == 0
    for n in (8, 60, 120, 400):
        a = line(n)
        b = list(a)
        for at in rng.sample(range(n), n // 5):
            b[at] = rng.choice(words)
        assert alike(a, b) and line_dedup.near_lines([x.encode() for x in a], [x.encode() for x in b])


def test_packed_keys_come_back():
    rng = np.random.default_rng(4)
    key, tag = rng.integers(0, 1 << 40, 5000).astype(np.uint64), rng.integers(0, 1 << 48, 5000)
    words = rng.integers(5, 90_000, 5000)
    batch = line_dedup.packed(key, tag, words, 7)
    assert batch.column("part").to_pylist() == list(range(7))
    found = list(zip(*line_dedup.unpacked(batch.column("keys").to_pylist())))
    assert sorted(found) == sorted(zip(key.tolist(), tag.tolist(), np.minimum(words, 65535).tolist()))


def test_met_keeps_what_fits_a_neighbour():
    # Key 1: 10 and 12 words may be near, 20 is alone; key 2: one tag twice; key 3: 7 and 9 words can't be near.
    rows = [(1, 5, 10), (1, 6, 12), (1, 7, 20), (2, 8, 9), (2, 8, 9), (3, 9, 7), (3, 10, 9)]
    key, tag, words = (np.array(x) for x in zip(*rows))
    batch = line_dedup.packed(key.astype(np.uint64), tag, words, 1)
    found = line_dedup._met(5)(pa.Table.from_batches([batch]))
    assert sorted(zip(found["key"].to_pylist(), found["tag"].to_pylist())) == [(1, 5), (1, 6)]
