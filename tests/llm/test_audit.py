"""The audit of filters against every order played through in plain Python."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from collegium.llm.audit import block_hashes, filter_audit

SCHEMA = "doc_id long, text string, source string, n string, mask string, blocks string, part string, good string"
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(doc_id, text: str, rows: list[tuple]) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
        out.add("E")
    return out


def plain(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    marked = [(s or "", fails(i, t or "", rows), any(d == i and i is not None and q == 1 for d, q, _ in labels), any(d == i and i is not None and x == 1 for d, _, x in labels)) for i, t, s in rows]
    out = []
    for part in {s or "" for _, _, s in rows}:
        own = [m for m in marked if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                shapley[letter] += len(gone)
                redundant = sum(letter in m[1] and bool(m[1] & set(order[: step - 1])) for m in own)
                lines.append((part, "".join(order), step, len(left), len(gone), redundant, sum(m[1] == {letter} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone), letter))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def found(spark, rows: list[tuple], labels: list[tuple], **options) -> list[tuple]:
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)  # clashing names
    out = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)
    assert out.columns == NAMES
    return sorted(tuple(r) for r in out.collect())


def text(pick: random.Random, words: int) -> str:
    out = " ".join(f"w{pick.randrange(200)}" for _ in range(words))
    out = out.upper() if pick.random() < 0.2 else out
    return out + (" 5%" if pick.random() < 0.3 else "")


def table(pick: random.Random) -> tuple[list[tuple], list[tuple]]:
    texts = [text(pick, pick.choice([3, 49, 50, 60, 400])) for _ in range(25)]
    texts += ["é" * 300, "é" * 300 + "x", "same start " * 500 + "a", "same start " * 500 + "b", "x" * 70_000 + "y", "x" * 70_000 + "z", "x" * 70_000 + "z", "", None, "\xa0".join(["word"] * 60)]
    rows = [(i, pick.choice(texts), pick.choice(["one", "two", "", None])) for i in range(90)]
    rows += [(i, "hot text of many rows", "one") for i in range(200, 240)] + [(7, "twice", "two"), (7, "twice", "two"), (None, "twice", "one"), (None, texts[0], None)]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    return rows, labels


def test_every_order_by_hand(spark):
    rows, labels = table(random.Random(11))
    assert found(spark, rows, labels) == plain(rows, labels)


@pytest.mark.parametrize("bits", [1, 3])
def test_texts_that_share_a_class_are_told_apart(spark, bits):
    """Hashes of one or three bits put different texts into one class, which whole texts show."""
    rows, labels = table(random.Random(12))
    rows = rows[:60] + [(500 + i, f"text {i % 6}", "one") for i in range(12)]
    assert found(spark, rows, labels, bits=bits) == plain(rows, labels)


def test_no_rows_and_no_labels(spark):
    assert found(spark, [], []) == []
    rows = [(1, None, None)]
    assert found(spark, rows, []) == plain(rows, [])


def test_blocks_cover_whole_texts():
    raw = bytes(range(256)) * 300
    assert len(block_hashes(raw)) == 4 and block_hashes(b"") == []
    for at in (0, 255, 256, 4095, 4096, 65_535, 65_536, len(raw) - 1):
        changed = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
        assert block_hashes(changed) != block_hashes(raw)
