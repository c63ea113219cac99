"""SimHash against a brute-force version that shares no code with it."""

import random

import numpy as np
import xxhash

from collegium.llm.simhash import BITS, Ball, fingerprint_links, near_dedup, prefix_bits, spanning


def plain_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in raw + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=4):
    """{fingerprint: set of reachable fingerprints} by comparing all."""
    left, found = set(nodes), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= radius}
            left -= near
            todo += near
        for a in group:
            found[a] = group
    return found


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = plain_components({p for _, p in prints})
    least = {p: min((i for i, q in prints if q in group[p] and i is not None), default=None) for _, p in prints}
    return sorted(((i, f"{p:016x}", least[p]) for i, p in prints), key=str)


def test_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup(docs).collect()), key=str) == expected(rows)


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e"), (5, "A B C D E"), (5, "A B C D E"), (7, "one"), (8, "One"), (9, "é x" * 3), (10, "w " * 5000)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fp string, component_id int")
    assert sorted(map(tuple, near_dedup(docs).collect()), key=str) == expected(rows)
    assert near_dedup(docs.where("false")).count() == 0


def test_links_lose_nothing(spark):
    """Clusters of fingerprints at 1 to 5 bits, chains among them, against all pairs."""
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(at)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    group = {p: {p} for p in prints}
    for e in edges:
        a, b = (x % (1 << 64) for x in (e.u, e.v))
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    assert group == plain_components(prints)


def test_large_key_is_split(monkeypatch):
    rng = random.Random(2)
    at = rng.getrandbits(60)
    fps = np.array(sorted({at ^ sum(1 << b for b in rng.sample(range(60), 3)) for _ in range(200)}), np.uint64)
    ball = Ball(4)
    whole = ball.links(fps, np.full(len(fps), 2, np.int8), fps)
    monkeypatch.setattr("collegium.llm.simhash.VARIANTS", 1 << 12)
    parts = ball.links(fps, np.full(len(fps), 2, np.int8), fps)
    assert {tuple(x) for x in spanning(np.concatenate(whole))} == {tuple(x) for x in spanning(np.concatenate(parts))}


def test_prefix_bits_follow_the_table():
    assert prefix_bits(0) == 4 and prefix_bits(10**6) > prefix_bits(10**4) and prefix_bits(10**14) == 30 and BITS == 64
