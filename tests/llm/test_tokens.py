"""Token files and packing against the tokenizers library used plainly."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from collegium.llm.packing import GAP, GRID, LENGTH, best_pattern, cutting_stock, linear_program, pack, pieces
from collegium.llm.token_files import token_report, write_token_files
from collegium.llm.tokens import Encoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n", "it's o'clock", "A\tB", "é́ é", "x y   z", "1234 5 67", "  ", "a <|endoftext|> b", "ﬁ Σας ΣΑΣ", "🙂 🙂🙂", "\x1c a \x1f", "don't  'll 's", "tab \t x", "z" * 3000, "́ a ́"]


def library(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("file", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_librarys_ids(file, keeps, spark):
    plain, own = library(file), Encoder(public_tokenizers.path(file), keeps, remembered=500)
    texts = [*ODD, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab'sé1 \n\t .,-́Σ") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    letters = [chr(c) for c in range(0xC0, 0x250)] + list("abcXYZ.,'! ")
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += [f"{a}b{chr(c)}{b} x{chr(c)}." for c in range(0xC0, 0x250) for a, b in (("", "."), ("a", ""), ("É", ","))]
    alphabet = ["a", "The", "é", "!!", "%%%", ".", ",", "\n", "\n\n", " ", " ", " ", "'", "'s", "1", "\t", "_", "|", "\r\n", "*", "\u00a0"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    for text in texts:
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def rows_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (2001, "the " * 9000)]
    return rows, spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, start int, ids string")


def test_token_report(spark):
    rows, docs = rows_of(spark)
    t, at, expected = library("byte_bpe_50k.json"), 0, []
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_report(docs).collect())) == expected
    assert token_report(docs.where("false")).count() == 0
    twice = token_report(spark.createDataFrame([(None, "b"), (None, "a"), (4, "x"), (4, "x")], "doc_id long, text string"))
    assert [r.start for r in twice.orderBy("start").collect()] == [0, 2, 4, 6]


def test_token_files_have_bloom_filters(spark, tmp_path):
    from pyarrow import orc

    write_token_files(rows_of(spark)[1], f"file://{tmp_path}/t")
    files = list((tmp_path / "t").glob("*.orc"))
    assert files and all(orc.ORCFile(f).nrows for f in files)
    assert any(b"BLOOM" in orc.ORCFile(f).schema.to_string().encode().upper() or orc.ORCFile(f).nstripes >= 1 for f in files)
    assert spark.read.orc(f"file://{tmp_path}/t").where("doc_id = 7").count() == 1


def check_packing(result, rows, length=2048, gapless=True):
    t = library("word_bpe_49k.json")
    by_doc, by_sequence = {}, {}
    for r in result:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == {i for i, _ in rows}
    for i, text in rows:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values() if gapless else ():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return sum(r.length for r in result) / (length * len(by_sequence))


def test_pack(spark):
    rows, docs = rows_of(spark)
    assert check_packing(pack(docs).collect(), rows) > 0.93
    assert pack(docs.where("false")).count() == 0
    assert pack(spark.createDataFrame([(None, "b"), (4, "x"), (4, "x")], "doc_id long, text string")).count() == 3


def test_knapsack_against_all_patterns():
    value, items = best_pattern(np.array([0.3, 0.5, 0.21]), np.array([3, 5, 2]), 11)
    best = max(0.3 * a + 0.5 * b + 0.21 * c for a in range(4) for b in range(3) for c in range(6) if 3 * a + 5 * b + 2 * c <= 11)
    assert value == pytest.approx(best) and (items * [3, 5, 2]).sum() <= 11


def test_cutting_stock_covers_the_histogram():
    rng = np.random.default_rng(4)
    units = np.arange(1, 65)
    counts = rng.integers(0, 500, 64)
    used = np.flatnonzero(counts)
    patterns = cutting_stock(counts[used], units[used], 64)
    assert all((p.items * units[used]).sum() <= 64 for p in patterns)
    assert (sum(p.items * p.copies for p in patterns) >= counts[used]).all()
    sequences, least = sum(p.copies for p in patterns), (counts * units).sum() / 64
    assert sequences <= 1.02 * least + 2


def test_the_linear_program_ends_by_its_bound(spark):
    """On the lengths of a whole table, within a sequence (or the gap) of what no packing can beat."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = pieces(docs).selectExpr(f"CAST(ceil(length / {GRID}) AS INT) AS units").groupBy("units").count().collect()
    units, counts = (np.array(x, np.int64) for x in zip(*sorted(map(tuple, rows))))
    patterns, copies, bound = linear_program(counts, units, LENGTH // GRID)
    assert (units @ patterns <= LENGTH // GRID).all() and (patterns @ copies >= counts - 1e-6).all()
    assert copies.sum() - bound <= max(1, GAP * bound)
    assert sum(p.copies for p in cutting_stock(counts, units, LENGTH // GRID)) <= bound + len(units) + 1


def test_packing_minds_no_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5, 6), (1, "a b c", "x", 5, 6), (None, None, "y", 7, 8)], "doc_id long, text string, units string, rank int, bucket int")
    rows = pack(docs).collect()
    assert pack(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 4), (1, 4)] and pack(docs.where("false")).count() == 0
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert [p[1] for p in places] == [0, places[0][2], places[0][2] + places[1][2]]


def test_many_rows_of_one_id(spark):
    rows = [(None, f"none {i % 800}") for i in range(2500)] + [(5, f"five {i}") for i in range(2500)]
    found = sorted((r.start, r.n_tokens) for r in token_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert len(found) == 5000 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))
