"""The registered queries on texts that hold special tokens' strings, against the tokenizers library as it comes."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from collegium.llm.queries import QUERIES
from collegium.llm.tokens import Encoder

TEXTS = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y  z\n", "a <|ENDOFTEXT|> b", "plain text", "<|endoftext|><|endoftext|>", "  <|startoftext|> It's", "a <|endoftext |> b"]


def library(file):
    return Tokenizer.from_file(public_tokenizers.path(file))


def plain(t, text, *end):
    return [*t.encode(text, add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("file", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(file, keeps):
    t, own = library(file), Encoder(public_tokenizers.path(file), keeps, special=True)
    for text in TEXTS:
        assert own.encode(text) == np.array(plain(t, text), "<u4").tobytes(), text


def test_queries(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    t, at, expected = library("byte_bpe_50k.json"), 0, []
    for i, text in enumerate(TEXTS):
        ids = plain(t, text, 2)
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op8_token_files"](spark, str(tmp_path)).collect())) == expected
    t = library("word_bpe_49k.json")
    expected = [(i, len(ids), crc(ids)) for i, text in enumerate(TEXTS) for ids in [plain(t, text, 1)]]
    for packed in (QUERIES["op7_packing"](spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, "")):
        assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in packed.collect()) == expected
