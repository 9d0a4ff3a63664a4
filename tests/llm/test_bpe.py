from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from logharbor.llm import bpe

DIR = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                       T.StructField("decoded", T.MapType(T.StringType(), T.StringType())), T.StructField("n_tokens", T.DoubleType())])


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts_round_trip(spark, ranks, known):
    rnd = random.Random(2)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "a", "'s", "12", "é", "中文", "😀", "\x00", "\x1c", "▁", "﻿", "<|endoftext|>", "...", "Ġ", "ā"]
    texts = [None, "", " ", "ab" * 60_000, "word " * 250_000] + ["".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(600)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(200)]
    rows = spark.createDataFrame([(i if i % 9 else None, t, "x", {"a": "b"}, 1.5) for i, t in enumerate(texts)], SCHEMA)
    encoded = bpe.encode_texts(rows, ranks, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "decoded", "n_tokens", "ids"]
    for r in bpe.decode_ids(encoded, ranks).collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == 1.5
        if len(r.text or "") < 10**5:
            assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(r.text or "")
    assert bpe.decode_ids(bpe.encode_texts(rows.limit(0), ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_bounds_change_nothing(ranks, known, monkeypatch):
    texts = ["one two three two one " * 30, "x" * 300 + " y" * 90, "", None, "tail"]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 4)
    monkeypatch.setattr(bpe, "HELD", 7)
    encoder = bpe._Encoder(bpe.piece_model(ranks), ranks, public_tokenizers.PATTERN)
    got = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [known.encode_ordinary(t or "") for t in texts]


def test_gaps_in_ranks_and_other_vocabularies():
    few = {bytes([b]): 3 * b + 1 for b in range(256)} | {b"ab": 2000, b"abc": 2004, b"bc": 1999}
    other = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=few, special_tokens={})
    encoder = bpe._Encoder(bpe.piece_model(few), few, public_tokenizers.PATTERN)
    texts = ["abc", "abcd", "xabcabc", "bcabc ab"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [other.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError, match="no token"):
        import base64
        import tempfile
        with tempfile.NamedTemporaryFile() as f:
            f.write(base64.b64encode(b"a") + b" 0\n")
            f.flush()
            bpe.read_ranks(f.name)


def test_query_against_the_public_library(spark, known):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = bpe.op12_byte_bpe(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
