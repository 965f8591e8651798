import random

import pytest
from pyspark.sql import functions as F

from finstrata.llm import tokenize as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    path = T.vocabulary(request.param)
    return T.encoder(path), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(path), special_tokens={})


def test_against_reference_encoder(both):
    ours, theirs = both
    rng = random.Random(8)
    pools = ["abcdefgh ijkl mnop'sdtll", "абвгдежзий клмн", " \n\t  ", "0123456789.,-", "😀é́ðÐ中文ﬁ<|endoftext|>﻿​"]
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 50)))
        assert ours.encode(t) == theirs.encode_ordinary(t), repr(t)
    for t in ("a" * 3000, "ab" * 2000, "ы" * 999, "<|endoftext|>", " " * 300):
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_memo_limits_change_nothing(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(T, "MEMO_WORDS", 5)
    monkeypatch.setattr(T, "STATES", 20)
    t = "Выручка составила 12 млн руб., прибыль выросла and revenue fell sharply"
    assert ours.encode(t * 3) == theirs.encode_ordinary(t * 3)


def test_frame_and_decoding(spark):
    texts = ["Выручка 5 млн", "", None, "😀 end", "a" * 20000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    out = T.encode_texts(df, ["doc_id"])
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[1] == [] and got[2] == [] and out.columns == ["doc_id", "ids"]
    back = {r.doc_id: r.t for r in out.select("doc_id", T.decode_column(F.col("ids")).alias("t")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert T.encode_texts(df.limit(0), ["doc_id"]).count() == 0
    d = T.StreamDecoder(T.vocabulary())
    assert "".join(d.feed([i]) for i in got[3]) + d.close() == "😀 end"
    d.feed(got[3][:1])
    assert d.close() == "�"
