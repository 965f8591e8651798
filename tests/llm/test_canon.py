import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from finstrata.llm import canon


@pytest.mark.parametrize(("a", "b"), [
    ("EBITDA за II квартал", "ЕВIТDА за II квартал"), ("й", "й"), ("１２３，４％", "123,4%"), ("при​быль ­роста", "прибыль роста"), ("1 234 5", "1 234 5"),
    ("рοст", "рост"), ("write‑down", "write-down"), ("a  b", "a b"), ("a\r\nb", "a\nb"), ("Ｉ", "I"), ("ﬁ", "fi"), ("‎х", "х"), ("x\ty", "x y"), ("и‍̆", "й"),
    ("ТMK рост", "ТМК рост"), ("ОСА", "OCA"), ("﻿", ""),
])
def test_same_looks(a, b):
    assert canon.canonical(a) == canon.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("м²", "м2"), ("ё", "е"), ("A", "a"), ("a\nb", "a b"), ("—", "-"), ("O", "0"), ("к", "k"), ("½", "1/2"), ("№", "No"), ("1", "l"), ("“", '"')])
def test_different_looks(a, b):
    assert canon.canonical(a) != canon.canonical(b)


def test_stable_and_idempotent():
    rng = random.Random(4)
    alphabet = "abcАВСопекй̆́ 　１Ａﾞ ​­\n\r\t‑ºⅣﬁΟοßİ가각ᄀ"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 15)))
        c = canon.canonical(t)
        assert canon.canonical(c) == c and unicodedata.is_normalized("NFC", c), repr(t)
    assert canon.canonical("Обычный текст, без правок: 12 %") == "Обычный текст, без правок: 12 %"
    assert canon.canonical(None) is None and canon.canonical("") == ""


def chunks(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "chunk_key long, text string, look string, form string")


def test_pairs_against_brute_force(spark):
    base = "одна две три четыре пять шесть семь восемь"
    rows = [(1, base), (2, base.replace("о", "o")), (3, base), (4, base.upper()), (5, "одна две"), (6, "oдна две"), (7, None), (8, ""), (2, base.replace("о", "o")), (9, base + " "), (10, base.replace(" ", "\n"))]
    got = sorted(tuple(r) for r in canon.look_alike_pairs(chunks(spark, rows)).collect())
    texts = {k: t for k, t in rows if t}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] != texts[b] and len(texts[a].split()) >= 8 and canon.canonical(texts[a]) == canon.canonical(texts[b]))
    assert got == want and (1, 2) in got and (1, 3) not in got
    classes = {r.chunk_key: r for r in canon.look_alike_rows(chunks(spark, rows)).collect()}
    assert set(classes) == {k for p in want for k in p} and all(r.n_partners == sum(k in p for p in want) for k, r in classes.items())
    assert len({r.class_id for r in classes.values()}) == 1 and {r.n_forms for r in classes.values()} == {len({texts[k] for k in classes})}
    assert canon.look_alike_pairs(chunks(spark, [])).count() == 0


def test_columns_and_spans(spark):
    df = spark.createDataFrame([(1, "рοст", [("рοст", "m", 0, 4), None, (None, "u", 1, 2)]), (2, None, None)], "chunk_key int, text string, spans array<struct<text:string,label:string,start_pos:int,end_pos:int>>")
    got = {r.chunk_key: r for r in canon.canonicalize_spans(canon.canonicalize(df)).collect()}
    assert got[1].canonical_text == "рост" and [s and s.text for s in got[1].canonical_spans] == ["рост", None, None] and got[2].canonical_spans is None
    assert df.select(canon.canonical_column(F.col("text"))).count() == 2
