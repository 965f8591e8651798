import random

import pytest
from pyspark.sql import functions as F

from finstrata.operators import chunk, lemma, noise
from finstrata.plans.pipeline import preprocess

SCHEMA = "doc_id string, section_idx int, page int, block_type string, text string, cell_rows array<array<string>>, y_top double, y_bottom double, n string"


def sections(spark, rows):
    return spark.createDataFrame([("d", i, r[0], r[1], r[2], r[3] if len(r) > 3 else [], *(r[4] if len(r) > 4 else (None, None)), "extra") for i, r in enumerate(rows)], SCHEMA)


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "section_idx").collect()]


def test_headers_patterns_geometry(spark):
    s = sections(spark, [(1, "header", "Шапка"), (1, "paragraph", "Выручка компании"), (1, "footer", "Страница 1"), (1, None, None)])
    assert texts(noise.remove_noise(s)) == ["Выручка компании", None]
    s = sections(spark, [(1, "paragraph", "Подробности на стр. 5"), (1, "paragraph", "ОГРН 1027700132195"), (1, "paragraph", "выручка составила 12 млн")])
    assert texts(noise.drop_patterns(s)) == ["выручка составила 12 млн"]
    assert texts(noise.drop_patterns(s, ("ВЫРУЧКА",))) == ["Подробности на стр. 5", "ОГРН 1027700132195"]
    s = sections(spark, [(1, "paragraph", "а", [], (0.01, 0.04)), (1, "paragraph", "б", [], (0.2, 0.8)), (1, "paragraph", "в", [], (0.96, 0.99)), (1, "paragraph", "г", [], (0.01, None))])
    assert texts(noise.drop_by_geometry(s)) == ["б", "г"]


def test_repeats(spark):
    s = sections(spark, [(1, "paragraph", "Повтор"), (2, "paragraph", "Повтор"), (1, "paragraph", "Одна"), (1, "title", "Т"), (2, "title", "Т")])
    assert texts(noise.drop_repeating(s)) == ["Одна", "Т", "Т"]
    many = sections(spark, [(p, "paragraph", "x") for p in (1, 2, 3, 4, 5, 6, 7)] + [(10, "paragraph", "y")])
    assert len(texts(noise.drop_repeating(many))) == 1
    assert texts(noise.drop_repeating(sections(spark, []))) == []


def test_titles_anchor(spark):
    s = sections(spark, [(3, "title", "Выручка"), (1, "paragraph", "а б"), (1, "title", "Расходы"), (1, "paragraph", "в"), (1, "paragraph", "  "), (1, "paragraph", None)])
    got = [tuple(r) for r in chunk.chunk_sections(s).orderBy("chunk_id").select("chunk_id", "text", "section_anchor", "page").collect()]
    assert got == [(1, "Выручка\nа б", "Выручка", 3), (2, "Расходы\nв", "Расходы", 1)]
    assert chunk.chunk_sections(sections(spark, [(5, "paragraph", "без титула")])).first().asDict() == {"doc_id": "d", "chunk_id": 1, "text": "без титула", "section_anchor": None, "page": 1}


def test_slices_and_packing_against_a_plain_loop(spark):
    rng = random.Random(5)
    for ratio, most in ((0.05, 10), (0.3, 10), (0.5, 4)):
        rows = [(1, rng.choice(["title", "paragraph", "paragraph"]), " ".join(f"w{i}" for i in range(rng.choice([1, 3, 9, 10, 11, 25, 45])))) for _ in range(25)]
        o = chunk.overlap_words(most, ratio)
        want, buffer, n, anchor = [], [], 0, None

        def flush():
            if buffer:
                want.append(("\n".join(buffer), anchor))  # noqa: B023
            buffer.clear()

        for _, kind, t in rows:
            ws = t.split()
            if kind == "title":
                flush()
                n, anchor = 0, t
            step = most - o
            parts = [t] if len(ws) <= most else [" ".join(ws[max(0, i - min(o, step)) : i + step]) for i in range(0, len(ws), step)]
            for p in parts:
                k = len(p.split())
                if buffer and n + k > most:
                    flush()
                    n = 0
                buffer.append(p)
                n += k
        flush()
        got = chunk.chunk_sections(sections(spark, rows), most, ratio).orderBy("chunk_id").collect()
        assert [(r.text, r.section_anchor) for r in got] == want
    with pytest.raises(ValueError):
        chunk.slices(F.lit("a"), 1, 1)


def test_pipeline_document(spark):
    s = sections(spark, [
        (1, "header", "Шапка отчёта"), (1, "title", "Годовой отчёт"), (1, "paragraph", "Выручка составила 1 234 567,89 руб."),
        (1, "table", "", [["Показатель", "Значение"], ["Выручка", "45 678"]]), (1, "footer", "Страница 1"),
    ])
    (r,) = preprocess(s).collect()
    assert "1234567.89" in r.text and "45678" in r.text and "Шапка" not in r.text and r.section_anchor == "Годовой отчет" and r.tokens[0].lemma == "годовой"


def test_lemmas_and_words(spark):
    df = spark.createDataFrame([("Выручки и  долгов",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(lemma.tokens(F.col("text"), True)).collect()]
    assert [t.lemma for t in got[0]] == ["выручка", "и", "долг"] and got[1] == [] and got[2] is None
    assert [tuple(w) for w in df.select(lemma.word_spans(F.col("text"))).first()[0]] == [("Выручки", 0, 7), ("и", 8, 9), ("долгов", 11, 17)]
    assert chunk.document_texts(sections(spark, [(1, "title", "а"), (1, "paragraph", ""), (1, "paragraph", "б")])).first().normalized_text == "а\nб"
