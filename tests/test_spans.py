import pytest
from pyspark.sql import functions as F

from finstrata.operators import bioes, encode, resolve, spans
from finstrata.operators.lemma import word_spans

SPANS = "array<struct<text:string,label:string,start_pos:int,end_pos:int>>"


def annotated(spark, text):
    return [tuple(s) for s in spans.annotate(spark.createDataFrame([(text,)], "text string")).first().spans]


def test_annotation(spark):
    got = annotated(spark, "По итогам 2023 года выручка составила 1 234 567 тыс. руб.")
    assert [s[:2] for s in got] == [("2023 года", "period"), ("выручка", "metric"), ("1 234 567", "amount"), ("тыс.", "unit"), ("руб.", "currency")]
    assert annotated(spark, "чистая прибыль компании составила 100 руб.")[0] == ("чистая прибыль", "metric", 0, 14)
    assert [s[0] for s in annotated(spark, "EBITDA 12 500,00 млн руб.")] == ["EBITDA", "12 500,00", "млн", "руб."]
    got = annotated(spark, "За 2023 год выручка 1 234 567 руб., рентабельность продаж 12,5 %.")
    assert got == sorted(got, key=lambda s: (s[2], s[3] - s[2])) and all(a[3] <= b[2] for a, b in zip(got, got[1:], strict=False))
    assert [s[0] for s in annotated(spark, "валовая прибыль от продаж")] == ["прибыль от продаж"]
    assert annotated(spark, "сверхприбыль единый трубы")[0][:2] == ("ед", "unit")


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None, "x"), ("", "y")], "text string, spans string")
    assert [r.spans for r in spans.annotate(df).orderBy("text").collect()] == [None, []]


def test_column_patterns_agree_with_annotation_patterns(spark):
    text = "С 31.12.2023 по 2022—2023, 9 месяцев и IV квартал 2023 года: -5 тыс. руб. и 7,5 % долларов"
    for label in ("amount", "currency", "unit", "period"):
        df = spark.createDataFrame([(1, text)], "id int, text string")
        got = sorted((r.start_pos, r.end_pos) for r in spans.pattern_spans(df, ["id"], label).collect())
        want = sorted(m.span() for name, p in spans._COMPILED if name == label for m in p.finditer(text))
        assert got == want


def labels_of(spark, text, rows):
    df = spark.createDataFrame([(text, rows)], f"text string, spans {SPANS}")
    return df.select(bioes.bioes_labels(word_spans(F.col("text")), F.col("spans"))).first()[0]


def test_bioes(spark):
    text = "чистая прибыль 1 234 567 руб."
    rows = [("чистая прибыль", "metric", 0, 14), ("1 234 567", "amount", 15, 24), ("руб.", "currency", 25, 29)]
    labels = labels_of(spark, text, rows)
    assert labels == ["B-metric", "E-metric", "B-amount", "I-amount", "E-amount", "S-currency"]
    assert [(a, b, k) for a, b, k in bioes.spans_of_labels(labels)] == [(0, 2, "metric"), (2, 5, "amount"), (5, 6, "currency")]
    assert labels_of(spark, "а б", [("а б", "metric", 0, 3), ("б", "unit", 2, 3), None]) == ["B-metric", "S-unit"]
    assert labels_of(spark, "а", None) == ["O"] and labels_of(spark, "", []) == []


@pytest.mark.parametrize(("labels", "strict", "predicted"), [
    (["E-a", "O"], [(0, 1, "a")], [(0, 1, "a")]),
    (["S-a", "I-a", "E-a"], [(0, 3, "a")], [(0, 1, "a"), (1, 3, "a")]),
    (["B-a", "I-b", "O"], [(0, 1, "a"), (1, 2, "b")], [(0, 2, "a")]),
    (["B-a", "E-b"], [(0, 2, "a")], [(0, 2, "a")]),
    (["S-a", "S-a"], [(0, 1, "a"), (1, 2, "a")], [(0, 1, "a"), (1, 2, "a")]),
    ([], [], []),
])
def test_decoders(labels, strict, predicted):
    assert bioes.spans_of_labels(labels) == strict
    assert bioes.spans_of_predictions(labels) == predicted


def test_decoding_frames(spark):
    df = spark.createDataFrame([(1, [("а", 0, 1), ("бв", 3, 5)], ["B-x", "E-x"], [0.5, 0.25]), (2, None, None, None)], "id int, words array<struct<text:string,start_pos:int,end_pos:int>>, labels array<string>, probs array<double>")
    got = {r.id: [tuple(s) for s in r.spans] for r in bioes.decode_bioes(df, ["id"]).collect()}
    assert got == {1: [("а бв", "x", 0, 5)], 2: []}
    got = {r.id: [tuple(s) for s in r.spans] for r in bioes.decode_predictions(df, ["id"]).collect()}
    assert got == {1: [("а бв", "x", 0.5)], 2: []}


def test_slots(spark):
    df = spark.createDataFrame([(1, "себестоимость 100 руб. выручка 1 234 567 руб."), (2, "Значение выручка: нет данных."), (3, None), (4, "")], "id int, text string")
    got = [(r.id, r.metric, r.value, r.period) for r in resolve.resolve_slots(spans.annotate(df), ["id"]).orderBy("id", "anchor_idx").collect()]
    assert got == [(1, "себестоимость", "100", None), (1, "выручка", "1 234 567", None), (2, "выручка", None, None)]
    full = spark.createDataFrame([(1, "По итогам 2023 год выручка 1 234 567 тыс. руб.")], "id int, text string")
    r = resolve.resolve_slots(spans.annotate(full), ["id"]).first()
    assert (r.period, r.value, r.unit, r.currency, r.context) == ("2023 год", "1 234 567", "тыс.", "руб.", full.first().text)


def test_ids_and_encoding(spark):
    df = spark.createDataFrame([("S-metric", "high", 2), ("I-x", None, 9), (None, "x", None)], "l string, r string, n int")
    got = [tuple(x) for x in df.select(bioes.label_id(F.col("l")), bioes.continuation_label(F.col("l")), bioes.risk_id(F.col("r")), bioes.id_risk(F.col("n"))).collect()]
    assert got == [(4, "I-metric", 2, "high"), (None, "I-x", None, None), (None, None, None, None)]
    vocab = {p: i for i, p in enumerate("[PAD] [UNK] [CLS] [SEP] [MASK] вы ##руч ##ка чис ##тая при ##быль 0 1 2 3 4 5 6 7 8 9".split())}
    df = spark.createDataFrame([(1, "прибыль 5", [("прибыль", "metric", 0, 7), ("5", "amount", 8, 9)]), (2, None, None)], f"id int, text string, spans {SPANS}")
    got = {r.id: r for r in encode.ner_examples(df, ["id"], vocab, 16).collect()}
    names = {4: "S-metric", 2: "I-metric", 8: "S-amount", -100: None}
    assert [names[x] for x in got[1].labels[:6]] == [None, "S-metric", "I-metric", "S-amount", None, None] and len(got[1].input_ids) == 16
    assert got[2].attention_mask[:3] == [1, 1, 0]
