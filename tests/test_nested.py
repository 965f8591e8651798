import json

from finstrata.operators.nested import flatten_records

SPAN = {"text": "а", "label": "metric", "start": 0, "end": 1}


def lines(spark, values):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "line_id long, raw_line string, source string")


def test_forms_and_positions(spark):
    values = [
        json.dumps({"source": "s", "risk": None, "chunks": [{"chunk_id": 0, "text": "т", "spans": [None, SPAN, SPAN]}, None, {"chunk_id": "1", "spans": SPAN}]}),
        json.dumps({"chunks": json.dumps([{"spans": json.dumps([SPAN])}])}), json.dumps({"record": {"chunks": {"spans": [dict(reversed(SPAN.items())) | {"start": "0"}]}}}),
        "", "  ", None, '{"chunks": [', '{"chunks": []} x', '{"chunks": []}}', "[1]", "{}", '{"chunks": "plain"}', '{"chunks": [{"spans": null}, {"spans": "x"}, {"spans": [1, "y"]}]}',
    ]
    t = flatten_records(lines(spark, values))
    got = sorted((r.line_id, r.chunk_pos, r.span_pos) for r in t.span_bridge.collect())
    assert got == [(0, 0, 1), (0, 0, 2), (0, 2, 0), (1, 0, 0), (2, 0, 0)]
    assert t.span_objects.count() == 1  # one identity whatever the form and key order
    assert sorted(r.line_id for r in t.records.collect()) == [0, 1, 2, 10, 11, 12]
    assert t.chunk_bridge.where("line_id = 0").count() == 2


def test_attributes_redelivery_and_empty(spark):
    span = SPAN | {"attrs": {"confidence": 0.5, "links": [{"kind": "k", "to": 3}, {"kind": "z", "to": 1}]}}
    value = json.dumps({"source": "s", "meta": {"annotators": [{"code": "c", "seconds": 4}], "round": 1}, "chunks": [{"text": "т", "spans": [span]}]})
    df = lines(spark, [value])
    t = flatten_records(df.union(df))
    assert [(r.link_pos, r.kind, r.to) for r in t.link_bridge.join(t.link_objects, "link_node").orderBy("link_pos").collect()] == [(0, "k", 3), (1, "z", 1)]
    assert [(r.code, r.seconds) for r in t.annotator_bridge.join(t.annotator_objects, "annotator_node").collect()] == [("c", 4)]
    assert json.loads(t.attrs_objects.join(t.span_objects, "attrs_node").first().attrs) == span["attrs"] and json.loads(t.meta_objects.join(t.records, "meta_node").first().meta)["round"] == 1
    assert t.records.count() == t.span_bridge.count() == 1
    joined = t.span_bridge.join(t.span_objects, "span_node").join(t.chunk_bridge.select("line_id", "chunk_pos", "chunk_node"), ["line_id", "chunk_pos", "chunk_node"])
    assert joined.first().text == "а"
    assert flatten_records(lines(spark, [])).span_bridge.count() == 0


def test_unknown_fields_and_identities(spark):
    """Objects that differ in fields without a column differ in identity and lose nothing; equal ones are stored once."""
    link = {"kind": "k", "to": 3}
    spans = [SPAN | {"note": "n1"}, SPAN | {"note": "n2"}, SPAN | {"start": "x"}, SPAN | {"attrs": {"links": [link, link | {"w": 1}]}}, SPAN | {"attrs": {"links": [link]}}]
    values = [json.dumps({"chunks": [{"spans": spans, "lang": "ru"}, {"spans": spans}], "meta": {"annotators": [{"code": "c", "seconds": 4}, {"code": "c", "seconds": 4}]}, "version": [2]})] * 2
    t = flatten_records(lines(spark, [*values, "{broken", " ", None]))
    assert t.span_objects.count() == 5 and t.span_bridge.count() == 20 and t.chunk_objects.count() == 2 and t.records.select("record_node").distinct().count() == 1
    extra = {r.extra for r in t.span_objects.collect()}
    assert extra == {'{"note":"n1"}', '{"note":"n2"}', '{"start":"x"}', None} and {r.extra for r in t.chunk_objects.collect()} == {'{"lang":"ru"}', None} and t.records.first().extra == '{"version":[2]}'
    assert t.link_objects.count() == 2 and t.link_bridge.count() == 12 and t.attrs_objects.count() == 2 and t.annotator_objects.count() == t.meta_objects.count() == 1 and t.annotator_bridge.count() == 4
    assert sorted((r.line_id, r.problem) for r in t.unreadable.collect()) == [(2, "no record"), (3, "blank"), (4, "null")]


def test_round_trip(spark, data):
    df = spark.read.parquet(f"{data}/annotation_lines.parquet")
    t = flatten_records(df)
    assert t.span_bridge.count() == t.span_bridge.join(t.span_objects, "span_node").count()
    assert t.span_bridge.join(t.chunk_bridge, ["line_id", "chunk_pos", "chunk_node"], "left_anti").count() == 0
