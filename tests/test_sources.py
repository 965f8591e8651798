import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from finstrata.operators import synth
from finstrata.sources import detect, files, records


def docx(body):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return b.getvalue()


def para(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def xlsx(rows, shared=()):
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="Отчёт о прибылях" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {m}><sheetData>{rows}</sheetData></worksheet>")
    return b.getvalue()


def brief(sections):
    return [(s["block_type"], s["text"]) for s in sections]


def test_html():
    html = "<html><h1>Отчёт.</h1><p>Выручка <b>за</b> год.</p><li>пункт</li><table><tr><th>Показатель</th><th>2023</th></tr><tr><td></td><td></td></tr><tr><td><p>Выручка</p></td><td>5</td></tr></table><p> </p></html>"
    got = files.parse_html(html.encode())
    assert brief(got) == [("title", "Отчёт."), ("paragraph", "Выручка за год."), ("title", "пункт"), ("table", "Показатель | 2023 | Выручка | 5")]
    assert got[3]["cell_rows"] == [["Показатель", "2023"], ["Выручка", "5"]]
    assert files.parse_html(b"") == [] and brief(files.parse_html(b"<p>a<p>b")) == [("title", "a b"), ("title", "b")]


def test_docx_and_xlsx():
    table = "<w:tbl>" + "".join(f"<w:tr><w:tc>{para(a)}</w:tc><w:tc>{para(b)}</w:tc></w:tr>" for a, b in [("Показатель", "2023"), ("Выручка", "5")]) + "</w:tbl>"
    got = files.parse_docx(docx(para("Отчёт") + para(" ") + para("Выручка выросла.") + table))
    assert brief(got) == [("title", "Отчёт"), ("paragraph", "Выручка выросла."), ("table", "Показатель | 2023 | Выручка | 5")]
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>123456.0</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3" t="inlineStr"><is><t> x </t></is></c></row>'
    got = files.parse_xlsx(xlsx(rows, ["Выручка"]))
    assert brief(got)[0] == ("title", "Отчёт о прибылях") and got[1]["cell_rows"] == [["Выручка", "", "123456.0"], ["", "x", ""]]


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>Т</h1><p>Текст, да.</p>", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(docx(para("Отчёт")))
    (tmp_path / "c.doc").write_bytes(b"x")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    got = {r.path.rpartition("/")[2]: r for r in files.read_reports(spark, str(tmp_path)).collect()}
    assert got["a.html"].raw_text == "Т\nТекст, да." and got["b.docx"].document_type == "docx"
    assert "unsupported" in got["c.doc"].error and got["d.xlsx"].error and got["d.xlsx"].sections is None
    docs = files.read_reports(spark, str(tmp_path)).where("error is null")
    assert [(s.section_idx, s.text) for s in files.sections_of(docs).where("path like '%html'").orderBy("section_idx").collect()] == [(0, "Т"), (1, "Текст, да.")]
    with pytest.raises(ValueError):
        files.parse_document("x.doc", b"")
    scans = files.parse_pdf_scan(b"", recognize=lambda c: ["стр", " ", "два"])
    assert [(s["page"], s["text"]) for s in scans] == [(1, "стр"), (3, "два")]


def test_detection(spark):
    df = spark.createDataFrame([("a/b.XLSM",), ("c.htm",), ("d.pdf",), ("e.doc",), (".pdf",), (None,)], "p string")
    assert [r[0] for r in df.select(detect.detect_type(F.col("p"), False)).collect()] == ["xlsx", "html", "pdf", None, None, None]
    with pytest.raises(Exception, match="unsupported"):
        df.select(detect.detect_type(F.col("p"))).collect()
    pages = spark.createDataFrame([("a", 1, "x" * 60), ("a", 2, "y" * 40), ("b", 1, None), ("c", 9, "z" * 99)], "doc_id string, page int, text string")
    assert {r.doc_id: r.document_type for r in detect.pdf_types(pages).collect()} == {"a": "pdf_text", "b": "pdf_scan", "c": "pdf_scan"}


def test_records_round_trip(spark, tmp_path):
    g = synth.generate(spark, synth.Options(count=6, min_entities=3))
    records.write_records(g, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r"))
    assert sorted(map(str, back.select("source", "risk", "chunks").collect())) == sorted(map(str, g.select("source", "risk", "chunks").collect()))
    (tmp_path / "bad").write_text('{"source": \n\n')
    with pytest.raises(Exception):  # noqa: B017
        records.read_records(spark, str(tmp_path / "bad")).collect()


def test_tasks_and_export(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "выручка 5"), ("s", 2, None)], "source string, chunk_id int, text string")
    tasks = [json.loads(r.task) for r in records.labelling_tasks(df).collect()]
    assert tasks[0]["data"] == {"text": "выручка 5", "source": "s", "chunk_id": 1}
    first = tasks[0]["predictions"][0]["result"][0]
    assert first["value"] == {"start": 0, "end": 7, "text": "выручка", "labels": ["metric"]} and first["from_name"] == "entities" and tasks[1]["predictions"][0]["result"] == []
    value = {"text": "a", "labels": ["metric", "x"], "start": 0, "end": 1}
    export = [
        {"data": {"source": "b", "chunk_id": 2, "text": "t2"}, "annotations": [{"result": [{"value": value}, {"value": {"labels": []}}, {"value": {}}]}, {"result": [{"value": value}]}]},
        {"data": {}, "annotations": None}, {"data": {"source": "b", "chunk_id": 1, "text": "t1"}},
    ]
    (tmp_path / "e.json").write_text(json.dumps(export))
    got = records.parse_export(records.read_export(spark, str(tmp_path / "e.json"))).orderBy("first_task").collect()
    assert [(r.source, [(c.chunk_id, c.text, len(c.spans)) for c in r.chunks]) for r in got] == [("b", [(1, "t1", 0), (2, "t2", 2)]), ("unknown", [(0, "", 0)])]
    records.write_report(spark.createDataFrame([(0.5, "ё")], "f1 double, n string"), str(tmp_path / "rep.json"))
    assert json.loads((tmp_path / "rep.json").read_text(encoding="utf-8")) == {"f1": 0.5, "n": "ё"}
