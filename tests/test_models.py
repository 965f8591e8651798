import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstrata import softmax
from finstrata.analyze import ReportAnalyzer, text_features, word_feature_lists
from finstrata.config import Settings
from finstrata.constants import LABELS, RISKS
from finstrata.operators import lemma
from finstrata.operators.bioes import bioes_labels
from finstrata.operators.lemma import word_spans
from finstrata.operators.split import warmup_rate
from finstrata.sources import files, labelling, records

FAST = Settings(epochs=8, batch_size=4, accumulation=3, learning_rate=0.05, patience=3)


def test_training_loop():
    """Accumulation steps on the last, shorter group too; losses fall; the best state is kept itself."""
    rows = [([f"a{i % 3}", "x"], i % 3) for i in range(50)]
    feats, labels = [f for f, _ in rows], [y for _, y in rows]
    accuracy = lambda m: float(np.mean([m.probabilities(f).argmax() == y for f, y in rows]))
    out = softmax.train(feats, labels, 3, accuracy, FAST)
    assert out.best_score == 1.0 and accuracy(out.best_model) == 1.0 and out.history[-1]["train_loss"] < out.history[0]["train_loss"]
    assert out.history[0]["epoch"] == 1 and len(out.history) <= 8
    falling = iter([0.5, 0.4, 0.3, 0.2, 0.9])
    stopped = softmax.train(feats, labels, 3, lambda m: next(falling), FAST)
    assert (stopped.best_epoch, len(stopped.history)) == (1, 4)
    assert softmax.train([], [], 3, lambda m: 0.0, FAST).history[0]["train_loss"] == 0.0
    q = out.best_model.quantized()
    assert q.weights.dtype == np.int8 and accuracy(q) == 1.0 and np.allclose(q.probabilities(["a1", "x"]), out.best_model.probabilities(["a1", "x"]), atol=0.02)


def test_schedule(spark):
    steps = spark.range(40).select(warmup_rate(F.col("id").cast("int"), 5, 40).alias("r")).collect()
    assert [r.r for r in steps] == pytest.approx([softmax.learning_rate(i, 5, 40) for i in range(40)])


def test_analyzer(spark, tmp_path):
    texts = [("выручка 5 млн", [("выручка", "metric", 0, 7), ("5", "amount", 8, 9), ("млн", "unit", 10, 13)], "low"), ("долг вырос до 7", [("долг", "metric", 0, 4), ("7", "amount", 14, 15)], "high")] * 6
    df = spark.createDataFrame([(i, t, s, r) for i, (t, s, r) in enumerate(texts)], "k int, text string, spans array<struct<text:string,label:string,start_pos:int,end_pos:int>>, risk string")
    words = df.select(word_spans(F.col("text")).alias("w"), "spans").select(F.explode(F.arrays_zip(word_feature_lists(F.col("w")).alias("f"), bioes_labels(F.col("w"), F.col("spans")).alias("l"))).alias("x"))
    feats, labels = softmax.sample(words.select("x.f", "x.l"), "f", "l")
    ner = softmax.train(feats, [LABELS.index(x) for x in labels], len(LABELS), lambda m: -len(m.bias), FAST).best_model
    ner = softmax.train(feats, [LABELS.index(x) for x in labels], len(LABELS), lambda m: float(np.mean([m.probabilities(f).argmax() == LABELS.index(y) for f, y in zip(feats, labels, strict=True)])), FAST).best_model
    feats, labels = softmax.sample(df.select(text_features(F.col("text")).alias("f"), "risk"), "f", "risk")
    risk = softmax.train(feats, [RISKS.index(x) for x in labels], 3, lambda m: float(np.mean([m.probabilities(f).argmax() == RISKS.index(y) for f, y in zip(feats, labels, strict=True)])), FAST).best_model
    risk.save(str(tmp_path / "risk.npz"))
    risk = softmax.SoftmaxModel.load(str(tmp_path / "risk.npz"))
    asked = spark.createDataFrame([(1, "выручка 5 млн"), (2, "долг вырос до 7"), (3, None), (4, "")], "k int, text string")
    for quantize in (False, True):
        got = {r.k: r for r in ReportAnalyzer(ner, risk, quantize).analyze(asked, ["k"]).collect()}
        assert [(s.text, s.label) for s in got[1].spans] == [("выручка", "metric"), ("5", "amount"), ("млн", "unit")] and got[1].risk_pred == "low"
        assert [(s.text, s.label) for s in got[2].spans] == [("долг", "metric"), ("7", "amount")] and got[2].risk_pred == "high"
        assert sum(got[1].probabilities.values()) == pytest.approx(1) and set(got[1].probabilities) == set(RISKS)
        assert not got[3].spans and got[3].risk_pred is None and got[3].probabilities is None and got[4].risk_pred in RISKS
    assert ReportAnalyzer(ner, risk).analyze(asked.limit(0), ["k"]).count() == 0


@pytest.fixture
def server():
    """A server of 5 tasks that keeps what is posted."""
    posted = []
    task = lambda i: {"data": {"source": "s", "chunk_id": str(i), "text": "долг"}, "annotations": [{"result": [{"value": {"text": "долг", "labels": ["metric"], "start": 0, "end": 4}}]}]}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, value=None):
            assert self.headers["Authorization"] == "Token key"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"" if value is None else json.dumps(value).encode())

        def do_POST(self):
            assert self.path == "/api/tasks"
            posted.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer()

        def do_GET(self):
            if "/export" in self.path:
                self.answer([task(i) for i in range(5)])
            else:
                page = int(self.path.partition("&page=")[2].partition("&")[0])
                self.answer({"tasks": [task(i) for i in range((page - 1) * 2, min(5, page * 2))]})

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", posted
    s.shutdown()


def test_upload_and_fetch(spark, server):
    url, posted = server
    client = labelling.LabellingClient(url, "key")
    df = spark.createDataFrame([("s", i, "Выручка 5 млн") for i in range(7)], "source string, chunk_id int, text string")
    labelling.upload_tasks(records.labelling_tasks(df), client)
    assert sorted(t["data"]["chunk_id"] for t in posted) == list(range(7)) and all(t["predictions"][0]["result"] for t in posted)
    assert len(client.export(3)) == 5
    got = records.export_chunks(labelling.fetch_tasks(spark, client, 3, 5, 2)).orderBy("task_idx").collect()
    assert [(r.task_idx, r.chunk_id, len(r.spans)) for r in got] == [(i, i, 1) for i in range(5)]
    assert labelling.fetch_tasks(spark, client, 3, 0).count() == 0


def test_validation(spark, tmp_path):
    def read(record):
        (tmp_path / "r.jsonl").write_text(json.dumps(record, ensure_ascii=False) + "\n\n", encoding="utf-8")
        return records.read_records(spark, str(tmp_path / "r.jsonl")).collect()

    def record(label="metric", end=4, risk="low", text="долг"):
        return {"source": "s", "risk": risk, "chunks": [{"chunk_id": 1, "text": text, "spans": [{"text": "долг", "label": label, "start": 0, "end": end}]}]}

    assert read(record())[0].source == "s" and read({"source": "s"})[0].chunks is None
    for bad in (record(label="x"), record(end=3), record(risk="huge"), record(text=None), {"chunks": []}):
        with pytest.raises(Exception, match="unknown|bounds|no text|no source"):
            read(bad)


def test_typed_cells():
    def book(cells, styles="", extra=""):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook>{extra}<sheets><sheet name="A"/></sheets></workbook>')
            z.writestr("xl/styles.xml", f"<styleSheet>{styles}</styleSheet>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>")
        return files.parse_xlsx(f.getvalue())[1]["cell_rows"][0]

    styles = '<numFmts><numFmt numFmtId="164" formatCode="[h]:mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="166" formatCode="dd/mm/yyyy"/></numFmts>'
    styles += "<cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165, 166, 18)) + "</cellXfs>"
    cells = '<c><v>1E3</v></c><c><v>5</v></c><c><v>2.50</v></c><c s="1"><v>45322</v></c><c s="2"><v>1.5</v></c><c s="3"><v>3</v></c><c s="4"><v>45322.25</v></c><c s="5"><v>0.5</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v> x </v></c>'
    assert book(cells, styles) == ["1000.0", "5", "2.5", "2024-01-31 00:00:00", "1 day, 12:00:00", "3", "2024-01-31 06:00:00", "12:00:00", "True", "#N/A", "x"]
    assert book('<c s="1"><v>1</v></c>', styles, '<workbookPr date1904="1"/>') == ["1904-01-02 00:00:00"] and book('<c s="1"><v>1</v></c>', styles) == ["1900-01-01 00:00:00"]


def test_merged_cells():
    def cell(text, marks=""):
        return f"<w:tc><w:tcPr>{marks}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    rows = [cell("a", '<w:vMerge w:val="restart"/>') + cell("b", '<w:gridSpan w:val="2"/>'), cell("", "<w:vMerge/>") + cell("c") + cell("d")]
    xml = '<w:document xmlns:w="u"><w:body><w:tbl>' + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl></w:body></w:document>"
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.parse_docx(f.getvalue())[0]["cell_rows"] == [["a", "b", "b"], ["a", "c", "d"]]


def test_lemmatiser_hook(spark):
    df = spark.createDataFrame([("Выручки росли ",), (None,)], "text string")
    make = lambda: lambda t: [(w, w[:3]) for w in t.split()]
    assert [(x.text, x.lemma) for x in df.select(lemma.linguistic_tokens(F.col("text"), make)).first()[0]] == [("Выручки", "выручка"), ("росли", "рос")]
    plain = df.select(lemma.linguistic_tokens(F.col("text"), lambda: None).alias("t")).collect()
    assert [(x.text, x.lemma) for x in plain[0].t] == [("Выручки", "выручки"), ("росли", "росли")] and plain[1].t is None
    assert lemma.model_available(make) and not lemma.model_available(lambda: None)
