"""Command line: python -m finstrata COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import Settings, setup_logging
from .operators.bioes import label_words, label_id
from .operators.encode import risk_examples
from .operators.split import split_records
from .operators.synth import Options, generate
from .session import local_session
from .sources.records import labelling_tasks, parse_export, read_export, read_records, write_records, write_report


def _chunks(records):
    return records.select("source", "risk", F.explode("chunks").alias("c")).select("source", "risk", "c.*")


def _train_steps(a, settings: Settings, chunks) -> None:
    """Trains one of the classifiers that ``analyze`` uses, on at most ``softmax.SAMPLE_ROWS`` examples."""
    from . import softmax
    from .analyze import text_features, word_feature_lists
    from .constants import LABELS, RISKS
    from .operators.bioes import bioes_labels
    from .operators.lemma import word_spans

    if a.command == "train-risk":
        examples, classes = risk_examples(chunks.select("source", "chunk_id", "text", "risk")).join(chunks.select("source", "part").distinct(), "source"), RISKS
        rows = examples.select("part", text_features(F.col("text"), settings.risk_max_length).alias("f"), F.col("risk").alias("y"))
    else:
        spans, classes = F.transform("spans", lambda s: F.struct(s["text"], s["label"], s["start"].alias("start_pos"), s["end"].alias("end_pos"))), LABELS
        found = chunks.select("part", F.slice(word_spans(F.col("text")), 1, settings.ner_max_length).alias("w"), spans.alias("spans"))
        pairs = F.arrays_zip(word_feature_lists(F.col("w")).alias("f"), bioes_labels(F.col("w"), F.col("spans")).alias("y"))
        rows = found.select("part", F.explode(pairs).alias("x")).select("part", "x.*")
    (xs, ys), (vx, vy) = (softmax.sample(rows.where(F.col("part") == part), "f", "y") for part in ("train", "validation"))
    number = {c: i for i, c in enumerate(classes)}
    right = lambda m: sum(m.probabilities(f).argmax() == number[y] for f, y in zip(vx, vy, strict=True)) / max(1, len(vy))
    out = softmax.train(xs, [number[y] for y in ys], len(classes), right, settings, seed=a.seed)
    out.best_model.save(a.output)
    print(out.history)


def main(argv: list[str] | None = None) -> None:
    settings = Settings.load()
    p = argparse.ArgumentParser(prog="finstrata")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("tasks", "records to labelling tasks"), ("import-export", "a labelling export to records"), ("synthetic", "generate records"), ("train-risk", "train the risk classifier"), ("train-ner", "train the word classifier"), ("evaluate", "evaluate both classifiers"), ("chunks", "report files to chunks"), ("upload", "records to a labelling server as tasks"), ("download", "a labelling server's project to records"), ("analyze", "entities and risk of texts (parquet with key, text)")):
        s = sub.add_parser(name, help=text)
        if name not in ("synthetic", "download"):
            s.add_argument("input")
        if name != "upload":
            s.add_argument("output")
        if name in ("upload", "download"):
            s.add_argument("--url", required=True)
            s.add_argument("--token", required=True)
        if name == "download":
            s.add_argument("--project", type=int, required=True)
        if name == "synthetic":
            s.add_argument("--count", type=int, default=500)
            s.add_argument("--min-entities", type=int, default=20)
            s.add_argument("--noise", type=float, default=0.02)
            s.add_argument("--seed", type=int, default=42)
        if name.startswith("train"):
            s.add_argument("--train-ratio", type=float, default=settings.train_ratio)
            s.add_argument("--seed", type=int, default=7)
        if name.startswith("train"):
            s.add_argument("--steps", action="store_true", help="train step by step on a bounded sample, for analyze")
        if name in ("evaluate", "analyze"):
            s.add_argument("--risk-model", required=True)
            s.add_argument("--ner-model", required=True)
    a = p.parse_args(argv)
    setup_logging(settings.log_level)
    spark = local_session("finstrata")
    if a.command == "synthetic":
        write_records(generate(spark, Options(a.count, a.min_entities, max(80, a.min_entities), a.noise, a.seed)), a.output, "overwrite")
        return
    if a.command == "import-export":
        write_records(parse_export(read_export(spark, a.input)).orderBy("first_task").drop("first_task"), a.output, "overwrite")
        return
    if a.command == "chunks":
        from .plans.pipeline import preprocess
        from .sources.files import read_reports, sections_of

        docs = read_reports(spark, a.input, settings=settings).where("error is null")
        preprocess(sections_of(docs).withColumnRenamed("path", "doc_id"), settings).write.mode("overwrite").parquet(a.output)
        return
    if a.command == "download":
        import json
        from pathlib import Path

        from .sources.labelling import LabellingClient

        Path(a.output + ".export.json").write_text(json.dumps(LabellingClient(a.url, a.token).export(a.project), ensure_ascii=False), encoding="utf-8")
        write_records(parse_export(read_export(spark, a.output + ".export.json")).orderBy("first_task").drop("first_task"), a.output, "overwrite")
        return
    if a.command == "analyze":
        from .analyze import ReportAnalyzer
        from .softmax import SoftmaxModel

        analyzer = ReportAnalyzer(SoftmaxModel.load(a.ner_model), SoftmaxModel.load(a.risk_model), max_words=settings.risk_max_length)
        analyzer.analyze(spark.read.parquet(a.input), ["key"]).write.mode("overwrite").parquet(a.output)
        return
    records = read_records(spark, a.input)
    if a.command == "upload":
        from .sources.labelling import LabellingClient, upload_tasks

        upload_tasks(labelling_tasks(_chunks(records)), LabellingClient(a.url, a.token))
        return
    if a.command == "tasks":
        labelling_tasks(_chunks(records), ["source", "chunk_id"]).select("task").write.mode("overwrite").text(a.output)
        return
    from pyspark.ml import PipelineModel

    from . import ml
    from .operators import metrics

    chunks = _chunks(records)
    spans = F.transform("spans", lambda s: F.struct(s["text"], s["label"], s["start"].alias("start_pos"), s["end"].alias("end_pos")))
    words = label_words(chunks.withColumn("spans", spans), ["source", "chunk_id"]).withColumn("label_id", label_id(F.col("label")))
    if a.command == "evaluate":
        write_report(metrics.risk_metrics(ml.predict_risk(PipelineModel.load(a.risk_model), risk_examples(chunks)), true="risk_id"), f"{a.output}/eval_risk.json")
        report = ml.evaluate_ner(ml.predict_ner(PipelineModel.load(a.ner_model), words, ["source", "chunk_id"]), ["source", "chunk_id"])
        write_report(report.agg(F.collect_list(F.struct(*report.columns)).alias("report")), f"{a.output}/eval_ner.json")
        return
    parts = split_records(records, ["source"], a.train_ratio, a.seed).select("source", "part")
    if a.steps:
        _train_steps(a, settings, chunks.join(parts, "source"))
        return
    if a.command == "train-risk":
        examples = risk_examples(chunks).join(parts, "source")
        out = ml.train_risk(examples.where("part = 'train'"), settings.epochs, settings.patience, examples.where("part = 'validation'"))
        out.best_model.write().overwrite().save(a.output)
        print(out.history)
    else:
        ml.train_ner(words.join(parts.where("part = 'train'"), "source"), ["source", "chunk_id"]).write().overwrite().save(a.output)


if __name__ == "__main__":
    main()
