import pytest
from pyspark.sql import functions as F

from finstrata.operators import metrics, split


def preds(spark, rows):
    return spark.createDataFrame(rows, "true_id int, pred_id int")


def test_macro_and_confusion(spark):
    r = metrics.macro_f1(preds(spark, [(0, 0), (0, 1), (1, 1), (1, 0)]), 2).first()
    assert r.macro_f1 == pytest.approx(0.5)
    assert tuple(metrics.macro_f1(preds(spark, []), 3).first()) == (0, 0, 0)
    c = {(r.true_id, r.pred_id): r.n for r in metrics.confusion_matrix(preds(spark, [(0, 0), (0, 1), (1, 1), (2, 2)]), 3).collect()}
    assert len(c) == 9 and c[0, 0] == c[0, 1] == c[1, 1] == c[2, 2] == 1 and sum(c.values()) == 4


def probs(spark, rows):
    return spark.createDataFrame(rows, "true_id int, probs array<double>")


def test_brier_and_calibration(spark):
    assert metrics.brier_score(probs(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0])])).first().brier == pytest.approx(1.0)
    assert metrics.calibration_error(probs(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [0.9, 0.1])])).first().ece == pytest.approx(1 / 30)
    assert metrics.brier_score(probs(spark, [])).first().brier == 0 and metrics.calibration_error(probs(spark, [])).first().ece == 0
    r = metrics.risk_metrics(probs(spark, [(0, [0.5, 0.5, 0.0]), (2, [0.0, 0.2, 0.8])])).first()
    assert r.n == 2 and r.accuracy == 1.0 and r.confusion == [[1, 0, 0], [0, 0, 0], [0, 0, 1]]


def test_entities(spark):
    rows = [(1, i, g, p) for i, (g, p) in enumerate(zip(["B-a", "I-a", "E-a", "O", "S-a"], ["O", "I-a", "E-a", "O", "S-a"], strict=True))] + [(1, 9, None, "S-a")]
    r = {x.entity: x for x in metrics.entity_report(spark.createDataFrame(rows, "s int, word_idx int, gold string, pred string"), ["s"]).collect()}
    assert r["a"].support == 2 and r["a"].precision == r["a"].recall == 0.5 and r["macro avg"].f1 == pytest.approx(0.5)


def test_weights(spark):
    def weights(ids, k):
        return [r.weight for r in metrics.class_weights(spark.createDataFrame([(i,) for i in ids], "label_id int"), k).orderBy("class_id").collect()]

    w = weights([0, 0, 0, 1, 1], 2)
    assert w[0] < w[1] and sum(w) / 2 == pytest.approx(1)
    w = weights([0, 0, 1], 3)
    assert w[2] == 1 and (w[0] + w[1]) / 2 == pytest.approx(1)
    assert weights([-100], 2) == [1.0, 1.0]


def test_split(spark):
    def parts(n, ratio=0.8, seed=7):
        df = spark.createDataFrame([(i, "x") for i in range(n)], "id int, part string").drop("part")
        return sorted(r.id for r in split.split_records(df, ["id"], ratio, seed).where("part = 'train'").collect())

    assert len(parts(10)) == 8 and parts(10) == parts(10) and parts(30) != parts(30, seed=8)
    assert parts(0) == [] and parts(1) == [] and len(parts(2, 0.1)) == 1
    assert [split.train_size(n, 0.8) for n in (0, 1, 2, 10)] == [0, 0, 1, 8]


def test_schedule_and_stopping(spark):
    r = [x[0] for x in spark.range(5).select(split.warmup_rate(F.col("id"), 2, 4)).collect()]
    assert r == [0.5, 1.0, 1.0, 0.5, 0.0]
    rows = [("a", i + 1, s) for i, s in enumerate([0.5, 0.4, 0.3, 0.2, 0.1])] + [("b", i + 1, s) for i, s in enumerate([0.1, 0.9, 0.5])]
    df = spark.createDataFrame(rows, "run string, epoch int, score double")
    assert split.best_epochs(df.where("run = 'a'"), ["run"]).first().asDict() == {"run": "a", "best_epoch": 1, "best_score": 0.5, "epochs_run": 3}
    assert split.best_epochs(df.where("run = 'b'"), ["run"], patience=1).first().best_epoch == 2
