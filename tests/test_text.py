import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from finstrata.operators import text as T

PAIRS = [
    ("  Выручка    составила\n1 млн.  ", "Выручка составила 1 млн."),
    ("прибыль — прибыль – прибыль - 2023–2024", "прибыль - прибыль - прибыль - 2023-2024"),
    ("счёт", "счет"),
    ("Выручка 1 234 567,89 руб.", "Выручка 1234567.89 руб."),
    ("5 000 000 руб.", "5000000 руб."),
    ("отчетный период 31.12.2023", "отчетный период 2023-12-31"),
    ("01/02/2024", "2024-02-01"),
    ("99.99.2023", "2023-99-99"),
    ("31,12,2023", "2023-12-31"),
    ("1.2.2023-10-2024", "2023-02-01-10-2024"),
    ("выручkа расхoды", "выручка расходы"),
    ("Oтчет о прибылях", "Отчет о прибылях"),
    ("прибыль до налога", "прибыль до налога"),
    ("выручка\nв размере\nприбы-\nль", "выручка в размере прибыль"),
    ("выру­чка за год", "выручка за год"),
    ("а‑б", "а‐б"),
    ("", ""),
    (None, None),
]


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_pairs(spark):
    assert one(spark, [a for a, _ in PAIRS], T.normalize) == [b for _, b in PAIRS]


def plain(t):
    t = unicodedata.normalize("NFKC", t).replace("­", "")
    t = re.sub(r"(?<=[а-яёА-ЯЁ])-\s*\n\s*(?=[а-яёА-ЯЁ])", "", t).replace("ё", "е").replace("Ё", "Е")
    t = re.sub("[—–−‑]", "-", t)
    t = re.sub("(?<=[а-яё])[acekopx](?=[а-яё])", lambda m: T.LOOKALIKES[m[0]], t)
    t = re.sub(r"(?<!\w)[coCO](?=[а-яёА-ЯЁ]{2,})", lambda m: {"c": "с", "o": "о", "C": "С", "O": "О"}[m[0]], t)
    t = re.sub(r"(?<=\d)\s+(?=\d)", "", t)
    t = re.sub(r"(?<=\d),(?=\d)", ".", t)
    t = re.sub(r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b", lambda m: f"{m[3]}-{int(m[2]):02d}-{int(m[1]):02d}", t)
    return re.sub(r"\s+", " ", t).strip()


def test_random_strings_against_plain_rules(spark):
    rng = random.Random(3)
    alphabet = "абвёЁОСсoaceCOkpx 1 2 3 4 5 0 .,/-—\n\t ­№½_ы"
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert one(spark, values, T.normalize) == [plain(v) for v in values]


@pytest.mark.parametrize(("text", "title"), [("Выручка", True), ("а" * 121, False), ("а" * 120, True), ("Итог.", False), ("a\nb", False), ("  ", False), (None, False), ("", False)])
def test_titles(spark, text, title):
    assert one(spark, [text], T.looks_like_title) == [title]


def test_tables_blocks_languages(spark):
    df = spark.createDataFrame([([["а", None], ["в", "г"]], 0.01, 0.2), (None, 0.5, 0.96), ([[], ["x"]], None, None)], "r array<array<string>>, a double, b double")
    got = df.select(T.rows_to_text(F.col("r")), T.classify_block(F.lit("Итог"), F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in got] == [("а |  | в | г", "header"), ("", "footer"), (" | x", "title")]
    assert one(spark, ["rus", "eng", "rus+eng", None], T.ocr_language) == ["rus+eng", "eng", "rus+eng", None]
