import pytest
from pyspark.sql import functions as F

from finstrata.llm import quality as Q

PROSE = "Выручка выросла на 5 %, что вызвано ростом цен. Совет директоров одобрил дивидендную политику и связал изменение с запуском новых мощностей в регионе."


@pytest.mark.parametrize(("text", "kind"), [
    (PROSE, "prose"), (PROSE + "\n- упаковки\n- связи", "prose"), ("Показатель | 2015 | 2016\nвыручка | 1,5 | 2\nактивы | 3 | н/д", "table"), ("a\t1\t2\nb\t3\t4\nc\t5\t6", "table"),
    ("выручка      12,5     13\nактивы        1,5    130\nдолг          3        4", "table"), ("• цены\n• спрос\n• связь\n• литьё", "list"), ("1) цены;\n2) спрос;\n3) связь;", "list"),
    ("АО «Альфа»\nООО «Бета»\nПАО «Гамма»\nАО «Дельта»\nООО «Эпсилон и Ко»", "list"), ("тест " * 50, "junk"), ("Ð ÐµÐ²Ð¸Ð·Ð¸Ð¾Ð½Ð½Ð°Ñ", "junk"), ("фл чхйбй шг зкж йх дчкчб мбгх хккзщ", "junk"),
    ("公司今年的收入比去年增长了百分之五，主要原因是产品价格上涨和新设备投入运行，董事会批准了分红政策，并对未来的市场需求保持谨慎乐观的态度，管理层还介绍了区域内新建产能的进展情况。", "prose"),
    ("Τα έσοδα της εταιρείας αυξήθηκαν κατά πέντε τοις εκατό. Το διοικητικό συμβούλιο ενέκρινε τη μερισματική πολιτική για το επόμενο έτος.", "prose"),
    ("ارتفعت إيرادات الشركة بنسبة خمسة في المئة مقارنة بالعام الماضي. ووافق مجلس الإدارة على سياسة توزيع الأرباح وعلى خطة التوسع الجديدة.", "prose"),
    ("Tekjur félagsins jukust um fimm prósent á árinu. Stjórnin samþykkti arðgreiðslur og ræddi áhættu í rekstri þess á næsta ári.", "prose"),
    ("Les dépenses liées à l'activité ont été révisées à la baisse. L'équipe dirigeante a réaffirmé sa stratégie élargie à l'été, où dès décembre l'évolution était déjà très élevée.", "prose"),
    ("¿Qué pasó? La dirección aprobó el plan. ¿Y después? Los ingresos crecieron.", "prose"), ("https://example.org/find?q=рост и далее по тексту, где всё написано словами.", "prose"),
    ("Âûðó÷êà êîìïàíèè âûðîñëà íà ïÿòü ïðîöåíòîâ ïî èòîãàì ãîäà", "junk"), ("б?н? ?т??ро??ил п??и???? го?а", "junk"),
    ("Совет рассмотрел итоги года и одобрил:\n- рост цен\n- рост спроса\n- рост связи\nЭто решение было принято с учётом мнения всех членов комитета.", "prose"),
    ("b8a5b92a fca6e7c2 1606a7ec c920c4dd", "junk"), ("/&>{}~}<==< _> @++[$$+*/", "junk"), ("", None), ("  \n ", None), (None, None),
])
def test_kinds(text, kind):
    assert Q.text_kind(Q.text_statistics(text)) == kind


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat, and the dog.\nEnd", "x"), (2, None, "x"), (3, " ", "x")], "doc_id int, text string, word_count string")
    got = {r.doc_id: r for r in Q.describe_texts(df).collect()}
    r = got[1]
    assert r.word_count == 6 and r.mean_word_length == pytest.approx(20 / 6) and r.symbol_ratio == pytest.approx(2 / 20) and r.punct_line_share == 0.5
    assert r.common_word_share == pytest.approx(3 / 6) and got[2].word_count is None and got[3].text_kind is None
    assert Q.describe_texts(df.limit(0)).count() == 0


def test_labelled_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/kind_labels.parquet").withColumnRenamed("text_kind", "label"), "doc_id")
    r = Q.describe_texts(d).select(F.avg((F.col("label") == F.col("text_kind")).cast("double"))).first()
    assert r[0] > 0.98


def test_signs_of_prose_decide():
    """The same share of listed lines is a list among bare entries and prose among sentences."""
    s = {"garbled_ratio": 0.0, "random_share": 0.0, "unspeakable_share": 0.0, "symbol_ratio": 0.05, "word_count": 50, "distinct_share": 1.0, "table_share": 0.0, "list_share": 0.5}
    sentences = {"common_word_share": 0.2, "punct_line_share": 0.9, "mean_word_length": 6.0, "line_autocorrelation": 0.95}
    entries = {"common_word_share": 0.0, "punct_line_share": 0.1, "mean_word_length": 6.0, "line_autocorrelation": 0.5}
    assert Q.prose_signs(s | sentences) == 5 and Q.text_kind(s | sentences) == "prose" and Q.text_kind(s | entries) == "list"
    assert Q.text_kind(s | sentences | {"list_share": 0.0, "unspeakable_share": 0.45}) == "prose" and Q.text_kind(s | entries | {"list_share": 0.0, "unspeakable_share": 0.45}) == "junk"


def test_long_texts():
    for t in ("a" * 300_000, "бвг" * 100_000, "1a" * 100_000, "? " * 100_000, "é" * 100_000):
        assert Q.text_kind(Q.text_statistics(t)) == "junk"
