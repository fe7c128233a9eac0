from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from triledger.functions import text
from triledger.vocabulary import RUSSIAN


def values(spark, inputs, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_tickets(spark):
    cases = {
        "376-2459531798|3762459531800": ["2459531798", "2459531800"],
        "2459531798 2459531798": ["2459531798"],
        "СЧ-000066": [],
        None: [],
        "12345678901234": ["4567890123"],  # thirteen digits are taken, the last ten kept
    }
    assert values(spark, list(cases), text.extract_tickets) == list(cases.values())


def test_names(spark):
    cases = {"  SkyWay-Travel ": "SKYWAY TRAVEL", 'ОсОО "Жибек Эйр"': "ОСОО ЖИБЕК ЭЙР", "Ёлка": "ЕЛКА", None: "", "--": ""}
    assert values(spark, list(cases), text.norm_text) == list(cases.values())


def test_numbers(spark):
    cases = {
        "7.889,70": "7889.70", "7,889.70": "7889.70", "115 877,00": "115877", "15 666.00": "15666", "24656": "24656",
        "331.304,00": "331304", "-24.782,00": "-24782", "289.000": "289000", "1.234.567": "1234567", "0.500": "0.5",
        "115\u00a0877,00": "115877", "+12,5": "12.5", "1234.500": "1234.5", "1.2.3,4": "123.4",
    }
    got = values(spark, list(cases), text.parse_number)
    assert got == [Decimal(v) for v in cases.values()]
    assert values(spark, ["", ".,", "abc", "1,2.3,4"], text.parse_number) == [None] * 4


@pytest.mark.parametrize("cell,expected", [
    ("7.889,70 USD + 35usd sf", "697373.60"), ("kgs 15 666.00 + 300 KGS sf", "15966"),
    ("-10 768,65 kgs (штраф 15%)", "-10768.65"), ("kzt -279.760,00", "-47559.20"), ("100 руб", "100"), ("1000 тг", "170"),
    ("115\u00a0877,00", "115877"), ("100 EUR+20 KGS", "20"), (None, None), ("cash", None), ("100 EUR", None),
])
def test_amounts(spark, cell, expected):
    rates = {"rate_usd": "88", "rate_eur": None, "rate_rub": "1", "rate_kzt": "0.17"}
    columns = {k: F.lit(v).cast("decimal(18,6)") for k, v in rates.items()}
    assert values(spark, [cell], lambda c: text.parse_amount(c, columns)) == [expected and Decimal(expected)]


def test_amount_issues(spark):
    cells = ["3762459527703", " 2459527703 ", "10 000 kgs", "later", None, "5 usd"]
    rates = {k: F.lit(1).cast("decimal(18,6)") for k in ("rate_usd", "rate_eur", "rate_rub", "rate_kzt")}

    def issue(c):
        amount = F.when(~text.is_ticket_cell(c), text.parse_amount(c, rates))
        return F.struct(text.amount_issue(c, amount).alias("issue"), text.is_foreign(c).alias("foreign"))

    got = [(r.issue, r.foreign) for r in values(spark, cells, issue)]
    assert got == [("TICKET_IN_AMOUNT", False)] * 2 + [("", False), ("UNPARSEABLE", False), ("UNPARSEABLE", False), ("", True)]


@pytest.mark.parametrize("a,b,expected", [
    ("12345.00", "12354.00", "TRANSPOSITION"), ("12345.00", "12845.00", "ONE_WRONG_DIGIT"), ("100.00", "100.00", ""),
    ("100.00", "-100.00", ""), ("1.00", "10.00", ""), ("0.05", "0.50", "TRANSPOSITION"), ("12345.00", "12999.00", ""),
])
def test_digit_pattern(spark, a, b, expected):
    row = spark.range(1).select(text.digit_pattern(*(F.lit(x).cast("decimal(18,2)") for x in (a, b))).alias("p")).first()
    assert row.p == expected


def test_document_kind(spark):
    docs = ["Реализация сервисный сбор 1", "Реализация NB", "Возврат 2", "Поступление на р/с", "Приход", "Прочее", None]
    assert values(spark, docs, lambda c: text.document_kind(c, RUSSIAN)) == [
        "service_fee", "sale", "refund", "receipt", "receipt", "other", "other"]


@pytest.mark.parametrize("cell", ["2459531798 2459531800", "9" * 14, "9" * 15, "9" * 20, "9" * 30, "9" * 60, "1" * 30 + " + 5", ("9" * 16 + " + ") * 20 + "1"])
def test_no_cell_ends_a_run(spark, cell):
    row = spark.createDataFrame([(cell, 1.0)], "cell string, r double").withColumn("rate", F.lit("999999").cast("decimal(18,6)"))
    rates = {name: F.col("rate") for name in ("rate_usd", "rate_eur", "rate_rub", "rate_kzt")}
    amount = row.select(text.parse_amount(F.col("cell"), rates).alias("a"), text.parse_amount(F.concat(F.col("cell"), F.lit(" USD")), rates)).first()["a"]
    digits = cell.replace(" ", "")
    if digits.isdigit():
        assert amount == (int(digits) if len(digits) <= 16 else None) or len(digits) > 16 and amount is None


@pytest.mark.parametrize("word,whole,number,day", [
    ("3.", None, 3, False), ("1e5", None, 100_000, False), (".5", None, 0.5, False), ("+7", 7, 7, False), ("٣", None, None, False), ("-0.005", None, -0.01, False),
    ("1e30", None, None, False), ("12a", None, None, False), ("", None, None, False), ("9223372036854775808", None, None, False), ("2024-02-30", None, None, False),
    ("2024-02-29", None, None, True), ("2024-2-9", None, None, False), (".", None, None, False), ("00012", 12, 12, False), ("NaN", None, None, False)])
def test_tolerant_casts(spark, word, whole, number, day):
    row = spark.createDataFrame([(word,)], "w string").select(
        text.whole_number(F.col("w")), text.decimal_number(F.col("w")).cast("double"), text.calendar_day(F.col("w")).isNotNull()).first()
    assert tuple(row) == (whole, number, day)
