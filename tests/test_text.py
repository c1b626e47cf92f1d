import datetime

import pytest
from pyspark.sql import functions as F

from noticelake.functions import text as T


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", column.alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_cleaning(spark):
    assert values(spark, T.clean_message("x"), ["\t- спряно;;\n", " a; ", "; b", None, ""]) == ["- спряно", "a", "; b", None, ""]
    assert values(spark, T.clean_date("x"), [" 03.01.2026 г.\n"]) == ["03.01.2026 г."]
    assert values(spark, T.event_date("x"), [" 03.01.2026 г.", "none", "99.99.2026", None]) == [datetime.date(2026, 1, 3), None, None, None]


def test_ids_and_urls(spark):
    assert values(spark, T.url_id("x"), ["/bg/16151.html", "/bg/a.html", "5.html?x", None, "7"]) == [16151, None, 5, None, None]
    assert values(spark, T.message_url("http://h/100%/", F.lit(7)), ["a"]) == ["http://h/100%/7.html"]


def test_words(spark):
    assert values(spark, T.capitalise("x"), ["вл. варненчик", "a", "", None]) == ["Вл. варненчик", "A", "", None]
    assert values(spark, T.folded_key("x"), [" A@B.c\t"]) == ["a@b.c"]
    chat = values(spark, T.chat_prompt("sys", "x"), ["hi"])[0]
    assert [(m.role, m.content) for m in chat] == [("system", "sys"), ("user", "hi")]


def test_district(spark):
    texts = ["ул. ШИПКА 3", "цар симеон, до шипка", "вл. варненчик 1", "somewhere", None, "галата"]
    assert values(spark, T.district("x"), texts) == ["Център", "Левски", "Вл. варненчик", T.UNKNOWN_DISTRICT, T.UNKNOWN_DISTRICT, "Galata"]


def test_password_strength(spark):
    assert values(spark, T.password_strength("x"), ["", None, "abc", "abcABC", "abcABC12", "abcABC1!", "паролаaB"]) == [0, 0, 0, 1, 3, 4, 3]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Кранът е спрян от 6.45ч. до около 7ч. днес", (405, 420)), ("работим от 7.05 ч.до 22.10 ч.", (425, 1330)), ("от 3.20 до около4.00 ч.", (200, 240)), ("От 5,55 часа до около 18 часа", (355, 1080)),
        ("От 13 часа до около 21:15 часа", (780, 1275)), ("ремонт до 19ч. в квартала", (None, 1140)), ("от 23.00 до 24.00 ч.", (1380, 1440)), ("няма час", (None, None)), (None, (None, None)),
        ("от 15.00ч. на 11.02.2031г. до 16.00ч. на 12.02.2031г", (900, 960)), ("от 25 ч. до 10.75", (None, None)), ("от 11.02.2031 до 12.02.2031", (None, None)), ("от 2-и до 9-и вход", (None, None)),
    ],
)
def test_time_range(spark, text, want):
    found = values(spark, T.time_range(F.col("x")), [text])[0]
    assert (found.start_minute, found.end_minute) == want


def test_clock(spark):
    assert values(spark, T.clock(F.col("x").cast("int")), ["0", "65", "1440", None]) == ["00:00", "01:05", "24:00", None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Промяна в маршрута на линия 31a", ["31A"]), ("автобусни линии 5, 12 и 409 се отклоняват", ["5", "12", "409"]), ("Линия 209 Бърз няма да спира", ["209B"]), ("Затворена спирка на булеварда", ["0"]),
        ("Продажба на карти", None), (None, None), ("линия 7 от 10:30 ч.", ["7"]),
    ],
)
def test_bus_lines(spark, text, want):
    assert values(spark, T.bus_lines("x"), [text])[0] == want


def test_violations(spark):
    rows = spark.createDataFrame([("a@b.c", "longenough", "longenough", "N"), ("ab", "short", "other", " "), (None, None, None, None)], "e string, p string, r string, n string")
    got = [r.v for r in rows.select(T.violations(F.col("e"), F.col("p"), F.col("r"), {"name": F.col("n")}).alias("v")).collect()]
    assert got == [[], ["email_format", "email_length", "password_length", "passwords_differ", "name_missing"], ["email_format", "email_length", "password_length", "name_missing"]]
