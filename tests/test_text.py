from __future__ import annotations

import datetime

import pytest

from tenura.functions import text
from tenura.operators import quality

CASES = [
    ("42", 42.0, "direct"), ("3.14", 3.14, "direct"), ("1e3", 1000.0, "direct"), ("-7", -7.0, "direct"),
    (" 5 ", 5.0, "direct"), (".5", 0.5, "direct"), ("5.", 5.0, "direct"),
    ("1,5", 1.5, "repare"), ("1,234", 1234.0, "repare"), ("1.234,56", 1234.56, "repare"),
    ("1,234.56", 1234.56, "repare"), ("1 234", 1234.0, "repare"), ("1 234", 1234.0, "repare"),
    ("1 234,5", 1234.5, "repare"), ("50.0%", 50.0, "repare"), ("45 €", 45.0, "repare"),
    ("12.5 h", 12.5, "repare"), ("30j", 30.0, "repare"), ("45 MIN", 45.0, "repare"), ("12,50", 12.5, "repare"),
    ("1.234.567,8", 1234567.8, "repare"), ("1.2,567", 12.567, "repare"),
    ("", None, "manquant"), ("N/A", None, "manquant"), (" nd ", None, "manquant"), ("-", None, "manquant"),
    ("Inconnu", None, "manquant"), (None, None, "manquant"),
    ("bonjour", None, "irrecuperable"), ("search", None, "irrecuperable"), ("inf", None, "irrecuperable"),
    ("1,2,3", None, "irrecuperable"), ("30d", None, "irrecuperable"), ("1_000", None, "irrecuperable"),
]


def test_coerce_number_cases(spark):
    rows = [(i, v) for i, (v, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string")
    got = {r.i: (r.c["value"], r.c["status"]) for r in df.select("i", text.coerce_number("v").alias("c")).collect()}
    wrong = {CASES[i][0]: got[i] for i in got if got[i] != CASES[i][1:]}
    assert not wrong


def test_coercion_report_counts_every_status(spark):
    df = spark.createDataFrame([("1",), ("1,5",), ("n/a",), ("abc",), (None,)], "v string")
    row = quality.coercion_report(df, ["v", "absent"]).first()
    assert tuple(row)[1:] == (1, 1, 2, 1)


@pytest.mark.parametrize(
    ("values", "convention", "expected"),
    [
        (["02/13/2021", "01/02/2021"], "MM/DD/YYYY", [(2021, 2, 13), (2021, 1, 2)]),
        (["13/02/2021", "01/02/2021"], "DD/MM/YYYY", [(2021, 2, 13), (2021, 2, 1)]),
        (["01/02/2021", "03/04/2021"], "DD/MM/YYYY", [(2021, 2, 1), (2021, 4, 3)]),
        (["2021-1-5", "2021/03/07", "05-06-2021", "05.06.2021", "3 Jan 2021", "3 January 2021", "20210105"], "", [
            (2021, 1, 5), (2021, 3, 7), (2021, 6, 5), (2021, 6, 5), (2021, 1, 3), (2021, 1, 3), (2021, 1, 5)]),
    ],
)
def test_parse_dates(spark, values, convention, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d string")
    assert quality.slash_convention(df, "d").first()["convention"] == convention
    got = [r.d for r in quality.parse_dates(df, ["d"]).orderBy("i").collect()]
    assert got == [datetime.date(*e) for e in expected]


def test_date_report_counts_unreadable_values(spark):
    df = spark.createDataFrame([("2021-01-05",), ("31/02/2021",), ("hier",), ("",), (None,)], "d string")
    row = quality.date_report(df, ["d"]).first()
    assert (row.nb_parsees, row.nb_irrecuperables, row.format_detecte) == (1, 2, "%Y-%m-%d")
