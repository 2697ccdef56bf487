"""Golden values of the scalar expressions."""

import pytest
from pyspark.sql import functions as F

from sondeo.functions import names
from sondeo.functions import numbers as N
from sondeo.functions import text as X
from sondeo.functions.dates import from_excel_serial
from sondeo.functions.scoring import currency_code, status

PARSED = {
    "1.234,56": 1234.56, "1,234.56": 1234.56, "1.234": 1234, "1,234": 1234, "1.23": 1.23, "1,5": 1.5, "1,2345": 12345,
    "1.2345": 1.2345, "1.234.567": 1234567, "1.234.56": 1234.56, "(500)": -500, "-500": -500, "−7": -7, "+8": 8,
    "$ 1.500.000 COP": 1500000, "US$ 1,200": 1200, "3 millones": 3e6, "2.5 mil": 2500, "3 mil mm": 3e9, "2M": 2e6,
    "5 k": 5000, "5k": 5, "2mm": 2, "15%": 15, "2024-01-15": 20240115, "Calle 10": 10, "0": 0, "-": None, "": None,
    None: None, "abc": None, "1.234,567,89": None, "--5": -5, "1.000.000,00": 1e6, "12 pesos aprox": 12,
}
REFUSED_WHEN_STRICT = {"2024-01-15", "Calle 10", "5k", "2mm", "abc", "-", "", None, "1.234,567,89"}


def column(spark, values, expression, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_locale_numbers(spark):
    found = dict(zip(PARSED, column(spark, list(PARSED), N.parse_number)))
    assert found == {k: None if v is None else float(v) for k, v in PARSED.items()}


def test_strict_numbers(spark):
    found = dict(zip(PARSED, column(spark, list(PARSED), lambda c: N.parse_number(c, strict=True))))
    wanted = {k: None if k in REFUSED_WHEN_STRICT or v is None else float(v) for k, v in PARSED.items()}
    assert found == wanted


def test_zero_can_be_read_as_missing(spark):
    assert column(spark, ["0", "0,0"], lambda c: N.parse_number(c, zero_is_null=True)) == [None, 0.0]


def test_parser_stays_in_the_jvm(spark):
    plan = spark.createDataFrame([("1",)], "v string").select(N.parse_number(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "*(1)" in plan


@pytest.mark.parametrize("value, kind, compact", [
    (1234567.0, "currency", "COP 1,2 M"), (1.5e9, "currency", "COP 1,5 mil MM"), (250000.0, "number", "250 mil"),
    (950.0, "number", "950"), (12.5, "number", "12,5"), (-1234567.0, "number", "-1,2 M"), (0.85, "percent", "85%"), (0.05, "percent", "5,0%"),
])
def test_display_numbers(spark, value, kind, compact):
    assert column(spark, [value], lambda c: N.format_metric(c, kind), "v double") == [compact]


def test_full_display(spark):
    assert column(spark, [1234.0, 12.0, 0.25, 3.75], N.format_full, "v double") == ["1.234", "12", "0,25", "3,8"]
    assert column(spark, [50.5, 1234.5], lambda c: N.format_full(c, "currency"), "v double") == ["COP 50,50", "COP 1.234"]
    assert column(spark, [5e9, 2.5e6, 1500.0, 7.0], N.format_dollars, "v double") == ["$5.0B", "$2.5M", "$2K", "$7"]


def test_text_predicates(spark):
    words = ["  ", "x", "N/D", "si/no", "ab", "—", "ñu", None, "7", "nan"]
    assert column(spark, words, X.is_noise) == [True, True, True, True, False, True, False, True, True, True]
    assert column(spark, [" N/A ", "0", "ok", None], X.is_placeholder) == [True, False, False, True]
    assert column(spark, ["a_x000d_b\n c", "null", None], X.clean_text) == ["a b c", "", ""]
    assert column(spark, ["Año  Número", None], X.semantic_text) == ["ano numero", ""]
    assert column(spark, ["enero", "2023", "3/4", "mesa", "mes 2", "rojo"], X.is_time_label) == [True, True, True, False, True, False]
    assert column(spark, ["Ã¡rea  de"], X.repair_mojibake) == ["área de"]


def test_serial_dates_leave_small_numbers_alone(spark):
    found = column(spark, [45292.0, 7.0, None], from_excel_serial, "v double")
    assert [str(d) if d else None for d in found] == ["2024-01-01", None, None]


def test_status_and_currency(spark):
    assert column(spark, [50.0, 35.0, 1.0, None], lambda c: status(c, 30, 45), "v double") == ["rojo", "amarillo", "verde", "amarillo"]
    assert column(spark, ["pesos", "us$", "Euro", "libra", "yen", None], currency_code) == ["COP", "USD", "EUR", "GBP", None, None]


def test_header_words_are_tokens():
    assert not names.is_identifier("cantidad") and not names.is_identifier("medida") and names.is_identifier("Id Comisión")
    assert not names.is_date_like("mesa") and names.is_date_like("Mes de pago")
    assert names.metric_kind("Avance %") == "percent" and names.metric_kind("Valor Total") == "currency" and names.metric_kind("Edad") == "number"
    assert names.semantic_role("Plan de Acción") == "activity" and names.semantic_role("Color") is None


def test_unique_names():
    assert names.unique_names(["a", None, "Unnamed: 3", "a", "a", " "]) == ["a", "Col_1", "Col_2", "a_1", "a_2", "Col_5"]
