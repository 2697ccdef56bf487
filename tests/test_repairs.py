"""Cases that once lost data, failed or said the wrong thing."""

import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.dates import parse_timestamp, unread_dates
from sondeo.functions.numbers import number_view
from sondeo.functions.text import semantic_text
from sondeo.operators.cleaning import clean_rows, fix_serial_dates
from sondeo.operators.correlation import correlations
from sondeo.operators.money import currency_alerts, money_facts
from sondeo.operators.quality import data_quality, duplicate_rows
from sondeo.operators.trend import periodic_totals, trend_summary
from sondeo.plans.analyze import TableAnalysis, merged_statements
from sondeo.sources.catalog import load_catalog
from sondeo.sources.grid import read_grid


def test_cleaning_loses_no_number(spark):
    df = spark.createDataFrame([(1, 45_000, 20240101, 7, 45_000), (12, 45_010, 20240102, 25, 3)], "mes int, fecha int, fecha_corte int, candidates int, date int")
    out = clean_rows(df)
    assert out.schema["fecha"].dataType == T.DateType() and out.orderBy("mes").first()["fecha"] == dt.date(2023, 3, 15)
    assert out.drop("fecha").collect() == df.drop("fecha").collect()
    assert fix_serial_dates(spark.createDataFrame([], "fecha int")).columns == ["fecha"]


def test_rows_of_several_files_follow_one_another(spark, tmp_path):
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/g")
    grid = read_grid(spark, f"{tmp_path}/g", "w", "s", skip_rows=3)
    assert {(r["row_ord"], r["cells"][0]) for r in grid.collect()} == {(i, str(i)) for i in range(3, 100)}


def test_date_shapes(spark):
    texts = ["2024-01-15 10:30", "2024-01-15 10:30:00.123", "2024-01-15T10:30:00Z", "2024-01-15T10:30:00+00:00", "15/01/2024 10:30", "2024-1-15", "15.1.2024", "2024/1/15", "2024-01"]
    df = spark.createDataFrame([(t,) for t in texts] + [("soon",), (" ",), (None,)], "t string")
    read = [r[0] for r in df.select(parse_timestamp(F.col("t"), T.StringType())).collect()]
    assert all(r is not None and (r.year, r.month) == (2024, 1) for r in read[: len(texts)]) and read[len(texts):] == [None] * 3
    assert unread_dates(df, "t").first()[0] == 1


def test_decomposed_accents_keep_words_whole(spark):
    text = "Año número Škoda Łódź Đ ﬁn"
    df = spark.createDataFrame([(text,), (unicodedata.normalize("NFD", text),), (unicodedata.normalize("NFC", text),)], "t string")
    assert {r[0] for r in df.select(semantic_text(F.col("t"))).collect()} == {"ano numero skoda odz fin"}


def test_folding_equals_unicode_decomposition_of_every_character(spark):
    def key(text):
        plain = "".join(x for x in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(x))
        return " ".join(re.sub("[^a-z0-9]+", " ", plain).split())

    points = [chr(c) for c in (*range(0x20, 0xD800), *range(0xE000, 0x20000)) if not unicodedata.category(chr(c)).startswith(("M", "C"))]
    texts = ["b" + "b".join(points[i : i + 50]) + "b" for i in range(0, len(points), 50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    # Java and Python know different versions of Unicode's lower case; letters that one of them does not lower are left aside
    got = df.select("t", semantic_text(F.col("t")), F.lower("t")).collect()
    checked = [(t, mine) for t, mine, low in got if low == t.lower()]
    assert len(checked) > 0.95 * len(texts) and all(mine == key(t) for t, mine in checked)


def test_infinity_is_no_number(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,)], "v double")
    assert [r[0] for r in df.select(number_view(F.col("v"), T.DoubleType())).collect()] == [None, None, 2.0]
    assert TableAnalysis(df, "t", ["v"]).profiles[0].column == "v"


def test_maps_are_compared(spark):
    df = spark.createDataFrame([({"a": 1},), ({"a": 1},), ({"a": 2},)], "m map<string,int>")
    assert duplicate_rows(df).first()[0] == 1 and data_quality(df, "s").first()["total_rows"] == 3


def test_corrupt_files_are_reported(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("this is no table")
    spark.range(3).write.parquet(f"{tmp_path}/good.parquet")
    book = load_catalog(spark, "w", {"bad": f"{tmp_path}/bad.parquet", "none": f"{tmp_path}/none.parquet", "good": f"{tmp_path}/good.parquet"})
    assert set(book.sheets) == {"good"} and set(book.errors) == {"bad", "none"}


def test_single_columns_have_no_pairs(spark):
    assert correlations(spark.range(9), {"id": F.col("id")}).collect() == []


def test_two_dated_rows_are_no_trend(spark):
    rows = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 2, 1), 5.0)]
    df = spark.createDataFrame([*rows, (None, 3.0)], "t timestamp, v double")
    assert trend_summary(periodic_totals(df, F.col("t"), F.col("v"))).collect() == []
    more = spark.createDataFrame([*rows, rows[0]], "t timestamp, v double")
    assert trend_summary(periodic_totals(more, F.col("t"), F.col("v"))).count() == 1


def test_pareto_falls_back_to_counts(spark):
    df = spark.createDataFrame([(f"k{i % 4}", -1.5 - i) for i in range(40)], "tipo string, saldo double")
    summary = TableAnalysis(df, "t", ["saldo"]).pareto_summary.collect()
    assert [(r["category_col"], r["value_col"], r["n_categories"]) for r in summary] == [("tipo", "conteo", 4)]


def test_statements_of_equal_meaning_are_said_once(spark):
    notes = spark.createDataFrame([("Revisión de controles.",), ("Otra nota",)], "text string")
    said = spark.createDataFrame([(1, "revision de CONTROLES"), (2, "Dato nuevo"), (3, "")], "ord int, text string")
    rows = merged_statements(notes, said, 3).orderBy("ord").collect()
    assert [(r["origin"], r["text"]) for r in rows][1:] == [("workbook", "Otra nota"), ("table", "Dato nuevo")] and len(rows) == 3


def test_currency_alerts(spark):
    df = spark.createDataFrame([(100.0, "USD", None), (50.0, "COP", None)] * 5, "valor double, moneda string, trm double")
    rows = currency_alerts(money_facts(df, ["valor"])).collect()
    assert [(r["column"], r["currencies"]) for r in rows] == [("valor", ["COP", "USD"])]
