"""One cell store for all sheets: the same facts as sheet by sheet, in a number of jobs that does not follow the sheets."""

import datetime as dt

from pyspark.sql import functions as F

from sondeo.operators.cellstore import facts_of_sheets, first_whole_numbers, store_cells
from sondeo.operators.cleaning import clean_rows, clean_tables, serial_dates_fixed
from sondeo.operators.tables import table_facts
from sondeo.plans.analyze import WorkbookAnalysis
from sondeo.plans.catalogue.workbooks import whole
from sondeo.sources.catalog import Catalog, Sheet, sheet_table

SF = "/root/testdata/sf0.001"


def assert_same(a, b):
    assert (a.name, a.n_rows, a.informative, a.weak) == (b.name, b.n_rows, b.informative, b.weak)
    assert abs(a.dominant_share - b.dominant_share) < 1e-12
    for x, y in zip(a.columns, b.columns, strict=True):
        for name, value in y.__dict__.items():
            mine = getattr(x, name)
            assert mine == value or abs(mine - value) <= 1e-9 * abs(value), (a.name, x.name, name, mine, value)


def odd_sheets(spark):
    rows = [(i, None if i % 3 else "n/a", "Enero" if i % 2 else "Febrero", 1000.5 * i, dt.datetime(2024, 1, 1 + i % 5), dt.date(2023, 2, 1 + i % 9)) for i in range(40)]
    some = spark.createDataFrame(rows, "`id` long, `vacía` string, `rótulo con.punto` string, valor double, cuando timestamp, dia date")
    empty = spark.createDataFrame([], "a string, b double")
    nested = spark.createDataFrame([([1], {"x": 1}, "t")], "l array<int>, m map<string,int>, t string")
    late = spark.range(3000).select("id", F.when(F.col("id") > 2500, F.col("id") * 2).cast("string").alias("tarde"))
    return [Sheet("2024", some, ["cuando", "dia", "valor", "id"]), Sheet("sin orden", some, []), Sheet("vacía", empty, ["a"]), Sheet("anidada", nested, ["t"]), Sheet("tarde", late, ["id"]),
            Sheet("texto", some, ["vacía", "id"])]


def test_facts_equal_those_of_each_sheet_alone(spark):
    sheets = [s for s in whole(spark, SF).sheets.values() if s.name in ("nation", "customer", "orders", "events", "embeddings")] + odd_sheets(spark)
    for mine, sheet in zip(facts_of_sheets(sheets), sheets, strict=True):
        assert_same(mine, table_facts(sheet.df, sheet.name, sheet.order_by))
    assert facts_of_sheets([]) == []


def test_the_store_is_pruned_by_sheet_and_heads_are_cut_before_they_move(spark):
    store = store_cells(odd_sheets(spark))
    plan = store.cells.where("s = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(s" in plan
    assert "WindowGroupLimit" in first_whole_numbers(store)._jdf.queryExecution().executedPlan().toString()


def test_sheet_table_reads_the_first_rows_in_order(spark):
    rows = {r["sheet"]: r for r in sheet_table(Catalog("libro", {s.name: s for s in odd_sheets(spark)})).collect()}
    assert {n: r["n_rows"] for n, r in rows.items()} == {"2024": 40, "sin orden": 40, "vacía": 0, "anidada": 1, "tarde": 3000, "texto": 40}
    assert rows["tarde"]["signature"] == "tarde id tarde 0 1 2 3"
    assert rows["2024"]["signature"].startswith("2024 id vacia rotulo con punto valor cuando dia 0 n a febrero 0 0") and rows["vacía"]["signature"] == "vacia a b"
    assert [r["ord"] for r in sorted(rows.values(), key=lambda r: r["ord"])] == list(range(6))


def test_serial_dates_of_many_tables_are_judged_by_one_job(spark):
    days = spark.createDataFrame([(45000.0, 1), (45001.0, 2)], "fecha double, n int")
    not_days = spark.createDataFrame([(45000.0, 1), (3.0, 2)], "fecha double, n int")
    empty = spark.createDataFrame([(None, 1)], "fecha double, n int")
    fixed = serial_dates_fixed([days, not_days, spark.range(2), empty])
    assert [dict(t.dtypes).get("fecha") for t in fixed] == [clean_rows(days).dtypes[0][1], "double", None, "double"]
    assert [t.count() for t in clean_tables([days, not_days])] == [2, 2]


def jobs_of(spark, group, n):
    sheets = {f"hoja {i}": Sheet(f"hoja {i}", spark.range(0, 4 + i % 3, 1, 1).select("id", F.concat(F.lit("x"), F.col("id") % 2).alias("grupo"), (F.col("id") * 1.5).alias("valor")), ["id"]) for i in range(n)}
    spark.sparkContext.setJobGroup(group, group)
    try:
        book = WorkbookAnalysis(Catalog("libro", sheets))
        assert len(book.reports) == n == len(book._found)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_forty_sheets_take_as_many_jobs_as_five(spark):
    few, many = jobs_of(spark, "few sheets", 5), jobs_of(spark, "many sheets", 40)
    assert 0 < many <= few + 2          # broadcast or sorted join, as sizes suggest
