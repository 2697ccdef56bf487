"""Records that cannot be read, stores read by pruning, repeatable audits, files of a plan, and how columns write dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sondeo.functions.dates import date_votes, parse_timestamp, unread_dates
from sondeo.operators import audit as A
from sondeo.plans.analyze import TableAnalysis
from sondeo.sources import sinks
from sondeo.sources.catalog import load_catalog

SF = "/root/testdata/sf0.001"


def jobs_of(spark, work):
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_files_of_a_plan_are_named_without_reading(spark):
    orders, customer = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").count()
    assert jobs_of(spark, lambda: A.referenced_paths(joined)) == 0
    assert sorted(r.path.rsplit("/", 1)[1] for r in A.referenced_paths(joined).collect()) == ["customer.parquet", "orders.parquet"]
    assert A.referenced_paths(spark.range(3)).count() == 0


def test_organised_store_reads_only_the_sheets_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([("007", 1), ("007", 2), ("b c/d", 3), (None, 4)], "sheet string, n int")
    tags = spark.createDataFrame([("007", "siete"), ("b c/d", "otra")], "sheet string, title string")
    sinks.write_organised(rows, tags, str(tmp_path))
    back, titles = sinks.read_organised(spark, str(tmp_path), ["007"])
    assert sorted((r.sheet, r.n) for r in back.collect()) == [("007", 1), ("007", 2)] and [r.title for r in titles.collect()] == ["siete"]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sheet" in plan or "PartitionFilters: [(sheet" in plan
    whole = sinks.read_organised(spark, str(tmp_path))[0]
    assert sorted((r.sheet or "", r.n) for r in whole.collect()) == [("", 4), ("007", 1), ("007", 2), ("b c/d", 3)]


def test_a_repeated_run_replaces_its_own_record(spark, tmp_path):
    records = lambda *rows: spark.createDataFrame(rows, "run_id string, n int")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    sinks.record_runs(records(("007", 1), ("7", 2), ("a/b", 3)), str(tmp_path))
    sinks.record_runs(records(("007", 9), ("c", 4)), str(tmp_path))
    sinks.record_runs(records(("007", 9), ("c", 4)), str(tmp_path))
    found = sinks.recorded_runs(spark, str(tmp_path), "run_id string, n int")
    assert sorted(map(tuple, found.collect())) == [("007", 9), ("7", 2), ("a/b", 3), ("c", 4)]
    assert [r.n for r in sinks.recorded_runs(spark, str(tmp_path), "run_id string, n int", ["7"]).collect()] == [2]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


@pytest.mark.parametrize("fmt, lines, refused", [
    ("csv", ["1,a,2.5", "dos,b,1", "3,c", "4,d,7,8", "5,,", ""], {"dos,b,1", "3,c", "4,d,7,8"}),
    ("json", ['{"k": 1, "t": "a", "v": 2.5}', '{"k": "dos"}', "{roto", '{"k": 5, "record": 1}', ""], {'{"k": "dos"}', "{roto"}),
])
def test_refused_records_stay_as_they_are(spark, tmp_path, fmt, lines, refused):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.txt").write_text("\n".join(lines))
    book = load_catalog(spark, "w", {"s": str(tmp_path / "x"), "gone": str(tmp_path / "y")}, fmt, schemas={"s": "k bigint, t string, v double", "gone": "k int"})
    assert sorted(r.k for r in book.sheets["s"].df.collect()) == [1, 5] and book.sheets["s"].df.columns == ["k", "t", "v"]
    told = book.rejected.collect()
    assert {r.record for r in told} == refused and {r.file.rsplit("/", 1)[1] for r in told} == {"one.txt"}
    assert set(book.errors) == {"gone"} and load_catalog(spark, "w", {"s": str(tmp_path / "x")}, fmt).rejected is None


def test_a_column_votes_for_its_order_of_dates(spark):
    rows = [("13/05/2024", "05-13-2024", "1/2/2024", None, 45000, dt.date(2024, 1, 1)), ("1/2/2024", "02-01-2024 9:05", "3/4/2024", "", 3, None),
            ("nada", "12-31-2024 23:59:01", "99/99/2024", " ", None, None)]
    df = spark.createDataFrame(rows, "`a b` string, m string, o string, e string, serial int, d date")
    found = {r.column: r for r in date_votes(df, df.columns).collect()}
    assert {c: (r.n, r.n_day, r.n_month, r.n_open, r.date_order, r.n_unread) for c, r in found.items()} == {
        "a b": (3, 1, 0, 1, "day", 1), "m": (3, 0, 2, 1, "month", 0), "o": (3, 0, 0, 2, "undecided", 1), "e": (0, 0, 0, 0, "none", 0),
        "serial": (2, 0, 0, 0, "none", 1), "d": (1, 0, 0, 0, "none", 0)}
    assert {r.column: r.n for r in date_votes(df.limit(0), ["m"]).collect()} == {"m": 0}
    assert unread_dates(df, "m").first()[0] == 0
    read = df.select(parse_timestamp(F.col("m"), df.schema["m"].dataType, True).alias("t")).collect()
    assert [r.t.day for r in read] == [13, 1, 31]


def test_the_trend_reads_the_month_first_where_the_column_does(spark):
    rows = [(i, f"{i % 12 + 1}/{i % 28 + 1}/2023" if i % 10 else "pendiente", 100.0 + 7.25 * i) for i in range(120)]
    done = TableAnalysis(spark.createDataFrame(rows, "n int, fecha string, importe double"), "t", ["n"])
    assert (done.date, done.timed_measure) == ("fecha", "importe")
    assert (done.date_reading.first().date_order, done.date_reading.first().n_unread) == ("month", 12)
    wanted = {}
    for i, text, amount in rows:
        if i % 10:
            wanted[i % 12 + 1] = wanted.get(i % 12 + 1, 0) + amount
    assert {r.period.month: r.value for r in done.trend.collect()} == pytest.approx(wanted)
    assert "date_reading" in done.tables()
