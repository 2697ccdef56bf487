"""The paths taken beyond one task's reach must give the same results as the short ones."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondeo.operators import groups as G
from sondeo.operators import quantiles
from sondeo.operators.outliers import outliers
from sondeo.operators.pareto import pareto
from sondeo.operators.profile import profile_columns
from sondeo.operators.quality import duplicate_rows
from sondeo.operators.quantiles import exact_quantiles
from sondeo.operators.running import first_appearances, forward_fill, running_totals
from sondeo.session import settle

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(3)


@pytest.mark.parametrize("name, values", [
    ("heavy tail", [math.exp(i / 40) for i in range(1500)]),
    ("hot value", [5.0] * 600 + [float(i) for i in range(900)]),
    ("two values", [0.0] * 500 + [1.0] * 501),
    ("one value", [3.0] * 40),
    ("negative", [-(i ** 3) * 0.1 for i in range(700)]),
    ("widest", [-1.7e308, 0.0, 1.0, 2.0, 1.7e308] * 20),
])
def test_quantiles_by_narrowing(spark, name, values):
    random.Random(1).shuffle(values)
    found = exact_quantiles(doubles(spark, values), {"v": F.col("v")}, PROBS, sortable_values=0)["v"]
    wanted = np.quantile(np.array(values, dtype=np.longdouble), PROBS)
    assert np.allclose(found, wanted.astype(float), rtol=1e-12, atol=0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_of_anything(spark, values):
    found = exact_quantiles(doubles(spark, values), {"v": F.col("v")}, (0.25, 0.5, 0.75), sortable_values=3)["v"]
    assert np.allclose(found, np.quantile(values, (0.25, 0.5, 0.75)))


@pytest.mark.parametrize("name, values", [
    ("orders of magnitude", [10.0 ** (i / 10 - 300) for i in range(6001)]),
    ("hot value", [7.0] * 3000 + [1e-300 * i for i in range(1500)] + [1e300 * i / 1500 for i in range(1500)]),
    ("both signs", [(-1) ** i * math.exp(i / 10) for i in range(6000)]),
])
def test_quantiles_take_three_passes_for_any_range(spark, monkeypatch, name, values):
    """One sketch, one count and one ordering of few values: no matter how the values are spread."""
    passes, ordered = [], []
    borders, count, order = quantiles._borders, quantiles._count_cells, quantiles._order_rest
    monkeypatch.setattr(quantiles, "_borders", lambda *a: passes.append("sketch") or borders(*a))
    monkeypatch.setattr(quantiles, "_count_cells", lambda *a: passes.append("count") or count(*a))
    monkeypatch.setattr(quantiles, "_order_rest", lambda views, left: ordered.extend(s.inside for s in left) or order(views, left))
    random.Random(2).shuffle(values)
    found = exact_quantiles(doubles(spark, values), {"v": F.col("v")}, PROBS, sortable_values=100, accuracy=500)["v"]
    assert np.allclose(found, np.quantile(np.array(values, dtype=np.longdouble), PROBS).astype(float), rtol=1e-12, atol=0)
    assert passes == ["sketch", "count"] and all(n <= 100 for n in ordered)


def test_quantiles_of_many_columns_need_three_jobs(spark):
    """Jobs do not follow the number of columns."""
    n = 4000
    df = spark.range(n).select(*[((F.col("id") * (2 * i + 1)) % n).cast("double").alias(f"c{i}") for i in range(12)])
    facts = {f"c{i}": (n, 0.0, n - 1.0) for i in range(12)}
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    found = exact_quantiles(df, {c: F.col(c) for c in facts}, (0.5,), facts=facts, sortable_values=100, accuracy=1000)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    wanted = {f"c{i}": np.median([(j * (2 * i + 1)) % n for j in range(n)]) for i in range(12)}
    assert {c: v for c, (v,) in found.items()} == wanted
    assert len(jobs) <= 8      # adaptive plans run a job for each shuffle


COMPILED = 8_000      # bytes; the JVM leaves longer methods to its interpreter


def method_sizes(df):
    """The longest generated method of each stage of a query that has run."""
    told = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]


def test_cells_of_many_columns_are_counted_in_compiled_code(spark, monkeypatch):
    n, wide, sizes = 1000, 12, []
    df = spark.range(n).select(*[F.when(F.col("id") % (i + 2) != 0, (F.col("id") * (2 * i + 1)) % n).cast("double").alias(f"v{i}") for i in range(wide)])
    collect = type(df).collect

    def collected(self):
        rows = collect(self)
        sizes.extend(method_sizes(self))
        return rows

    monkeypatch.setattr(type(df), "collect", collected)
    borders = {i: [0.0, 99.5, *(100.0 * k for k in range(1, 4 + i % 5)), 999.0] for i in range(wide) if i != 3}      # not equally many
    counted = quantiles._count_cells(df, borders)
    monkeypatch.undo()
    assert sizes and max(sizes) <= COMPILED
    for i, edges in borders.items():
        cells = {}
        for v in ((j * (2 * i + 1)) % n for j in range(n) if j % (i + 2)):
            cells.setdefault(sum((v >= b) + (v > b) for b in edges), []).append(v)
        assert [(r["n"], r["lo"], r["hi"]) for r in counted[i]] == [(len(vs), min(vs), max(vs)) for _, vs in sorted(cells.items())]


def test_a_profile_reads_numbers_apart_from_texts(spark, monkeypatch):
    """A text or a sketch beside them must not take the sums of number columns out of compiled code."""
    numbers = [F.col("id").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") * 0.5).alias("c"), (F.col("id") % 3).alias("d")]
    texts = [F.concat(F.lit("x"), F.col("id") % 4).alias("e"), F.concat(F.lit("1.00"), F.col("id") % 5).alias("f"), F.lit(None).cast("string").alias("g")]
    df = spark.range(300).select(*numbers, *texts)
    read, first = [], type(df).first

    def seen(self):
        self.collect()      # ``first`` runs another query, with a limit
        read.append((self._jdf.queryExecution().optimizedPlan().toString(), method_sizes(self)))
        return first(self)

    monkeypatch.setattr(type(df), "first", seen)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    found = {p.column: p for p in profile_columns(df)}
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    monkeypatch.undo()
    sums = [(plan, sizes) for plan, sizes in read if plan.count("stddev_samp(") >= len(numbers)]
    assert len(sums) == 1 and "approx_count_distinct" not in sums[0][0] and "RLIKE" not in sums[0][0]
    assert len(sums[0][1]) == 2 and max(sums[0][1]) <= COMPILED      # before and after the shuffle
    assert {c: (p.role, p.n, p.n_missing) for c, p in found.items()} == {
        "a": ("numerico", 300, 0), "b": ("numerico", 300, 0), "c": ("numerico", 300, 0), "d": ("numerico", 300, 0),
        "e": ("categorica", 300, 0), "f": ("numerico", 300, 0)}
    assert found["e"].n_distinct == 4 and found["a"].stats["total"] == 44850.0 and found["b"].stats["max"] == 6.0


def test_quantiles_ignore_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, (0.5,)) == {"a": [2.0], "b": [None]}


def test_running_totals_across_slices(spark):
    rows = [(f"k{i:04d}", (i * 7) % 13) for i in range(800)]   # long runs of equal values
    df = spark.createDataFrame(rows, "label string, value bigint")
    order = [F.col("value").desc(), F.col("label").asc()]
    found = running_totals(df, order, "value", "run", "rank").orderBy("rank").collect()
    wanted, total = [], 0
    for rank, (label, value) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += value
        wanted.append((label, value, total, rank))
    assert [tuple(r[c] for c in ("label", "value", "run", "rank")) for r in found] == wanted


def test_pareto_shares_climb_to_the_whole(spark):
    rows = [("a", 50.0)] * 7 + [(f"t{i}", float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "c string, v double")
    one = pareto(df, "c", F.col("v")).orderBy("rank").collect()
    assert one[0].label == "a" and [r.rank for r in one] == list(range(1, len(one) + 1))
    shares = [r.cum_share for r in one]
    assert shares == sorted(shares) and shares[-1] == 100.0


def test_forward_fill_over_blocks(spark):
    rows = [("s", i, "g%d" % i if i in (3, 4, 250) else None) for i in range(400)] + [("t", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "sheet string, row_ord bigint, g string").repartition(4)
    found = {(r.sheet, r.row_ord): r.g for r in forward_fill(df, "g", "row_ord", ["sheet"], block_rows=17).collect()}
    last, wanted = None, {}
    for sheet, i, g in rows:
        last = (g or last) if sheet == "s" else None
        wanted[sheet, i] = last
    assert found == wanted


def test_first_appearances_keeps_the_earliest(spark):
    df = spark.createDataFrame([(5, "A"), (1, "b"), (2, "a"), (3, "B"), (4, " ")], "i int, t string")
    found = first_appearances(df, F.lower(F.trim("t")), "i").orderBy("i").collect()
    assert [(r.i, r.t) for r in found] == [(1, "b"), (2, "a")]


def test_duplicates_count_nulls_by_position(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None), (None, None)], "x string, y string")
    assert duplicate_rows(df).first()[0] == 2


def test_top_with_others_keeps_the_total(spark):
    df = spark.createDataFrame([(c, 1) for c in "aaaabbbccdef"], "c string, n int")
    top = G.top_with_others(G.frequency(df, "c"), 3).orderBy("ord").collect()
    assert [(r.label, r.value) for r in top] == [("a", 4), ("b", 3), ("Otros", 5)]
    assert {r.label for r in G.top_with_others(G.frequency(df, "c"), 6).collect()} == set("abcdef")


def test_outlier_examples_keep_repeats(spark):
    df = doubles(spark, [float(i) for i in range(20)] + [900.0, 900.0, 800.0, 700.0])
    row = outliers(df, {"v": F.col("v")}).first()
    assert row.n_outliers == 4 and row.examples == [900.0, 900.0, 800.0]
    assert outliers(doubles(spark, [1.0] * 20), {"v": F.col("v")}).count() == 0


def test_settled_tables_cut_lineage(spark):
    table = settle(spark.range(50).withColumn("r", F.rand()))
    assert table.count() == 50 and table.collect() == table.collect()


def test_correlation_of_a_constant_is_null(spark):
    from sondeo.operators.correlation import correlations

    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(6)], "a double, b double, c double")
    found = correlations(df, {c: F.col(c) for c in "abc"}).collect()
    assert [(r.col_a, r.col_b, r.r, r.label) for r in found] == [("a", "b", 1.0, "positiva fuerte")]
