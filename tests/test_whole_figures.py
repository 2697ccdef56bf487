"""Figures that are shown are counted exactly, and lists are cut only by a parameter."""

from pyspark.sql import functions as F

from sondeo.operators.commissions import generic_summary
from sondeo.operators.profile import exact_distinct
from sondeo.operators.tables import table_facts
from sondeo.plans.analyze import TableAnalysis


def test_distinct_counts_of_many_labels_are_exact(spark):
    n = 130_000
    rows = spark.range(n).select(F.concat(F.lit("Cliente "), F.col("id")).alias("cliente"), F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("g"))
    assert exact_distinct(rows, {"cliente": F.col("cliente"), "g": F.col("g"), "none": F.lit(None).cast("string")}) == {"cliente": n, "g": 7, "none": 0}
    assert exact_distinct(rows, {}) == {} and exact_distinct(rows.limit(0), {"g": F.col("g")}) == {"g": 0}
    facts = table_facts(rows, "clientes", None)
    assert {c.name: c.n_distinct for c in facts.columns}["cliente"] == n


def test_lists_are_cut_by_parameters_only(spark):
    measures = [f"valor_{i}" for i in range(5)]
    labels = [f"tipo_{i}" for i in range(5)]
    rows = spark.range(60).select("id", *[(F.col("id") * (i + 1) + 0.5).alias(m) for i, m in enumerate(measures)], *[F.concat(F.lit("t"), F.col("id") % (i + 2)).alias(c) for i, c in enumerate(labels)])
    cut = TableAnalysis(rows, "t", ["id"])
    every = TableAnalysis(rows, "t", ["id"], totalled_measures=None, charted_categories=None, charted_totals=None, ranked_categories=None)
    assert len(cut.groups.slots) == 3 and set(every.groups.slots) >= set(measures)
    summed = {r["label"]: r["value"] for r in every.groups.by_value("tipo_0", "valor_4").collect()}
    assert summed == {"t0": sum(5 * i + 0.5 for i in range(0, 60, 2)), "t1": sum(5 * i + 0.5 for i in range(1, 60, 2))}
    assert every.chart_meta.count() == cut.chart_meta.count()       # the charts shown have a limit of their own
    one = generic_summary(rows, "t", measures, max_measures=None, max_columns=None).first()
    assert len(one["measures"]) == 5 and len(one["columns"]) == 11
    assert len(generic_summary(rows, "t", measures, max_measures=2).first()["measures"]) == 2
