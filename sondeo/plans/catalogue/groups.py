"""Grouping, top-k, Pareto and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.operators import groups as G
from sondeo.operators.audit import new_titles
from sondeo.operators.pareto import pareto, pareto_summary, pareto_top
from sondeo.operators.running import first_appearances, forward_fill
from sondeo.plans.catalogue import add, query, table


# ---- Pareto -----------------------------------------------------------------------------
def pareto_sql(source: str, label: str, value: str) -> str:
    return f"""
WITH g AS (SELECT trim({label}::VARCHAR) AS label, {value} AS value FROM {source} GROUP BY 1),
p AS (SELECT * FROM g WHERE value > 0),
r AS (SELECT label, value, row_number() OVER o AS rank, sum(value) OVER () AS total,
             sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS running
      FROM p WINDOW o AS (ORDER BY value DESC, label))
SELECT label, round(value::DOUBLE, 2) AS value, rank, round_even(value / total * 100, 1) AS share,
       round_even(running / total * 100, 1) AS cum_share FROM r"""


def summary_sql(source: str, label: str, value: str, value_name: str) -> str:
    return f"""
WITH s AS ({pareto_sql(source, label, value)}),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE cum_share <= 80) AS below, max(share) FILTER (WHERE rank = 1) AS top,
             max(label) FILTER (WHERE rank = 1) AS leader FROM s),
m AS (SELECT *, least(below + 1, n) AS n80 FROM c)
SELECT '{label}' AS category_col, '{value_name}' AS value_col, n AS n_categories, n80, round_even(n80 / n * 100, 0) AS pct80,
       CASE WHEN round_even(n80 / n * 100, 0) <= 25 THEN 'alta' WHEN round_even(n80 / n * 100, 0) <= 50 THEN 'moderada'
            ELSE 'dispersa' END AS concentration, left(leader, 40) AS leader, top AS leader_share
FROM m WHERE n >= 3"""


PARETOS = {
    "event_type": ("events", "event_type", "value"),
    "user_value": ("events", "user_id", "value"),
    "part_value": ("lineitem", "l_partkey", "l_extendedprice"),
    "supplier_value": ("lineitem", "l_suppkey", "l_extendedprice"),
    "lang_count": ("documents", "lang", None),
    "source_count": ("documents", "source", None),
    "priority_count": ("orders", "o_orderpriority", None),
}

for _name, (_t, _label, _value) in PARETOS.items():
    def _shares(spark, sf, t=_t, label=_label, value=_value):
        shares = pareto(table(spark, sf, t), label, F.col(value) if value else None)
        return shares.withColumn("value", F.round(F.col("value").cast("double"), 2))

    def _summary(spark, sf, t=_t, label=_label, value=_value):
        return pareto_summary(pareto(table(spark, sf, t), label, F.col(value) if value else None), label, value or "conteo")

    _agg = f"sum({_value})" if _value else "count(*)"
    add(f"pareto_{_name}", _shares, pareto_sql(_t, _label, _agg))
    add(f"pareto_summary_{_name}", _summary, summary_sql(_t, _label, _agg, _value or "conteo"))


@query(f"SELECT * FROM ({pareto_sql('lineitem', 'l_partkey', 'sum(l_extendedprice)')}) WHERE rank <= 5")
def pareto_top_parts(spark, sf):
    shares = pareto(table(spark, sf, "lineitem"), "l_partkey", F.col("l_extendedprice"))
    return pareto_top(shares).withColumn("value", F.round("value", 2))


# ---- plain groups --------------------------------------------------------------------------
@query("SELECT lang AS label, count(*) AS value FROM documents GROUP BY 1")
def frequency_lang(spark, sf):
    return G.frequency(table(spark, sf, "documents"), "lang")


@query("SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1")
def totals_by_brand(spark, sf):
    return G.totals(table(spark, sf, "part"), "p_brand", F.col("p_retailprice")).withColumn("value", F.round("value", 2))


@query("""
SELECT o_custkey::VARCHAR AS label, round(sum(o_totalprice), 2) AS value, count(o_orderkey) AS n
FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, label LIMIT 8""")
def multi_agg_top8_customers(spark, sf):
    grouped = G.totals_and_counts(table(spark, sf, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey")
    return G.top_groups(grouped, 8).withColumn("value", F.round("value", 2))


@query("""
SELECT 'quantity' AS label, round(sum(l_quantity), 2) AS value FROM lineitem UNION ALL
SELECT 'price', round(sum(l_extendedprice), 2) FROM lineitem UNION ALL
SELECT 'discount', round(sum(l_extendedprice * l_discount), 2) FROM lineitem""")
def measure_totals(spark, sf):
    discount = F.col("l_extendedprice") * F.col("l_discount")
    sums = G.measure_totals(table(spark, sf, "lineitem"), {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": discount})
    return sums.select("label", F.round("value", 2).alias("value"))


@query("""
SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities,
       count(DISTINCT CASE WHEN length(o_orderpriority) > 5 THEN o_orderpriority END) AS long_priorities FROM orders""")
def distinct_counts_orders(spark, sf):
    long = F.when(F.length("o_orderpriority") > 5, F.col("o_orderpriority"))
    return G.distinct_counts(table(spark, sf, "orders"), {
        "customers": F.col("o_custkey"), "priorities": F.col("o_orderpriority"), "long_priorities": long})


@query("""
WITH c AS (SELECT unnest(['l_returnflag', 'l_linestatus']) AS "column", unnest([l_returnflag, l_linestatus]) AS label,
                  l_quantity, l_extendedprice FROM lineitem)
SELECT "column", label, count(*) AS n, round(sum(l_quantity), 2) AS s0, round(sum(l_extendedprice), 2) AS s1
FROM c GROUP BY 1, 2""")
def category_totals_lineitem(spark, sf):
    amounts = {"l_quantity": F.col("l_quantity"), "l_extendedprice": F.col("l_extendedprice")}
    rows = G.category_totals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], amounts)
    return rows.withColumn("s0", F.round("s0", 2)).withColumn("s1", F.round("s1", 2))


# ---- top-k with others ---------------------------------------------------------------------
def others_sql(source: str, label: str, value: str, k: int) -> str:
    return f"""
WITH g AS (SELECT {label}::VARCHAR AS label, {value} AS value FROM {source} GROUP BY 1),
r AS (SELECT label, value, row_number() OVER (ORDER BY value DESC, label) AS rn, count(*) OVER () AS n FROM g WHERE value > 0)
SELECT (CASE WHEN n <= {k} OR rn < {k} THEN rn ELSE {k} END)::BIGINT AS ord,
       CASE WHEN n <= {k} OR rn < {k} THEN left(label, 30) ELSE 'Otros' END AS label, round(sum(value)::DOUBLE, 2) AS value
FROM r GROUP BY 1, 2"""


for _name, (_t, _label, _value, _k) in {
    "segment": ("customer", "c_mktsegment", None, 4),
    "brand": ("part", "p_brand", None, 5),
    "part_value": ("lineitem", "l_partkey", "l_extendedprice", 6),
    "user_value": ("events", "user_id", "value", 5),
}.items():
    def _others(spark, sf, t=_t, label=_label, value=_value, k=_k):
        df = table(spark, sf, t)
        grouped = G.totals(df, label, F.col(value)) if value else G.frequency(df, label)
        top = G.top_with_others(grouped, k)
        return top.select(F.col("ord").cast("bigint").alias("ord"), "label", F.round(F.col("value").cast("double"), 2).alias("value"))

    add(f"topk_others_{_name}", _others, others_sql(_t, _label, f"sum({_value})" if _value else "count(*)", _k))


@query("""
WITH g AS (SELECT c_mktsegment AS label, count(*) AS value FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn, sum(value) OVER () AS total, count(*) OVER () AS n FROM g)
SELECT max(label) FILTER (WHERE rn = 1) AS leader, max(value) FILTER (WHERE rn = 1) AS leader_value,
       max(round_even(value / total * 100, 1)) FILTER (WHERE rn = 1) AS leader_share,
       max(label) FILTER (WHERE rn = 2) AS second,
       max(round_even(value / total * 100, 1)) FILTER (WHERE rn = 2) AS second_share,
       max(n) AS n_groups, max(total)::BIGINT AS total FROM r""")
def leaders_segment(spark, sf):
    return G.leaders(G.frequency(table(spark, sf, "customer"), "c_mktsegment"))


@query("""
WITH g AS (SELECT lang AS label, count(*) AS value FROM documents GROUP BY 1),
r AS (SELECT *, sum(value) OVER () AS total, row_number() OVER (ORDER BY value DESC, label) AS rn FROM g)
SELECT 'lang' AS "column", label AS leader, value AS leader_value, round_even(value / total * 100, 1) AS leader_share,
       total::BIGINT AS total FROM r WHERE rn = 1 AND value / total * 100 > 55""")
def imbalance_lang(spark, sf):
    return G.imbalance(G.frequency(table(spark, sf, "documents"), "lang"), "lang")


@query("""
WITH g AS (SELECT p_brand AS label, sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS ord FROM g QUALIFY ord <= 5),
m AS (SELECT *, avg(value) OVER () AS mean FROM t)
SELECT ord, label, round(value, 2) AS value, round(mean, 2) AS mean,
       CASE WHEN value >= mean * 1.45 THEN 'rojo' WHEN value >= mean * 1.15 THEN 'amarillo' ELSE 'verde' END AS status FROM m""")
def top5_alerts_brand(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    top = G.alerts(G.totals(lines, "p_brand", F.col("l_extendedprice")))
    return top.select(F.col("ord").cast("bigint").alias("ord"), "label", F.round("value", 2).alias("value"), F.round("mean", 2).alias("mean"), "status")


@query("""
WITH g AS (SELECT user_id::VARCHAR AS label, sum(value) AS value FROM events GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS ord FROM g WHERE value > 0 QUALIFY ord <= 5),
m AS (SELECT *, avg(value) OVER () AS mean FROM t)
SELECT ord, label, round(value, 2) AS value,
       CASE WHEN value >= mean * 1.45 THEN 'Supera el umbral critico.' WHEN value >= mean * 1.15 THEN 'Requiere seguimiento.'
            ELSE 'Dentro del rango esperado.' END AS detail FROM m""")
def top5_alerts_users(spark, sf):
    top = G.alerts(G.totals(table(spark, sf, "events"), "user_id", F.col("value")))
    return top.select(F.col("ord").cast("bigint").alias("ord"), "label", F.round("value", 2).alias("value"), "detail")


# ---- windows and de-duplication ---------------------------------------------------------------
@query("""
WITH r AS (SELECT doc_id, lower(trim(text)) AS key, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id FROM r WHERE rn = 1 AND key <> ''""")
def first_appearance_documents(spark, sf):
    return first_appearances(table(spark, sf, "documents"), F.lower(F.trim("text")), "doc_id").select("doc_id")


@query("""
WITH s AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS p FROM orders)
SELECT o_orderkey, last_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS filled FROM s""")
def forward_fill_priority(spark, sf):
    merged = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("hoja").alias("sheet"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("filled"))
    return forward_fill(merged, "filled", "o_orderkey", ["sheet"], block_rows=1_000).select("o_orderkey", "filled")


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity > 45 THEN l_returnflag END AS f FROM lineitem)
SELECT filled, count(*) AS n FROM (
  SELECT last_value(f IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY pos RANGE UNBOUNDED PRECEDING) AS filled FROM (
    SELECT l_suppkey, pos, max(f) AS f FROM s GROUP BY 1, 2)) GROUP BY 1""")
def forward_fill_by_supplier(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_quantity") > 45, F.col("l_returnflag")).alias("filled"))
    once = rows.groupBy("l_suppkey", "pos").agg(F.max("filled").alias("filled"))
    return forward_fill(once, "filled", "pos", ["l_suppkey"], block_rows=10_000).groupBy("filled").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT DISTINCT upper(p_brand) AS title FROM part
WHERE lower(p_brand) NOT IN (SELECT DISTINCT lower(p_brand) FROM part WHERE p_retailprice > 1500 AND p_size > 40)""")
def titles_not_taken(spark, sf):
    parts = table(spark, sf, "part")
    wanted = parts.select(F.upper("p_brand").alias("title")).distinct()
    return new_titles(wanted, parts.where("p_retailprice > 1500 AND p_size > 40").select(F.col("p_brand").alias("title")))
