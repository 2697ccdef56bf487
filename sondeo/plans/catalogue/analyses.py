"""Profiles, quality, outliers, correlation, trend and money."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.operators.correlation import correlations
from sondeo.operators.money import currency_alerts, financial_context, money_facts, money_view
from sondeo.operators.outliers import outliers
from sondeo.operators.profile import numeric_profile, profile_table, shape_types
from sondeo.operators.quality import data_quality, duplicate_rows, fill_rates, passes_fill_gate, sparse_measures
from sondeo.operators.quantiles import exact_quantiles
from sondeo.operators.readers import progress_status, progress_values
from sondeo.operators.trend import before_after, last_periods, periodic_totals, trend_summary
from sondeo.plans.catalogue import add, query, table


def rounded(df, digits: int, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


# ---- numeric statistics -------------------------------------------------------------------
def stats_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_missing, round(sum({c})::DOUBLE, 2) AS total,
       round(avg({c}), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, min({c})::DOUBLE AS min,
       max({c})::DOUBLE AS max, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1,
       round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3 FROM {source}""" for c in columns)


for _t, _columns in {
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "orders": ["o_totalprice"],
    "events": ["value"],
    "documents": ["n_chars"],
    "customer": ["c_acctbal"],
    "part": ["p_size", "p_retailprice"],
}.items():
    def _stats(spark, sf, t=_t, columns=_columns):
        stats = numeric_profile(table(spark, sf, t), columns)
        return rounded(stats, 4, "mean", "median", "std", "q1", "q3").withColumn("total", F.round("total", 2))

    add(f"numeric_profile_{_t}", _stats, stats_sql(_t, _columns))


@query("""
SELECT round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem""")
def quantiles_by_narrowing(spark, sf):
    """The selection used beyond one task's reach, asked for at any size."""
    found = exact_quantiles(table(spark, sf, "lineitem"), {"p": F.col("l_extendedprice")}, sortable_values=0)["p"]
    return spark.range(1).select(*[F.round(F.lit(v), 4).alias(f"q{i + 1}") for i, v in enumerate(found)])


# ---- quality --------------------------------------------------------------------------------
def quality_sql(source: str, columns: list[str], text: list[str]) -> str:
    words = "('???', '—', 'n/a', 'na', 'nan', 'none', '', '-', 'null', 'sin datos', 'sin información', 'sin dato', 'no aplica', 'no disponible', 'nd', 's/d')"
    cells = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR lower(trim({c})) IN {words})" for c in text) or "0"
    return f"""
WITH c AS (SELECT count(*) AS n, {cells} AS p FROM {source}),
d AS (SELECT (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS dup)
SELECT '{source}' AS source, n AS total_rows, n * {len(columns)} AS total_cells, p::BIGINT AS placeholder_cells,
       round(p / (n * {len(columns)}), 3) AS placeholder_ratio, dup AS duplicate_rows, round(dup / n, 3) AS duplicate_ratio,
       round(greatest(0, 1 - p / (n * {len(columns)}) * 0.55 - dup / n * 0.45)::DOUBLE, 3) AS quality_score FROM c, d"""


COLUMNS = {
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_name", "c_mktsegment"]),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_orderstatus", "o_orderpriority"]),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus", "l_shipdate"], ["l_returnflag", "l_linestatus"]),
    "events": (["event_id", "ts", "user_id", "event_type", "value", "props"], ["event_type", "props"]),
    "documents": (["doc_id", "text", "lang", "source", "n_chars"], ["text", "lang", "source"]),
    "conversations": (["conv_id", "turn", "role", "text"], ["role", "text"]),
}

for _t, (_columns, _text) in COLUMNS.items():
    add(f"data_quality_{_t}", lambda spark, sf, t=_t: data_quality(table(spark, sf, t), t), quality_sql(_t, _columns, _text))


@query("SELECT count(*) - count(DISTINCT lower(trim(text))) AS duplicate_rows FROM documents")
def duplicate_text_documents(spark, sf):
    return duplicate_rows(table(spark, sf, "documents"), [F.lower(F.trim("text"))])


@query("""
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber,
       CASE WHEN l_quantity > 25 THEN l_quantity END FROM lineitem)) AS duplicate_rows FROM lineitem""")
def duplicate_rows_lineitem(spark, sf):
    """Few distinct rows, many copies, NULLs in the key."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("q"))
    return duplicate_rows(rows)


PATCHY = """
SELECT o_orderkey AS clave, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS valor,
       CASE WHEN o_orderkey % 25 = 0 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN ' ' END AS nota,
       CASE WHEN o_custkey < 0 THEN o_custkey END AS vacia FROM orders"""


def patchy(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("clave"), F.when(key % 3 == 0, F.col("o_totalprice")).alias("valor"),
        F.when(key % 25 == 0, F.col("o_orderpriority")).when(key % 2 == 0, " ").alias("nota"),
        F.when(F.col("o_custkey") < 0, F.col("o_custkey")).alias("vacia"))


@query(f"""
WITH p AS ({PATCHY})
SELECT 'clave' AS "column", 0 AS ord, count(clave) AS n_filled, count(*) AS n_rows FROM p UNION ALL
SELECT 'valor', 1, count(valor), count(*) FROM p UNION ALL
SELECT 'nota', 2, count(*) FILTER (WHERE trim(nota) <> ''), count(*) FROM p UNION ALL
SELECT 'vacia', 3, count(vacia), count(*) FROM p""")
def fill_rates_patchy(spark, sf):
    return fill_rates(patchy(spark, sf))


@query(f"""
WITH p AS ({PATCHY}),
s AS (SELECT count(clave) + count(valor) + count(*) FILTER (WHERE trim(nota) <> '') + count(vacia) AS f, count(*) * 4 AS c FROM p)
SELECT round(f / c, 4) AS fill_ratio, f / c >= 0.25 AS accepted FROM s""")
def fill_gate_patchy(spark, sf):
    return passes_fill_gate(patchy(spark, sf))


@query(f"""SELECT 'valor' AS "column", round(1 - count(valor) / count(*), 3) AS missing_ratio FROM ({PATCHY})""")
def sparse_measures_patchy(spark, sf):
    return sparse_measures(profile_table(patchy(spark, sf), "patchy", order_by=["clave"]))


# ---- column roles ----------------------------------------------------------------------------
def roles_sql(source: str, order: str, specs: list[tuple[str, str, int, bool]]) -> str:
    """``specs``: column, kind of values (num or text), header points, executive header."""
    parts = []
    for i, (c, values, points, executive) in enumerate(specs):
        if values == "num":
            parts.append(f"""
SELECT '{c}' AS "column", {i} AS ord, CASE WHEN seq THEN 'identificador' ELSE 'numerico' END AS role,
       ({points + 20} - CASE WHEN seq THEN 18 ELSE 0 END + CASE WHEN total > 1e6 THEN 30 WHEN total > 1e4 THEN 15 ELSE 0 END)::INTEGER AS importance,
       n, nm AS n_missing, NULL::BIGINT AS n_distinct
FROM (SELECT sum({c}) AS total, count({c}) AS n, count(*) - count({c}) AS nm FROM {source}),
     (SELECT {"false" if executive else "count(DISTINCT round(d, 6)) <= 2 AND max(abs(d)) <= 10"} AND
             (SELECT count(*) FILTER (WHERE {c} = floor({c})) >= greatest(4, floor(count({c}) * 0.8)) FROM {source}) AS seq FROM (
        SELECT v - lag(v) OVER (ORDER BY {order}) AS d FROM (
          SELECT {c}::DOUBLE AS v, {order} FROM {source} WHERE {c} = floor({c}) ORDER BY {order} LIMIT 10)))""")
        else:
            parts.append(f"""
SELECT '{c}', {i}, CASE WHEN d <= 20 AND d / n <= 0.3 THEN 'categorica' WHEN d / n > 0.8 THEN 'identificador' ELSE 'texto' END,
       ({points} + CASE WHEN d <= 20 AND d / n <= 0.3 THEN 15 WHEN d / n > 0.8 THEN 5 ELSE 3 END)::INTEGER,
       n, nm, CASE WHEN d <= 20 AND d / n <= 0.3 THEN d END
FROM (SELECT count(DISTINCT {c}) AS d, count({c}) AS n, count(*) - count({c}) AS nm FROM {source})""")
    head = parts[0] if specs[0][1] == "num" else None
    return " UNION ALL ".join(parts) if head else " UNION ALL ".join(parts)


ROLES = {
    "orders": ("o_orderkey", [
        ("o_orderkey", "num", 0, False), ("o_custkey", "num", 0, False), ("o_orderstatus", "text", 32, True),
        ("o_totalprice", "num", 25, False), ("o_orderdate", "text", 10, False), ("o_orderpriority", "text", 0, False)]),
    "part": ("p_partkey", [
        ("p_partkey", "num", 0, False), ("p_name", "text", 0, False), ("p_brand", "text", 0, False), ("p_type", "text", 0, False),
        ("p_size", "num", 0, False), ("p_retailprice", "num", 0, False)]),
    "customer": ("c_custkey", [
        ("c_custkey", "num", 0, False), ("c_name", "text", 0, False), ("c_nationkey", "num", 0, False), ("c_acctbal", "num", 0, False),
        ("c_mktsegment", "text", 0, False)]),
    "events": ("event_id", [
        ("event_id", "num", -22, False), ("ts", "text", 0, False), ("user_id", "num", -22, False), ("event_type", "text", 0, False),
        ("value", "num", 0, False), ("props", "text", 0, False)]),
    "documents": ("doc_id", [
        ("doc_id", "num", -22, False), ("text", "text", 0, False), ("lang", "text", 0, False), ("source", "text", 0, False),
        ("n_chars", "num", 0, False)]),
    "lineitem": ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate", [
        ("l_orderkey", "num", 0, False), ("l_partkey", "num", 0, False), ("l_suppkey", "num", 0, False), ("l_linenumber", "num", 0, False),
        ("l_quantity", "num", 0, False), ("l_extendedprice", "num", 0, False), ("l_discount", "num", 0, False), ("l_tax", "num", 0, False),
        ("l_returnflag", "text", 0, False), ("l_linestatus", "text", 32, True), ("l_shipdate", "text", 10, False)]),
}

for _t, (_order, _specs) in ROLES.items():
    def _roles(spark, sf, t=_t, order=_order):
        profile = profile_table(table(spark, sf, t), t, order_by=order.split(", "))
        return profile.select("column", "ord", "role", "importance", "n", "n_missing", "n_distinct")

    add(f"column_roles_{_t}", _roles, roles_sql(_t, _order, _specs))


def shapes_sql(source: str, specs: list[tuple[str, str]]) -> str:
    """``specs``: column and either a type fixed by its header or ``?`` for a judgement by values."""
    parts = []
    for i, (c, fixed) in enumerate(specs):
        if fixed != "?":
            parts.append(f"""SELECT '{c}' AS "column", {i} AS ord, '{fixed}' AS type""")
            continue
        text = f"{c}::VARCHAR"
        parts.append(f"""
SELECT '{c}' AS "column", {i} AS ord,
       CASE WHEN n_numbers >= 0.75 * n THEN CASE WHEN n_unit = n_numbers AND n_numbers >= 5 THEN 'percent' WHEN mean > 10000 THEN 'currency' ELSE 'numeric' END
            WHEN n_keys <= 2 AND yes_no THEN 'boolean' WHEN n_keys <= 10 AND n >= 4 THEN 'categorical' ELSE 'text' END AS type
FROM (SELECT count(*) AS n, count(v) AS n_numbers, count(*) FILTER (WHERE v BETWEEN 0 AND 1) AS n_unit, avg(v) AS mean,
             count(DISTINCT k) AS n_keys, bool_or(k IN ('SI', 'NO', 'TRUE')) AS yes_no
      FROM (SELECT try_cast(nullif(regexp_extract(regexp_replace(upper({text}), '[$€£¥,\\s]|COP|USD', '', 'g'),
                     '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)', 0), '') AS DOUBLE) AS v,
                   upper(regexp_replace(lower({text}), '[^a-z0-9]', '', 'g')) AS k
            FROM {source} WHERE trim({text}) <> ''))""")
    return " UNION ALL ".join(parts)


for _t, _specs in {
    "orders": [("o_orderkey", "?"), ("o_custkey", "?"), ("o_orderstatus", "?"), ("o_totalprice", "currency"), ("o_orderdate", "date"), ("o_orderpriority", "?")],
    "part": [("p_partkey", "?"), ("p_name", "?"), ("p_brand", "?"), ("p_type", "?"), ("p_size", "?"), ("p_retailprice", "?")],
    "customer": [("c_custkey", "?"), ("c_name", "?"), ("c_nationkey", "?"), ("c_acctbal", "?"), ("c_mktsegment", "?")],
    "lineitem": [("l_orderkey", "?"), ("l_partkey", "?"), ("l_suppkey", "?"), ("l_linenumber", "?"), ("l_quantity", "?"), ("l_extendedprice", "?"),
                 ("l_discount", "?"), ("l_tax", "?"), ("l_returnflag", "?"), ("l_linestatus", "?"), ("l_shipdate", "date")],
}.items():
    add(f"shape_types_{_t}", lambda spark, sf, t=_t: shape_types(table(spark, sf, t)), shapes_sql(_t, _specs))


# ---- outliers ------------------------------------------------------------------------------------
def outliers_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""
SELECT * FROM (
WITH q AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM q),
o AS (SELECT {c}::DOUBLE AS v, lo, hi FROM {source}, f WHERE iqr > 0 AND ({c} < lo OR {c} > hi))
SELECT '{c}' AS "column", (SELECT count({c}) FROM {source}) AS n, count(*) AS n_outliers,
       round_even(count(*) / (SELECT count({c}) FROM {source}) * 100, 1) AS pct, round(max(lo), 2) AS lower, round(max(hi), 2) AS upper,
       min(v) AS min_outlier, max(v) AS max_outlier,
       (SELECT string_agg(printf('%.2f', v), ' ' ORDER BY v DESC) FROM (SELECT v FROM o ORDER BY v DESC LIMIT 3)) AS examples
FROM o HAVING count(*) > 0 AND n >= 8)""" for c in columns)


for _name, (_t, _columns) in {
    "events": ("events", ["value"]),
    "documents": ("documents", ["n_chars"]),
    "orders": ("orders", ["o_totalprice"]),
    "lineitem_sweep": ("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "mixed_sweep": ("events", ["value", "user_id"]),
}.items():
    def _outliers(spark, sf, t=_t, columns=_columns):
        found = outliers(table(spark, sf, t), {c: F.col(c) for c in columns})
        return found.withColumn("examples", F.array_join(F.transform("examples", lambda v: F.format_string("%.2f", v)), " "))

    add(f"iqr_outliers_{_name}", _outliers, outliers_sql(_t, _columns))


SPIKED = """(SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 60 ELSE o_totalprice END AS total,
       CASE WHEN o_orderkey % 89 = 0 THEN -o_custkey * 9.0 ELSE o_custkey END AS custkey FROM orders)"""


@query(outliers_sql(SPIKED, ["total", "custkey"]))
def iqr_outliers_spiked_orders(spark, sf):
    """Orders of which some are sixty times too large, and keys of which some are far below zero."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    df = table(spark, sf, "orders").select(
        F.when(key % 97 == 0, F.col("o_totalprice") * 60).otherwise(F.col("o_totalprice")).alias("total"),
        F.when(key % 89 == 0, -cust * 9.0).otherwise(cust).alias("custkey"))
    found = outliers(df, {c: F.col(c) for c in df.columns})
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda v: F.format_string("%.2f", v)), " "))


# ---- correlation ---------------------------------------------------------------------------------
ORDER_LINES = """SELECT l_orderkey, count(*) AS lines, sum(l_extendedprice) AS price, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY 1"""


def correlation_sql(source: str, columns: list[str], minimum: float) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    union = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM s" for a, b in pairs)
    return f"""
WITH s AS ({source}), c AS ({union})
SELECT col_a, col_b, round_even(r, 3) AS r, CASE WHEN r > 0 THEN 'positiva' ELSE 'negativa' END || ' ' ||
       CASE WHEN abs(r) >= 0.8 THEN 'fuerte' ELSE 'moderada' END AS label, n
FROM c WHERE n >= 5 AND abs(r) >= {minimum} ORDER BY abs(r) DESC, col_a, col_b LIMIT 5"""


@query(correlation_sql(ORDER_LINES, ["lines", "price", "qty", "disc"], 0.5))
def correlation_order_lines(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    return correlations(lines, {c: F.col(c) for c in ("lines", "price", "qty", "disc")})


@query(correlation_sql("SELECT l_quantity AS q, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS p, -l_quantity * l_quantity AS s2, 1.0::DOUBLE AS k FROM lineitem", ["q", "p", "s2", "k"], 0.5).replace("corr(q, k)", "NULL::DOUBLE").replace("corr(p, k)", "NULL::DOUBLE").replace("corr(s2, k)", "NULL::DOUBLE"))
def correlation_lineitem(spark, sf):
    """With NULLs in one column and another that never varies."""
    q = F.col("l_quantity")
    return correlations(table(spark, sf, "lineitem"), {
        "q": q, "p": F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")), "s2": -q * q, "k": F.lit(1.0)})


# ---- trend ------------------------------------------------------------------------------------------
def periods_sql(source: str, ts: str, value: str, unit: str) -> str:
    return f"SELECT date_trunc('{unit}', {ts}) AS period, sum({value}) AS value FROM {source} GROUP BY 1"


def trend_sql(source: str, ts: str, value: str, unit: str) -> str:
    return f"""
WITH p AS ({periods_sql(source, ts, value, unit)}),
r AS (SELECT value, row_number() OVER (ORDER BY period) AS place, count(*) OVER () AS n FROM p),
m AS (SELECT max(n) AS n, avg(value) FILTER (WHERE place <= greatest(1, n // 2)) AS a, avg(value) FILTER (WHERE place > n - greatest(1, n // 2)) AS b FROM r),
c AS (SELECT *, round_even((b - a) / abs(a) * 100, 1) AS change FROM m WHERE n >= 2)
SELECT CASE WHEN change > 10 THEN 'creciente' WHEN change < -10 THEN 'decreciente' ELSE 'estable' END AS direction, change AS change_pct,
       round(a, 2) AS mean_start, round(b, 2) AS mean_end, n AS n_periods FROM c"""


TRENDS = {
    "orders": ("orders", "o_orderdate", "o_totalprice", "month"),
    "shipdate": ("lineitem", "l_shipdate", "l_extendedprice", "month"),
    "daily_events": ("events", "ts", "value", "day"),
    "hourly_events": ("events", "ts", "value", "hour"),
    "monthly_events": ("events", "ts", "value", "month"),
}

for _name, (_t, _ts, _value, _unit) in TRENDS.items():
    def _trend(spark, sf, t=_t, ts=_ts, value=_value, unit=_unit):
        return trend_summary(periodic_totals(table(spark, sf, t), F.col(ts), F.col(value), unit))

    add(f"trend_{_name}", _trend, trend_sql(_t, _ts, _value, _unit))


@query(trend_sql("(SELECT ts + to_months((event_id % 9)::INT) AS ts, value * (1 + event_id % 9) AS value FROM events)", "ts", "value", "month"))
def trend_shifted_events(spark, sf):
    """Events spread over nine more months, each month's values larger than those before."""
    shift = F.col("event_id") % 9
    df = table(spark, sf, "events").select(F.expr("ts + make_interval(0, cast(event_id % 9 AS int))").alias("ts"), (F.col("value") * (shift + 1)).alias("value"))
    return trend_summary(periodic_totals(df, F.col("ts"), F.col("value")))


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1""")
def monthly_totals_orders(spark, sf):
    return rounded(periodic_totals(table(spark, sf, "orders"), F.col("o_orderdate"), F.col("o_totalprice")), 2, "value")


@query("""
WITH p AS (SELECT date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 6)
SELECT row_number() OVER (ORDER BY m) AS ord, strftime(m, '%Y-%m') AS label, round(v, 2) AS value FROM p""")
def last_months_shipped(spark, sf):
    recent = last_periods(periodic_totals(table(spark, sf, "lineitem"), F.col("l_shipdate"), F.col("l_quantity")))
    return rounded(recent.withColumn("ord", F.col("ord").cast("bigint")), 2, "value")


@query(f"""
SELECT 'o_totalprice' AS measure, mean_start AS before_value, mean_end AS after_value, change_pct AS delta_pct,
       CASE WHEN change_pct > 0 THEN 'mejora' ELSE 'ajuste' END AS verdict FROM ({trend_sql('orders', 'o_orderdate', 'o_totalprice', 'month')})""")
def before_after_orders(spark, sf):
    return before_after(trend_summary(periodic_totals(table(spark, sf, "orders"), F.col("o_orderdate"), F.col("o_totalprice"))), "o_totalprice")


# ---- money ------------------------------------------------------------------------------------------
FOREIGN = """
SELECT o_orderkey, o_totalprice AS "Valor Total",
       CASE o_orderstatus WHEN 'O' THEN 'COP' WHEN 'F' THEN 'USD' ELSE '' END AS code,
       CASE WHEN o_orderkey % 4 <> 0 THEN 4000.0 + o_orderkey % 10 END::DOUBLE AS rate FROM orders"""


def foreign(spark, sf):
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("Valor Total"),
        F.when(state == "O", "Pesos").when(state == "F", "US$").otherwise("").alias("Moneda"),
        F.when(key % 4 != 0, F.lit(4000.0) + key % 10).alias("TRM"))


CONVERTED = """CASE WHEN code IN ('', 'COP') THEN "Valor Total" WHEN rate > 0 THEN "Valor Total" * rate END"""


@query(f"SELECT o_orderkey, round({CONVERTED}, 2) AS converted FROM ({FOREIGN})")
def fx_conversion(spark, sf):
    df = foreign(spark, sf)
    return df.select("o_orderkey", F.round(money_view(df, "Valor Total").converted, 2).alias("converted"))


@query(f"""
WITH f AS (SELECT code, {CONVERTED} AS v FROM ({FOREIGN}))
SELECT 'Valor Total' AS "column", 'Moneda' AS currency_column, 'TRM' AS rate_column,
       (SELECT string_agg(DISTINCT code, '/' ORDER BY code) FROM f WHERE code <> '') AS currencies,
       (SELECT count(DISTINCT code) > 1 FROM f WHERE code <> '') AS mixed_currency, round(count(v) / count(*), 3) AS resolved_ratio,
       count(*) - count(v) AS unresolved_rows, count(v) / count(*) >= 0.7 AS trusted FROM f""")
def fx_facts(spark, sf):
    return money_facts(foreign(spark, sf), ["Valor Total"]).withColumn("currencies", F.array_join("currencies", "/"))


@query(f"""
WITH f AS (SELECT code, {CONVERTED} AS v FROM ({FOREIGN}))
SELECT string_agg(DISTINCT code, '/' ORDER BY code) FILTER (WHERE code <> '') AS currencies, count(*) > count(v) AS has_unresolved,
       count(DISTINCT code) FILTER (WHERE code <> '') > 1 AS has_mixed FROM f""")
def fx_context(spark, sf):
    df = foreign(spark, sf).withColumn("Costo", F.col("Valor Total") * 2)
    return financial_context(money_facts(df, ["Valor Total", "Costo"])).withColumn("currencies", F.array_join("currencies", "/"))


@query(f"""
WITH f AS (SELECT code, {CONVERTED} AS v FROM ({FOREIGN}))
SELECT 'Valor Total' AS "column", string_agg(DISTINCT code, '/' ORDER BY code) FILTER (WHERE code <> '') AS currencies,
       round(count(v) / count(*), 3) AS resolved_ratio, count(*) - count(v) AS unresolved_rows FROM f
HAVING count(v) < count(*) OR count(DISTINCT code) FILTER (WHERE code <> '') > 1""")
def currency_alerts_orders(spark, sf):
    """The mixed column is told, the one in a single currency is not."""
    df = foreign(spark, sf)
    alone = money_facts(df.drop("Moneda", "TRM").withColumnRenamed("Valor Total", "Costo"), ["Costo"])
    return currency_alerts(money_facts(df, ["Valor Total"]).unionByName(alone)).withColumn("currencies", F.array_join("currencies", "/"))


# ---- progress ----------------------------------------------------------------------------------------
@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE quality >= 1) AS done, count(*) FILTER (WHERE quality > 0 AND quality < 1) AS under_way,
       count(*) FILTER (WHERE quality = 0) AS pending, round(avg(quality), 4) AS mean_progress FROM labels""")
def progress_status_labels(spark, sf):
    return progress_status(table(spark, sf, "labels"), F.col("quality").cast("double"))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE l_linenumber >= 7) AS done, count(*) FILTER (WHERE l_linenumber < 7 AND l_linenumber > 1) AS under_way,
       count(*) FILTER (WHERE l_linenumber = 1) AS pending,
       round(avg(CASE WHEN l_linenumber >= 7 THEN 1 ELSE (l_linenumber - 1) * 15 / 100 END), 4) AS mean_progress FROM lineitem""")
def progress_status_percent(spark, sf):
    """A column on the 0 to 100 scale, written as text."""
    line = F.col("l_linenumber")
    pct = F.when(line >= 7, "100%").otherwise(F.concat(((line - 1) * 15).cast("string"), F.lit(",0 %")))
    df = table(spark, sf, "lineitem").select(pct.alias("Avance"))
    return progress_status(df, progress_values(df, "Avance"))
