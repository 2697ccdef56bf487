"""Charts, report tables, insights, KPIs, conclusions and the audit record."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.functions import vocabulary as V
from sondeo.operators import charts as C
from sondeo.operators import tables as T
from sondeo.operators.audit import check_blocks, rank_tables, run_audit
from sondeo.operators.commissions import commission_charts, executive_summary, expense_totals, generic_summary, top_people
from sondeo.operators.digest import input_digests
from sondeo.operators.groups import frequency, top_with_others, totals
from sondeo.operators.insights import insight_direction
from sondeo.operators.trend import last_periods, periodic_totals
from sondeo.plans.analyze import TableAnalysis, WorkbookAnalysis, derived_charts
from sondeo.plans.catalogue import add, query, table
from sondeo.plans.catalogue.grids import MESSY, messy
from sondeo.plans.catalogue.groups import others_sql, summary_sql
from sondeo.plans.catalogue.workbooks import KEYS, named
from sondeo.session import local_table
from sondeo.sources.catalog import Catalog, Sheet


def r2(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 2))
    return df


# ---- commissions --------------------------------------------------------------------------
@query(f"""
WITH m AS ({MESSY})
SELECT count(*) AS n_records, round(sum("Valor Total Solicitado"), 2) AS total, count(DISTINCT "Solicitante") AS n_people,
       count(DISTINCT "Ciudad Destino") AS n_cities, count(DISTINCT "Centro de Costos") FILTER (WHERE length(trim("Centro de Costos")) > 1) AS n_centres,
       round(sum("Valor Total Solicitado") / count(*), 2) AS mean_amount, max("Valor Total Solicitado") AS max_amount, 1.0::DOUBLE AS resolved_ratio,
       'COP' AS currencies FROM m""")
def executive_summary_commissions(spark, sf):
    one = executive_summary(messy(spark, sf))
    return r2(one, "total", "mean_amount").withColumn("currencies", F.array_join("currencies", "/"))


@query("""SELECT 'orders' AS source, count(*) AS n_rows, 6 AS n_cols, 'o_totalprice' AS measures,
          'o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority' AS columns FROM orders""")
def generic_summary_orders(spark, sf):
    one = generic_summary(table(spark, sf, "orders"), "orders", ["o_totalprice"])
    return one.withColumn("measures", F.array_join("measures", "|")).withColumn("columns", F.array_join("columns", "|"))


@query("""SELECT 'Tiquete' AS label, round(sum(o_totalprice * 0.5), 2) AS value FROM orders UNION ALL SELECT 'Hospedaje', round(sum(o_totalprice * 0.25), 2) FROM orders""")
def expense_totals_commissions(spark, sf):
    return r2(expense_totals(messy(spark, sf)).select("label", "value"), "value")


@query(f"""
SELECT "Solicitante" AS label, round(sum("Valor Total Solicitado"), 2) AS value, count("Id Comisión") AS n FROM ({MESSY})
WHERE "Solicitante" IS NOT NULL AND "Valor Total Solicitado" IS NOT NULL GROUP BY 1 ORDER BY sum("Valor Total Solicitado") DESC, 1 LIMIT 8""")
def top_people_commissions(spark, sf):
    return r2(top_people(messy(spark, sf)).select("label", "value", "n"), "value")


M = f"({MESSY} )"
CITY = f"""(SELECT trim("Ciudad Destino") AS c FROM {M} WHERE lower(trim("Ciudad Destino")) NOT IN ('n/a', '-'))"""
CENTRE = f"""(SELECT "Centro de Costos" AS c, "Valor Total Solicitado" AS v FROM {M} WHERE "Centro de Costos" <> '-' AND "Valor Total Solicitado" IS NOT NULL)"""


@query(f"""
SELECT 'estados' AS chart_id, label, value FROM ({others_sql(M, '"Estado"', 'count(*)', 4)}) UNION ALL
SELECT 'ciudades', label, value FROM ({others_sql(CITY, 'c', 'count(*)', 5)}) UNION ALL
SELECT 'centros', label, value FROM ({others_sql(CENTRE, 'c', 'sum(v)', 5)}) UNION ALL
SELECT 'gastos', 'Tiquete', round(sum(o_totalprice * 0.5), 2) FROM orders UNION ALL SELECT 'gastos', 'Hospedaje', round(sum(o_totalprice * 0.25), 2) FROM orders""")
def commission_chart_data(spark, sf):
    return r2(commission_charts(messy(spark, sf)).where("chart_id <> 'solicitantes'").select("chart_id", "label", "value"), "value")


# ---- charts ---------------------------------------------------------------------------------
def chart_set(spark, sf):
    """Four charts over the tables, one of them flat and one with a single pair."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    line = last_periods(periodic_totals(orders, F.col("o_orderdate"), F.col("o_totalprice")))
    flat = line.withColumn("value", F.lit(7.0))
    one = top_with_others(totals(part.where("p_brand = 'Brand#1'"), "p_brand", F.col("p_retailprice")), 5)
    data = C.stack([C.distribution_chart(part, "p_type"), C.value_chart(orders, "o_orderstatus", F.col("o_totalprice"), "price"),
                    C.chart(line, "line"), C.chart(flat, "flat"), C.chart(one, "single")])
    meta = local_table(spark, [
        ("distribution:p_type", "bar", "part", "conteo"), ("value:o_orderstatus:price", "pie", "orders", "suma"), ("line", "line", "orders", "tendencia"),
        ("flat", "line", "", "otra"), ("single", "bar", "part", "suma")], "chart_id string, kind string, source string, aggregation string")
    return data, meta


LINE = """SELECT strftime(m, '%Y-%m') AS label, v AS value FROM (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 6)"""
CHART_SET = f"""
SELECT 'distribution:p_type' AS chart_id, label, value FROM ({others_sql('part', 'p_type', 'count(*)', 5)}) UNION ALL
SELECT 'value:o_orderstatus:price', label, value FROM ({others_sql('orders', 'o_orderstatus', 'sum(o_totalprice)', 5)}) UNION ALL
SELECT 'line', label, value FROM ({LINE}) UNION ALL SELECT 'flat', label, 7.0 FROM ({LINE}) UNION ALL
SELECT 'single', p_brand, sum(p_retailprice) FROM part WHERE p_brand = 'Brand#1' GROUP BY 2"""


@query(f"""
WITH d AS ({CHART_SET}),
m(chart_id, kind, source, aggregation) AS (VALUES ('distribution:p_type', 'bar', 'part', 'conteo'), ('value:o_orderstatus:price', 'pie', 'orders', 'suma'),
   ('line', 'line', 'orders', 'tendencia'), ('flat', 'line', '', 'otra'), ('single', 'bar', 'part', 'suma')),
f AS (SELECT chart_id, count(*) AS p, count(*) FILTER (WHERE abs(value) > 1e-9) AS nz, count(*) FILTER (WHERE value > 0) AS pos,
             count(DISTINCT round(value, 6)) AS u, max(value) - min(value) AS spread FROM d GROUP BY 1),
s AS (SELECT f.*, kind, source, aggregation, 0.24 + 0.18 + least(p, 6) / 6 * 0.16 + nz / p * 0.12 + pos / p * 0.12 + u / p * 0.08
             + CASE WHEN source <> '' THEN 0.06 ELSE 0 END + CASE WHEN aggregation IN ('suma', 'conteo', 'tendencia') THEN 0.06 ELSE 0 END
             - CASE WHEN kind = 'line' AND spread <= 1e-9 THEN 0.22 ELSE 0 END - CASE WHEN p < 3 THEN 0.08 ELSE 0 END AS raw FROM f JOIN m USING (chart_id))
SELECT chart_id, CASE WHEN p < 2 THEN 0.18 ELSE round(greatest(0, least(0.99, raw))::DOUBLE, 4) END::DOUBLE AS score,
       p < 2 OR raw < 0.58 OR (kind = 'line' AND spread <= 1e-9) AS blocked,
       CASE WHEN p < 2 THEN 'menos de dos pares validos' WHEN raw < 0.58 THEN 'confianza insuficiente'
            WHEN kind = 'line' AND spread <= 1e-9 THEN 'serie plana sin tendencia real' ELSE '' END AS reason,
       CASE WHEN p < 2 THEN 0 ELSE 1 END::DOUBLE AS numeric_coverage FROM s""")
def chart_truth_scores(spark, sf):
    return C.chart_truth(*chart_set(spark, sf))


@query(f"""
WITH d AS ({CHART_SET})
SELECT chart_id, max_by(label, value) AS leader, round(max(value)::DOUBLE, 2) AS leader_value, round_even(max(value) / sum(value) * 100, 0)::DOUBLE AS share,
       count(*) AS n, round(sum(value)::DOUBLE, 2) AS total FROM d WHERE chart_id <> 'flat' GROUP BY 1""")
def chart_summaries(spark, sf):
    return r2(C.chart_summary(chart_set(spark, sf)[0].where("chart_id <> 'flat'")), "leader_value", "total")


@query(f"""
WITH d AS ({CHART_SET})
SELECT chart_id, label, round_even(value / sum(value) OVER () * 100, 0)::DOUBLE AS share, round(value::DOUBLE, 2) AS value
FROM d WHERE chart_id = 'value:o_orderstatus:price' ORDER BY value DESC LIMIT 4""")
def chart_details_status(spark, sf):
    details = C.chart_details(chart_set(spark, sf)[0].where("chart_id LIKE 'value:%'"))
    return r2(details.select("chart_id", "label", "share", "value"), "value")


@query(f"""
WITH d AS ({CHART_SET})
SELECT chart_id, count(*) FILTER (WHERE value > 0) >= 2 AS valid FROM d GROUP BY 1""")
def chart_validity(spark, sf):
    return C.valid_charts(chart_set(spark, sf)[0])


@query(f"SELECT 'brands' AS chart_id, * FROM ({others_sql('part', 'p_brand', 'count(*)', 4)})")
def chart_presentable_pie(spark, sf):
    """All brands cut to what a pie can show: however many they are, the rest holds all that is not shown."""
    grouped = frequency(table(spark, sf, "part"), "p_brand")
    shown = C.presentable(C.chart(top_with_others(grouped, V.MAX_PIE), "brands"), "pie")
    return shown.withColumn("ord", F.col("ord").cast("bigint"))


def auto_sql() -> str:
    by_status = others_sql("orders", "o_orderstatus", "sum(o_totalprice)", 5)
    by_priority = others_sql("orders", "o_orderpriority", "sum(o_totalprice)", 5)
    return f"""
SELECT 'value:o_orderstatus:o_totalprice' AS chart_id, label, value FROM ({by_status}) UNION ALL
SELECT 'value:o_orderpriority:o_totalprice', label, value FROM ({by_priority}) UNION ALL
SELECT chart_id, label, round(value, 2) FROM (SELECT CASE WHEN (SELECT sum(o_custkey) FROM orders) > 1e6 THEN 'value:o_orderstatus:o_custkey'
  ELSE 'trend:o_totalprice' END AS chart_id), ({LINE}) WHERE chart_id = 'trend:o_totalprice' UNION ALL
SELECT 'value:o_orderstatus:o_custkey', label, value FROM ({others_sql('orders', 'o_orderstatus', 'sum(o_custkey)', 5)})
  WHERE (SELECT sum(o_custkey) FROM orders) > 1e6"""


@query(auto_sql())
def automatic_charts_orders(spark, sf):
    data = TableAnalysis(table(spark, sf, "orders"), "orders", ["o_orderkey"]).chart_data
    return r2(data.select("chart_id", "label", "value"), "value")


# ---- statements -----------------------------------------------------------------------------
@query("""
WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
o AS (SELECT count(*) AS n FROM documents, q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)),
l AS (SELECT max(c) * 100.0 / sum(c) AS top FROM (SELECT lang, count(*) AS c FROM documents GROUP BY 1)),
s AS (SELECT max(c) * 100.0 / sum(c) AS top FROM (SELECT source, count(*) AS c FROM documents GROUP BY 1)),
n AS (SELECT count(DISTINCT source) / count(*) AS ratio, count(DISTINCT source) AS u FROM documents)
SELECT 'anomalia' AS kind, 88 AS importance, 'n_chars' AS subject, n::VARCHAR AS figure, 'risk' AS direction FROM o WHERE n > 0 UNION ALL
SELECT 'desbalance', 72, 'lang', round_even(top, 1)::DOUBLE::VARCHAR, 'risk' FROM l WHERE top > 55""")
def insights_documents(spark, sf):
    said = insight_direction(TableAnalysis(table(spark, sf, "documents"), "documents", ["doc_id"]).insights)
    p = F.col("params")
    return said.where("kind <> 'concentracion'").select(
        "kind", "importance", p["column"].alias("subject"), F.coalesce(p["n_outliers"], p["leader_share"]).alias("figure"), "direction")


def concentration_sql(t: str, label: str, agg: str, name: str) -> str:
    return f"""SELECT category_col, value_col, n80, leader, concentration FROM ({summary_sql(t, label, agg, name)}) WHERE concentration <> 'dispersa'"""


@query(concentration_sql("documents", "lang", "sum(n_chars)", "n_chars") + " UNION ALL " + concentration_sql("documents", "source", "sum(n_chars)", "n_chars"))
def concentration_documents(spark, sf):
    """Pareto statements on the categorical columns, by the main measure."""
    summary = TableAnalysis(table(spark, sf, "documents"), "documents", ["doc_id"]).pareto_summary
    return summary.where("concentration <> 'dispersa'").select("category_col", "value_col", "n80", "leader", "concentration")


@query("""
SELECT 'Total o_totalprice' AS label, round(sum(o_totalprice), 2) AS value, 25 + 20 + 30 + 15 AS importance FROM orders UNION ALL
SELECT 'Promedio o_totalprice', round(avg(o_totalprice), 2), 25 + 20 + 30 + 5 FROM orders UNION ALL
SELECT 'Total Registros', count(*), 50 FROM orders UNION ALL
SELECT 'Suma o_custkey', sum(o_custkey), 20 + CASE WHEN sum(o_custkey) > 1e6 THEN 30 WHEN sum(o_custkey) > 1e4 THEN 15 ELSE 0 END FROM orders UNION ALL
SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), 47 FROM orders UNION ALL
SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 15 FROM orders""")
def kpis_orders(spark, sf):
    kpis = TableAnalysis(table(spark, sf, "orders"), "orders", ["o_orderkey"]).kpis
    return r2(kpis.select("label", "value", "importance"), "value")


@query(f"""
WITH cv AS (SELECT stddev_samp(n_chars) / avg(n_chars) AS v, max(n_chars) / sum(n_chars) AS peak FROM documents),
q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
o AS (SELECT count(*) AS n FROM documents, q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)),
l AS (SELECT max(c) * 100.0 / sum(c) AS top FROM (SELECT lang, count(*) AS c FROM documents GROUP BY 1))
SELECT 'tamano' AS kind, 1::BIGINT AS n UNION ALL SELECT 'anomalia', 1 FROM o WHERE n > 0 UNION ALL
SELECT 'concentracion', count(*) FROM ({concentration_sql("documents", "lang", "sum(n_chars)", "n_chars")} UNION ALL
                                       {concentration_sql("documents", "source", "sum(n_chars)", "n_chars")}) HAVING count(*) > 0 UNION ALL
SELECT CASE WHEN v > 1 THEN 'variabilidad_alta' ELSE 'variabilidad_moderada' END, 1 FROM cv WHERE v > 0.5 UNION ALL
SELECT 'maximo_dominante', 1 FROM cv WHERE peak > 0.25 UNION ALL SELECT 'dominancia', 1 FROM l WHERE top > 50""")
def conclusions_documents(spark, sf):
    said = TableAnalysis(table(spark, sf, "documents"), "documents", ["doc_id"]).conclusions
    return said.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
o AS (SELECT count(*) AS n FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)),
t AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1), s AS (SELECT round_even(max(v) / sum(v) * 100, 1) AS lead FROM t)
SELECT 'Concentracion' AS label, CASE WHEN lead >= 45 THEN 'rojo' WHEN lead >= 30 THEN 'amarillo' ELSE 'verde' END AS status FROM s UNION ALL
SELECT 'Anomalias', CASE WHEN n >= 3 THEN 'rojo' ELSE 'amarillo' END FROM o WHERE n > 0""")
def traffic_lights_events(spark, sf):
    """One month of events has no monthly trend, so two lights are lit."""
    return TableAnalysis(table(spark, sf, "events"), "events", ["event_id"]).traffic_lights.select("label", "status")


@query("""
SELECT 'risk' AS direction, 1::BIGINT AS n FROM (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q
WHERE EXISTS (SELECT 1 FROM events WHERE value > q3 + 1.5 * (q3 - q1))""")
def cards_events(spark, sf):
    cards = TableAnalysis(table(spark, sf, "events"), "events", ["event_id"]).cards
    return cards.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


# ---- report tables -----------------------------------------------------------------------------
REPORTED = ["customer", "part", "events", "documents", "conversations"]


def reports(spark, sf, names=REPORTED):
    return [T.report_on(table(spark, sf, t), t, t, "general", KEYS[t]) for t in names]


def signal_sql(t: str, specs: list[tuple[str, bool]], label: str) -> str:
    """``specs``: column, numeric or not. Text columns of these tables hold no numbers."""
    def cell(c):
        return rf"trim(regexp_replace({c}::VARCHAR, '\s+', ' ', 'g'))"

    ok = {c: f"length(regexp_replace({cell(c)}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 1" for c, _ in specs}
    readable = " + ".join(f"({ok[c]})::INT" for c, _ in specs)
    ok_cells = " + ".join(f"count(*) FILTER (WHERE {ok[c]})" for c, _ in specs)
    numbers = " + ".join(f"count(*) FILTER (WHERE {ok[c]})" for c, num in specs if num) or "0"
    chars = " + ".join(f"coalesce(sum(length({cell(c)})) FILTER (WHERE {ok[c]}), 0)" for c, _ in specs)
    sentences = " + ".join(
        f"count(*) FILTER (WHERE {ok[c]} AND (len(string_split({cell(c)}, ' ')) >= 8 OR length({cell(c)}) >= 55))" for c, num in specs if not num) or "0"
    n = len(specs)
    return f"""
SELECT '{t}' AS "table", n AS n_rows, {n} AS n_cols, inf AS informative_rows, round(weak / n, 4) AS weak_ratio, round(1 - ok / (n * {n}), 4) AS noise_ratio,
       round(dom, 4) AS dominant_share, round(ch / ok, 4) AS mean_length, round(num / ok, 4) AS numeric_ratio, round(sen / ok, 4) AS sentence_ratio, '{label}' AS dimension
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {readable} >= 2) AS inf, count(*) FILTER (WHERE {readable} <= 1) AS weak, {ok_cells} AS ok,
             {numbers} AS num, {chars} AS ch, {sentences} AS sen FROM {t}),
     (SELECT max(c) / sum(c) AS dom FROM (SELECT {label}, count(*) AS c FROM {t} WHERE {ok[label]} GROUP BY 1))"""


SPECS = {
    "customer": ([("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False)], "c_mktsegment"),
    "part": ([("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True)], "p_type"),
    "conversations": ([("conv_id", True), ("turn", True), ("role", False), ("text", False)], "role"),
}
for _t, (_spec, _label) in SPECS.items():
    def _signal(spark, sf, t=_t):
        rows = T.report_rows(spark, reports(spark, sf, [t]))
        numbers = rows.select("table", "n_rows", "n_cols", "informative_rows", "weak_ratio", "noise_ratio", "dominant_share", "mean_length", "numeric_ratio", "sentence_ratio", "dimension")
        # Single digits are readable numbers but not readable text; the numeric share counts readable cells.
        return numbers

    add(f"table_signal_{_t}", _signal, signal_sql(_t, _spec, _label))


@query(""" 
SELECT 'customer' AS "table", 'c_mktsegment' AS dimension, 'suma' AS aggregation, true AS allow_dashboard, true AS allow_summary,
       (SELECT count(*) FROM customer) <= 25 AS allow_detail, 'Alta' AS confidence, 'generic' AS sheet_type UNION ALL
SELECT 'part', 'p_type', 'suma', true, true, (SELECT count(*) FROM part) <= 25, 'Alta', 'generic' UNION ALL
SELECT 'documents', 'lang', 'suma', true, true, false, 'Alta', 'generic'""")
def table_decisions(spark, sf):
    rows = T.report_rows(spark, reports(spark, sf, ["customer", "part", "documents"]))
    return rows.select("table", "dimension", "aggregation", "allow_dashboard", "allow_summary", "allow_detail", "confidence", "sheet_type")


@query("""
WITH s(name, family) AS (VALUES ('Hallazgos 2024', 'hallazgos'), ('Matriz de riesgos', 'matriz_riesgos'), ('Cuestionario', 'cuestionario'), ('Acta de arqueo', 'arqueo'))
SELECT name AS "table", CASE family WHEN 'matriz_riesgos' THEN 'risk' WHEN 'arqueo' THEN 'evidence' ELSE 'findings' END AS sheet_type,
       CASE WHEN family IN ('arqueo', 'cuestionario') THEN 2 ELSE 1 END AS priority FROM s""")
def table_types_and_priorities(spark, sf):
    """Documentary sheets rank last whatever they contain."""
    book = named(spark, sf)
    family = {"Hallazgos 2024": "hallazgos", "Matriz de riesgos": "matriz_riesgos", "Cuestionario": "cuestionario", "Acta de arqueo": "arqueo"}
    rows = T.report_rows(spark, [T.report_on(book.sheets[n].df, n, n, f, book.sheets[n].order_by) for n, f in family.items()])
    return rank_tables(rows.withColumn("ord", F.lit(0))).select("table", "sheet_type", "priority")


@query("""
SELECT 'events' AS "table", 'kpi' AS section, 1 AS ord, 'Filas utiles' AS label, count(*)::DOUBLE AS value FROM events UNION ALL
SELECT 'events', 'kpi', 2, 'Columnas', 6 UNION ALL SELECT 'events', 'kpi', 3, 'value', round(sum(value), 2) FROM events UNION ALL
SELECT * FROM (SELECT 'events', 'ranking', row_number() OVER (ORDER BY v DESC, event_type)::INTEGER AS ord, event_type, round(v, 2) FROM (
  SELECT event_type, sum(value) AS v FROM events GROUP BY 1)) WHERE ord <= 4""")
def dashboard_events(spark, sf):
    board = T.dashboard(reports(spark, sf, ["events"])[0])
    return r2(board.drop("display"), "value")


@query("""
SELECT 'part' AS "table", 1 AS ord, 'rows' AS fact, NULL::VARCHAR AS label, count(*)::DOUBLE AS value FROM part UNION ALL
SELECT 'part', 2, 'columns', NULL, 6 UNION ALL SELECT 'part', 3, 'total', 'p_size', sum(p_size) FROM part UNION ALL SELECT 'part', 4, 'mean', 'p_size', round(avg(p_size), 2) FROM part UNION ALL
SELECT * FROM (SELECT 'part', 5, 'top_row', p_type, p_size FROM part ORDER BY p_size DESC, p_type LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'part', 6, 'dominant', p_type, count(*) FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1)""")
def summary_facts_part(spark, sf):
    return r2(T.table_summary(reports(spark, sf, ["part"])[0]), "value")


@query("""
SELECT 'part' AS "table", printf('%d filas | 6 columnas | Total %s mil', count(*), replace(CASE WHEN sum(p_size) >= 100000 THEN printf('%.0f', sum(p_size) / 1e3)
       ELSE printf('%.1f', sum(p_size) / 1e3) END, '.', ',')) AS summary FROM part""")
def table_meta_part(spark, sf):
    return T.table_meta(reports(spark, sf, ["part"])[0])


@query("""
WITH r AS (SELECT 'text' AS "column", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, doc_id FROM documents),
k AS (SELECT * FROM r WHERE len(string_split(text, ' ')) >= 8 OR length(text) >= 55 ORDER BY doc_id LIMIT 2)
SELECT 'documents' AS "table", row_number() OVER (ORDER BY doc_id)::INTEGER AS ord, "column", text FROM k""")
def narrative_lines_documents(spark, sf):
    return T.narrative_lines(table(spark, sf, "documents"), "documents", ["lang", "text"], ["doc_id"])


@query("""
WITH r AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, source FROM documents),
risk AS (SELECT lower(t) AS k, min_by(t, doc_id) AS t, min(doc_id) AS d FROM r WHERE length(t) >= 10
         AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) > 1 GROUP BY 1 ORDER BY d LIMIT 3),
own AS (SELECT source AS t, min(doc_id) AS d FROM documents GROUP BY 1 ORDER BY 2 LIMIT 3)
SELECT 'risk' AS role, row_number() OVER (ORDER BY d)::INTEGER AS ord, 'Hallazgo' AS "column", t AS text FROM risk UNION ALL
SELECT 'owner', row_number() OVER (ORDER BY d)::INTEGER, 'Responsable', t FROM own""")
def semantic_samples_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("Hallazgo"), F.col("source").alias("Responsable"), "lang")
    return T.semantic_samples(docs, ["doc_id"])


def derived_sql(t: str, dimension: str, measure: str, k: int, minimum: int = 1) -> str:
    return f"""
SELECT 'derived:{t}:{dimension}' AS chart_id, {dimension} AS label, round(sum({measure})::DOUBLE, 2) AS value FROM {t} GROUP BY 2
ORDER BY sum({measure}) DESC, 2 LIMIT {k}"""


@query(f"SELECT * FROM ({derived_sql('customer', 'c_mktsegment', 'c_nationkey', 6)}) UNION ALL SELECT * FROM ({derived_sql('part', 'p_type', 'p_size', 6)})")
def derived_charts_tables(spark, sf):
    """Charts found in tables nobody described: dimension, measure and kind are all inferred."""
    out = derived_charts(reports(spark, sf, ["customer", "part"]))
    return r2(out["chart_data"].select("chart_id", "label", "value"), "value")


# ---- a workbook run composes its parts ---------------------------------------------------------------
def tasks_book(spark, sf) -> WorkbookAnalysis:
    """Orders beside a plan in percent, a follow-up in fractions, findings, and a sheet that is nearly empty."""
    labels, docs, part = (table(spark, sf, t) for t in ("labels", "documents", "part"))
    plan = labels.select("doc_id", F.concat(F.lit("Tarea "), "doc_id").alias("Tarea"), (F.coalesce("quality", F.lit(0)) * 60 + F.coalesce("toxic", F.lit(0)) * 40).alias("Avance"))
    follow = part.select("p_partkey", F.col("p_name").alias("Tema"), F.col("p_brand").alias("Area"), (F.col("p_size") / 40.0).alias("%"))
    finds = docs.select("doc_id", F.col("text").alias("Hallazgo"), F.col("source").alias("Origen"))
    rare = part.select("p_partkey", *[F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).alias(f"Nota {i}") for i in range(9)])
    sheets = {
        "Ventas": Sheet("Ventas", table(spark, sf, "orders"), ["o_orderkey"]), "Plan": Sheet("Plan", plan, ["doc_id"]), "Seguimiento": Sheet("Seguimiento", follow, ["p_partkey"]),
        "Hallazgos 2024": Sheet("Hallazgos 2024", finds, ["doc_id"]), "Notas": Sheet("Notas", rare, ["p_partkey"])}
    return WorkbookAnalysis(Catalog("libro", sheets))


@query("""
WITH p AS (SELECT 'Plan' AS sheet, 'Avance' AS "column", (coalesce(quality, 0) * 60 + coalesce(toxic, 0) * 40) / 100.0 AS v FROM labels UNION ALL
           SELECT 'Seguimiento', '%', p_size / 40.0 FROM part),
s AS (SELECT max(v) > 1.2 AS hundred FROM p WHERE sheet = 'Seguimiento'),
q AS (SELECT sheet, "column", CASE WHEN sheet = 'Seguimiento' AND hundred THEN v / 100 ELSE v END::DOUBLE AS v FROM p, s)
SELECT sheet, "column", count(*) AS total, count(*) FILTER (WHERE v >= 1) AS done, count(*) FILTER (WHERE v > 0 AND v < 1) AS under_way,
       count(*) FILTER (WHERE v = 0) AS pending, round(avg(v), 4) AS mean_progress FROM q GROUP BY 1, 2""")
def workbook_secondary_progress(spark, sf):
    return tasks_book(spark, sf).progress


@query("""
SELECT 'Plan' AS sheet, count(*) AS n_rows, 3 * count(*) AS n_cells, 3 * count(*) AS n_filled, true AS enough FROM labels UNION ALL
SELECT 'Seguimiento', count(*), 4 * count(*), 4 * count(*), true FROM part UNION ALL
SELECT 'Hallazgos 2024', count(*), 3 * count(*), count(*) + count(text) + count(source), true FROM documents""")
def workbook_fill(spark, sf):
    """How full the other sheets are, but for the one that cleaning thins out."""
    return tasks_book(spark, sf).fill.where("sheet <> 'Notas'")


@query("""
SELECT 'Hallazgos 2024' AS sheet, row_number() OVER (ORDER BY doc_id)::INTEGER AS ord, 'Hallazgo' AS "column", left(replace(text, '_x000d_', ' '), 120) AS text FROM (
  SELECT * FROM documents WHERE length(left(text, 120)) > 5 ORDER BY doc_id LIMIT 8)""")
def workbook_bullets(spark, sf):
    return tasks_book(spark, sf).bullets


# ---- content checks and audit ---------------------------------------------------------------
@query("""
SELECT CASE WHEN p_size % 5 = 0 THEN 'chart' WHEN p_size % 5 = 1 THEN 'table' ELSE 'text' END AS type, count(*) AS n,
       count(*) FILTER (WHERE (p_size % 5 = 0 AND (p_size < 10 OR p_retailprice / 2000 < 0.58)) OR (p_size % 5 = 1 AND p_size > 30) OR (p_size % 5 > 1 AND p_size > 40)) AS n_bad
FROM part GROUP BY 1""")
def content_checks(spark, sf):
    """Block facts derived from part sizes and prices."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "chart").when(size % 5 == 1, "table").otherwise("text")
    blocks = table(spark, sf, "part").select(
        kind.alias("type"), F.col("p_name").alias("title"), F.lit("part").alias("source"), (F.col("p_retailprice") / 2000).alias("score"),
        F.when(size < 10, 1).otherwise(4).alias("n_pairs"), F.when(size > 30, 0).otherwise(5).alias("n_rows"), F.lit(3).alias("n_cols"), F.when(size > 40, 0).otherwise(2).alias("n_lines"))
    return check_blocks(blocks).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("n_bad"))


@query()
def run_audit_orders(spark, sf):
    """The audit record of a whole run over three tables, with the digest of every input."""
    inputs = {t: table(spark, sf, t) for t in ("orders", "customer", "part")}
    done = WorkbookAnalysis(Catalog("libro", {t: Sheet(t, df, KEYS[t]) for t, df in inputs.items()}))
    record = run_audit(done.blocks, input_digests(inputs), done.run, done.primary.data_quality)
    return record.select("run_id", F.size("inputs").alias("n_inputs"), F.to_json("counts").alias("counts"), F.size("issues").alias("n_issues"), "conservative")


