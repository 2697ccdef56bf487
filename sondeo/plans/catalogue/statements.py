"""Statements, conclusions and lights over a sheet of sales in which every kind of them has something to say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.operators.correlation import NOTABLE, STRONG
from sondeo.plans.analyze import TableAnalysis
from sondeo.plans.catalogue import query, table
from sondeo.plans.catalogue.analyses import outliers_sql, trend_sql
from sondeo.plans.catalogue.cells import COMPACT, SUFFIX
from sondeo.plans.catalogue.groups import summary_sql

# Orders as sales: they grow by the year (trend, outliers), cost follows value (correlation), one zone holds three
# quarters (concentration, imbalance), hours are missing in two of five rows (gaps).
SALES = """
SELECT o_orderkey AS id, o_orderdate AS fecha_venta, CASE WHEN o_custkey % 20 < 15 THEN 'Norte' ELSE concat('Zona ', o_custkey % 20) END AS zona,
       o_totalprice * (1 + 4 * (year(o_orderdate) - 1992)) AS valor_venta,
       o_totalprice * (2 + 8 * (year(o_orderdate) - 1992)) + 1000 * (o_orderkey % 7) AS costo_venta,
       CASE WHEN o_orderkey % 5 >= 2 THEN CAST(40 + o_custkey % 7 AS DOUBLE) + 1 / CAST(2 AS DOUBLE) END AS horas FROM orders"""


def sales(spark, sf) -> TableAnalysis:
    rows: DataFrame = spark.sql(SALES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    return TableAnalysis(rows, "ventas", ["id"])


def metric(value: str, column: str) -> str:
    """The display form of a figure: ``COP 1,2 M``, or without the currency for hours."""
    scaled = f"({COMPACT.format(value)})"
    return f"""(CASE WHEN {column} = 'horas' THEN '' ELSE 'COP ' END ||
      replace(CASE WHEN abs({scaled}) >= 100 THEN printf('%.0f', {scaled}) ELSE printf('%.1f', {scaled}) END, '.', ',') || ({SUFFIX.format(value)}))"""


def number(value: str) -> str:
    return rf"regexp_replace(round({value}, 1)::DOUBLE::VARCHAR, '\.0$', '')"


MEASURES = ["valor_venta", "costo_venta", "horas"]
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS raw FROM s" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:])
FACTS = f"""
WITH s AS MATERIALIZED ({SALES}),
o AS ({outliers_sql('s', MEASURES)}),
c AS (SELECT a, b, round_even(raw, 3) AS r, CASE WHEN raw > 0 THEN 'positiva' ELSE 'negativa' END || CASE WHEN abs(raw) >= {STRONG} THEN ' fuerte' ELSE ' moderada' END AS label
      FROM ({PAIRS}) WHERE abs(raw) >= {NOTABLE} ORDER BY abs(raw) DESC, a, b LIMIT 2),
t AS ({trend_sql('s', 'fecha_venta', 'valor_venta', 'month')}),
p AS ({summary_sql('s', 'zona', 'sum(valor_venta)', 'valor_venta')}),
z AS (SELECT zona, n, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, zona) AS place, count(*) OVER () AS groups FROM (SELECT zona, count(*) AS n FROM s GROUP BY 1)),
g AS (SELECT count(*) AS n, count(*) - count(horas) AS missing FROM s),
v AS ({" UNION ALL ".join(f"SELECT '{m}' AS c, stddev_samp({m}) / avg({m}) AS cv, avg({m}) AS mean, min({m}) AS least, max({m}) AS most FROM s" for m in MEASURES)})"""


@query(f"""{FACTS}
SELECT 'anomalia' AS kind, 88 AS importance, '''' || "column" || ''' tiene ' || n_outliers || ' valores atipicos (' || {number('pct')} || '%): lo normal llega a '
       || {metric('upper', '"column"')} || ' y hay hasta ' || {metric('max_outlier', '"column"')} || '.' AS text FROM o UNION ALL
SELECT 'concentracion', CASE concentration WHEN 'alta' THEN 95 ELSE 80 END, '''' || leader || ''' aporta el ' || {number('leader_share')} || '% de valor_venta; ' || n80 || ' de '
       || n_categories || ' categorias reunen el 80%.' FROM p WHERE concentration <> 'dispersa' UNION ALL
SELECT 'tendencia', 85, 'Tendencia ' || direction || ' de ''valor_venta'': cambio de ' || printf('%+.1f', change_pct) || '% entre inicio y cierre.' FROM t WHERE direction <> 'estable' UNION ALL
SELECT 'correlacion', 75, 'Correlacion ' || label || ' (' || printf('%.2f', r) || '): cuando ''' || a || ''' sube, ''' || b || ''' ' || CASE WHEN r > 0 THEN 'tambien crece.' ELSE 'decrece.' END FROM c UNION ALL
SELECT 'desbalance', 72, 'En ''zona'' domina ''' || zona || ''' con el ' || printf('%.0f', n * 100.0 / total) || '% (' || n || ' de ' || total || ').' FROM z WHERE place = 1 AND n * 100.0 / total > 55 UNION ALL
SELECT 'calidad_datos', 60, 'Faltan datos en: ''horas'' (' || printf('%.0f', missing * 100.0 / n) || '%).' FROM g WHERE missing * 100.0 / n > 15""")
def insight_texts_sales(spark, sf):
    """All six kinds of insights, sentence and weight."""
    return sales(spark, sf).insights.select("kind", "importance", "text")


@query(f"""{FACTS}
SELECT 'tamano' AS kind, 'Base de ' || format('{{:,}}', n) || ' registros y 5 columnas con informacion.' AS text FROM g UNION ALL
SELECT 'concentracion', CASE concentration WHEN 'alta' THEN 'Concentracion critica en ''zona'': ' || n80 || ' de ' || n_categories || ' categorias (' || printf('%.0f', pct80) || '%) reunen el 80%; lidera ''' || leader
       || ''' con ' ELSE 'Concentracion moderada en ''zona'': encabeza ''' || leader || ''' con ' END || {number('leader_share')} || '%.' FROM p WHERE concentration <> 'dispersa' UNION ALL
SELECT 'anomalia', CASE WHEN n_outliers >= 2 THEN n_outliers || ' valores atipicos en ''' || "column" || ''' fuera de ' || {metric('lower', '"column"')} || ' a ' || {metric('upper', '"column"')}
       || '; el mayor es ' || {metric('max_outlier', '"column"')} || '.' ELSE 'Un valor atipico de ' || {metric('max_outlier', '"column"')} || ' en ''' || "column" || '''.' END FROM o UNION ALL
SELECT 'correlacion', 'Correlacion ' || label || ' (r=' || printf('%.2f', r) || ') entre ''' || a || ''' y ''' || b || '''.' FROM c UNION ALL
SELECT 'tendencia', 'Tendencia ' || upper(direction) || ' en ''valor_venta'': ' || printf('%+.1f', change_pct) || '%, de ' || {metric('mean_start', "''")} || ' a ' || {metric('mean_end', "''")} || ' en promedio.' FROM t UNION ALL
SELECT 'variabilidad_alta', 'Alta variabilidad en ''' || c || ''' (CV=' || printf('%.1f', cv) || '): de ' || {metric('least', 'c')} || ' a ' || {metric('most', 'c')} || ', promedio ' || {metric('mean', 'c')} || '.' FROM v WHERE cv > 1 UNION ALL
SELECT 'variabilidad_moderada', 'Variabilidad moderada en ''' || c || ''' (CV=' || printf('%.1f', cv) || '): promedio ' || {metric('mean', 'c')} || ', maximo ' || {metric('most', 'c')} || '.' FROM v WHERE cv > 0.5 AND cv <= 1 UNION ALL
SELECT 'dominancia', '''zona'' se concentra en ''' || max(zona) FILTER (WHERE place = 1) || ''' (' || printf('%.0f', max(n * 100.0 / total) FILTER (WHERE place = 1)) || '%), seguido de '''
       || max(zona) FILTER (WHERE place = 2) || ''' (' || printf('%.0f', max(n * 100.0 / total) FILTER (WHERE place = 2)) || '%).' FROM z HAVING max(n * 100.0 / total) > 50 UNION ALL
SELECT 'datos_faltantes', '''horas'': ' || format('{{:,}}', missing) || ' registros en blanco (' || printf('%.0f', missing * 100.0 / n) || '%).' FROM g WHERE missing * 100.0 / n > 20""")
def conclusion_texts_sales(spark, sf):
    """The sentences of a table's conclusions, all of them with figures."""
    return sales(spark, sf).conclusions.select("kind", "text")


@query(f"""{FACTS}
SELECT 1 AS ord, 'Tendencia' AS label, CASE WHEN direction = 'creciente' THEN 'verde' WHEN direction = 'estable' OR abs(change_pct) < 15 THEN 'amarillo' ELSE 'rojo' END AS status, printf('%+.1f', change_pct) || '%' AS metric FROM t UNION ALL
SELECT 2, 'Concentracion', CASE WHEN leader_share >= 45 THEN 'rojo' WHEN leader_share >= 30 THEN 'amarillo' ELSE 'verde' END, printf('%.0f', leader_share) || '%' FROM p UNION ALL
SELECT 4, 'Calidad de datos', 'amarillo', 'Revision' FROM g WHERE missing * 100.0 / n > 15""")
def traffic_lights_sales(spark, sf):
    """The lights of trend, concentration and data quality; that of outliers shows one of two columns."""
    return sales(spark, sf).traffic_lights.where("label <> 'Anomalias'").select("ord", "label", "status", "metric")
