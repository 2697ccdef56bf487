"""Raw grids, header detection and cleaning.

The grids are built from the tables: a title row, a tag row, the column names, then the
data, all as text cells with their position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.functions import names
from sondeo.operators import cleaning as C
from sondeo.operators import structure as S
from sondeo.operators.readers import finding_bullets, read_first_column, read_hierarchy, secondary_table
from sondeo.plans.catalogue import query, table
from sondeo.session import local_table, shared_path
from sondeo.sources.grid import GRID_COLUMNS, as_grid, read_grid
from sondeo.sources.sinks import read_organised, write_organised

SHEETS = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
}


def grid(spark, sf) -> DataFrame:
    parts = []
    for name, (key, columns) in SHEETS.items():
        blanks = [None] * (len(columns) - 1)
        top = [("libro", name, 0, [f"TITLE: Hoja {name}", *blanks]), ("libro", name, 1, ["Datos base", *blanks]),
               ("libro", name, 2, ["TYPE: CHART", *blanks]), ("libro", name, 3, [*columns[:-1], "Unnamed: 9"]), ("libro", name, 4, columns)]
        parts.append(local_table(spark, top, "workbook string, sheet string, row_ord bigint, cells array<string>"))
        data = table(spark, sf, name)
        parts.append(as_grid(data, "libro", name, F.col(key) + 5, columns))
    return reduce(DataFrame.unionByName, parts)


def grid_sql() -> str:
    parts = []
    for name, (key, columns) in SHEETS.items():
        pad = ", NULL" * (len(columns) - 1)
        listed = ", ".join(f"'{c}'" for c in columns)
        parts.append(f"""
SELECT '{name}' AS sheet, 0::BIGINT AS row_ord, ['TITLE: Hoja {name}'{pad}]::VARCHAR[] AS cells UNION ALL
SELECT '{name}', 1, ['Datos base'{pad}] UNION ALL SELECT '{name}', 2, ['TYPE: CHART'{pad}] UNION ALL
SELECT '{name}', 3, [{', '.join(f"'{c}'" for c in columns[:-1])}, 'Unnamed: 9'] UNION ALL
SELECT '{name}', 4, [{listed}] UNION ALL
SELECT '{name}', {key} + 5, [{', '.join(f'{c}::VARCHAR' for c in columns)}] FROM {name}""")
    return " UNION ALL ".join(parts)


HEADERS = f"""
WITH g AS ({grid_sql()}),
n AS (SELECT sheet, row_ord, cells, len([c FOR c IN cells IF c IS NOT NULL AND trim(c) <> '' AND NOT starts_with(c, 'Unnamed')
             AND NOT contains(c, 'TITLE:') AND NOT contains(c, 'TYPE:')]) AS n FROM g WHERE row_ord < 20)
SELECT sheet, row_ord AS header_row, array_to_string(cells, '|') AS header FROM n WHERE n >= 2
QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY n DESC, row_ord) = 1"""


@query(HEADERS)
def grid_headers(spark, sf):
    return S.detect_headers(grid(spark, sf)).select("sheet", "header_row", F.array_join("header", "|").alias("header"))


@query(f"""
WITH g AS ({grid_sql()}),
n AS (SELECT sheet, row_ord, len([c FOR c IN cells IF c IS NOT NULL AND trim(c) <> '']) AS n FROM g WHERE row_ord < 20)
SELECT sheet, min(row_ord) AS header_row FROM n WHERE n >= 2 GROUP BY sheet""")
def grid_headers_first(spark, sf):
    return S.detect_headers(grid(spark, sf), "first").select("sheet", "header_row")


@query(f"""
WITH g AS ({grid_sql()}), h AS ({HEADERS}),
a AS (SELECT g.sheet, trim(cells[1]) AS t, len([c FOR c IN cells IF c IS NOT NULL AND trim(c) <> '']) AS filled FROM g JOIN h USING (sheet) WHERE row_ord < header_row)
SELECT sheet, max(trim(substr(t, 7))) FILTER (WHERE starts_with(t, 'TITLE:')) AS title,
       max(t) FILTER (WHERE filled = 1 AND length(t) > 3 AND NOT regexp_matches(t, '^(TITLE|SUBTITLE|TYPE):')) AS subtitle,
       max(trim(substr(t, 6))) FILTER (WHERE starts_with(t, 'TYPE:')) AS type FROM a GROUP BY 1""")
def grid_tags(spark, sf):
    g = grid(spark, sf)
    return S.sheet_tags(g, S.detect_headers(g)).drop("workbook")


@query(f"""
WITH g AS ({grid_sql()}), h AS ({HEADERS})
SELECT g.sheet, count(*) AS n_rows, min(row_ord) AS first_row, max(row_ord) AS last_row
FROM g JOIN h USING (sheet) WHERE row_ord > header_row GROUP BY 1""")
def grid_body(spark, sf):
    g = grid(spark, sf)
    rows = S.body_rows(g, S.detect_headers(g))
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_ord").alias("first_row"), F.max("row_ord").alias("last_row"))


@query(f"""
WITH g AS ({grid_sql()}), h AS ({HEADERS})
SELECT g.sheet, 'Hoja ' || g.sheet AS title, row_ord, array_to_string(cells, '|') AS line FROM g JOIN h USING (sheet) WHERE row_ord > header_row AND sheet IN ('part', 'supplier')""")
def organised_store(spark, sf):
    """Two of three sheets read back from a store, each row beside the title of its sheet."""
    g = grid(spark, sf)
    heads, folder = S.detect_headers(g), shared_path(spark, "organised")
    write_organised(S.body_rows(g, heads), S.sheet_tags(g, heads), folder)
    rows, tags = read_organised(spark, folder, ["part", "supplier"])
    return rows.join(F.broadcast(tags.select("sheet", "title")), "sheet").select("sheet", "title", "row_ord", F.array_join("cells", "|").alias("line"))


@query("""
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, min(c_name) AS first_name FROM customer GROUP BY 1""")
def materialized_sheet(spark, sf):
    sheet = S.materialize(grid(spark, sf), "libro", "customer")
    return sheet.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"), F.min("c_name").alias("first_name"))


@query("SELECT p_partkey::VARCHAR AS key, p_name AS name FROM part WHERE p_partkey >= 3")
def grid_scan_skipping_rows(spark, sf):
    raw = read_grid(spark, f"{sf}/part.parquet", "libro", "part", skip_rows=3)
    assert raw.columns == GRID_COLUMNS
    return raw.select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


# ---- cleaning of a messy table derived from orders ------------------------------------------
MESSY_COLUMNS = {
    "clave": "o_orderkey",
    "Id Comisión": "CASE WHEN o_orderkey % 17 <> 0 THEN concat('C-', o_orderkey) END",
    "Solicitante": "CASE WHEN o_orderkey % 11 <> 0 THEN concat('Cliente ', o_custkey) END",
    "Ciudad Destino": "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END",
    "Valor Total Solicitado": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END",
    "Estado": "CASE o_orderstatus WHEN 'O' THEN 'Abierta' WHEN 'F' THEN 'Cerrada' ELSE 'Parcial' END",
    "Centro de Costos": "CASE WHEN o_custkey % 13 = 0 THEN '-' ELSE concat('CC', o_custkey % 25) END",
    "Valor Tiquete Solicitado": "o_totalprice * 0.5",
    "Valor Hospedaje Solicitado": "o_totalprice * 0.25",
    "Nota": "CASE WHEN o_orderkey % 13 = 0 THEN 'Agrega una COLUMNA aqui' WHEN o_orderkey % 4 = 0 THEN '—' ELSE o_orderpriority END",
    "Col_10": "CASE WHEN o_orderkey % 50 = 0 THEN 'dato' END",
}
MESSY = "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in MESSY_COLUMNS.items()) + " FROM orders"


def messy(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(*[F.expr(e).alias(c) for c, e in MESSY_COLUMNS.items()])


JUNK = "regexp_matches(lower({0}), 'diapositiva|power point|powerpoint|agrega|información|columna|imagen adjunta|placeholder')"


@query(f"""SELECT clave FROM ({MESSY}) WHERE NOT {JUNK.format('"Nota"')}""")
def junk_rows_removed(spark, sf):
    return C.remove_junk_rows(messy(spark, sf)).select("clave")


@query(f"""SELECT clave FROM ({MESSY}) WHERE "Id Comisión" IS NOT NULL""")
def key_rows_kept(spark, sf):
    return C.require_keys(messy(spark, sf)).select("clave")


PHANTOM = "({0} IS NULL OR lower(trim({0})) IN ('n/a', '-', '—'))"


@query(f"""
SELECT clave FROM ({MESSY})
WHERE (NOT {PHANTOM.format('"Solicitante"')})::INT + (NOT {PHANTOM.format('"Ciudad Destino"')})::INT + (NOT {PHANTOM.format('"Centro de Costos"')})::INT >= 2""")
def phantom_rows_dropped(spark, sf):
    return C.drop_phantom_rows(messy(spark, sf), 2, columns=["Solicitante", "Ciudad Destino", "Centro de Costos"]).select("clave")


NOISY = """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE source END AS fuente, CASE WHEN doc_id % 4 = 0 THEN 'N/D' WHEN doc_id % 4 = 1 THEN '' ELSE lang END AS idioma,
       CASE WHEN doc_id % 9 = 0 THEN lang END AS "Columna 3", CASE WHEN doc_id % 100 = 0 THEN lang END AS "Columna 4" FROM documents"""


def noisy(spark, sf) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf, "documents").select(
        key, F.when(key % 6 == 0, "x").otherwise(F.col("source")).alias("fuente"),
        F.when(key % 4 == 0, "N/D").when(key % 4 == 1, "").otherwise(F.col("lang")).alias("idioma"),
        F.when(key % 9 == 0, F.col("lang")).alias("Columna 3"), F.when(key % 100 == 0, F.col("lang")).alias("Columna 4"))


READABLE = '(doc_id % 6 <> 0)::INT + (doc_id % 4 >= 2)::INT + (doc_id % 9 = 0)::INT + (doc_id % 100 = 0)::INT'


@query(f"SELECT doc_id FROM ({NOISY}) WHERE {READABLE} >= 2")
def informative_rows(spark, sf):
    columns = ["fuente", "idioma", "Columna 3", "Columna 4"]
    scored = noisy(spark, sf).where(C.meaningful_cells(columns) >= 2)
    return scored.select("doc_id")


@query(f"""
SELECT count(*) AS n_rows, (SELECT count(*) FROM ({NOISY}) WHERE {READABLE} >= 2 AND doc_id % 9 = 0) AS n_third, 3 AS n_cols
FROM ({NOISY}) WHERE {READABLE} >= 2""")
def report_table_documents(spark, sf):
    """Noise rows and the almost empty generic column go; the better filled generic one stays."""
    cleaned = C.report_table(noisy(spark, sf).drop("doc_id"))
    return cleaned.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("Columna 3") != "").alias("n_third"), F.lit(len(cleaned.columns)).alias("n_cols"))


@query(f"""
SELECT count(*) AS n_rows, string_agg(DISTINCT "Estado", '|' ORDER BY "Estado") AS states, 10 AS n_cols FROM ({MESSY})""")
def sparse_columns_dropped(spark, sf):
    kept = C.drop_sparse_columns(messy(spark, sf))
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set("Estado")), "|").alias("states"), F.lit(len(kept.columns)).alias("n_cols"))


@query("""
SELECT count(*) AS n_rows, count(p_name) AS n_filled, 2 AS n_cols FROM part""")
def empty_columns_dropped(spark, sf):
    nothing = F.when(F.col("p_partkey") < 0, F.col("p_name"))
    wide = table(spark, sf, "part").select(nothing.alias("a"), nothing.alias("b"), "p_name", nothing.alias("c"), "p_size")
    kept = C.drop_empty(C.strip_leading_empty(wide))
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count("p_name").alias("n_filled"), F.lit(len(kept.columns)).alias("n_cols"))


@query(f"""
SELECT coalesce("Solicitante", '—') AS who, count(*) AS n, round(sum(coalesce("Valor Total Solicitado", 0)), 2) AS total FROM ({MESSY}) GROUP BY 1""")
def nulls_filled(spark, sf):
    filled = C.fill_nulls(messy(spark, sf))
    return filled.groupBy(F.col("Solicitante").alias("who")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Valor Total Solicitado"), 2).alias("total"))


@query("""
SELECT o_orderkey, o_orderdate::DATE AS fecha, month(o_orderdate)::INT AS mes, strftime(o_orderdate, '%Y%m%d')::INT AS fecha_corte, 5 + o_orderkey % 21 AS candidates
FROM orders""")
def serial_date_columns(spark, sf):
    """Day serials become dates; month numbers, dates written as numbers and look-alike headers keep their values."""
    from sondeo.functions.vocabulary import EXCEL_EPOCH

    day = F.col("o_orderdate")
    return C.fix_serial_dates(table(spark, sf, "orders").select(
        "o_orderkey", F.date_diff(day, F.lit(EXCEL_EPOCH).cast("date")).alias("fecha"), F.month(day).alias("mes"),
        F.date_format(day, "yyyyMMdd").cast("int").alias("fecha_corte"), (F.col("o_orderkey") % 21 + 5).alias("candidates")))


@query("""
SELECT row_ord, p_partkey::VARCHAR AS key, p_name AS name
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_ord FROM part) WHERE row_ord >= 3""")
def grid_of_several_files(spark, sf):
    """A sheet kept in four files loses its first three rows, not three of each file."""
    folder = shared_path(spark, "grid")
    table(spark, sf, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.parquet(folder)
    grid = read_grid(spark, folder, "libro", "part", skip_rows=3)
    return grid.select("row_ord", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


@query(f"""
SELECT "Id Comisión", left("Solicitante", 70) AS "Solicitante", left("Ciudad Destino", 70) AS "Ciudad Destino", "Valor Total Solicitado",
       "Estado", "Centro de Costos" FROM ({MESSY})""")
def main_table_commissions(spark, sf):
    return C.main_table(messy(spark, sf), [])


@query("""
SELECT left(text, 200) AS "Hallazgo", lang AS "Estado", source AS "Evidencia", n_chars AS "Largo" FROM documents ORDER BY doc_id LIMIT 50""")
def findings_table(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("n_chars").alias("Largo"), F.col("text").alias("Hallazgo"), F.col("lang").alias("Estado"), F.col("source").alias("Evidencia"), F.col("doc_id").alias("row_ord"))
    return secondary_table(docs, ["row_ord"], "hallazgos")


@query(r"""
SELECT left(replace(text, '_x000d_', ' '), 120) AS text FROM documents WHERE length(left(text, 120)) > 5 ORDER BY doc_id LIMIT 8""")
def findings_bullets(spark, sf):
    return finding_bullets(table(spark, sf, "documents"), "text", ["doc_id"])


@query(f"""SELECT count(*) AS valid_rows FROM ({MESSY})""")
def valid_rows_messy(spark, sf):
    return C.valid_row_count(messy(spark, sf))


@query("""
SELECT 'orders' AS sheet, 'Costo real' AS "column", min(o_orderkey) AS row,
       min_by('dato ' || o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderkey % 997 = 900""")
def first_bad_number(spark, sf):
    text = F.when(F.col("o_orderkey") % 997 == 900, F.concat(F.lit("dato "), "o_orderpriority")).otherwise(F.concat(F.lit("$ "), F.format_number("o_totalprice", 2)))
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("Costo real"), F.lit("NA").alias("Total"))
    return C.declared_numeric_violations(df, "orders", "o_orderkey")


# ---- special layouts ------------------------------------------------------------------------
@query("""
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN p_brand END AS g, p_name AS item,
                  CASE WHEN p_size < 5 THEN 'n/a' ELSE p_type END AS st, p_type || ' ' || p_size AS act FROM part)
SELECT p_partkey + 5 AS row_ord, last_value(g IGNORE NULLS) OVER (ORDER BY p_partkey) AS "Componente", item AS "Ítems Evaluados",
       CASE WHEN st = 'n/a' THEN 'Pendiente de evaluacion' ELSE st END AS "Estado", act AS "Acción Recomendada" FROM s""")
def hierarchy_reader(spark, sf):
    """Merged group cells over items, below three rows of titles and an empty first column."""
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        key, F.lit(None).cast("string").alias("blank"), F.when(key % 20 == 0, F.col("p_brand")).alias("g"), F.col("p_name").alias("item"),
        F.when(F.col("p_size") < 5, "n/a").otherwise(F.col("p_type")).alias("st"), F.concat_ws(" ", "p_type", "p_size").alias("act"))
    rows = as_grid(parts, "libro", "coso", key + 5, ["blank", "g", "item", "st", "act"])
    top = local_table(spark, [("libro", "coso", i, c) for i, c in (
        (0, ["Evaluacion"]), (1, [None]), (2, [None]), (3, [None, "nota"]), (4, [None, "Componente", "Item", "Estado", "Accion"]))],
        "workbook string, sheet string, row_ord bigint, cells array<string>")
    return read_hierarchy(rows.unionByName(top), block_rows=500)


@query("""SELECT c_custkey AS row_ord, c_name AS "Centro de Costos" FROM customer WHERE c_custkey > 0 AND c_custkey % 2 = 0 ORDER BY c_custkey LIMIT 12""")
def first_column_reader(spark, sf):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("n"), "c_mktsegment")
    return read_first_column(as_grid(rows, "libro", "td", F.col("c_custkey"), ["n", "c_mktsegment"]))


@query("""SELECT c_mktsegment AS "Riesgo", c_custkey, c_name FROM customer""")
def semantic_columns(spark, sf):
    """The columns a findings sheet cares about come first, then the rest up to the limit."""
    df = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "Riesgo")
    return C.select_columns(df, names.pick_columns(df.columns, "hallazgos", limit=3))
