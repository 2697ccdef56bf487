"""The test tables as a workbook: catalog, families, primary sheet, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.operators import audit as A
from sondeo.operators.cellstore import column_facts, distinct_labels, row_facts, store_cells
from sondeo.operators.digest import column_digests, table_digest
from sondeo.operators.profile import shape_types
from sondeo.operators.workbook import classify_sheets, decide_shape, workbook_notes, workbook_profile
from sondeo.plans.catalogue import add, query, table
from sondeo.session import local_table, shared_path, union_all
from sondeo.sources.catalog import Catalog, Sheet, find_sheet, load_catalog, sheet_table
from sondeo.sources.sinks import file_fingerprints, from_report_json, record_runs, recorded_runs, to_report_json

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5,
          "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


def whole(spark, sf) -> Catalog:
    return load_catalog(spark, "libro", {t: f"{sf}/{t}.parquet" for t in KEYS}, order_by=KEYS)


# Sheet names an audit workbook would use, over the same tables.
NAMED = {
    "Base de comisiones": ("orders", "general", 500), "Hallazgos 2024": ("documents", "hallazgos", 120 - 200),
    "Matriz de riesgos": ("part", "matriz_riesgos", 180), "Check list": ("customer", "checklist", 260), "TD": ("supplier", "distribucion", -80 - 200),
    "Resumen ventas": ("lineitem", "general", 180), "Acta de arqueo": ("events", "arqueo", -260), "Cuestionario": ("labels", "cuestionario", 40),
    "COSO": ("nation", "coso", 20 - 200),
}


def named(spark, sf) -> Catalog:
    return Catalog("libro", {n: Sheet(n, table(spark, sf, t), KEYS[t]) for n, (t, *_) in NAMED.items()})


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS sheet, {i} AS ord, count(*) AS n_rows, {w} AS n_cols, count(*) * {w} AS cells FROM {t}" for i, (t, w) in enumerate(WIDTHS.items())))
def sheet_catalog(spark, sf):
    return sheet_table(whole(spark, sf)).select("sheet", "ord", "n_rows", "n_cols", (F.col("n_rows") * F.col("n_cols")).alias("cells"))


FAMILIES = " UNION ALL ".join(
    f"SELECT '{n}' AS sheet, {i} AS ord, '{fam}' AS family, (count(*) * {WIDTHS[t]} + {bonus})::BIGINT AS score FROM {t}"
    for i, (n, (t, fam, bonus)) in enumerate(NAMED.items()))


@query(f"""
WITH s AS ({FAMILIES})
SELECT sheet, family, score, row_number() OVER (ORDER BY score DESC, ord) = 1 AND score >= 0 AS is_primary FROM s""")
def sheet_families(spark, sf):
    return classify_sheets(sheet_table(named(spark, sf))).select("sheet", "family", "score", "is_primary")


@query("""
WITH s AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS sheet, count(*) * {w} AS score FROM {t}" for t, w in WIDTHS.items()) + """)
SELECT sheet, score::BIGINT AS score FROM s ORDER BY score DESC LIMIT 1""")
def primary_sheet(spark, sf):
    return classify_sheets(sheet_table(whole(spark, sf))).where("is_primary").select("sheet", "score")


@query(f"""
WITH s AS ({FAMILIES})
SELECT 'libro' AS workbook, CASE WHEN count(*) FILTER (WHERE family NOT IN ('general', 'distribucion')) >= 3 THEN 'auditoria_control' ELSE 'general' END AS kind,
       count(*) AS n_sheets, string_agg(DISTINCT family, '|' ORDER BY family) FILTER (WHERE family <> 'general') AS families FROM s""")
def workbook_kind(spark, sf):
    return workbook_profile(classify_sheets(sheet_table(named(spark, sf)))).withColumn("families", F.array_join("families", "|"))


@query(f"""
WITH s AS ({FAMILIES}), f AS (SELECT DISTINCT family FROM s)
SELECT 'conclusion' AS note, 2 AS n UNION ALL
SELECT 'insight', (1 + (SELECT count(*) FROM f WHERE family IN ('matriz_riesgos', 'checklist', 'coso')))::INTEGER""")
def workbook_note_counts(spark, sf):
    notes = workbook_notes(workbook_profile(classify_sheets(sheet_table(named(spark, sf)))))
    return notes.groupBy("note").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS sheet, {i} AS ord, count(*) AS n_rows FROM {t}" for i, (n, (t, *_)) in enumerate(NAMED.items())).join(("WITH s AS (", """)
SELECT 'libro' AS workbook, min_by(sheet, ord) FILTER (WHERE contains(lower(sheet), 'coso')) AS coso,
       min_by(sheet, ord) FILTER (WHERE contains(lower(sheet), 'distribucion') OR trim(lower(sheet)) = 'td') AS td,
       min_by(n_rows, ord) FILTER (WHERE contains(lower(sheet), 'coso')) AS coso_rows FROM s""")))
def sheets_by_name(spark, sf):
    """Two sheets found by name, and the rows of the first."""
    sheets = sheet_table(named(spark, sf))
    coso = find_sheet(sheets, contains="coso").withColumnRenamed("sheet", "coso")
    both = coso.join(find_sheet(sheets, contains="distribucion", equals="td").withColumnRenamed("sheet", "td"), "workbook")
    return both.join(sheets.select("workbook", F.col("sheet").alias("coso"), F.col("n_rows").alias("coso_rows")), ["workbook", "coso"])


SHAPES = {"orders": "auto", "part": "auto", "customer": "boardroom", "lineitem": "charts", "documents": "tables"}
SHAPE_SQL = {
    "orders": "SELECT 'TABLE' AS shape, 6::BIGINT AS n_cols, 4::BIGINT AS n_measures, 1::BIGINT AS n_categories",
    "part": "SELECT CASE WHEN count(*) <= 30 THEN 'MIXTO' ELSE 'TABLE' END AS shape, 6::BIGINT AS n_cols, 3::BIGINT AS n_measures, 1::BIGINT AS n_categories FROM part",
    "customer": "SELECT CASE WHEN count(DISTINCT c_mktsegment) <= 10 THEN 'MIXTO' ELSE 'CHART' END AS shape, 5::BIGINT AS n_cols, 3::BIGINT AS n_measures, 1::BIGINT AS n_categories FROM customer",
    "lineitem": "SELECT 'TABLE' AS shape, 11::BIGINT AS n_cols, 8::BIGINT AS n_measures, 2::BIGINT AS n_categories",
    "documents": "SELECT 'TABLE' AS shape, 5::BIGINT AS n_cols, 1::BIGINT AS n_measures, 1::BIGINT AS n_categories",
}
for _t, _mode in SHAPES.items():
    def _shape(spark, sf, t=_t, mode=_mode):
        df = table(spark, sf, t)
        return decide_shape(shape_types(df), F.lit(df.count()), mode)

    add(f"sheet_shape_{_t}", _shape, SHAPE_SQL[_t])


# ---- provenance ---------------------------------------------------------------------------
@query("SELECT 'orders.parquet' AS file")
def unauthorised_inputs(spark, sf):
    """Both files are read; only one is on the list."""
    read = table(spark, sf, "orders").select("o_custkey", "_metadata").join(
        table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    paths = A.referenced_paths(read).unionByName(A.referenced_paths(table(spark, sf, "customer")))
    allowed = A.referenced_paths(table(spark, sf, "customer"))
    return A.unauthorised_paths(paths, allowed).select(F.element_at(F.split("path", "/"), -1).alias("file"))


@query("SELECT 'orders.parquet' AS file, false AS authorised UNION ALL SELECT 'customer.parquet', true")
def plan_dependencies(spark, sf):
    """Both files of a join, from its plan, and whether each is on the list."""
    read = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").count()
    referenced, allowed = A.referenced_paths(read), A.referenced_paths(table(spark, sf, "customer"))
    strange = A.unauthorised_paths(referenced, allowed).withColumn("authorised", F.lit(False))
    told = referenced.join(strange, "path", "left").select(F.regexp_extract("path", r"/([a-z]+\.parquet)", 1).alias("file"), F.coalesce("authorised", F.lit(True)).alias("authorised"))
    return told.distinct()      # a table may be a folder of files


@query("""
SELECT c_mktsegment AS run_id, CASE WHEN c_mktsegment < 'G' THEN 10 * count(*) ELSE count(*) END AS n_rows, round(sum(c_acctbal), 2) AS total
FROM customer GROUP BY 1""")
def audit_of_repeated_runs(spark, sf):
    """A record for each market segment; some are written again with another count and replace what was there."""
    runs = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    folder = shared_path(spark, "audit")
    record_runs(runs, folder)
    record_runs(runs.where("run_id < 'G'").withColumn("n_rows", F.col("n_rows") * 10), folder)
    return recorded_runs(spark, folder, runs.schema)


@query("""
SELECT 'kept' AS side, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey % 7 > 1 UNION ALL
SELECT 'refused', count(*), NULL, min(o_orderkey) FROM orders WHERE o_orderkey % 7 <= 1""")
def refused_records_orders(spark, sf):
    """Orders written as lines, some with a price in letters and some cut short; nothing is lost, each line is on one side."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    line = F.when(key % 7 == 0, F.concat_ws(";", key, F.lit("mil"), "o_orderstatus")).when(key % 7 == 1, F.concat_ws(";", key, price)).otherwise(F.concat_ws(";", key, price, "o_orderstatus"))
    folder = shared_path(spark, "lines")
    table(spark, sf, "orders").select(line.alias("value")).write.text(folder)
    book = load_catalog(spark, "libro", {"pedidos": folder}, "csv", schemas={"pedidos": "clave bigint, precio double, estado string"}, sep=";")
    kept = book.sheets["pedidos"].df.agg(F.lit("kept").alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("precio"), 2).alias("total"), F.min("clave").alias("first_key"))
    told = F.split("record", ";")[0].cast("bigint")
    refused = book.rejected.agg(F.lit("refused").alias("side"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"), F.min(told).alias("first_key"))
    return kept.unionByName(refused)


# ---- facts of all sheets from one store, and digests of what they hold ------------------------------
FACTS = {
    "region": {"r_regionkey": "n", "r_name": "t"}, "nation": {"n_nationkey": "n", "n_name": "t", "n_regionkey": "n"},
    "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"},
    "supplier": {"s_suppkey": "n", "s_name": "t", "s_nationkey": "n", "s_acctbal": "n"}, "labels": {"doc_id": "n", "quality": "n", "toxic": "n"},
}


def _facts_sql() -> str:
    def one(sheet: str, column: str, kind: str) -> str:
        ok = f"length(regexp_replace({column}::VARCHAR, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2"
        number = f"{column}::DOUBLE" if kind == "n" else "NULL::DOUBLE"
        return f"""SELECT '{sheet}' AS sheet, '{column}' AS "column", count(*) AS n_rows, count(*) FILTER ({ok}) AS n, count({number}) AS n_numbers,
          count(*) FILTER ({number} = floor({number})) AS n_whole, count(*) FILTER (abs({number}) > 1e-9) AS n_nonzero,
          count(DISTINCT lower({column}::VARCHAR)) FILTER ({ok}) AS n_distinct, min({number}) AS lowest, max({number}) AS highest, round(sum({number}), 2) AS total FROM {sheet}"""

    return " UNION ALL ".join(one(s, c, k) for s, cs in FACTS.items() for c, k in cs.items())


@query(_facts_sql())
def workbook_facts(spark, sf):
    """Facts of every column of five sheets, grouped by sheet and column over one store of cells."""
    sheets = [Sheet(t, table(spark, sf, t), KEYS[t]) for t in FACTS]
    store = store_cells(sheets)
    named = local_table(spark, [(s, c, sheet.name, name) for s, sheet in enumerate(sheets) for c, name in enumerate(store.columns[s])], "s int, c int, sheet string, column string")
    facts = column_facts(store).join(distinct_labels(store), ["s", "c"], "left").join(row_facts(store), "s").join(named, ["s", "c"])
    return facts.select(
        "sheet", "column", "n_rows", *[f"facts.{x}" for x in ("n", "n_numbers", "n_whole", "n_nonzero")], F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "facts.lowest", "facts.highest", F.round("facts.total", 2).alias("total"))


DIGESTED = {
    "orders": {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "", "o_totalprice": "", "o_orderdate": "", "o_orderpriority": ""},
    "customer": {"c_custkey": "", "c_name": "", "c_nationkey": "", "c_acctbal": "", "c_mktsegment": ""},
    "documents": {"doc_id": "", "text": "", "lang": "", "source": "", "n_chars": ""},
}


def _cell_sql(column: str, how: str) -> str:
    return f"coalesce({how}({column})::VARCHAR, chr(1))" if how else f"coalesce({column}::VARCHAR, chr(1))"


def _sum_sql(text: str, start: int) -> str:
    return f"coalesce(sum(('0x' || substr(md5({text}), {start}, 15))::BIGINT::HUGEINT), 0)::VARCHAR"


def _digest_sql() -> str:
    def one(name: str, columns: dict[str, str]) -> str:
        text = " || chr(2) || ".join(_cell_sql(c, columns[c]) for c in sorted(columns))
        return f"SELECT '{name}' AS \"table\", '{','.join(sorted(columns))}' AS columns, count(*) AS n_rows, {_sum_sql(text, 1)} AS sum_1, {_sum_sql(text, 16)} AS sum_2 FROM {name}"

    sums = " UNION ALL ".join(one(t, cs) for t, cs in DIGESTED.items())
    return f"SELECT \"table\", n_rows, sum_1, sum_2, sha256(columns || chr(2) || n_rows || chr(2) || sum_1 || chr(2) || sum_2) AS digest FROM ({sums})"


@query(_digest_sql())
def content_digests(spark, sf):
    """Digests of the rows of three tables, whatever files they lie in."""
    return union_all([table_digest(table(spark, sf, t)).select(F.lit(t).alias("table"), "n_rows", "sum_1", "sum_2", "digest") for t in DIGESTED])


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_filled, {_sum_sql(_cell_sql(c, how), 1)} AS sum_1, {_sum_sql(_cell_sql(c, how), 16)} AS sum_2 FROM orders" for c, how in DIGESTED["orders"].items()))
def column_digests_orders(spark, sf):
    return column_digests(table(spark, sf, "orders"))


@query()
def input_fingerprints(spark, sf):
    files = file_fingerprints(spark, f"{sf}/*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("""
SELECT c_mktsegment AS run_id, count(*) AS n_tables, concat_ws('; ', 'fuera del flujo especializado de comisiones',
       CASE WHEN c_mktsegment LIKE 'F%' THEN 'resumen generico presente' END, CASE WHEN c_mktsegment NOT LIKE 'M%' THEN 'modo solicitado: charts' END) AS reasons,
       true AS conservative FROM customer GROUP BY 1""")
def conservative_runs(spark, sf):
    """Run facts derived per market segment, to exercise every reason at once."""
    segment = F.col("c_mktsegment")
    runs = table(spark, sf, "customer").groupBy(segment.alias("run_id")).agg(F.count(F.lit(1)).alias("n_tables")).select(
        "run_id", "n_tables", F.lit(True).alias("has_result"), F.lit(False).alias("is_commissions"),
        F.col("run_id").startswith("F").alias("has_generic_summary"), F.when(F.col("run_id").startswith("M"), "mixed").otherwise("charts").alias("mode"))
    return A.conservative_mode(runs).select("run_id", "n_tables", F.array_join("reasons", "; ").alias("reasons"), "conservative")


@query("""
SELECT source AS archivo, CASE WHEN source <> 'src0' THEN 'unauthorised data dependency: ' || source END AS problem FROM documents
WHERE source <> 'src0' GROUP BY 1, 2""")
def source_mismatches(spark, sf):
    """Stored reports that name another input than the one being processed."""
    reports = table(spark, sf, "documents").groupBy(F.col("source").alias("archivo")).agg(F.collect_set("lang").alias("hojas_encontradas")).withColumn("error", F.lit(None).cast("string"))
    problems = A.source_problems(reports, "/entrada/src0")
    return problems.select(F.element_at(F.split("problem", ": "), 2).alias("archivo"), "problem")


@query("SELECT lang AS label, count(*) AS value FROM documents GROUP BY 1")
def report_json_round_trip(spark, sf):
    from sondeo.operators.groups import frequency

    stored = to_report_json(frequency(table(spark, sf, "documents"), "lang"))
    return from_report_json(stored, "label string, value bigint")
