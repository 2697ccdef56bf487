"""Messy grids, cleaning rules, sheet families and the reference's own five checks."""

import pytest
from pyspark.sql import functions as F

from sondeo.functions.numbers import number_view
from sondeo.operators import audit as A
from sondeo.operators import cleaning as C
from sondeo.operators import structure as S
from sondeo.operators.profile import profile_columns, shape_types
from sondeo.operators.readers import read_hierarchy
from sondeo.operators.workbook import classify_sheets, sheet_type
from sondeo.plans.analyze import TableAnalysis, WorkbookAnalysis
from sondeo.session import local_table
from sondeo.sources import sinks
from sondeo.sources.catalog import Catalog, Sheet, load_catalog, sheet_table
from sondeo.sources.grid import read_grid, write_grid

GRID = "workbook string, sheet string, row_ord bigint, cells array<string>"


def grid(spark, rows, sheet="h"):
    return local_table(spark, [("w", sheet, i, r) for i, r in enumerate(rows)], GRID)


def test_guide_sheet(spark):
    g = grid(spark, [["TITLE: Ventas", None], ["TYPE: CHART", None], ["SUBTITLE: 2024", None], ["Mes", "Valor"], ["Enero", "1500"], [None, " "], ["Febrero", "2200"]])
    headers = S.detect_headers(g)
    assert headers.first().header_row == 3
    tags = S.sheet_tags(g, headers).first()
    assert (tags.title, tags.subtitle, tags.type) == ("Ventas", "2024", "CHART")
    table = S.materialize(g, "w", "h", keep_order=False)
    assert table.columns == ["Mes", "Valor"] and table.count() == 2


def test_headers_with_blanks_repeats_and_an_empty_column(spark):
    g = grid(spark, [["informe", None, None, None], ["a", None, "a", "b"], ["1", "x", "2", None], ["3", "y", None, None]])
    assert S.materialize(g, "w", "h", keep_order=False).columns == ["a", "Col_1", "a_1"]
    assert S.detect_headers(g, "first").first().header_row == 1


def test_lone_cells_become_titles(spark):
    g = grid(spark, [["Informe anual", None], ["Detalle", None], ["k", "v"], ["1", "2"]])
    tags = S.sheet_tags(g, S.detect_headers(g)).first()
    assert (tags.title, tags.subtitle, tags.type) == ("Informe anual", "Detalle", None)


def test_informative_rows_fall_back(spark):
    poor = spark.createDataFrame([("ab", "x", None), ("x", "", None)], "a string, b string, c string")
    assert C.keep_informative_rows(poor).count() == 1
    rich = spark.createDataFrame([("ab", "cd", None), ("ef", "", None)], "a string, b string, c string")
    assert C.keep_informative_rows(rich).count() == 1


def test_hierarchy_without_header_words(spark):
    rows = [[None], [None], [None], ["Componente", "Item", "Estado"], ["Ambiente", "Etica y valores", None], [None, "Supervision", "Alta"], [None, "ab", "x"]]
    found = read_hierarchy(grid(spark, rows)).orderBy("row_ord").collect()
    assert [tuple(r)[1:] for r in found] == [("Ambiente", "Etica y valores", "Pendiente de evaluacion"), ("Ambiente", "Supervision", "Alta")]


def test_roles(spark):
    rows = [(i, f"C-{i}", ["norte", "sur"][i % 2], f"$ {i * 37 % 91}.000", i % 3 == 0, float((i * 31) % 57)) for i in range(40)]
    df = spark.createDataFrame(rows, "orden int, codigo string, zona string, `Valor Total` string, activo boolean, medida double")
    roles = {p.column: p.role for p in profile_columns(df, ["orden"])}
    assert roles == {"orden": "identificador", "codigo": "identificador", "zona": "categorica", "Valor Total": "numerico", "activo": "categorica", "medida": "numerico"}
    assert {r.column: r.type for r in shape_types(df).collect()}["Valor Total"] == "currency"
    assert shape_types(df, ["orden"], sample_rows=30).count() == 6


def test_mixed_currency_below_the_gate_is_not_trusted(spark):
    rows = [(100.0, "USD", None), (200.0, "COP", None), (300.0, "EUR", 0.0), (400.0, "USD", 4000.0)]
    df = spark.createDataFrame(rows, "`Valor Total` double, Moneda string, TRM double")
    p = next(p for p in profile_columns(df) if p.column == "Valor Total")
    assert (p.currencies, p.unresolved_rows, p.resolved_ratio, p.trusted) == (["COP", "EUR", "USD"], 2, 0.5, False)


def test_families(spark):
    schema = "a string, b string"
    one = spark.createDataFrame([("x", "y"), ("z", "w")], schema)
    riesgos = spark.createDataFrame([("x", "y"), ("z", "w")], "Riesgo string, `Causa / Consecuencia` string")
    book = Catalog("w", {n: Sheet(n, df) for n, df in {"Evaluación COSO": one, "Hallazgos": one, "Hoja3": riesgos, "TD": one, "Ventas": one, "metodos": one}.items()})
    found = {r.sheet: r for r in classify_sheets(sheet_table(book)).collect()}
    assert {n: r.family for n, r in found.items()} == {
        "Evaluación COSO": "coso", "Hallazgos": "hallazgos", "Hoja3": "matriz_riesgos", "TD": "distribucion", "Ventas": "general", "metodos": "general"}
    # The risk matrix and the sales sheet tie on points; the earlier sheet wins.
    assert [n for n, r in found.items() if r.is_primary] == ["Hoja3"] and found["Hoja3"].score == found["Ventas"].score
    assert WorkbookAnalysis(book).workbook.first().kind == "auditoria_control"
    assert sheet_type("Cronograma", ["Actividad", "Responsable"], False) == "workplan"


def test_unreadable_sheet_is_reported(spark, tmp_path):
    book = load_catalog(spark, "w", {"no": str(tmp_path / "missing.parquet")})
    assert book.sheets == {} and list(book.errors) == ["no"]


# ---- the reference's own checks -------------------------------------------------------------
def test_empty_input_is_refused():
    with pytest.raises(A.ProvenanceError, match="fallback"):
        A.require_input("")


def test_retired_input_is_refused():
    with pytest.raises(A.ProvenanceError, match=r"viejo\.xlsx"):
        A.require_input("/datos/Viejo.xlsx".lower(), refused=("viejo.xlsx",))
    assert A.require_input("/datos/nuevo.xlsx", refused=("viejo.xlsx",)) == "/datos/nuevo.xlsx"


def test_report_of_another_file_is_refused(spark):
    report = spark.createDataFrame([("otro_archivo.xlsx", ["Hoja1"], None)], "archivo string, hojas_encontradas array<string>, error string")
    with pytest.raises(A.ProvenanceError, match="unauthorised data dependency"):
        A.require_source(report, "/x/entrada-prueba.xlsx")
    A.require_source(report, "/x/otro_archivo.xlsx")


def test_conservative_mode_for_limited_structure(spark):
    run = local_table(spark, [(True, False, True, "mixed", 0)], "has_result boolean, is_commissions boolean, has_generic_summary boolean, mode string, n_tables int")
    row = A.conservative_mode(run).first()
    assert row.conservative and any("comisiones" in r for r in row.reasons)


def test_unknown_paths_are_refused(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    allowed = paths("/x/entrada-prueba.xlsx", "/x/apoyo.py")
    A.require_authorised(paths("/x/ENTRADA-prueba.xlsx"), allowed)
    with pytest.raises(A.ProvenanceError, match="origen-no-autorizado"):
        A.require_authorised(paths("/x/entrada-prueba.xlsx", "/x/origen-no-autorizado.xlsx"), allowed)


# ---- sources, sinks and the whole analysis -----------------------------------------------------
def test_grid_files(spark, tmp_path):
    write_grid(grid(spark, [["a", "b"], ["1", "2"]]), str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.where("sheet = 'h'").count() == 2
    csv = tmp_path / "c"
    spark.createDataFrame([(0, "t", None), (1, "a", "b"), (2, "1", "2")], "n int, x string, y string").write.csv(str(csv))
    assert read_grid(spark, str(csv), "w", "h", ordinal="_c0", skip_rows=1, fmt="csv").count() == 2
    with pytest.raises(ValueError):
        read_grid(spark, str(csv), "w", "h", fmt="csv")


def test_reports_and_audit_files(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    result = TableAnalysis(orders, "orders", ["o_orderkey"])
    tables = result.tables()
    assert {"column_profile", "insights", "kpis", "chart_data", "conclusions", "trend_summary"} <= set(tables)
    sinks.write_reports({"kpis": tables["kpis"]}, str(tmp_path))
    back = sinks.read_report(spark, str(tmp_path), "kpis", "label string, value double, importance int")
    assert back.count() == tables["kpis"].count()
    for _ in range(2):
        sinks.append_audit(tables["data_quality"], str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    g = grid(spark, [["a", "b"], ["1", "2"]])
    heads = S.detect_headers(g)
    sinks.write_organised(S.body_rows(g, heads), S.sheet_tags(g, heads), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o/rows")).count() == 1


def test_workbook_of_test_tables(spark):
    base = "/root/testdata/sf0.001"
    book = load_catalog(spark, "libro", {t: f"{base}/{t}.parquet" for t in ("orders", "customer", "nation")},
                        order_by={"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"]})
    done = WorkbookAnalysis(book)
    assert done.primary.source == "orders" and done.run.first().conservative
    assert done.blocks.where("valid").count() > 0
    assert set(done.secondary_tables()) == {"table:customer", "table:nation"}


def test_number_view_has_no_reading_for_dates(spark):
    df = spark.sql("SELECT DATE'2024-01-15' AS d, true AS b, '1.234,5' AS s")
    row = df.select(*[number_view(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert (row.d, row.b, row.s) == (None, None, 1234.5)
