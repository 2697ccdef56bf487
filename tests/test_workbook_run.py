"""A workbook run brings out what each sheet has to say."""

from pyspark.sql import functions as F

from sondeo.plans.analyze import WorkbookAnalysis
from sondeo.sources.catalog import Catalog, Sheet


def book(spark):
    sales = spark.range(60).select("id", F.concat(F.lit("Zona "), F.col("id") % 4).alias("Zona"), ((F.col("id") * 37) % 101 + 5.5).alias("Importe"))
    plan = spark.createDataFrame([(1, "Revisar caja", 100.0), (2, "Cerrar actas", 40.0), (3, "Archivar todo", 0.0), (4, "Publicar", None)], "n int, Tarea string, Avance double")
    finds = spark.createDataFrame([(2, "Falta la firma del contrato", "Caja"), (1, "Sin respaldo de los gastos", "Actas"), (3, "x", "Caja"), (4, None, "Caja")], "n int, Hallazgo string, Area string")
    empty = spark.createDataFrame([(1, None, None, None, None)] * 5, "n int, a string, b string, c string, d string")
    grid = spark.createDataFrame(
        [("w", "COSO", i, cells) for i, cells in enumerate([["t"], ["t"], ["t"], ["Componente", "Item evaluado", "Estado"], ["Ambiente", "Codigo firmado", "Cumple"], [None, "Manual vigente", "0"]])],
        "workbook string, sheet string, row_ord bigint, cells array<string>")
    return {"Ventas": Sheet("Ventas", sales, ["id"]), "Plan": Sheet("Plan", plan, ["n"]), "Hallazgos": Sheet("Hallazgos", finds, ["n"]),
            "Vacia": Sheet("Vacia", empty, ["n"]), "COSO": Sheet("COSO", grid, ["row_ord"])}


def test_a_run_composes_its_parts(spark):
    done = WorkbookAnalysis(Catalog("libro", book(spark)))
    assert done.primary.source == "Ventas"
    assert [tuple(r) for r in done.progress.collect()] == [("Plan", "Avance", 4, 1, 1, 2, 0.35)]
    assert [(r.ord, r.text) for r in done.bullets.orderBy("ord").collect()] == [(1, "Sin respaldo de los gastos"), (2, "Falta la firma del contrato")]
    assert "table:Vacia" not in done.secondary_tables() and {"table:Plan", "table:Hallazgos"} <= set(done.secondary_tables())
    layouts = done.special_layouts
    assert [(r["Componente"], r["Estado"]) for r in layouts["layout:COSO"].orderBy("row_ord").collect()] == [("Ambiente", "Cumple"), ("Ambiente", "Pendiente de evaluacion")]
    assert done.dashboards.where("label = 'Filas utiles' AND value = 60").count() == 1
    assert done.table_summaries.where("fact = 'rows'").count() >= 1
    record = done.audit.first()
    assert [x.path for x in record.inputs] == sorted(book(spark)) and all(len(x.sha256) == 64 for x in record.inputs)


def test_a_workbook_of_one_sheet_has_no_other_parts(spark):
    done = WorkbookAnalysis(Catalog("libro", {"Ventas": book(spark)["Ventas"]}))
    assert done.fill is None and done.progress is None and done.bullets is None
    assert done.secondary_tables() == {} and done.special_layouts == {}
