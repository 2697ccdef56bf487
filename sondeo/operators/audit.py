"""Provenance checks, content checks, conservative mode and the run audit record."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.functions import vocabulary as V
from sondeo.session import local_table


class ProvenanceError(ValueError):
    """Data came from somewhere it must not come from."""


def require_input(path: str | None, refused: tuple[str, ...] = ()) -> str:
    """Every run names its input; there is no fallback, and ``refused`` lists retired file names."""
    if not path or not path.strip():
        raise ProvenanceError("no input given, and no fallback is allowed")
    if PurePath(path).name.lower() in refused:
        raise ProvenanceError(f"retired input refused: {path}")
    return path


def referenced_paths(df: DataFrame) -> DataFrame:
    """(path): the distinct files a plan reads, as its scans name them; no row is read, and no job is run.

    The list is as long as the one the driver keeps to plan the scans.
    """
    return local_table(df.sparkSession, [(path,) for path in sorted({p.lower() for p in df.inputFiles()})], "path string")


def unauthorised_paths(referenced: DataFrame, allowed: DataFrame) -> DataFrame:
    """Referenced paths missing from the allow-list (an anti join; both sides are file lists)."""
    named = referenced.where("path IS NOT NULL").select(F.lower("path").alias("path"))
    return named.join(allowed.select(F.lower("path").alias("path")), "path", "left_anti")


def require_authorised(referenced: DataFrame, allowed: DataFrame) -> None:
    stranger = unauthorised_paths(referenced, allowed).orderBy("path").first()
    if stranger:
        raise ProvenanceError(f"unauthorised data dependency: {stranger['path']}")


def source_problems(report: DataFrame, input_file: str) -> DataFrame:
    """(problem): why a stored report does not belong to this input. No row means it does.

    ``report`` has ``archivo``, ``hojas_encontradas`` and ``error``.
    """
    label = PurePath(input_file).name
    named = F.trim(F.coalesce("archivo", F.lit("")))
    problems = F.array_compact(F.array(
        F.when(F.col("error").isNotNull(), F.concat(F.lit("analysis error: "), F.col("error"))),
        F.when((named != "") & (named != label), F.concat(F.lit("unauthorised data dependency: "), named)),
        F.when(F.coalesce(F.size("hojas_encontradas"), F.lit(0)) <= 0, F.lit("no usable sheets")),
    ))
    return report.select(F.explode(problems).alias("problem"))


def require_source(report: DataFrame, input_file: str) -> None:
    problem = source_problems(report, input_file).first()
    if problem:
        raise ProvenanceError(problem["problem"])


def conservative_mode(runs: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``conservative`` to rows of run facts.

    Facts: has_result, is_commissions, has_generic_summary, mode, n_tables.
    """
    reasons = F.array_compact(F.array(
        F.when(~F.col("has_result"), F.lit("sin resultado legible")),
        F.when(~F.col("is_commissions"), F.lit("fuera del flujo especializado de comisiones")),
        F.when(F.col("has_generic_summary"), F.lit("resumen generico presente")),
        F.when(F.col("mode") != "mixed", F.concat(F.lit("modo solicitado: "), F.col("mode"))),
        F.when(F.col("n_tables") <= 2, F.lit("estructura limitada")),
    ))
    return runs.withColumn("reasons", reasons).withColumn("conservative", F.size("reasons") > 0)


# Fixed rule per block type: (condition that makes it invalid, issue).
BLOCK_RULES = (
    ("chart", "n_pairs < 2", "grafica invalida"),
    ("chart", f"score < {V.CHART_MIN_SCORE}", "grafica descartada por baja confianza"),
    ("table", "n_cols = 0 OR n_rows = 0", "tabla sin estructura valida"),
    ("table_summary", "n_lines = 0", "resumen tabular vacio"),
    ("kpi_dashboard", "n_lines = 0", "dashboard sin contenido util"),
    ("text", "n_lines = 0", "bloque textual vacio"),
)


def check_blocks(blocks: DataFrame) -> DataFrame:
    """Add ``issue`` (NULL when fine) and ``valid`` to content blocks.

    Blocks: type, title, source, score, n_pairs, n_rows, n_cols, n_lines.
    """
    issue = F.lit(None).cast("string")
    for kind, broken, text in reversed(BLOCK_RULES):
        issue = F.when((F.col("type") == kind) & F.coalesce(F.expr(broken), F.lit(False)), text).otherwise(issue)
    return blocks.withColumn("issue", issue).withColumn("valid", F.col("issue").isNull())


def run_audit(checked: DataFrame, inputs: DataFrame, run: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One audit row: inputs with hashes, blocks per type, issues, thresholds and trace of each block.

    ``inputs`` has one row per file, ``checked`` one per block; both are report-sized.
    """
    per_type = checked.where("valid").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    counts = per_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))).scalar()
    files = inputs.agg(F.array_sort(F.collect_list(F.struct("path", "sha256")))).scalar()
    issues = checked.agg(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("title", "issue"))))).scalar()
    trace = checked.agg(F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("type", "title", "source", "score"))))).scalar()
    minimum = F.create_map(*[F.lit(x) for x in (
        "chart", V.CHART_MIN_SCORE, "tableDetail", V.DETAIL_MIN_SCORE, "tableSummary", V.SUMMARY_MIN_SCORE, "dashboard", V.DASHBOARD_MIN_SCORE)])
    record = conservative_mode(run).select(
        "run_id", F.current_timestamp().alias("generated_at"), files.alias("inputs"), counts.alias("counts"), issues.alias("issues"),
        trace.alias("content"), minimum.alias("minimum_confidence"), "conservative", "reasons", "mode",
    )
    if quality is not None:
        record = record.withColumn("data_quality", quality.agg(F.first(F.struct(*quality.columns))).scalar())
    return record


def new_titles(charts: DataFrame, existing: DataFrame) -> DataFrame:
    """Charts whose title, ignoring case, is not taken yet (both sides are chart lists)."""
    taken = existing.select(F.lower("title").alias("_key")).distinct()
    return charts.withColumn("_key", F.lower("title")).join(taken, "_key", "left_anti").drop("_key")


def rank_tables(reports: DataFrame) -> DataFrame:
    """Report tables with detail first, operational next, narrative last; input order on a tie."""
    return reports.orderBy("priority", "ord")
