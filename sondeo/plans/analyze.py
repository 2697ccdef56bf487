"""The whole analysis of a table or workbook, as a dictionary of result tables.

Top to bottom: profile the columns, decide on roles (a record per column reaches the
driver), run one aggregation per analysis, and derive every report table from those small
results.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sondeo.functions import names
from sondeo.functions import vocabulary as V
from sondeo.functions.dates import date_votes, parse_timestamp
from sondeo.functions.text import semantic_text
from sondeo.operators import charts as C
from sondeo.operators import insights as I
from sondeo.operators.audit import check_blocks, conservative_mode, new_titles, run_audit
from sondeo.operators.cellstore import facts_of_sheets
from sondeo.operators.cleaning import clean_rows, clean_tables, main_table
from sondeo.operators.commissions import commission_charts, executive_summary, generic_summary, is_commissions
from sondeo.operators.correlation import correlations
from sondeo.operators.digest import input_digests
from sondeo.operators.groups import category_totals, imbalance, leaders, ranked_top, report_groups, top_with_others, totals
from sondeo.operators.money import currency_alerts, financial_context, money_facts, money_view
from sondeo.operators.outliers import outliers
from sondeo.operators.pareto import group_shares, pareto_summary, pareto_top
from sondeo.operators.profile import ColumnProfile, profile_columns, profile_table
from sondeo.operators.quality import data_quality, sparse_measures
from sondeo.operators.readers import (
    finding_bullets,
    progress_column,
    progress_status,
    progress_values,
    read_first_column,
    read_hierarchy,
    secondary_table,
)
from sondeo.operators.tables import TableReport, dashboard, dimension_score, judged, report_rows, table_summary
from sondeo.operators.trend import before_after, last_periods, periodic_totals, trend_summary
from sondeo.operators.workbook import classify_sheets, workbook_notes, workbook_profile
from sondeo.session import local_table, settle, union_all
from sondeo.sources.catalog import Catalog, Sheet, sheet_table


COUNT = "conteo"
LEAST_GROUPS = 3        # below this a Pareto says nothing


def is_date_column(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or names.is_date_like(column)


def date_column(df: DataFrame, profiles: list[ColumnProfile]) -> str | None:
    """The most important column that is a date by name or by type."""
    return next((p.column for p in profiles if is_date_column(df, p.column)), None)


class TableAnalysis:
    """The analyses of one table, each computed when first asked for and then kept.

    The table is scanned a fixed number of times. All categorical columns share one scan, and
    every statement about them reads its few grouped rows.
    """

    def __init__(self, df: DataFrame, source: str, order_by: list[str] | None = None, strict: bool = True, unit: str = "month", ranked_categories: int | None = 3,
                 totalled_measures: int | None = 3, charted_categories: int | None = 3, charted_totals: int | None = 2):
        self.df, self.source, self.order_by, self.strict, self.unit = df, source, order_by, strict, unit
        self.ranked_categories = ranked_categories      # how many get a Pareto; None: all
        self.totalled_measures = totalled_measures      # how many are totalled by category; None: all
        # how many categories get a chart of counts, and of totals; None: all
        self.charted_categories, self.charted_totals = charted_categories, charted_totals

    # -- decisions: one record per column -------------------------------------------------
    @cached_property
    def profiles(self) -> list[ColumnProfile]:
        return profile_columns(self.df, self.order_by, self.strict)

    @cached_property
    def order(self) -> list[str]:
        return [p.column for p in self.profiles]

    @cached_property
    def measures(self) -> list[ColumnProfile]:
        """Measures whose currency could be resolved well enough."""
        return [p for p in self.profiles if p.is_measure and p.trusted]

    @cached_property
    def categories(self) -> list[str]:
        return [p.column for p in self.profiles if p.role == "categorica"]

    @cached_property
    def amounts(self) -> dict[str, Column]:
        return {p.column: money_view(self.df, p.column, self.strict).converted for p in self.measures}

    @property
    def lead(self) -> str | None:
        return next(iter(self.amounts), None)

    @cached_property
    def date(self) -> str | None:
        return date_column(self.df, self.profiles)

    @cached_property
    def timed_measure(self) -> str | None:
        return next((p.column for p in self.measures if p.column != self.date and p.n >= 3), None) if self.date else None

    # -- result tables --------------------------------------------------------------------
    @cached_property
    def column_profile(self) -> DataFrame:
        return profile_table(self.df, self.source, self.profiles)

    @cached_property
    def data_quality(self) -> DataFrame:
        return data_quality(self.df, self.source)

    @cached_property
    def sparse_measures(self) -> DataFrame:
        return sparse_measures(self.column_profile)

    @cached_property
    def money_facts(self) -> DataFrame | None:
        money = [p.column for p in self.profiles if p.is_measure and p.kind == "currency"]
        return settle(money_facts(self.df, money, self.strict)) if money else None

    @cached_property
    def currency_alerts(self) -> DataFrame | None:
        return None if self.money_facts is None else currency_alerts(self.money_facts)

    @cached_property
    def financial_context(self) -> DataFrame | None:
        return None if self.money_facts is None else financial_context(self.money_facts)

    @cached_property
    def outliers(self) -> DataFrame:
        quartiles = {p.column: [p.stats["q1"], p.stats["q3"]] for p in self.measures}
        return settle(outliers(self.df, self.amounts, quartiles))

    @cached_property
    def correlations(self) -> DataFrame | None:
        paired = {p.column: self.amounts[p.column] for p in self.measures if p.n >= 5 and not names.is_calendar(p.column)}
        return settle(correlations(self.df, paired)) if len(paired) >= 2 else None

    @cached_property
    def groups(self) -> CategoryGroups | None:
        return CategoryGroups(self.df, self.categories, dict(list(self.amounts.items())[: self.totalled_measures])) if self.categories else None

    @cached_property
    def _shares(self) -> dict[str, DataFrame]:
        def grouped(c: str) -> DataFrame:
            return self.groups.counts(c) if self._ranked_by[c] == COUNT else self.groups.by_value(c, self.lead)

        return {c: group_shares(grouped(c)) for c in self._ranked_by}

    @cached_property
    def _ranked_by(self) -> dict[str, str]:
        """The leading categories, and what each is ranked by: the first measure where it says something, else the count."""
        shown = self.categories[: self.ranked_categories]
        if not self.lead or not shown:
            return dict.fromkeys(shown, COUNT)
        positive = self.groups.rows.where(F.col(self.groups.slots[self.lead]) > 0)
        groups = {r["column"]: r["n"] for r in positive.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row per column
        return {c: self.lead if groups.get(c, 0) >= LEAST_GROUPS else COUNT for c in shown}

    @cached_property
    def pareto(self) -> DataFrame | None:
        return _tagged("category_col", self._shares)

    @cached_property
    def pareto_summary(self) -> DataFrame | None:
        parts = [pareto_summary(s, c, self._ranked_by[c]) for c, s in self._shares.items()]
        return settle(C.stack(parts)) if parts else None

    @cached_property
    def pareto_top(self) -> DataFrame | None:
        return _tagged("category_col", {c: pareto_top(s) for c, s in self._shares.items()})

    @cached_property
    def date_reading(self) -> DataFrame | None:
        """How the date column writes its dates, and how many of its cells are none: what the trend leaves out."""
        return settle(date_votes(self.df, [self.date])) if self.date else None

    @cached_property
    def trend(self) -> DataFrame | None:
        if not self.timed_measure:
            return None
        kind = self.df.schema[self.date].dataType
        # only texts leave the order open
        month_first = isinstance(kind, T.StringType) and self.date_reading.first()["date_order"] in ("month", "mixed: month")
        ts = parse_timestamp(F.col(f"`{self.date}`"), kind, month_first)
        return settle(periodic_totals(self.df, ts, self.amounts[self.timed_measure], self.unit))

    @cached_property
    def trend_summary(self) -> DataFrame | None:
        return None if self.trend is None else settle(trend_summary(self.trend))

    @cached_property
    def before_after(self) -> DataFrame | None:
        return None if self.trend is None else before_after(self.trend_summary, self.timed_measure)

    @cached_property
    def insights(self) -> DataFrame:
        said = [I.anomaly_insights(self.outliers, self.order), I.missing_insights(self.column_profile)]
        if self.pareto_summary is not None:
            said.append(I.concentration_insights(self.pareto_summary))
        if self.correlations is not None:
            said.append(I.correlation_insights(self.correlations))
        if self.trend is not None:
            said.append(I.trend_insights(self.trend_summary, self.timed_measure))
        if self.groups:
            said.append(I.imbalance_insights(C.stack([imbalance(self.groups.counts(c), c) for c in self.categories]), self.order))
        return settle(I.rank_insights(said))

    @cached_property
    def cards(self) -> DataFrame:
        return I.risk_opportunity_cards(self.insights)

    @cached_property
    def traffic_lights(self) -> DataFrame | None:
        return I.traffic_lights(self.trend_summary, self.pareto_summary, self.outliers, self.insights)

    @cached_property
    def kpis(self) -> DataFrame:
        heads = [leaders(self.groups.counts(c)).select(F.lit(c).alias("column"), "leader", "leader_share") for c in self.categories]
        return I.kpis(self.column_profile, settle(C.stack(heads)) if heads else None)

    @cached_property
    def conclusions(self) -> DataFrame:
        return I.conclusions(
            self.column_profile, self.pareto_summary, self.outliers, self.correlations, self.trend_summary, self.timed_measure or "",
            {c: self.groups.counts(c) for c in self.categories},
        )

    @cached_property
    def _charts(self) -> dict[str, DataFrame]:
        return automatic_charts(self)

    @property
    def chart_meta(self) -> DataFrame | None:
        return self._charts.get("chart_meta")

    @property
    def chart_data(self) -> DataFrame | None:
        return self._charts.get("chart_data")

    @cached_property
    def main_table(self) -> DataFrame:
        return main_table(self.df, self.order)

    def tables(self) -> dict[str, DataFrame]:
        """Every result table this input gives rise to."""
        found = {name: getattr(self, name) for name in RESULT_TABLES}
        return {name: result for name, result in found.items() if result is not None}


RESULT_TABLES = (
    "column_profile", "data_quality", "sparse_measures", "money_facts", "currency_alerts", "financial_context", "outliers", "correlations",
    "pareto", "pareto_summary", "pareto_top", "date_reading", "trend", "trend_summary", "before_after", "insights", "cards",
    "traffic_lights", "kpis", "conclusions", "chart_meta", "chart_data", "main_table",
)


def analyze_table(df: DataFrame, source: str, order_by: list[str] | None = None, strict: bool = True, unit: str = "month") -> dict[str, DataFrame]:
    """Profile, quality, outliers, Pareto, correlation, trend, KPIs, charts, insights, conclusions."""
    return TableAnalysis(df, source, order_by, strict, unit).tables()


def _tagged(column: str, parts: dict[str, DataFrame]) -> DataFrame | None:
    return C.stack([df.select(F.lit(tag).alias(column), "*") for tag, df in parts.items()]) if parts else None


class CategoryGroups:
    """Counts and totals of all categorical columns, from one scan.

    Categorical columns have at most twenty labels by definition, so the result is small.
    """

    def __init__(self, df: DataFrame, categories: list[str], amounts: dict):
        self.slots = {name: f"s{i}" for i, name in enumerate(amounts)}
        self.rows = settle(category_totals(df, categories, amounts))

    def counts(self, category: str) -> DataFrame:
        return self.rows.where(F.col("column") == category).select("label", F.col("n").alias("value"))

    def by_value(self, category: str, measure: str) -> DataFrame:
        return self.rows.where(F.col("column") == category).select("label", F.col(self.slots[measure]).alias("value")).where("value > 0")


def automatic_charts(t: TableAnalysis) -> dict[str, DataFrame]:
    """``chart_data`` and ``chart_meta`` of the three most important valid charts."""
    wanted: list[tuple] = []   # (data, id, kind or None, title, dimension, metric, aggregation, importance)

    def want(data, chart_id, kind, title, dimension, metric, aggregation, importance, least=2):
        wanted.append((C.chart(data, chart_id), chart_id, kind, title, dimension, metric, aggregation, importance, t.source, least))

    cats = [p for p in t.profiles if p.role == "categorica" and not names.is_person(p.column) and not names.is_identifier(p.column)]
    measures = [p for p in t.measures if not names.is_identifier(p.column)]
    for p in cats[: t.charted_categories]:
        data = top_with_others(t.groups.counts(p.column), V.MAX_BAR)
        want(data, f"distribution:{p.column}", None, f"Distribución por {p.column}", p.column, "Registros", "conteo", p.importance + 8)
    for p in cats[: t.charted_totals]:
        for m in [m for m in measures if m.column in t.groups.slots]:
            data = top_with_others(t.groups.by_value(p.column, m.column), V.MAX_BAR)
            want(data, f"value:{p.column}:{m.column}", "bar", f"{m.column} por {p.column}", p.column, m.column, "suma", p.importance + m.importance)
    if t.trend is not None:
        m = t.timed_measure
        want(last_periods(t.trend, unit=t.unit), f"trend:{m}", "line", f"Tendencia de {m} en el tiempo", t.date, m, "tendencia", 85, LEAST_GROUPS)
    product = next((p.column for p in t.profiles if p.role in ("texto", "identificador") and names.mentions(p.column, V.PRODUCT_HEADERS)), None)
    if product and measures:
        m = measures[0]
        data = ranked_top(totals(t.df, product, t.amounts[m.column]), V.MAX_CATEGORIES)
        want(data, f"top:{product}:{m.column}", "bar", f"Top por {m.column}", product, m.column, "suma", m.importance + 15, LEAST_GROUPS)
    wanted = sorted(wanted, key=lambda w: -w[7])
    return describe_charts(wanted, V.MAX_AUTO_CHARTS) if wanted else {}


def describe_charts(wanted: list[tuple], limit: int) -> dict[str, DataFrame]:
    """Metadata, truth scores and the ``limit`` best valid charts of a list of candidates."""
    spark = wanted[0][0].sparkSession
    data = settle(C.stack([w[0] for w in wanted]))
    plan = local_table(
        spark, [(i, *w[1:]) for i, w in enumerate(wanted)],
        "seq int, chart_id string, kind string, title string, dimension string, metric string, aggregation string, importance int, source string, least int",
    )
    facts = C.chart_summary(data)
    known = plan.join(facts, "chart_id").withColumn("kind", F.coalesce("kind", C.distribution_kind(F.col("n"), F.col("share"))))
    judged = known.join(C.chart_truth(data, known), "chart_id").join(C.valid_charts(data), "chart_id")
    meta = judged.where("valid AND NOT blocked AND n >= least").orderBy(F.desc("importance"), "seq").limit(limit)
    meta = meta.select("chart_id", "kind", "title", "dimension", "metric", "aggregation", "source", "importance", "n", "leader", "leader_value", "share", "score", "numeric_coverage")
    meta = settle(meta)
    return {"chart_meta": meta, "chart_data": data.join(F.broadcast(meta.select("chart_id")), "chart_id", "left_semi")}


def derived_charts(reports: list[TableReport], limit: int = V.MAX_DERIVED_CHARTS, dimensions: int | None = 2) -> dict[str, DataFrame]:
    """Charts from report tables: the best ``dimensions`` of each (None: all), by total of the measure or by count."""
    wanted, titles = [], set()
    for r in reports:
        f, s = r.facts, r.signal
        if len(f.columns) < 2 or f.n_rows < 3 or f.informative < 3 or s.sentence_ratio > 0.30 or s.mean_length > 50:
            continue
        measure = r.basis.measure
        dims = sorted((c for c in f.columns if c is not measure and dimension_score(c) > 0 and c.n_distinct >= 3), key=dimension_score, reverse=True)
        for c in dims[:dimensions]:
            title = f"{f.name} · {c.name}"
            if title.lower() in titles:
                continue
            titles.add(title.lower())
            kind = C.derived_kind(f.name, c.name, c.time_like, min(c.n_distinct, V.MAX_CATEGORIES))
            groups = report_groups(f.df, c.name, f.number(measure.name) if measure else None)
            k = V.MAX_CATEGORIES if kind in ("bar", "line") else V.MAX_BAR
            top = ranked_top(groups, k)
            chart_id = f"derived:{f.name}:{c.name}"
            wanted.append((C.chart(top, chart_id), chart_id, kind, title, c.name, measure.name if measure else "registros", r.basis.aggregation, 0, r.source, 2))
    return describe_charts(wanted, limit) if wanted else {}


#: Families of sheets with a layout of their own, families of findings, and the roles of columns that tell one.
SPECIAL_FAMILIES, FINDING_FAMILIES, FINDING_ROLES = ("coso", "distribucion"), ("hallazgos", "oportunidades"), ("risk",)


class WorkbookAnalysis:
    """A workbook: its sheets classified, the primary one analysed, every table reported on."""

    def __init__(self, catalog: Catalog, strict: bool = True, mode: str = "mixed"):
        self.catalog, self.strict, self.mode = catalog, strict, mode

    @cached_property
    def sheets(self) -> DataFrame:
        return settle(classify_sheets(sheet_table(self.catalog)))

    @cached_property
    def _found(self) -> list:
        return self.sheets.orderBy("ord").collect()   # one row per sheet

    @cached_property
    def workbook(self) -> DataFrame:
        return workbook_profile(self.sheets)

    @cached_property
    def workbook_notes(self) -> DataFrame:
        return workbook_notes(self.workbook)

    @cached_property
    def primary(self) -> TableAnalysis | None:
        name = next((r["sheet"] for r in self._found if r["is_primary"]), None)
        if name is None:
            return None
        sheet = self.catalog.sheets[name]
        return TableAnalysis(clean_rows(sheet.df), name, sheet.order_by, self.strict)

    @cached_property
    def is_audit(self) -> bool:
        return self.workbook.where("kind = 'auditoria_control'").first() is not None

    @property
    def automatic_chart_meta(self) -> DataFrame | None:
        """Commission and audit workbooks have charts of their own, none made from roles."""
        return None if self.primary is None or self.is_commissions or self.is_audit else self.primary.chart_meta

    @cached_property
    def conclusions(self) -> DataFrame:
        """What the workbook's families call for, then what the primary table says; the first of equal meaning stays."""
        return merged_statements(self.workbook_notes.where("note = 'conclusion'"), self.primary.conclusions if self.primary else None, V.MAX_CONCLUSIONS)

    @cached_property
    def insights(self) -> DataFrame:
        return merged_statements(self.workbook_notes.where("note = 'insight'"), self.primary.insights if self.primary else None, V.MAX_INSIGHTS)

    @property
    def is_commissions(self) -> bool:
        return self.primary is not None and is_commissions(self.primary.df.columns)

    @cached_property
    def executive_summary(self) -> DataFrame | None:
        return executive_summary(self.primary.df) if self.is_commissions else None

    @cached_property
    def commission_charts(self) -> DataFrame | None:
        return commission_charts(self.primary.df) if self.is_commissions else None

    @cached_property
    def generic_summary(self) -> DataFrame | None:
        if self.primary is None or self.is_commissions:
            return None
        numeric = [p.column for p in self.primary.profiles if p.role == "numerico"]
        return generic_summary(self.primary.df, self.primary.source, numeric)

    @cached_property
    def reports(self) -> list[TableReport]:
        """Every sheet with two rows and columns, except the two special layouts."""
        wanted = [r for r in self._found if r["n_rows"] >= 2 and r["n_cols"] >= 2 and r["family"] not in SPECIAL_FAMILIES]
        sheets = [self.catalog.sheets[r["sheet"]] for r in wanted]
        cleaned = clean_tables([s.df for s in sheets])
        titles = ["Tabla principal" if r["is_primary"] else r["sheet"] for r in wanted]
        facts = facts_of_sheets([Sheet(s.name, df, s.order_by) for s, df in zip(sheets, cleaned)], titles)
        return [judged(f, r["sheet"], r["family"]) for f, r in zip(facts, wanted)]

    @cached_property
    def table_reports(self) -> DataFrame | None:
        return report_rows(self.sheets.sparkSession, self.reports) if self.reports else None

    @cached_property
    def derived_charts(self) -> dict[str, DataFrame]:
        """Charts found in the report tables whose titles the automatic charts have not taken."""
        found = derived_charts(self.reports)
        own = self.automatic_chart_meta
        if found and own is not None:
            found["chart_meta"] = new_titles(found["chart_meta"], own)
        return found

    @cached_property
    def _others(self) -> list[tuple[Sheet, str]]:
        """The sheets beside the primary one, cleaned like report tables, with their families; the two special layouts and sheets
        of fewer than two rows or columns are none of them."""
        wanted = [r for r in self._found if not r["is_primary"] and r["family"] not in SPECIAL_FAMILIES and r["n_rows"] >= 2 and r["n_cols"] >= 2]
        sheets = [self.catalog.sheets[r["sheet"]] for r in wanted]
        cleaned = clean_tables([s.df for s in sheets])
        return [(Sheet(s.name, df, s.order_by), r["family"]) for s, df, r in zip(sheets, cleaned, wanted)]

    @cached_property
    def fill(self) -> DataFrame | None:
        """(sheet, n_rows, n_cells, n_filled, enough): how full each other sheet is, from one scan of each, in one job."""
        def counted(sheet: Sheet) -> DataFrame:
            filled = sum((F.count(F.col(f"`{c}`")) for c in sheet.df.columns), F.lit(0))
            return sheet.df.agg(F.count(F.lit(1)).alias("n_rows"), filled.alias("n_filled")).select(
                F.lit(sheet.name).alias("sheet"), "n_rows", (F.col("n_rows") * len(sheet.df.columns)).alias("n_cells"), "n_filled")

        if not self._others:
            return None
        facts = union_all([counted(sheet) for sheet, _ in self._others])
        enough = (F.col("n_rows") > 0) & (F.col("n_filled") >= V.MIN_FILL_RATIO * F.col("n_cells"))
        return settle(facts.withColumn("enough", enough))

    @cached_property
    def _shown(self) -> list[tuple[Sheet, str]]:
        """The other sheets worth a table: findings always, the rest if they are full enough."""
        if not self._others:
            return []
        enough = {r["sheet"] for r in self.fill.where("enough").collect()}      # one row per sheet
        return [(sheet, family) for sheet, family in self._others if family in FINDING_FAMILIES or sheet.name in enough]

    def secondary_tables(self) -> dict[str, DataFrame]:
        """The display table of each other sheet that has an order."""
        return {f"table:{s.name}": secondary_table(s.df, s.order_by, family) for s, family in self._shown if s.order_by}

    @cached_property
    def progress(self) -> DataFrame | None:
        """(sheet, column, total, done, under_way, pending, mean_progress) of every other sheet that tells how far its items are."""
        told = [(s, c) for s, _ in self._shown if (c := progress_column(s.df.columns))]
        parts = [progress_status(s.df, progress_values(s.df, c)).select(F.lit(s.name).alias("sheet"), F.lit(c).alias("column"), "*") for s, c in told]
        return settle(union_all(parts)) if parts else None

    @cached_property
    def bullets(self) -> DataFrame | None:
        """(sheet, ord, column, text): the first findings of each sheet of findings or opportunities, from its first column that tells one."""
        parts = []
        for sheet, family in self._others:
            told = next((c for c in sheet.df.columns if names.semantic_role(c) in FINDING_ROLES), None)
            if family in FINDING_FAMILIES and sheet.order_by and told:
                lines = finding_bullets(sheet.df, told, sheet.order_by)      # eight lines at most
                ranked = lines.select(F.lit(sheet.name).alias("sheet"), F.monotonically_increasing_id().alias("place"), F.lit(told).alias("column"), "text")
                parts.append(ranked)
        if not parts:
            return None
        rank = F.row_number().over(Window.partitionBy("sheet").orderBy("place"))
        return settle(union_all(parts).select("sheet", rank.alias("ord"), "column", "text"))

    @cached_property
    def special_layouts(self) -> dict[str, DataFrame]:
        """The readings of raw grids in the two special layouts: the control hierarchy, and the first column of a distribution."""
        out = {}
        for r in self._found:
            df = self.catalog.sheets[r["sheet"]].df
            if r["family"] in SPECIAL_FAMILIES and {"row_ord", "cells"} <= set(df.columns):
                out[f"layout:{r['sheet']}"] = read_hierarchy(df) if r["family"] == "coso" else read_first_column(df)
        return {name: found for name, found in out.items() if found is not None}

    @cached_property
    def dashboards(self) -> DataFrame | None:
        """The figures and rankings of all tables that may have a dashboard, those with detail first."""
        wanted = sorted((r for r in self.reports if r.allows_dashboard()), key=lambda r: r.priority)
        return settle(union_all([dashboard(r) for r in wanted])) if wanted else None

    @cached_property
    def table_summaries(self) -> DataFrame | None:
        """The facts of all tables that may be summed up."""
        wanted = sorted((r for r in self.reports if r.allows_summary()), key=lambda r: r.priority)
        return settle(union_all([table_summary(r) for r in wanted])) if wanted else None

    @cached_property
    def audit(self) -> DataFrame | None:
        """The record of the run: what was shown and why, with the digest of what every sheet holds."""
        if self.blocks is None:
            return None
        inputs = input_digests({name: sheet.df for name, sheet in self.catalog.sheets.items()})
        return run_audit(self.blocks, inputs, self.run, self.primary.data_quality if self.primary else None)

    @cached_property
    def blocks(self) -> DataFrame | None:
        """What a report would show, with the issues that keep a block out."""
        if not self.reports:
            return None
        charts = [c for c in (self.automatic_chart_meta, self.derived_charts.get("chart_meta")) if c is not None]
        return settle(check_blocks(content_blocks(charts, self.table_reports)))

    @cached_property
    def run(self) -> DataFrame:
        facts = (self.catalog.workbook, bool(self._found), self.is_commissions, not self.is_commissions, self.mode, len(self.reports))
        schema = "run_id string, has_result boolean, is_commissions boolean, has_generic_summary boolean, mode string, n_tables int"
        return conservative_mode(local_table(self.sheets.sparkSession, [facts], schema))

    def tables(self) -> dict[str, DataFrame]:
        out = {name: getattr(self, name) for name in (
            "sheets", "workbook", "workbook_notes", "executive_summary", "commission_charts", "generic_summary", "table_reports", "fill", "progress", "bullets", "dashboards", "table_summaries", "blocks", "run", "audit")}
        out |= self.primary.tables() if self.primary else {}
        out |= {"conclusions": self.conclusions, "insights": self.insights}
        out |= self.secondary_tables() | self.special_layouts | {f"derived_{k}": v for k, v in self.derived_charts.items()}
        return {name: result for name, result in out.items() if result is not None}


def analyze_workbook(catalog: Catalog, strict: bool = True, mode: str = "mixed") -> dict[str, DataFrame]:
    """Classify the sheets, analyse the primary one and report on the others."""
    return WorkbookAnalysis(catalog, strict, mode).tables()


def merged_statements(notes: DataFrame, said: DataFrame | None, limit: int) -> DataFrame:
    """(ord, origin, text): statements of the workbook, then of its table, equal ones once, ``limit`` in all.

    Two texts are equal when their words are, whatever accents, case and marks. All inputs are a handful of rows.
    """
    parts = [notes.select(F.lit("workbook").alias("origin"), F.monotonically_increasing_id().alias("place"), "text")]
    if said is not None:
        place = F.col("ord").cast("bigint") if "ord" in said.columns else F.monotonically_increasing_id()
        parts.append(said.select(F.lit("table").alias("origin"), place.alias("place"), "text"))
    every = C.stack(parts).withColumn("order", F.struct((F.col("origin") == "table").alias("t"), "place"))
    once = every.where(semantic_text(F.col("text")) != "").groupBy(semantic_text(F.col("text")).alias("meaning")).agg(F.min(F.struct("order", "origin", "text")).alias("s"))
    first = once.orderBy("s.order").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("s.order")).alias("ord"), "s.origin", "s.text")


def content_blocks(charts: list[DataFrame], tables: DataFrame) -> DataFrame:
    """(type, title, source, score, n_pairs, n_rows, n_cols, n_lines): what a report would show."""
    def block(df: DataFrame, kind: str, title: str, **sizes: str) -> DataFrame:
        known = [F.col(sizes[n]).cast("bigint").alias(n) if n in sizes else F.lit(None).cast("bigint").alias(n) for n in ("n_pairs", "n_rows", "n_cols", "n_lines")]
        return df.select(F.lit(kind).alias("type"), F.col(title).alias("title"), "source", "score", *known)

    sized = {"n_rows": "n_rows", "n_cols": "n_cols"}
    parts = [block(c, "chart", "title", n_pairs="n") for c in charts]
    parts.append(block(tables.where("allow_dashboard"), "kpi_dashboard", "table", **sized, n_lines="n_cols"))
    parts.append(block(tables.where("allow_summary AND NOT allow_dashboard"), "table_summary", "table", **sized, n_lines="n_cols"))
    parts.append(block(tables.where("allow_detail"), "table", "table", **sized))
    return C.stack(parts)
