"""Report tables: signal profile, choice of columns, truth score, dashboards and summaries.

All rows of a table are read in one aggregate (plus the exact distinct counts); what follows
are decisions on one record per column, made while the report is planned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.functions import names
from sondeo.functions import vocabulary as V
from sondeo.functions.numbers import format_full, format_metric, number_view
from sondeo.functions.text import clean_text, is_noise, is_readable, is_sentence, is_time_label, reads_as_sentence
from sondeo.operators.groups import leaders, ranked_top, report_groups
from sondeo.operators.profile import SEQUENCE_LENGTH, exact_distinct, first_whole_values, profilable
from sondeo.operators.running import first_appearances
from sondeo.operators.weights import FLOOR, TEXT_SIGNS, TEXT_SIGNS_NEEDED, admitted, best, holds, weigh
from sondeo.session import local_table


@dataclass
class CellFacts:
    """Aggregates over one column of a report table."""

    name: str
    n: int                 # readable cells
    n_numbers: int
    n_whole: int
    n_nonzero: int
    n_sentences: int
    n_dated: int
    n_chars: int
    n_distinct: int
    lowest: float | None
    highest: float | None
    total: float | None
    n_fractions: int
    head: list[float] = field(default_factory=list)
    time_like: bool = False

    @property
    def numeric_ratio(self) -> float:
        return self.n_numbers / max(1, self.n)

    @property
    def unique_ratio(self) -> float:
        return self.n_distinct / max(1, self.n)

    @property
    def kind(self) -> str:
        by_name = names.metric_kind(self.name)
        small = self.n_numbers and max(abs(self.lowest), abs(self.highest)) <= 1.2 and self.n_fractions
        return "percent" if by_name == "number" and small else by_name


@dataclass
class TableFacts:
    """A report table seen as one record per column."""

    name: str
    df: DataFrame
    columns: list[CellFacts]
    n_rows: int
    informative: int
    weak: int
    dominant_share: float = 0.0

    @property
    def headers(self) -> list[str]:
        return [c.name for c in self.columns]

    def number(self, name: str) -> Column:
        return number_view(F.col(f"`{name}`"), self.df.schema[name].dataType)


def cell_aggregates(text: Column, ok: Column, v: Column) -> Column:
    """What is counted of a column's cells: cleaned texts, whether they are readable, and their numbers."""
    return F.struct(
        F.count_if(ok).alias("n"),
        F.count(v).alias("n_numbers"),
        F.count_if(v == F.floor(v)).alias("n_whole"),
        F.count_if(v != F.floor(v)).alias("n_fractions"),
        F.count_if(F.abs(v) > 1e-9).alias("n_nonzero"),
        F.count_if(ok & v.isNull() & reads_as_sentence(text)).alias("n_sentences"),
        F.count_if(ok & text.rlike("[-/:]")).alias("n_dated"),
        F.coalesce(F.sum(F.when(ok, F.length(text))), F.lit(0)).alias("n_chars"),
        F.min(v).alias("lowest"),
        F.max(v).alias("highest"),
        F.sum(v).alias("total"),
    )


def table_facts(df: DataFrame, name: str, order_by: list[str] | None = None) -> TableFacts:
    """Read a table once and keep one record per column."""
    columns = [c for c in df.columns if c in profilable(df) and c != "row_ord"]
    least = 1 if len(columns) <= 2 else 2
    # Projected first, so each text is cleaned and parsed once however often it is counted.
    staged = df.select(*(order_by or []), *[
        view
        for i, c in enumerate(columns)
        for view in (
            clean_text(F.col(f"`{c}`")).alias(f"text{i}"),
            number_view(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}"),
        )
    ]).select("*", *[is_readable(F.col(f"text{i}")).alias(f"ok{i}") for i in range(len(columns))])
    cells = [{k: F.col(f"{k}{i}") for k in ("text", "ok", "v")} for i in range(len(columns))]
    readable = sum((s["ok"].cast("int") for s in cells), F.lit(0))
    labels = [F.when(s["ok"], F.lower(s["text"])) for s in cells]

    one = staged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(readable >= least).alias("informative"),
        F.count_if(readable <= max(1, least - 1)).alias("weak"),
        *[cell_aggregates(s["text"], s["ok"], s["v"]).alias(f"f{i}") for i, s in enumerate(cells)],
    ).first()
    distinct = exact_distinct(staged, dict(zip(columns, labels)))
    heads = first_whole_values(
        staged, {c: cells[i]["v"] for i, c in enumerate(columns) if one[f"f{i}"]["n_whole"]},
        {c: one[f"f{i}"]["n_whole"] for i, c in enumerate(columns)}, order_by,
    ) if order_by else {}

    described = []
    for i, c in enumerate(columns):
        f = one[f"f{i}"].asDict()
        described.append(CellFacts(c, n_distinct=distinct[c], head=heads.get(c, []), **f))
    facts_ = TableFacts(name, df, described, one["n_rows"], one["informative"], one["weak"])
    _mark_time_columns(facts_, order_by)
    label_column = choose_label(facts_)
    if label_column:
        top = leaders(report_groups(df, label_column.name)).first()
        facts_.dominant_share = top["leader_value"] / top["total"] if top["total"] else 0.0
    return facts_


def _mark_time_columns(facts: TableFacts, order_by: list[str] | None) -> None:
    """A dimension is temporal when its header, or one of its first four values, names a time."""
    for c in facts.columns:
        c.time_like = names.is_time_like(c.name)
        if c.time_like or not order_by or not 2 <= c.n_distinct <= 18:
            continue
        text = clean_text(F.col(f"`{c.name}`"))
        rows = facts.df.where(~is_noise(F.col(f"`{c.name}`"))).select(F.struct(*order_by).alias("o"), text.alias("t"))
        first = first_appearances(rows, F.lower("t"), "o").orderBy("o").limit(4)
        c.time_like = bool(first.agg(F.bool_or(is_time_label(F.col("t")))).first()[0])


def column_traits(c: CellFacts, n_rows: int = 0) -> dict[str, float]:
    """A column as the named numbers that ``weights`` speaks of; ``n_rows`` are the rows of its table."""
    numbers, cells = max(1, c.n_numbers), max(1, c.n)
    mean = max(abs((c.total or 0.0) / numbers), 1)
    person, identifier, metric = names.is_person(c.name), names.is_identifier(c.name), names.is_executive_metric(c.name)
    whole = c.n_whole >= max(4, int(c.n_numbers * 0.8))
    steps = [round(b - a, 6) for a, b in zip(c.head, c.head[1:])]
    even = whole and bool(steps)
    return {
        "n": c.n, "n_numbers": c.n_numbers, "n_distinct": c.n_distinct, "unique_ratio": c.unique_ratio, "numeric_ratio": c.numeric_ratio,
        "dated_ratio": c.n_dated / cells, "mean_length": c.n_chars / cells, "sentence_ratio": c.n_sentences / cells,
        "filled_to_12": min(c.n, 12) / 12, "values_to_12": min(c.n_distinct, 12) / 12, "scattered": c.unique_ratio >= 0.85 or c.n_distinct > 18,
        "coverage": c.n_numbers / max(1, n_rows), "nonzero_ratio": c.n_nonzero / numbers, "spread": min(((c.highest or 0.0) - (c.lowest or 0.0)) / mean, 25),
        "nearly_unique": c.n_distinct / numbers >= 0.9 and not metric, "unit_known": c.kind != "number",
        # of the first numbers: at most two different steps, and small ones
        "even_steps": even and c.n_numbers >= 4 and len(set(steps[:8])) <= 2,
        "small_even_steps": even and c.n_numbers >= 5 and len(set(steps)) <= 2 and max(map(abs, steps)) <= SEQUENCE_LENGTH,
        "mostly_unique": c.unique_ratio >= 0.72, "repetitive": c.unique_ratio <= 0.35, "up_to_6_values": c.n_distinct <= 6, "7_to_10_values": 7 <= c.n_distinct <= 10,
        "dimension_name": names.is_executive_dimension(c.name), "metric_name": metric, "time_name": names.is_time_like(c.name), "time_like": c.time_like,
        "person_name": person, "identifier_name": identifier, "shunned_name": person or identifier,
        "scattered_date": names.mentions(c.name, ("fecha",)) and c.n_distinct > 8,
    }


def _described(facts: TableFacts, excluded: set[str] = frozenset()) -> list[tuple[CellFacts, dict[str, float]]]:
    return [(c, column_traits(c, facts.n_rows)) for c in facts.columns if c.name not in excluded]


def choose_label(facts: TableFacts) -> CellFacts | None:
    """The column whose values best name the rows; none when no column qualifies."""
    return best("label", _described(facts))


def choose_measure(facts: TableFacts) -> CellFacts | None:
    """The column that measures best: well covered, varied, and not a code or a counter."""
    return best("measure", _described(facts))


def choose_focus(facts: TableFacts, excluded: set[str]) -> CellFacts | None:
    """A second label column worth a remark."""
    return best("focus", _described(facts, excluded))


def dimension_score(c: CellFacts) -> float:
    """Fitness of a column as a chart dimension; zero or less means unfit."""
    traits = column_traits(c)
    return weigh("dimension", traits) if admitted("dimension", traits) else FLOOR


@dataclass
class Basis:
    """What a table is about: a dimension, a measure (or a count), and how it is aggregated."""

    label: CellFacts | None
    measure: CellFacts | None

    @property
    def aggregation(self) -> str:
        return "suma" if self.measure else "conteo"

    def groups(self, facts: TableFacts) -> DataFrame:
        amount = facts.number(self.measure.name) if self.measure else None
        return report_groups(facts.df, self.label.name, amount)


def table_basis(facts: TableFacts) -> Basis:
    """Label and measure; an identifier or person label yields to an executive dimension."""
    label, measure = choose_label(facts), choose_measure(facts)
    if measure and names.is_identifier(measure.name):
        measure = None
    if label and (names.is_identifier(label.name) or names.is_person(label.name)):
        label = next((c for c in facts.columns if names.is_executive_dimension(c.name)), label)
    return Basis(label, measure)


@dataclass
class Signal:
    """How much a table says, and in which way."""

    weak_ratio: float
    noise_ratio: float
    generic_ratio: float
    dominant_share: float
    mean_length: float
    numeric_ratio: float
    sentence_ratio: float
    text_ratio: float
    narrative: bool
    detail_allowed: bool


def table_signal(facts: TableFacts) -> Signal:
    """What the cells of a table are like, and whether it reads like a text."""
    columns = len(facts.columns)
    readable, numbers = (sum(x) for x in zip((0, 0), *[(c.n, min(c.n_numbers, c.n)) for c in facts.columns]))
    chars, sentences = (sum(x) / max(1, readable) for x in zip((0, 0), *[(c.n_chars, c.n_sentences) for c in facts.columns]))
    traits = {
        "weak_ratio": facts.weak / max(1, facts.n_rows), "noise_ratio": 1 - readable / max(1, facts.n_rows * columns),
        "generic_ratio": sum(map(names.is_generic_report_header, facts.headers)) / max(1, columns),
        "dominant_share": facts.dominant_share, "mean_length": chars, "numeric_ratio": numbers / max(1, readable), "sentence_ratio": sentences,
        "text_ratio": 1 - numbers / max(1, readable), "n_columns": columns, "informative": facts.informative, "informative_share": facts.informative / max(1, facts.n_rows),
    }
    wordy = sum(holds(sign, traits) for sign in TEXT_SIGNS) >= TEXT_SIGNS_NEEDED
    traits["narrative"] = wordy and not admitted("operational", traits)
    shares = ("weak_ratio", "noise_ratio", "generic_ratio", "dominant_share", "mean_length", "numeric_ratio", "sentence_ratio", "text_ratio", "narrative")
    return Signal(*[traits[name] for name in shares], admitted("readable", traits) and not admitted("essay", traits))


@dataclass
class Truth:
    score: float
    numeric_coverage: float | None

    @property
    def blocked_dashboard(self) -> bool:
        return self.score < V.DASHBOARD_MIN_SCORE

    @property
    def blocked_detail(self) -> bool:
        return self.score < V.DETAIL_MIN_SCORE

    @property
    def blocked_summary(self) -> bool:
        return self.score < V.SUMMARY_MIN_SCORE


def table_truth(facts: TableFacts, basis: Basis, signal: Signal, source: str = "") -> Truth:
    """Weighted confidence in a table, between 0 and 0.99."""
    rows, label = max(1, facts.n_rows), basis.label
    coverage = basis.measure.n_numbers / rows if basis.measure else None
    identifier = label is not None and names.is_identifier(label.name)
    person = label is not None and not identifier and names.is_person(label.name)
    score = weigh("truth", {
        "always": 1, "rows_to_12": min(facts.n_rows, 12) / 12, "informative_share": facts.informative / rows, "clean_share": 1 - signal.noise_ratio,
        "strong_share": 1 - signal.weak_ratio, "named_share": 1 - signal.generic_ratio, "source_named": bool(source.strip()),
        "counted_only": coverage is None, "measure_coverage": coverage or 0.0, "label_missing": label is None, "label_identifier": identifier,
        "label_person": person, "label_good": label is not None and not identifier and not person,
        "told_without_measure": signal.narrative and basis.measure is None, "under_3_rows": facts.n_rows < 3,
    })
    return Truth(max(0.0, min(0.99, score)), coverage)


@dataclass
class TableReport:
    """Everything decided about one table."""

    facts: TableFacts
    source: str
    family: str
    basis: Basis
    signal: Signal
    truth: Truth

    @property
    def good_measure(self) -> bool:
        return self.basis.measure is not None

    @property
    def good_label(self) -> bool:
        label = self.basis.label
        return label is not None and not names.is_identifier(label.name) and not names.is_person(label.name)

    def titled(self, *words: str) -> bool:
        return names.mentions(self.facts.name, words)

    def traits(self, slots: int) -> dict[str, float]:
        """The table as the named numbers that ``weights`` speaks of; ``slots`` are the places left for its rows."""
        f, s = self.facts, self.signal
        return {
            "n_rows": f.n_rows, "n_columns": len(f.columns), "informative": f.informative, "slots": slots, "rows_per_slot": f.n_rows / max(1, slots),
            "noise_ratio": s.noise_ratio, "numeric_ratio": s.numeric_ratio, "mean_length": s.mean_length, "sentence_ratio": s.sentence_ratio,
            "narrative": s.narrative, "detail_allowed": s.detail_allowed, "documentary": self.family in V.DOCUMENTARY_FAMILIES,
            "measure_good": self.good_measure, "label_good": self.good_label, "basis_good": self.good_measure or self.good_label,
            "title_leading": self.titled("principal", "hallazgo", "coso", "consolidado"), "title_spread": self.titled("principal", "hallazgo", "coso", "distribucion"),
            "title_consolidated": self.titled("consolidado"), "title_main": self.titled("principal"), "title_findings": self.titled("hallazgo", "coso"),
        }

    def _allows(self, purpose: str, blocked: bool, slots: int = 2) -> bool:
        traits = self.traits(slots)
        return not blocked and not admitted(f"no_{purpose}", traits) and admitted(purpose, traits)

    def allows_dashboard(self, slots: int = 2) -> bool:
        return self._allows("dashboard", self.truth.blocked_dashboard, slots)

    def allows_summary(self) -> bool:
        return self._allows("summary", self.truth.blocked_summary)

    def allows_detail(self, slots: int = 2) -> bool:
        return self._allows("detail", self.truth.blocked_detail, slots)

    @property
    def priority(self) -> int:
        """Tables with detail first, other operational ones next, narrative ones last."""
        if self.family in V.DOCUMENTARY_FAMILIES:
            return 2
        return 0 if self.allows_detail() else 2 if self.signal.narrative else 1


def report_on(df: DataFrame, name: str, source: str = "", family: str = "general", order_by: list[str] | None = None) -> TableReport:
    return judged(table_facts(df, name, order_by), source, family)


def judged(facts: TableFacts, source: str = "", family: str = "general") -> TableReport:
    """The report on a table of which the facts are known; no job runs."""
    basis, signal = table_basis(facts), table_signal(facts)
    return TableReport(facts, source, family, basis, signal, table_truth(facts, basis, signal, source))


SIGNAL_SCHEMA = """
    table string, source string, n_rows bigint, n_cols int, informative_rows bigint, weak_ratio double,
    noise_ratio double, generic_ratio double, dominant_share double, mean_length double,
    numeric_ratio double, sentence_ratio double, table_kind string, detail_allowed boolean,
    dimension string, measure string, aggregation string, score double, confidence string,
    numeric_coverage double, sheet_type string, priority int,
    allow_dashboard boolean, allow_summary boolean, allow_detail boolean
"""


def report_rows(spark, reports: list[TableReport]) -> DataFrame:
    """One row per table: signal, basis, traceability and what may be shown of it."""
    from sondeo.operators.workbook import sheet_type

    rows = []
    for r in reports:
        f, s, b, t = r.facts, r.signal, r.basis, r.truth
        level = "Alta" if t.score >= 0.8 else "Media" if t.score >= 0.62 else "Baja"
        rows.append((
            f.name, r.source, f.n_rows, len(f.columns), f.informative, round(s.weak_ratio, 4), round(s.noise_ratio, 4),
            round(s.generic_ratio, 4), round(s.dominant_share, 4), round(s.mean_length, 4), round(s.numeric_ratio, 4),
            round(s.sentence_ratio, 4), "narrative" if s.narrative else "operational", s.detail_allowed,
            b.label.name if b.label else None, b.measure.name if b.measure else "Registros", b.aggregation,
            round(t.score, 4), level, None if t.numeric_coverage is None else round(t.numeric_coverage, 4),
            sheet_type(f.name, f.headers, s.narrative, r.family), r.priority,
            r.allows_dashboard(), r.allows_summary(), r.allows_detail(),
        ))
    return local_table(spark, rows, SIGNAL_SCHEMA)


def table_meta(report: TableReport) -> DataFrame:
    """One row: size and, with a measure, its total as display text."""
    f, m = report.facts, report.basis.measure
    text = F.format_string(f"{f.n_rows} filas | {len(f.columns)} columnas" + (" | Total %s" if m else ""), *([format_metric(F.lit(m.total), m.kind)] if m else []))
    return f.df.sparkSession.range(1).select(F.lit(f.name).alias("table"), text.alias("summary"))


def dashboard(report: TableReport, bars: int = 4) -> DataFrame:
    """(table, section, ord, label, value, display): KPIs and the ranking of a table's dashboard."""
    f, b = report.facts, report.basis
    spark = f.df.sparkSession
    kind = b.measure.kind if b.measure else "number"
    figures = [("Filas utiles", float(f.n_rows), "number"), ("Columnas", float(len(f.columns)), "number")]
    if b.measure:
        figures.append((b.measure.name, float(b.measure.total), kind))
    elif b.label:
        figures.append(("Cobertura", float(b.label.n_distinct), "number"))
    kpis = local_table(spark, [(i + 1, *x) for i, x in enumerate(figures)], "ord int, label string, value double, kind string")
    shown = F.when(F.col("kind") == "currency", format_full(F.col("value"), "currency")).when(
        F.col("kind") == "percent", format_full(F.col("value"), "percent")).otherwise(format_full(F.col("value")))
    out = kpis.select(F.lit(f.name).alias("table"), F.lit("kpi").alias("section"), "ord", "label", "value", shown.alias("display"))
    if not b.label:
        return out
    ranking = ranked_top(b.groups(f), bars).select(
        F.lit(f.name).alias("table"), F.lit("ranking").alias("section"), "ord", "label", F.col("value").cast("double").alias("value"),
        (format_metric(F.col("value"), kind) if b.measure else format_full(F.col("value"))).alias("display"),
    )
    focus = choose_focus(f, {c.name for c in (b.label, b.measure) if c})
    if focus:
        top = leaders(report_groups(f.df, focus.name)).where("leader_value > 1 OR n_groups <= 3")
        remark = top.select(
            F.lit(f.name).alias("table"), F.lit("focus").alias("section"), F.lit(1).alias("ord"), F.col("leader").alias("label"),
            F.col("leader_value").cast("double").alias("value"), F.lit(focus.name).alias("display"),
        )
        out = out.unionByName(remark)
    return out.unionByName(ranking)


def table_summary(report: TableReport) -> DataFrame:
    """(table, ord, fact, label, value): size, total, mean, heaviest row, dominant category."""
    f, b = report.facts, report.basis
    spark = f.df.sparkSession
    known = [(1, "rows", None, float(f.n_rows)), (2, "columns", None, float(len(f.columns)))]
    if b.measure:
        known += [(3, "total", b.measure.name, float(b.measure.total)), (4, "mean", b.measure.name, b.measure.total / b.measure.n_numbers)]
    tables = [local_table(spark, known, "ord int, fact string, label string, value double")]
    if b.label:
        label = clean_text(F.col(f"`{b.label.name}`"))
        if b.measure:
            value = f.number(b.measure.name)
            rows = f.df.where(~is_noise(F.col(f"`{b.label.name}`")) & value.isNotNull()).select(label.alias("label"), value.alias("value"))
            tables.append(rows.orderBy(F.desc("value"), "label").limit(1).select(F.lit(5).alias("ord"), F.lit("top_row").alias("fact"), "label", "value"))
        counted = leaders(report_groups(f.df, b.label.name)).where("leader_value > 1 OR n_groups <= 3")
        tables.append(counted.select(F.lit(6).alias("ord"), F.lit("dominant").alias("fact"), F.col("leader").alias("label"), F.col("leader_value").cast("double").alias("value")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select(F.lit(f.name).alias("table"), "*")


def narrative_lines(df: DataFrame, table: str, columns: list[str], order_by: list[str], per_column: int = 2, limit: int = 3) -> DataFrame:
    """(table, ord, column, text): the first sentences of each text column of a narrative table.

    Rows rank within their column; Spark keeps the best few of each partition before the
    shuffle, so a long column is never gathered.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), clean_text(F.col(f"`{c}`")).alias("text")) for i, c in enumerate(columns)
    ])
    long = df.select(F.struct(*order_by).alias("o"), F.inline(cells)).where(is_sentence(F.col("text")) & ~is_noise(F.col("text")))
    first = Window.partitionBy("i").orderBy("o", "text")
    kept = long.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_column)
    # At most per_column rows per column are left here.
    listed = Window.orderBy("i", "place")
    return kept.select(F.lit(table).alias("table"), F.row_number().over(listed).alias("ord"), "column", "text").where(F.col("ord") <= limit)


def semantic_samples(df: DataFrame, order_by: list[str], roles: dict[str, str] | None = None, per_role: int = 3) -> DataFrame:
    """(role, ord, column, text): the first distinct readable values of columns with a semantic role.

    De-duplication is an aggregation per (role, text), so a value repeated in a third of the
    rows costs one row per partition.
    """
    roles = roles or {c: names.semantic_role(c) for c in df.columns if names.semantic_role(c)}
    if not roles:
        return df.sparkSession.createDataFrame([], "role string, ord int, column string, text string")
    cells = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(i).alias("i"), F.lit(c).alias("column"), clean_text(F.col(f"`{c}`")).alias("text"))
        for i, (c, role) in enumerate(roles.items())
    ])
    long = df.select(F.struct(*order_by).alias("o"), F.inline(cells))
    owner = F.col("role") == "owner"
    fit = F.when(owner, ~is_sentence(F.col("text")) & (F.length("text") <= 42)).otherwise(F.length("text") >= 10)
    firsts = (
        long.where(~is_noise(F.col("text")) & fit)
        .groupBy("role", F.lower("text").alias("key"))
        .agg(F.min_by(F.struct("column", "text"), F.struct("i", "o")).alias("cell"), F.min(F.struct("i", "o")).alias("at"))
    )
    place = F.row_number().over(Window.partitionBy("role").orderBy("at", "key"))
    return firsts.select("role", place.alias("ord"), "cell.column", "cell.text").where(F.col("ord") <= per_role)
