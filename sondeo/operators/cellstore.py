"""All sheets of a workbook as one table of cells, and what reports need to know of each, by grouped aggregates.

However many sheets there are, the number of jobs is fixed: a sheet is a key of the aggregates, not a turn of a loop. A row
holds the cells of one row of one sheet, cleaned and read as numbers once; it is taken apart into cells inside a task, where
partial aggregation puts them together again, so cells are never shuffled one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions import names
from sondeo.functions.numbers import number_view
from sondeo.functions.text import clean_text, is_noise, is_time_label
from sondeo.operators.profile import HEAD_ROWS, SEQUENCE_LENGTH, profilable
from sondeo.operators.tables import CellFacts, TableFacts, cell_aggregates, choose_label
from sondeo.session import shared_path, union_all
from sondeo.sources.catalog import Sheet, sort_place

#: A temporal dimension has from 2 to so many values; so many of the first are looked at.
FEW_VALUES, FIRST_VALUES = 18, 4


@dataclass
class CellStore:
    """The stored cells (s, place, cells) of ``sheets``, and the columns that each sheet's cells stand for."""

    cells: DataFrame
    sheets: list[Sheet]
    columns: list[list[str]]

    @property
    def exploded(self) -> DataFrame:
        """A row per cell: sheet ``s``, row ``place``, column ``c``, its ``text``, is it readable (``ok``), its number ``v``."""
        return self.cells.select("s", "place", F.posexplode("cells").alias("c", "cell")).select("s", "place", "c", "cell.*")


def store_cells(sheets: list[Sheet]) -> CellStore:
    """Every sheet's named columns of plain types as rows of one table, partitioned by sheet in the shared folder."""
    def rows(s: int, sheet: Sheet, columns: list[str]) -> DataFrame:
        cells = [F.struct(
            clean_text(F.col(f"`{c}`")).alias("text"), (~is_noise(F.col(f"`{c}`"))).alias("ok"), number_view(F.col(f"`{c}`"), sheet.df.schema[c].dataType).alias("v"),
        ) for c in columns]
        shape = "array<struct<text: string, ok: boolean, v: double>>"
        return sheet.df.select(F.lit(s).alias("s"), sort_place(sheet.df, sheet.order_by).alias("place"), (F.array(*cells) if cells else F.array()).cast(shape).alias("cells"))

    columns = [[c for c in sheet.df.columns if c in profilable(sheet.df) and c != "row_ord"] for sheet in sheets]
    every = union_all([rows(s, sheet, columns[s]) for s, sheet in enumerate(sheets)])
    path = shared_path(every.sparkSession, "cells")
    every.write.partitionBy("s").parquet(path)
    return CellStore(every.sparkSession.read.schema(every.schema).parquet(path), sheets, columns)


def row_facts(store: CellStore) -> DataFrame:
    """(s, n_rows, informative, weak): rows of each sheet, those with enough readable cells, and those with too few."""
    readable = F.size(F.filter("cells", lambda x: x["ok"]))
    least = F.when(F.size("cells") <= 2, 1).otherwise(2)
    return store.cells.groupBy("s").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(readable >= least).alias("informative"), F.count_if(readable <= F.greatest(F.lit(1), least - 1)).alias("weak"))


def column_facts(store: CellStore) -> DataFrame:
    """(s, c, facts): the aggregates over each column of each sheet."""
    return store.exploded.groupBy("s", "c").agg(cell_aggregates(F.col("text"), F.col("ok"), F.col("v")).alias("facts"))


def distinct_labels(store: CellStore) -> DataFrame:
    """(s, c, n_distinct): readable values of each column, exactly, told apart by 128 bits and ignoring case."""
    label = F.lower("text")
    prints = store.exploded.where("ok").groupBy("s", "c", F.xxhash64(label).alias("a"), F.xxhash64(F.lit("sondeo"), label).alias("b")).agg(F.lit(1))
    return prints.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n_distinct"))


def first_whole_numbers(store: CellStore) -> DataFrame:
    """(s, c, head): the first ten whole numbers of each column of a sheet that has an order.

    Ranks are cut off within each partition before rows move. The first thousand rows of a sheet answer for nearly every
    column; one whose whole numbers start further down is ranked by itself.
    """
    ordered = store.cells.where(F.size("place") > 0)
    rank = F.row_number().over(Window.partitionBy("s").orderBy("place"))
    top = ordered.withColumn("rank", rank).where(F.col("rank") <= HEAD_ROWS).select("s", "place", F.posexplode("cells").alias("c", "cell"))
    whole = F.col("cell.v").isNotNull() & (F.col("cell.v") == F.floor("cell.v"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("place", F.col("cell.v").alias("v")))), 1, SEQUENCE_LENGTH)       # of at most HEAD_ROWS cells
    early = top.where(whole).groupBy("s", "c").agg(F.transform(ranked, lambda x: x["v"]).alias("head"))
    enough = early.where(F.size("head") >= SEQUENCE_LENGTH)
    rest = ordered.select("s", "place", F.posexplode("cells").alias("c", "cell")).where(whole).join(enough.select("s", "c"), ["s", "c"], "left_anti")
    place = F.row_number().over(Window.partitionBy("s", "c").orderBy("place"))
    late = rest.withColumn("rank", place).where(F.col("rank") <= SEQUENCE_LENGTH).groupBy("s", "c").agg(F.transform(ranked, lambda x: x["v"]).alias("head"))
    return enough.unionByName(late)


def time_columns(store: CellStore, few: list[tuple[int, int]]) -> DataFrame:
    """(s, c): columns of ``few`` of which one of the first four values, in row order, names a time.

    They have at most ``FEW_VALUES`` values each, so a group of them is small."""
    text = F.col("text")
    cells = _only(store.exploded.where("ok"), few).where(F.lower(text) != "")
    firsts = cells.groupBy("s", "c", F.lower(text).alias("key")).agg(F.min(F.struct("place", "text")).alias("first"))
    four = firsts.groupBy("s", "c").agg(F.slice(F.array_sort(F.collect_list("first")), 1, FIRST_VALUES).alias("firsts"))
    return four.select("s", "c", F.explode("firsts").alias("first")).groupBy("s", "c").agg(F.bool_or(is_time_label(F.col("first.text"))).alias("timed")).where("timed")


def dominant_shares(store: CellStore, labels: list[tuple[int, int]]) -> DataFrame:
    """(s, share): of the most frequent value of a sheet's label column among all its readable values."""
    groups = _only(store.exploded.where("ok"), labels).groupBy("s", "c", "text").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("s").agg((F.max("n") / F.sum("n")).alias("share"))


def _only(cells: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """Cells of the given columns of the given sheets: a list of them, read as a filter on partitions and a map."""
    by_sheet: dict[int, list[int]] = {}
    for s, c in wanted:
        by_sheet.setdefault(s, []).append(c)
    known = F.create_map(*[x for s, cs in by_sheet.items() for x in (F.lit(s), F.array(*map(F.lit, cs)))])
    return cells.where(F.col("s").isin(*by_sheet)).where(F.array_contains(F.element_at(known, F.col("s")), F.col("c")))


def facts_of_sheets(sheets: list[Sheet], titles: list[str] | None = None) -> list[TableFacts]:
    """What :func:`sondeo.operators.tables.table_facts` says of each sheet, for all of them in a fixed number of jobs.

    Records that reach the driver: one per sheet, and one per column.
    """
    if not sheets:
        return []
    store = store_cells(sheets)
    columns = column_facts(store).join(distinct_labels(store), ["s", "c"], "left").join(first_whole_numbers(store), ["s", "c"], "left")
    found = {(r["s"], r["c"]): r for r in columns.collect()}
    sizes = {r["s"]: r for r in row_facts(store).collect()}
    out = []
    for s, (sheet, named) in enumerate(zip(sheets, store.columns)):
        cells = []
        for c, name in enumerate(named):
            r = found.get((s, c))
            facts = r["facts"].asDict() if r else dict.fromkeys(("n", "n_numbers", "n_whole", "n_fractions", "n_nonzero", "n_sentences", "n_dated", "n_chars"), 0) | {"lowest": None, "highest": None, "total": None}
            cells.append(CellFacts(name, n_distinct=(r["n_distinct"] or 0) if r else 0, head=list(r["head"] or []) if r else [], time_like=names.is_time_like(name), **facts))
        size = sizes.get(s)
        rows = (size["n_rows"], size["informative"], size["weak"]) if size else (0, 0, 0)
        out.append(TableFacts(titles[s] if titles else sheet.name, sheet.df, cells, *rows))

    few = [(s, c) for s, f in enumerate(out) if sheets[s].order_by for c, x in enumerate(f.columns) if not x.time_like and 2 <= x.n_distinct <= FEW_VALUES]
    for r in time_columns(store, few).collect() if few else ():
        out[r["s"]].columns[r["c"]].time_like = True
    chosen = [(s, f.headers.index(label.name)) for s, f in enumerate(out) if (label := choose_label(f))]
    for r in dominant_shares(store, chosen).collect() if chosen else ():
        out[r["s"]].dominant_share = r["share"]
    return out
