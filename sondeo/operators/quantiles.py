"""Exact quantiles of any number of columns, for tables of any size and any range of values.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation buffer, which no task can hold for a long
column. Three passes do instead:

1. ``percentile_approx``, a sketch that merges, names two values of the column around every wanted rank;
2. one counting pass over the cells between these values says exactly which cell holds the rank;
3. the few values of that cell are put in order, each cell in a group of its own.

A cell holds some ``4 / ACCURACY`` of the rows, whatever their values, so one round of the first two passes is enough up to
about ``SORTABLE_VALUES * ACCURACY / 4`` rows (5 * 10^8) and a second one up to 10^12. A value shared by many rows is a cell of
its own and ends the search. Short columns go straight to the third pass. Only counts are shuffled in the second pass and
only the values of the wanted cells in the third.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's rank error is 1 / ACCURACY of the rows. A sketch of one column takes about a megabyte of a task.
ACCURACY = 20_000
#: The most values of a cell that are put in order in one task.
SORTABLE_VALUES = 100_000


class _Search:
    """One wanted quantile: ranks ``low`` and ``high`` (0-based) lie in [lo, hi], which has ``below`` values before it."""

    def __init__(self, column: int, n: int, lo: float, hi: float, prob: float):
        position = prob * (n - 1)
        self.column, self.low, self.high = column, math.floor(position), math.ceil(position)
        self.weight = position - self.low
        self.lo, self.hi, self.below, self.inside = lo, hi, 0, n
        self.value = lo if lo == hi else None

    @property
    def interval(self) -> tuple[int, float, float]:
        return self.column, self.lo, self.hi

    def shares(self, margin: float) -> tuple[float, float]:
        """Shares of the interval's values that lie surely before and surely after both ranks."""
        before, after = (self.low - self.below) / self.inside, (self.high - self.below + 1) / self.inside
        return max(0.0, before - margin), min(1.0, after + margin)

    def settle(self, low: float, high: float) -> None:
        self.value = low if low == high else low + (high - low) * self.weight

    def narrow(self, cells: list) -> None:
        """Go on in the cell of the column that holds both ranks, or finish between two neighbours."""
        seen, left = 0, None
        for cell in cells:
            if left is not None:
                self.settle(left["hi"], cell["lo"])
                return
            if self.low < seen + cell["n"]:
                if self.high < seen + cell["n"]:
                    self.lo, self.hi, self.below, self.inside = cell["lo"], cell["hi"], seen, cell["n"]
                    if self.lo == self.hi:
                        self.settle(self.lo, self.lo)
                    return
                left = cell
            seen += cell["n"]


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: tuple[float, ...] = (0.25, 0.5, 0.75),
    facts: dict[str, tuple[int, float, float]] | None = None,
    sortable_values: int | None = None,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, NULLs ignored; ``None`` where a column is empty.

    ``facts`` gives (count, minimum, maximum) of each column to a caller that already has them.
    """
    if not columns:
        return {}
    limit = SORTABLE_VALUES if sortable_values is None else sortable_values
    names = list(columns)
    views = df.select(*[columns[name].cast("double").alias(f"v{i}") for i, name in enumerate(names)])
    if facts is None:
        row = views.agg(*[
            F.struct(F.count(f"v{i}"), F.min(f"v{i}"), F.max(f"v{i}")).alias(f"c{i}") for i in range(len(names))
        ]).first()
        facts = {name: tuple(row[i]) for i, name in enumerate(names)}

    searches = {(i, p): _Search(i, *facts[name], p) for i, name in enumerate(names) for p in probs if facts[name][0]}
    while pending := [s for s in searches.values() if s.value is None and s.inside > limit]:
        cells = _count_cells(views, _borders(views, pending, accuracy))
        for s in pending:
            s.narrow(cells[s.column])
    _order_rest(views, [s for s in searches.values() if s.value is None])
    return {name: [searches[i, p].value if (i, p) in searches else None for p in probs] for i, name in enumerate(names)}


def _borders(views: DataFrame, pending: list[_Search], accuracy: int) -> dict[int, list[float]]:
    """For each column, values of it on either side of the wanted ranks, in order; one sketch per interval, all in one pass.

    The ends of the interval are borders too, so every pass takes at least them out of the interval.
    """
    shares: dict[tuple, set[float]] = {}
    for s in pending:
        shares.setdefault(s.interval, set()).update(s.shares(1 / accuracy))
    sketches = [
        F.percentile_approx(F.when(F.col(f"v{c}").between(lo, hi), F.col(f"v{c}")), sorted(wanted), accuracy).alias(f"s{k}")
        for k, ((c, lo, hi), wanted) in enumerate(shares.items())
    ]
    borders: dict[int, set[float]] = {}
    for (c, lo, hi), found in zip(shares, views.agg(*sketches).first()):
        borders.setdefault(c, set()).update((lo, hi, *found))
    return {c: sorted(values) for c, values in borders.items()}


def _count_cells(views: DataFrame, borders: dict[int, list[float]]) -> dict[int, list]:
    """Non-empty cells of every column in value order, all columns in one pass: each border is a cell, and so is what lies
    between two of them, with its count, minimum and maximum."""
    # Columns fan out first and a value looks its borders up: as expressions of every column at once they are too long a method
    # to be compiled. Columns of fewer borders are filled up with NaN, which no other value reaches.
    fan = F.array(*[F.when(F.col(f"v{c}").isNotNull(), F.struct(F.lit(c).alias("c"), F.col(f"v{c}").alias("v"))) for c in borders])
    # Nulls are dropped after the fan-out: a filter on the array would leave generated code.
    values = views.select(F.inline(fan)).where("c IS NOT NULL")
    held = [borders.get(c, []) for c in range(max(borders) + 1)]
    ranked = [F.get(F.array(*[F.lit(b[j] if j < len(b) else math.nan) for b in held]), F.col("c")) for j in range(max(map(len, held)))]
    # 2j + 1 for the border j itself, 2j for what comes before it
    cell = reduce(lambda a, b: a + b, [(F.col("v") >= b).cast("int") + (F.col("v") > b).cast("int") for b in ranked])
    rows = values.select("c", cell.alias("cell"), "v")
    counted = rows.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out: dict[int, list] = {c: [] for c in borders}
    for row in sorted(counted.collect(), key=lambda r: (r["c"], r["cell"])):
        out[row["c"]].append(row)
    return out


def _order_rest(views: DataFrame, searches: list[_Search]) -> None:
    """Pick the ranks from the few values left in each interval, put in order in a group of its own."""
    if not searches:
        return
    ranks: dict[tuple, set[int]] = {}
    for s in searches:
        ranks.setdefault(s.interval, set()).update((s.low - s.below, s.high - s.below))
    located = [
        F.when(F.col(f"v{c}").between(lo, hi), F.struct(F.lit(k).alias("k"), F.col(f"v{c}").alias("v")))
        for k, (c, lo, hi) in enumerate(ranks)
    ]
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r) for r in sorted(rs)]) for rs in ranks.values()]), F.col("k") + 1)
    # of at most SORTABLE_VALUES values a group
    ordered = views.select(F.inline(F.array(*located))).where("k IS NOT NULL").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = ordered.select("k", wanted.alias("ranks"), F.transform(wanted, lambda r: F.get("vs", r)).alias("at"))
    at = {(r["k"], rank): v for r in found.collect() for rank, v in zip(r["ranks"], r["at"])}
    place = {interval: k for k, interval in enumerate(ranks)}
    for s in searches:
        k = place[s.interval]
        s.settle(at[k, s.low - s.below], at[k, s.high - s.below])
