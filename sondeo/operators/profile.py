"""Column roles, importance and statistics: the profile every report is derived from.

The rows are read a fixed number of times whatever the number of columns: three aggregates
(numbers, texts, sketches), some for quantiles, one for the distinct counts that need to be
exact, and a short look at the top of the table for running numbers. What comes back to the
driver is one record per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import names
from sondeo.functions import vocabulary as V
from sondeo.functions.numbers import parse_simple_number
from sondeo.functions.text import compact_key
from sondeo.operators.money import MIN_RESOLVED, money_view
from sondeo.operators.quantiles import exact_quantiles
from sondeo.session import local_table

PROFILE_SCHEMA = """
    source string, column string, ord int, role string, kind string, importance int,
    n_rows bigint, n bigint, n_missing bigint, n_distinct bigint,
    stats struct<total: double, mean: double, median: double, min: double, max: double,
                 std: double, q1: double, q3: double>,
    resolved_ratio double, currencies array<string>, unresolved_rows bigint, trusted boolean
"""

NUMERIC_SCHEMA = """
    column string, n bigint, n_missing bigint, total double, mean double, median double,
    min double, max double, std double, q1 double, q3 double
"""

SKETCH_ERROR = 0.02
SKETCH_MARGIN = 0.2          # ten standard errors of the sketch
CHEAP_DISTINCT = 100_000     # below this, exact counting collapses before the shuffle
HEAD_ROWS = 1_000
SEQUENCE_LENGTH = 10


@dataclass
class ColumnProfile:
    """What is known about one column."""

    column: str
    ord: int
    role: str
    kind: str
    importance: int
    n_rows: int
    n: int
    n_missing: int
    n_distinct: int | None = None
    stats: dict[str, float] | None = None
    resolved_ratio: float = 1.0
    currencies: list[str] = field(default_factory=lambda: [V.BASE_CURRENCY])
    unresolved_rows: int = 0
    trusted: bool = True

    @property
    def is_measure(self) -> bool:
        return self.role == "numerico" and self.stats is not None


def profilable(df: DataFrame) -> list[str]:
    """Named columns of plain types; generic names and nested columns carry no role."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    return [c for c in plain if not names.is_generic(c)]


def numeric_profile(df: DataFrame, columns: list[str], strict: bool = True, sortable_values: int | None = None) -> DataFrame:
    """(column, n, n_missing, total, mean, median, min, max, std, q1, q3) for the given columns."""
    slots = {c: F.col(f"v{i}") for i, c in enumerate(columns)}
    views = df.select(*[money_view(df, c, strict).converted.alias(f"v{i}") for i, c in enumerate(columns)])
    facts = views.agg(F.count(F.lit(1)).alias("n_rows"), *[_basic(v).alias(c) for c, v in slots.items()]).first()
    told = {c: (facts[c]["n"], facts[c]["min"], facts[c]["max"]) for c in columns}
    quartiles = exact_quantiles(views, slots, facts=told, sortable_values=sortable_values)
    rows = []
    for c in columns:
        s, (q1, median, q3) = facts[c], quartiles[c]
        if s["n"] >= 2:
            rows.append((c, s["n"], facts["n_rows"] - s["n"], s["total"], s["mean"], median, s["min"], s["max"], s["std"], q1, q3))
    return local_table(df.sparkSession, rows, NUMERIC_SCHEMA)


def _basic(v: Column) -> Column:
    return F.struct(
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"),
        F.count_if(v == F.floor(v)).alias("n_whole"),
    )


def exact_where_it_matters(df: DataFrame, sketched: dict[str, tuple[Column, int, int]]) -> dict[str, int]:
    """Distinct counts from sketches, replaced by exact ones wherever a decision could turn on them.

    ``sketched`` maps a name to (expression, estimate, non-null rows). Small counts are
    recounted because it is cheap, and ratios near a threshold (0.3 or 0.8) because the
    sketch's error could move them across it.
    """
    def decides(estimate: int, n: int) -> bool:
        near = any(abs(estimate / n - edge) <= edge * SKETCH_MARGIN for edge in (0.3, 0.8)) if n else False
        return estimate <= CHEAP_DISTINCT or near

    recount = {name: expr for name, (expr, estimate, n) in sketched.items() if decides(estimate, n)}
    return {name: estimate for name, (_, estimate, _) in sketched.items()} | exact_distinct(df, recount)


def exact_distinct(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Exact distinct counts of several expressions in one scan, for figures that are shown."""
    if not values:
        return {}
    # Compared by 128 bits of hash, so that long texts are not shuffled whole.
    prints = F.array(*[
        F.when(expr.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(expr).alias("a"), F.xxhash64(F.lit("sondeo"), expr).alias("b")))
        for i, expr in enumerate(values.values())
    ])
    cells = df.select(F.inline(prints)).where("i IS NOT NULL").groupBy("i", "a", "b").count()
    exact = {r["i"]: r["n"] for r in cells.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: exact.get(i, 0) for i, name in enumerate(values)}


def looks_sequential(values: list[float | None], n_whole: int, n: int) -> bool:
    """Running numbers: mostly whole, and the first ten step by at most two small differences."""
    if n < 4 or n_whole < max(4, int(n * 0.8)) or len(values) < 2:
        return False
    steps = [round(b - a, 6) for a, b in zip(values, values[1:])]
    return len(set(steps)) <= 2 and max(map(abs, steps)) <= SEQUENCE_LENGTH


def first_whole_values(df: DataFrame, views: dict[str, Column], whole: dict[str, int], order_by: list[str]) -> dict[str, list[float]]:
    """The first ten whole numbers of each column in row order.

    A bounded top-of-table read answers for nearly every column; one whose whole numbers all
    start further down gets its own distributed top-k.
    """
    if not views:
        return {}
    slots = {name: f"v{i}" for i, name in enumerate(views)}
    table = df.select(*order_by, *[views[name].alias(slot) for name, slot in slots.items()])
    head = table.orderBy(*order_by).limit(HEAD_ROWS).select(*slots.values()).collect()
    out = {}
    for name, slot in slots.items():
        found = [r[slot] for r in head if r[slot] is not None and r[slot] == int(r[slot])][:SEQUENCE_LENGTH]
        if len(found) < min(SEQUENCE_LENGTH, whole[name]):
            rows = table.where(F.col(slot) == F.floor(slot)).orderBy(*order_by).limit(SEQUENCE_LENGTH).select(slot).collect()
            found = [r[0] for r in rows]
        out[name] = found
    return out


def profile_columns(
    df: DataFrame,
    order_by: list[str] | None = None,
    strict: bool = True,
    sortable_values: int | None = None,
) -> list[ColumnProfile]:
    """Role, importance and statistics of every column, most important first.

    ``order_by`` gives the row order that running-number detection needs; without it that
    test is left out. ``strict=False`` lets any text with a digit count as a number.
    """
    columns = profilable(df)
    views = {c: money_view(df, c, strict) for c in columns}
    numbers = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in columns}
    # Projected first, so each text is parsed once however many aggregates read the number.
    staged = df.select(*(order_by or []), *[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in _cell_views(views[c], numbers[c]).items()])
    slot = {c: {k: F.col(f"{k}{i}") for k in _cell_views(views[c], numbers[c])} for i, c in enumerate(columns)}

    n_rows, facts = _table_facts(staged, slot, numbers)
    known = {c: facts[c] for c in columns if facts[c]["n_filled"]}
    numeric = [c for c in known if known[c]["n_amounts"] / known[c]["n_filled"] >= 0.6]
    textual = [c for c in known if c not in numeric]

    basics = {c: known[c]["basic"] for c in numeric if known[c]["basic"]["n"] >= 2}
    measured = {c: slot[c]["v"] for c in basics}
    told = {c: (b["n"], b["min"], b["max"]) for c, b in basics.items()}
    quartiles = exact_quantiles(staged, measured, facts=told, sortable_values=sortable_values)
    heads = first_whole_values(staged, measured, {c: b["n_whole"] for c, b in basics.items()}, order_by) if order_by else {}
    distinct = exact_where_it_matters(
        staged, {c: (slot[c]["t"], known[c]["sketch"], known[c]["n_filled"]) for c in textual if "t" in slot[c]}
    )

    profiles = []
    for position, c in enumerate(columns):
        if c not in known:
            continue
        fact, basic = known[c], known[c]["basic"]
        profile = ColumnProfile(
            c, position, "texto", views[c].kind, names.header_points(c), n_rows,
            n=fact["n_filled"], n_missing=n_rows - fact["n_filled"],
        )
        if c in numeric:
            _describe_number(profile, fact, basic, quartiles.get(c), heads.get(c, []), views[c].currency_column is not None)
        else:
            _describe_text(profile, distinct[c], fact["n_filled"])
        if names.is_person(c) and profile.role in ("texto", "identificador"):
            profile.importance -= 8
        profiles.append(profile)
    return sorted(profiles, key=lambda p: (-p.importance, p.ord))


def _cell_views(view, is_number: bool) -> dict[str, Column]:
    """The readings of one column that the profile needs: number, amount, currency, text."""
    raw = F.col(f"`{view.column}`")
    out = {"v": view.converted}
    if view.currency_column:
        out |= {"a": view.amount, "k": view.code}
    return out if is_number else out | {"t": raw.cast("string")}


def _table_facts(staged: DataFrame, slot: dict[str, dict[str, Column]], numbers: dict[str, bool]) -> tuple[int, dict[str, dict]]:
    """The number of rows and, for every column, what ``_cell_facts`` and ``_cell_sketches`` say.

    Three aggregates, as one would be slow at all of it: sketches and sets keep the sums beside them out of generated code,
    and the steps that read texts make a method too long to be compiled, in which plain numbers would be counted too.
    """
    plain = [c for c in slot if numbers[c] and "a" not in slot[c]]
    passes = (
        (plain, _cell_facts),
        ([c for c in slot if c not in plain], _cell_facts),
        ([c for c in slot if _cell_sketches(slot[c])], _cell_sketches),
    )
    n_rows, facts = 0, {c: {} for c in slot}
    for columns, parts in passes:
        if columns:
            row = staged.agg(F.count(F.lit(1)).alias("n_rows"), *[F.struct(*parts(slot[c])).alias(f"c{i}") for i, c in enumerate(columns)]).first()
            n_rows = row["n_rows"]
            for i, c in enumerate(columns):
                facts[c] |= row[f"c{i}"].asDict()
    return n_rows, facts


def _cell_facts(slot: dict[str, Column]) -> list[Column]:
    amount = slot.get("a", slot["v"])
    parts = [
        F.count(slot.get("t", amount)).alias("n_filled"),
        F.count(amount).alias("n_amounts"),
        _basic(slot["v"]).alias("basic"),
    ]
    if "a" in slot:
        parts.append(F.count(slot["v"]).alias("n_resolved"))
    return parts


def _cell_sketches(slot: dict[str, Column]) -> list[Column]:
    parts = []
    if "a" in slot:
        parts.append(F.array_sort(F.collect_set(F.when(slot["a"].isNotNull(), slot["k"]))).alias("currencies"))
    if "t" in slot:
        parts.append(F.approx_count_distinct(slot["t"], SKETCH_ERROR).alias("sketch"))
    return parts


def _describe_number(profile, fact, basic, quartiles, head, foreign: bool) -> None:
    profile.role = "numerico"
    profile.importance += 20
    profile.n, profile.n_missing = basic["n"], profile.n_rows - basic["n"]
    if foreign:
        profile.currencies = fact["currencies"] or [V.BASE_CURRENCY]
        profile.unresolved_rows = fact["n_amounts"] - fact["n_resolved"]
        profile.resolved_ratio = fact["n_resolved"] / max(1, fact["n_amounts"])
        profile.trusted = len(profile.currencies) <= 1 or profile.resolved_ratio >= MIN_RESOLVED
    if quartiles is None:
        return
    q1, median, q3 = quartiles
    profile.stats = {
        "total": basic["total"], "mean": basic["mean"], "median": median, "min": basic["min"],
        "max": basic["max"], "std": basic["std"], "q1": q1, "q3": q3,
    }
    if looks_sequential(head, basic["n_whole"], basic["n"]) and not names.mentions(profile.column, V.EXECUTIVE_HEADERS):
        profile.role = "identificador"
        profile.importance -= 18
    profile.importance += 30 if basic["total"] > 1e6 else 15 if basic["total"] > 1e4 else 0


def _describe_text(profile: ColumnProfile, n_distinct: int, n: int) -> None:
    if n_distinct <= 20 and n_distinct / n <= 0.3:
        profile.role, profile.n_distinct = "categorica", n_distinct
        profile.importance += 15
    elif n_distinct / n > 0.8:
        profile.role = "identificador"
        profile.importance += 5
    else:
        profile.importance += 3


def profile_table(df: DataFrame, source: str, profiles: list[ColumnProfile] | None = None, **options) -> DataFrame:
    """The profile as a DataFrame, one row per column."""
    profiles = profile_columns(df, **options) if profiles is None else profiles
    rows = [
        (source, p.column, p.ord, p.role, p.kind, p.importance, p.n_rows, p.n, p.n_missing, p.n_distinct,
         p.stats, round(p.resolved_ratio, 3), p.currencies, p.unresolved_rows, p.trusted)
        for p in profiles
    ]
    return local_table(df.sparkSession, rows, PROFILE_SCHEMA)


def shape_types(df: DataFrame, order_by: list[str] | None = None, sample_rows: int | None = None) -> DataFrame:
    """(column, ord, type): the organiser's nine column types.

    The whole column is judged by default; ``sample_rows`` with ``order_by`` judges the top
    of the table only, as an interactive preview does.
    """
    columns = profilable(df)
    rows = df.orderBy(*order_by).limit(sample_rows) if sample_rows else df
    # A header that settles the type spares its column the look at the values.
    open_columns = [c for c in columns if not _header_type(c)]
    texts = {c: _filled_text(df, c) for c in columns}
    cells = rows.select(*[texts[c].alias(f"c{i}") for i, c in enumerate(columns)], *[_simple_number(df, c).alias(f"v{i}") for i, c in enumerate(columns) if c in open_columns])

    def judged(i: int, c: str) -> Column:
        parts = [F.count(f"c{i}").alias("n")]
        if c in open_columns:
            v = F.col(f"v{i}")
            parts += [F.count(v).alias("n_numbers"), F.count_if(v.between(0, 1)).alias("n_unit"), F.avg(v).alias("mean")]
        return F.struct(*parts).alias(f"j{i}")

    facts = cells.agg(*[judged(i, c) for i, c in enumerate(columns)]).first()
    undecided = [i for i, c in enumerate(columns) if c in open_columns and facts[i]["n_numbers"] < 0.75 * facts[i]["n"]]
    keys = _distinct_keys(cells, undecided)
    judgements = [(c, i, _shape_type(c, facts[i], *keys.get(i, (0, False)))) for i, c in enumerate(columns)]
    return local_table(df.sparkSession, judgements, "column string, ord int, type string")


def _filled_text(df: DataFrame, c: str) -> Column:
    text = F.col(f"`{c}`").cast("string")
    return text if isinstance(df.schema[c].dataType, T.NumericType) else F.when(F.trim(text) != "", text)


def _simple_number(df: DataFrame, c: str) -> Column:
    raw = F.col(f"`{c}`")
    return raw.cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else parse_simple_number(raw)


def _distinct_keys(cells: DataFrame, columns: list[int]) -> dict[int, tuple[int, bool]]:
    """Number of distinct comparison keys, and whether one is a yes/no word, per column.

    Equal short cells collapse before their key is worked out. Long texts seldom repeat: their key is worked out where they
    are read, and 128 bits of its hash are shuffled instead of the text.
    """
    if not columns:
        return {}
    lasting = {i: F.length(f"c{i}") > LONG_CELL for i in columns}
    read = cells.select(*[x for i in columns for x in (
        F.when(~lasting[i], F.col(f"c{i}")).alias(f"c{i}"), F.when(lasting[i], compact_key(F.col(f"c{i}"))).alias(f"k{i}"))])
    fan = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("cell"), *_key_print(F.col(f"k{i}"))) for i in columns])
    once = read.select(F.inline(fan)).where("cell IS NOT NULL OR yes_no IS NOT NULL").distinct()
    short = once.where("cell IS NOT NULL").select("i", compact_key(F.col("cell")).alias("key")).select("i", *_key_print(F.col("key")))
    keys = once.where("cell IS NULL").select("i", "a", "b", "yes_no").unionByName(short).distinct()
    counted = keys.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.bool_or("yes_no").alias("yes_no"))
    return {r["i"]: (r["n"], r["yes_no"]) for r in counted.collect()}


def _key_print(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("sondeo"), key).alias("b"), key.isin("SI", "NO", "TRUE").alias("yes_no")]


LONG_CELL = 64      # characters
FEW_KEYS = 10


def _shape_type(name: str, fact, n_keys: int, yes_no: bool) -> str:
    n = fact["n"]
    if not n:
        return "empty"
    if by_header := _header_type(name):
        return by_header
    n_numbers = fact["n_numbers"]
    if n_numbers >= 0.75 * n:
        if fact["n_unit"] == n_numbers and n_numbers >= 5:
            return "percent"
        return "currency" if fact["mean"] > 10_000 else "numeric"
    if n_keys <= 2 and yes_no:
        return "boolean"
    return "categorical" if n_keys <= FEW_KEYS and n >= 4 else "text"


# Fixed header patterns of the organiser's type test, tried in this order.
HEADER_TYPES = (
    ("id", r"ID$|^ID|COD|CODIGO|FOLIO|CONS"),
    ("date", r"FECHA|DATE|PERIODO|YEAR|MONTH|MES"),
    ("percent", r"PORC|PCT|PERCENT|TASA"),
    ("currency", r"VALOR|TOTAL|COSTO|PRECIO|MONTO|GASTO|SALAR|COMIS|PAGO"),
)


def _header_type(name: str) -> str | None:
    import re

    key = names.semantic_key(name).replace(" ", "").upper()
    return next((kind for kind, pattern in HEADER_TYPES if re.search(pattern, key)), None)
