"""Numbers hidden in text, and numbers turned back into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import vocabulary as V


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _magnitude(body: Column) -> Column:
    return (
        F.when(body.rlike(V.BILLION_WORDS), F.lit(1e9))
        .when(body.rlike(V.MILLION_WORDS), F.lit(1e6))
        .when(body.rlike(V.THOUSAND_WORDS), F.lit(1e3))
        .otherwise(F.lit(1.0))
    )


# Shapes of a bare number in which the last separator is the decimal mark.
DECIMAL_SHAPES = "|".join((
    r"^[^,]*\.[^,]*,[^.,]*$",              # 1.234,56
    r"^[^.]*,[^.]*\.[^.,]*$",              # 1,234.56
    r"^[^.,]*,[^.,]{0,2}$",                # 1,5
    r"^[^.,]*\.(?:[^.,]{0,2}|[^.,]{4,})$", # 1.5 and 1.2345
    r"^[^,]*\.[^,]*\.[^.,]{0,2}$",         # 1.234.56
))
# Both separators, the last kind repeated: no reading makes sense.
MUDDLED_SHAPES = r"^(?=.*\.)(?=.*,.*,).*,[^.,]*$|^(?=.*,)(?=.*\..*\.).*\.[^.,]*$"
# Fails at the first foreign letter, so prose costs next to nothing.
NUMBER_ALPHABET = (
    r"^(?:[\s\d.,'$€£¥%()+\-\x{a0}−–—]++|(?:us|col?)\$|(?:mil|mm|m|k|bn|millon(?:es)?|billon(?:es)?|cop|usd|eur|"
    r"pesos?|dolares?|moneda|aprox|aproximado|estimado)\b)*+$"
)
UNIT_WORDS = rf"{V.BILLION_WORDS}|\b(?:mm|millones?)\b|(?<=\d)\s*m\b|{V.THOUSAND_WORDS}|{V.CURRENCY_WORDS}"


def _settle_separators(s: Column) -> Column:
    """Decide which of ``,`` and ``.`` is the decimal mark, by position and last-group length."""
    last_only = F.translate(F.regexp_replace(s, r"[.,](?=.*[.,])", ""), ",", ".")
    return (
        F.when(s.rlike(DECIMAL_SHAPES), last_only)
        .when(s.rlike(MUDDLED_SHAPES), F.lit(None))
        .otherwise(F.translate(s, ",.", ""))
    )


def _reads_as_number(text: Column) -> Column:
    """True when nothing but digits, separators, signs and unit words is left in the text."""
    rest = F.regexp_replace(text, rf"{UNIT_WORDS}|\b(?:us|col?)?\$", "")
    return rest.rlike(r"^[\s$€£¥]*[+-]*[\s$€£¥]*[.,]?\d[\d\s.,']*[\s$€£¥%.]*$")


PLAIN = r"^-?\d{1,15}(\.\d{1,2})?$"
DOT_GROUPS = r"^-?\d{1,3}(\.\d{3})+(,\d{1,2})?$"      # 1.234 and 1.234.567,89
COMMA_GROUPS = r"^-?\d{1,3}(,\d{3})+(\.\d{1,2})?$"     # 1,234 and 1,234,567.89
PERCENT = r"^-?\d{1,15}([.,]\d{1,2})? *%$"             # 85%, 12,5 %


def parse_number(c: Column, strict: bool = False, zero_is_null: bool = False) -> Column:
    """Locale-formatted text to DOUBLE, NULL when it is not a number.

    Understands both decimal conventions, parentheses and three dash glyphs for negatives,
    currency words, and the multipliers mil / millones / mil millones. ``strict`` refuses
    text that merely contains digits (``Calle 10``, ``2024-01-15``, ``Brand#4``).

    Every step refers to the one before it once, so the expression stays small enough for
    whole-stage code generation.
    """
    text = F.trim(F.translate(F.lower(c), "\u00a0−–—", " ---"))
    signed = F.regexp_replace(text, r"^\(\s*(.*?)\s*\)$", "-$1")
    kept = F.regexp_replace(F.regexp_replace(signed, V.CURRENCY_WORDS, ""), r"[^0-9,.\-]", "")
    digits = F.regexp_replace(kept, r"(?<!^)-", "")
    # A failing cast costs an exception, so text without digits never reaches it.
    value = F.when(digits.rlike(r"\d"), _settle_separators(digits).try_cast("double") * _magnitude(signed))
    if strict:
        value = F.when(_reads_as_number(signed), value)
    # Most cells are plain, a percentage, or grouped in one of the two usual ways; settle those without the regex ladder,
    # the first two as they stand. Prose ends there: it has no digit, or letters
    # of no number.
    parsed = (
        F.when(c.rlike(PLAIN), c.try_cast("double"))
        .when(c.rlike(PERCENT), F.translate(c, ", %", ".").try_cast("double"))
        .when(~c.rlike("[0-9]") | (~F.lower(c).rlike(NUMBER_ALPHABET) if strict else F.lit(False)), F.lit(None))
        .when(text.rlike(PLAIN), text.try_cast("double"))
        .when(text.rlike(DOT_GROUPS), F.translate(text, ",.", ".").try_cast("double"))
        .when(text.rlike(COMMA_GROUPS), F.translate(text, ",", "").try_cast("double"))
        .when(text.rlike(PERCENT), F.translate(text, ", %", ".").try_cast("double"))
        .otherwise(value)
    )
    return F.when(text != "0", parsed) if zero_is_null else parsed


def number_view(c: Column, dtype: T.DataType, strict: bool = True) -> Column:
    """The DOUBLE reading of a column of any type; booleans, dates and nested types have none."""
    if is_numeric_type(dtype):
        value = c.cast("double")
        return F.when(F.abs(value) < float("inf"), value)      # neither NaN nor infinite
    if isinstance(dtype, T.StringType):
        return parse_number(c, strict=strict)
    return F.lit(None).cast("double")


def parse_simple_number(c: Column) -> Column:
    """The organiser's parser: symbols, commas, blanks and COP/USD out, then a leading number."""
    text = F.upper(c.cast("string"))
    bare = F.regexp_replace(text, r"[$€£¥,\s]|COP|USD", "")
    lead = F.regexp_extract(bare, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?", 0)
    # Where no number can come first, the rest of the text is not looked at.
    return F.when(text.rlike(r"^(?:[$€£¥,\s]|COP|USD)*+[+\-.\d]"), F.when(lead != "", lead.try_cast("double")))


def _spanish(value: Column, decimals: int) -> Column:
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def _choose(value: Column, few: Column, lo: int, hi: int) -> Column:
    """``lo`` decimals where ``few`` holds, else ``hi``."""
    return F.when(few, _spanish(value, lo)).otherwise(_spanish(value, hi))


def _scaled(value: Column) -> tuple[Column, Column]:
    size = F.abs(value)
    scale = F.when(size >= 1e9, F.lit(1e9)).when(size >= 1e6, F.lit(1e6)).when(size >= 1e3, F.lit(1e3)).otherwise(F.lit(1.0))
    suffix = F.when(size >= 1e9, F.lit(" mil MM")).when(size >= 1e6, F.lit(" M")).when(size >= 1e3, F.lit(" mil")).otherwise(F.lit(""))
    return value / scale, suffix


def format_metric(value: Column, kind: str = "number", compact: bool = True) -> Column:
    """Spanish display text: ``COP 1,2 M``, ``250 mil``, ``85%``; long form with ``compact=False``."""
    value = value.cast("double")
    size = F.abs(value)
    if kind == "percent":
        shown = F.when(size <= 1.2, value * 100).otherwise(value)
        return F.concat(_choose(shown, F.abs(shown) >= 10, 0, 1), F.lit("%"))
    if compact:
        scaled, suffix = _scaled(value)
        text = F.concat(_choose(scaled, F.abs(scaled) >= 100, 0, 1), suffix)
    else:
        text = F.when((size >= 1000) | (value == F.floor(value)), _spanish(value, 0)).otherwise(
            _choose(value, size >= 1, 1, 2)
        )
    return F.concat(F.lit(f"{V.BASE_CURRENCY} "), text) if kind == "currency" else text


def format_full(value: Column, kind: str = "number") -> Column:
    """The report's uncompacted text (percent keeps one decimal, small money two)."""
    value = value.cast("double")
    size = F.abs(value)
    whole = value == F.floor(value)
    if kind == "percent":
        shown = F.when(size <= 1.2, value * 100).otherwise(value)
        return F.concat(_spanish(shown, 1), F.lit("%"))
    if kind == "currency":
        return F.concat(F.lit(f"{V.BASE_CURRENCY} "), _choose(value, (size >= 1000) | whole, 0, 2))
    return F.when((size < 1000) & whole, value.cast("bigint").cast("string")).otherwise(
        F.when(size >= 1000, _spanish(value, 0)).otherwise(_choose(value, size >= 1, 1, 2))
    )


def format_axis(value: Column, kind: str = "number") -> Column:
    """Short text for chart axes."""
    if kind != "currency":
        return format_metric(value, kind)
    scaled, suffix = _scaled(value.cast("double"))
    return F.concat(_choose(scaled, F.abs(scaled) >= 10, 0, 1), suffix)


def format_callout(value: Column, kind: str = "number") -> Column:
    """Full text, or the compact one where the full text is longer than 16 characters."""
    full = format_full(value, kind)
    return F.when(F.length(full) > 16, format_metric(value, kind)).otherwise(full)


def format_dollars(value: Column) -> Column:
    """``$1.2B`` / ``$1.2M`` / ``$12K`` / ``$9``."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.concat(
        F.lit("$"),
        F.when(value >= 1e9, F.format_string("%.1fB", value / 1e9))
        .when(value >= 1e6, F.format_string("%.1fM", value / 1e6))
        .when(value >= 1e3, F.format_string("%.0fK", value / 1e3))
        .otherwise(F.format_string("%.0f", value)),
    )
