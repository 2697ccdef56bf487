"""Keys, numbers and sentences of long texts and long tables: read once, and the same as the plain way."""

import contextlib
import io
import unicodedata

from pyspark.sql import functions as F

from sondeo.functions import numbers as N
from sondeo.functions import text as X
from sondeo.operators import profile as P
from sondeo.operators.readers import progress_status, progress_values


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_characters_that_become_several_are_looked_for_as_ranges(spark):
    several = X.fold_table()[2]
    spread = X._beyond_ascii("".join(several))
    assert spread.startswith(r"[\x{80}-\x{10FFFF}&&") and spread.count("-") < len(several) / 3
    texts = [f"{a}{b}x{a}" for a, b in zip(several, [*several][1:])]
    told = lambda t: "".join(several.get(x, x) for x in t)
    lowered = column(spark, texts, F.lower)
    assert column(spark, texts, X.fold_accents) == ["".join(x for x in told(t)) for t in lowered]


def test_keys_of_ascii_and_accented_texts(spark):
    texts = ["Año  Ñandú", unicodedata.normalize("NFD", "Año Ñandú"), "plain-Text 1", "½ﬁn", "🄂🄂", "", None]
    assert column(spark, texts, X.semantic_text) == ["ano nandu", "ano nandu", "plain text 1", "1 2fin", "1 1", "", ""]
    assert column(spark, texts, X.compact_key) == ["ANONANDU", "ANONANDU", "PLAINTEXT1", "12FIN", "11", "", ""]


def test_keys_of_long_cells_are_counted_by_their_hash(spark):
    long = "é palabra " * P.LONG_CELL
    rows = [(long,), (long.upper(),), (long.replace("é", "e"),), ("otra " * P.LONG_CELL,), ("Otra",), ("OTRA",), ("s" + "." * P.LONG_CELL + "i",), ("Sí",), (None,)]
    cells = spark.createDataFrame(rows, "c0 string")
    assert P._distinct_keys(cells, [0]) == {0: (4, True)}


def test_progress_is_read_once_a_row(spark):
    df = spark.createDataFrame([("100%",), ("15,0 %",), ("0,0 %",), ("-5%",), ("15.5%",), (None,)], "Avance string")
    status = progress_status(df, progress_values(df, "Avance"))
    assert status.first().asDict() == {"total": 6, "done": 1, "under_way": 2, "pending": 2, "mean_progress": round((1 + 0.15 - 0.05 + 0.155) / 6, 4)}
    aggregate = next(line for line in plan(status).splitlines() if "Aggregate" in line)
    assert "RLIKE" not in aggregate


def test_percentages_have_a_shape_of_their_own(spark):
    texts = ["85%", "12,5 %", "-7.25%", " 5 % ", "1.234 %", "5 % x"]
    assert column(spark, texts, lambda c: N.parse_number(c, strict=True)) == [85.0, 12.5, -7.25, 5.0, 1234.0, None]
    assert N.PERCENT


def test_a_clean_sentence_is_not_cleaned_again(spark):
    texts = ["a b c d e f g h", "a b c d e f g", "x" * 55, "x" * 54, ""]
    assert column(spark, texts, X.reads_as_sentence) == [True, False, True, False, False] == column(spark, texts, X.is_sentence)


def test_blanks_of_every_kind(spark):
    texts = ["a  b", "a \n b", "a\n\t b\r\nc", "a_x000d_ _x000d_b", " null ", "a b", "\n"]
    assert column(spark, texts, X.clean_text) == ["a b", "a b", "a b c", "a b", "", "a b", ""]


def test_a_text_that_starts_with_no_number_is_left_early(spark):
    texts = ["$ 1,200 x", "COP USD -5.5e2", "x 12", "+", ".5", "usd", None, "COP,CO1"]
    assert column(spark, texts, N.parse_simple_number) == [1200.0, -550.0, None, None, 0.5, None, None, None]
