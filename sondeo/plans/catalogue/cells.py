"""Scalar expressions at work on whole columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sondeo.functions import vocabulary as V
from sondeo.functions.dates import bucket_label, date_votes, from_excel_serial, parse_timestamp
from sondeo.functions.numbers import (
    format_axis,
    format_callout,
    format_dollars,
    format_full,
    format_metric,
    parse_number,
    parse_simple_number,
)
from sondeo.functions.scoring import confidence_label, currency_code, status
from sondeo.functions.text import (
    clean_category,
    clean_text,
    compact_key,
    is_noise,
    is_placeholder,
    is_sentence,
    is_time_label,
    repair_mojibake,
    semantic_text,
)
from sondeo.plans.catalogue import query, table


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders")
def parse_locale_numbers(spark, sf):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, sf, "orders").select("o_orderkey", parse_number(text, strict=True).alias("amount"))


@query("""
SELECT o_orderkey,
       CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice WHEN o_orderkey % 3 = 1 THEN o_totalprice
            ELSE round(o_totalprice, 0) * 1000 END AS amount
FROM orders""")
def parse_decorated_numbers(spark, sf):
    price = F.format_number("o_totalprice", 2)
    kind = F.col("o_orderkey") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("( "), price, F.lit(" )")))
        .when(kind == 1, F.concat(F.lit("US$ "), price))
        .otherwise(F.concat(F.round("o_totalprice", 0).cast("bigint").cast("string"), F.lit(" mil pesos")))
    )
    return table(spark, sf, "orders").select("o_orderkey", parse_number(text, strict=True).alias("amount"))


@query("""
WITH c AS (SELECT 'o_orderpriority' AS col, o_orderpriority AS x FROM orders UNION ALL SELECT 'p_brand', p_brand FROM part)
SELECT col, count(*) AS n, count(*) FILTER (WHERE regexp_matches(x, '[0-9]')) AS n_lenient,
       count(*) FILTER (WHERE regexp_full_match(trim(x), '[-+(]*[0-9][0-9.,]*[)%]*')) AS n_strict FROM c GROUP BY 1""")
def parse_strictness(spark, sf):
    def counted(t, c):
        return table(spark, sf, t).agg(
            F.count(F.lit(1)).alias("n"),
            F.count(parse_number(F.col(c))).alias("n_lenient"),
            F.count(parse_number(F.col(c), strict=True)).alias("n_strict"),
        ).select(F.lit(c).alias("col"), "n", "n_lenient", "n_strict")

    return counted("orders", "o_orderpriority").unionByName(counted("part", "p_brand"))


@query("SELECT c_custkey, c_acctbal AS amount FROM customer")
def parse_simple_numbers(spark, sf):
    text = F.concat(F.lit("$ "), F.format_number("c_acctbal", 2), F.lit(" cop"))
    return table(spark, sf, "customer").select("c_custkey", parse_simple_number(text).alias("amount"))


FOLDED = f"translate(lower(text), '{V.ACCENTED}', '{V.UNACCENTED}')"


@query(f"""
SELECT doc_id, md5(trim(regexp_replace({FOLDED}, '[^a-z0-9]+', ' ', 'g'))) AS key_hash,
       length(upper(regexp_replace({FOLDED}, '[^a-z0-9]+', '', 'g'))) AS compact_length
FROM documents""")
def normalised_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(semantic_text(text)).alias("key_hash"), F.length(compact_key(text)).cast("bigint").alias("compact_length")
    )


ACCENTS = " Škoda Łódź Đ ﬁn ｗｉｄｅ"       # letters with marks, letters that are no marked letter, a ligature, wide letters


@query(f"""
SELECT c_custkey, k AS composed, k AS decomposed FROM (
  SELECT c_custkey, trim(regexp_replace(replace(translate(strip_accents(lower(c_name || '{ACCENTS}' || c_mktsegment)), 'ｗｉｄｅ', 'wide'), 'ﬁ', 'fi'), '[^a-z0-9]+', ' ', 'g')) AS k
  FROM customer)""")
def accents_in_two_forms(spark, sf):
    """The same key whether a mark is part of a letter or follows it."""
    def key(form: str) -> Column:
        return semantic_text(F.concat("c_name", F.lit(unicodedata.normalize(form, ACCENTS) if form == "NFD" else ACCENTS), "c_mktsegment"))

    return table(spark, sf, "customer").select("c_custkey", key("NFC").alias("composed"), key("NFD").alias("decomposed"))


CLEAN = r"trim(regexp_replace(regexp_replace({0}, '_x000d_|\s+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, md5({CLEAN.format('text')}) AS text_hash FROM documents")
def cleaned_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("text_hash"))


def _repaired(expr: str) -> str:
    for broken, sound in V.MOJIBAKE.items():
        expr = f"replace({expr}, '{broken}', '{sound}')"
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, md5({_repaired("replace(replace(text, 'é', 'Ã©'), 'ñ', 'Ã±')")}) AS text_hash FROM documents""")
def repaired_text(spark, sf):
    damaged = F.replace(F.replace("text", F.lit("é"), F.lit("Ã©")), F.lit("ñ"), F.lit("Ã±"))
    return table(spark, sf, "documents").select("doc_id", F.md5(repair_mojibake(damaged)).alias("text_hash"))


SHORT_TIMES = "|".join(w for w in V.TIME_LABELS if len(w) <= 3)
LONG_TIMES = "|".join(w for w in V.TIME_LABELS if len(w) > 3)


@query(f"""
SELECT role, count(*) AS n,
       count(*) FILTER (WHERE len(string_split({CLEAN.format('text')}, ' ')) >= 8
                        OR length({CLEAN.format('text')}) >= 55) AS n_sentences,
       count(*) FILTER (WHERE regexp_matches(regexp_replace({FOLDED}, '[^a-z0-9]+', ' ', 'g'),
                              '\\b(?:{SHORT_TIMES})\\b|{LONG_TIMES}|\\b20\\d{{2}}\\b')
                        OR regexp_matches(text, '\\b\\d{{1,2}}[/-]\\d{{1,2}}([/-]\\d{{2,4}})?\\b')) AS n_timed
FROM conversations GROUP BY role""")
def text_signals(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_sentence(text)).alias("n_sentences"),
        F.count_if(is_time_label(text)).alias("n_timed"),
    )


@query("""
WITH cells AS (
  SELECT l_returnflag AS flag,
         CASE l_linenumber WHEN 1 THEN 'N/A ' WHEN 2 THEN ' s/d' WHEN 3 THEN 'x' WHEN 4 THEN '—'
              WHEN 5 THEN '0' ELSE l_linestatus || ' ' || l_linenumber END AS cell
  FROM lineitem)
SELECT flag, count(*) AS n,
       count(*) FILTER (WHERE lower(trim(cell)) IN ('n/a', 's/d', '—')) AS n_placeholder,
       count(*) FILTER (WHERE lower(trim(cell)) IN ('n/a', 's/d', 'x', '—', '0')) AS n_noise,
       count(*) FILTER (WHERE lower(trim(cell)) NOT IN ('n/a', 's/d', '—')) AS n_labels
FROM cells GROUP BY flag""")
def placeholder_cells(spark, sf):
    number = F.col("l_linenumber")
    cell = (
        F.when(number == 1, "N/A ").when(number == 2, " s/d").when(number == 3, "x").when(number == 4, "—").when(number == 5, "0")
        .otherwise(F.concat_ws(" ", "l_linestatus", number.cast("string")))
    )
    cells = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), cell.alias("cell"))
    c = F.col("cell")
    return cells.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_placeholder(c)).alias("n_placeholder"),
        F.count_if(is_noise(c)).alias("n_noise"),
        F.count(clean_category(c)).alias("n_labels"),
    )


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderkey IS NOT NULL")
def excel_serial_dates(spark, sf):
    serial = F.date_diff("o_orderdate", F.lit(V.EXCEL_EPOCH).cast("date")).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", from_excel_serial(serial).alias("day"))


@query("""
SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month, count(*) AS n
FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1""")
def lenient_dates(spark, sf):
    """Dates written three ways, and one way that is no date."""
    line = F.col("l_linenumber")
    text = (
        F.when(line == 7, F.lit("pendiente"))
        .when(line % 3 == 0, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .when(line % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    )
    ts = parse_timestamp(text, StringType())
    return (
        table(spark, sf, "lineitem").select(bucket_label(ts).alias("month")).where("month IS NOT NULL")
        .groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    )


DATE_WRITINGS = {
    "day first": "dd/MM/yyyy", "month first": "M-d-yyyy", "year first": "yyyy-MM-dd", "with time": "MM.dd.yyyy H:mm",
}


def _writings(spark, sf):
    """Order days written in every way; one column only on days that fit both orders, one with two orders in it."""
    day = F.col("o_orderdate")
    early = F.date_add(F.date_trunc("month", day).cast("date"), F.dayofmonth(day) % 12)
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    rest = {"either": F.date_format(early, "dd/MM/yyyy"), "mixed": mixed, "gaps": F.when(F.col("o_orderkey") % 5 > 0, F.date_format(day, "MM/dd/yyyy")).otherwise("sin fecha")}
    return table(spark, sf, "orders").select("o_totalprice", *[F.date_format(day, f).alias(name) for name, f in DATE_WRITINGS.items()], *[c.alias(name) for name, c in rest.items()])


@query("""
WITH d AS (SELECT o_orderkey AS k, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders WHERE o_orderdate IS NOT NULL),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE d > 12) AS late, count(*) FILTER (WHERE d <= 12) AS early,
      count(*) FILTER (WHERE d > 12 AND k % 3 = 0) AS late_day, count(*) FILTER (WHERE d > 12 AND k % 3 <> 0) AS late_month,
      count(*) FILTER (WHERE k % 5 = 0) AS gaps, count(*) FILTER (WHERE d > 12 AND k % 5 > 0) AS late_told, count(*) FILTER (WHERE d <= 12 AND k % 5 > 0) AS early_told FROM d)
SELECT 'day first' AS "column", n, late AS n_day, 0::BIGINT AS n_month, early AS n_open, 'day' AS date_order, 0::BIGINT AS n_unread FROM n UNION ALL
SELECT 'month first', n, 0, late, early, 'month', 0 FROM n UNION ALL
SELECT 'year first', n, 0, 0, 0, 'none', 0 FROM n UNION ALL
SELECT 'with time', n, 0, late, early, 'month', 0 FROM n UNION ALL
SELECT 'either', n, 0, 0, n, 'undecided', 0 FROM n UNION ALL
SELECT 'mixed', n, late_day, late_month, early, 'mixed: month', late_day FROM n UNION ALL
SELECT 'gaps', n, 0, late_told, early_told, 'month', gaps FROM n""")
def date_order_votes(spark, sf):
    written = _writings(spark, sf)
    return date_votes(written, written.columns[1:]).select("column", "n", "n_day", "n_month", "n_open", "date_order", "n_unread")


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def month_first_dates(spark, sf):
    """Totals by month of days written with the month first, in the order the column votes for."""
    written = _writings(spark, sf)
    order = date_votes(written, ["month first"]).first()["date_order"]
    ts = parse_timestamp(F.col("`month first`"), StringType(), order == "month")
    return written.groupBy(bucket_label(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT code, count(*) AS n, round(sum(price), 2) AS total FROM (
  SELECT CASE o_orderstatus WHEN 'O' THEN 'COP' WHEN 'F' THEN 'USD'
              ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END END AS code, o_totalprice AS price
  FROM orders) GROUP BY code""")
def currency_codes(spark, sf):
    state = F.col("o_orderstatus")
    text = F.when(state == "O", "pesos col").when(state == "F", "us$ dolar").when(F.col("o_orderkey") % 2 == 0, "Euros").otherwise("?")
    rows = table(spark, sf, "orders").select(currency_code(text).alias("code"), "o_totalprice")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


COMPACT = """
CASE WHEN abs({0}) >= 1e9 THEN {0} / 1e9 WHEN abs({0}) >= 1e6 THEN {0} / 1e6
     WHEN abs({0}) >= 1e3 THEN {0} / 1e3 ELSE {0} END"""
SUFFIX = """
CASE WHEN abs({0}) >= 1e9 THEN ' mil MM' WHEN abs({0}) >= 1e6 THEN ' M'
     WHEN abs({0}) >= 1e3 THEN ' mil' ELSE '' END"""


@query(f"""
WITH t AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT o_custkey, v, {COMPACT.format('v')} AS scaled, {SUFFIX.format('v')} AS suffix FROM t)
SELECT o_custkey,
       'COP ' || replace(CASE WHEN abs(scaled) >= 100 THEN printf('%.0f', scaled) ELSE printf('%.1f', scaled) END, '.', ',')
         || suffix AS compact,
       replace(CASE WHEN abs(scaled) >= 10 THEN printf('%.0f', scaled) ELSE printf('%.1f', scaled) END, '.', ',')
         || suffix AS axis,
       'COP ' || replace(format('{{:,}}', round_even(v, 0)::BIGINT), ',', '.') AS long_text,
       CASE WHEN v >= 1e6 THEN '$' || printf('%.1f', v / 1e6) || 'M' ELSE '$' || printf('%.0f', v / 1e3) || 'K' END AS dollars
FROM s WHERE v >= 1000""")
def display_amounts(spark, sf):
    v = F.col("v")
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).where("v >= 1000")
    return sums.select(
        "o_custkey",
        format_metric(v, "currency").alias("compact"),
        format_axis(v, "currency").alias("axis"),
        format_full(v, "currency").alias("long_text"),
        format_dollars(v).alias("dollars"),
    )


@query("""
WITH t AS (SELECT l_suppkey, avg(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT l_suppkey,
       replace(CASE WHEN d * 100 >= 10 THEN printf('%.0f', d * 100) ELSE printf('%.1f', d * 100) END, '.', ',') || '%' AS short,
       replace(printf('%.1f', d * 100), '.', ',') || '%' AS callout,
       CASE WHEN d >= 0.055 THEN 'rojo' WHEN d >= 0.05 THEN 'amarillo' ELSE 'verde' END AS light,
       CASE WHEN d * 15 >= 0.8 THEN 'Alta' WHEN d * 15 >= 0.62 THEN 'Media' ELSE 'Baja' END AS confidence
FROM t""")
def display_percentages(spark, sf):
    d = F.col("d")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d")).select(
        "l_suppkey",
        format_metric(d, "percent").alias("short"),
        format_callout(d, "percent").alias("callout"),
        status(d, 0.05, 0.055).alias("light"),
        confidence_label(d * 15).alias("confidence"),
    )
