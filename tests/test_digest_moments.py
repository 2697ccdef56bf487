"""Content digests against plain Python, and correlations of many columns in one scan."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sondeo.operators.correlation import correlations, pair_moments
from sondeo.operators.digest import column_digests, table_digest

SF = "/root/testdata/sf0.001"


def sums(texts):
    digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    return str(sum(int(d[:15], 16) for d in digests)), str(sum(int(d[15:30], 16) for d in digests))


def test_digest_is_of_the_rows_alone(spark):
    rows = [(1, "a", None), (2, None, True), (2, None, True), (3, "", False), (None, None, None)]
    df = spark.createDataFrame(rows, "k long, `t.x` string, b boolean")
    one = table_digest(df).first()
    text = lambda v: "\x01" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    want = sums("\x02".join(text(r[i]) for i in (2, 0, 1)) for r in rows)
    assert (one["n_rows"], one["sum_1"], one["sum_2"]) == (5, *want)
    for other in (df.repartition(7), df.orderBy(F.desc("k")), df.select("b", "`t.x`", "k")):
        assert table_digest(other).first() == one
    for changed in (df.limit(4), df.unionByName(df.limit(1)), df.withColumn("k", F.col("k") + 1), df.withColumnRenamed("b", "c"), df.withColumn("b", F.lit(None).cast("boolean"))):
        assert table_digest(changed).first()["digest"] != one["digest"]
    empty = table_digest(df.where("false")).first()
    assert (empty["n_rows"], empty["sum_1"], empty["sum_2"]) == (0, "0", "0")
    assert [tuple(r) for r in column_digests(df).collect()] == [(c, sum(r[i] is not None for r in rows), *sums(text(r[i]) for r in rows)) for i, c in enumerate(df.columns)]


def test_digest_takes_any_type_and_moves_a_row_for_each_task(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("m", F.create_map(F.lit("a"), F.col("label"))).withColumn("d", F.lit("2024-01-02").cast("date"))
    assert table_digest(df).first() == table_digest(df.repartition(5)).first()
    plan = table_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "hashpartitioning" not in plan


def test_correlations_of_a_hundred_measures_read_the_table_once(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    measures = {f"m{i}": F.col("l_quantity") * i + F.col("l_extendedprice") * (i % 7) - F.col("l_tax") * (i * i % 11) for i in range(100)}
    found = correlations(df, measures, top=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan parquet", plan)) == 1


def test_correlations_of_columns_with_nulls_everywhere(spark):
    rnd = random.Random(8)
    rows = [tuple(None if rnd.random() < 0.3 else rnd.gauss(0, 1) + (i % 10) * k for k in range(5)) + (2.0, None) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, constante double, nada double")
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in pair_moments(df, [F.col(c) for c in df.columns]).collect()}
    for i in range(7):
        for j in range(i + 1, 7):
            pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            if not pairs:
                assert (i, j) not in got
                continue
            n, r = got.pop((i, j))
            mx, my = (sum(p[k] for p in pairs) / len(pairs) for k in (0, 1))
            sx, sy = (math.sqrt(sum((p[k] - m) ** 2 for p in pairs)) for k, m in ((0, mx), (1, my)))
            assert n == len(pairs)
            if sx * sy == 0:
                assert r is None
            else:
                assert r == pytest.approx(sum((x - mx) * (y - my) for x, y in pairs) / (sx * sy))
    assert not got
