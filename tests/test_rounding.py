"""Rounding goes as in the SQL, to the last digit and to the sign of 0."""

import math

import duckdb
from harness import database
from pyspark.sql import functions as F

from voxtable.functions.numbers import r6
from voxtable.plans import catalog

DATA = "/root/testdata/sf0.001"
NUMBERS = [64.3109375, -64.3109375, 129.9578125, 0.0000005, -0.0000004, 0.0, -0.0, 2.5, 1e-320, 1e15 + 0.3, 1e303, -1e303, math.inf, -math.inf, None]


def test_rounds_as_duckdb(spark):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(NUMBERS)], "n int, x double").select("n", r6(F.col("x")).alias("y")).collect()
    db = duckdb.connect()
    assert [repr(y) for _, y in sorted(rows)] == [repr(db.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchall()[0][0]) for x in NUMBERS]
    assert math.isnan(spark.range(1).select(r6(F.lit(math.nan)).alias("y")).collect()[0].y)


def test_unit_vectors_keep_the_sign_of_zero(spark):
    name = "F1_l2norm"
    got = [repr((r.vec_id, list(r.u))) for r in catalog.queries()[name](spark, DATA).collect()]
    wanted = [repr((i, list(u))) for i, u in database(DATA).execute(catalog.oracle_sql()[name]).fetchall()]
    assert sorted(got) == sorted(wanted)
