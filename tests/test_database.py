"""Tables in database files: what comes back, and which conditions reach the database."""

import contextlib
import datetime as dt
import io
import sqlite3

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, Not, StringContains

from tapeloom.sources import database

T0 = dt.datetime(2024, 3, 1)
KIND = "symbol string, ts timestamp_ntz, close double, n int, day date, ok boolean, at timestamp"


def _rows():
    day = T0.date()
    made = [(s, T0 + dt.timedelta(hours=i), i / 2, i, day + dt.timedelta(days=i), i % 2 == 0, T0) for s in ("A", "B", "it's \"C\"") for i in range(20)]
    return [*made, made[0], (None, None, None, None, None, None, None)]


def test_rows_come_back_and_conditions_reach_the_database(spark, tmp_path):
    df = spark.createDataFrame(_rows(), KIND).repartition(3, "symbol")
    assert database.write_table(df, f"{tmp_path}/t", ["symbol", "ts"]) == 62
    got = database.read_table(spark, f"{tmp_path}/t", df.schema, rows=7)
    assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
    assert got.rdd.getNumPartitions() >= 62 // 7
    for test, pushed in (("symbol = 'A'", True), ("symbol = 'it''s \"C\"'", True), ("ts >= TIMESTAMP_NTZ '2024-03-01 05:00:00'", True), ("n IN (3, 4, 90)", True), ("close > 4.5", True),
                         ("symbol IS NULL", True), ("day < DATE '2024-03-09'", True), ("symbol LIKE '%t%'", False), ("n + 1 = 4", False)):
        some = got.where(test)
        assert sorted(map(str, some.collect())) == sorted(map(str, df.where(test).collect())) and some.count() > 0
        assert (" Filter " in some._jdf.queryExecution().executedPlan().toString()) != pushed, test
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        got.where("symbol = 'A'").explain("formatted")
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in shown.getvalue(), shown.getvalue()


def test_conditions():
    kinds = {"s": "string", "n": "int", "x": "double", "t": "timestamp", "u": "timestamp_ntz"}
    tell = lambda f: database.condition(f, kinds)
    assert tell(EqualTo(("s",), "a")) == ('"s" = ?', ["a"]) and tell(In(("n",), (1, 2))) == ('"n" IN (?, ?)', [1, 2])
    assert tell(IsNull(("x",))) == ('"x" IS NULL', []) and tell(LessThanOrEqual(("u",), dt.datetime(1970, 1, 1, 0, 0, 1))) == ('"u" <= ?', [10**6])
    for f in (GreaterThan(("t",), T0), EqualTo(("x",), float("nan")), EqualTo(("other",), 1), EqualTo(("a", "b"), 1), Not(EqualTo(("s",), "a")), StringContains(("s",), "a"), In(("n",), tuple(range(501)))):
        assert tell(f) is None


def test_a_task_that_runs_twice_leaves_one_file_and_empty_tables_are_empty(spark, tmp_path):
    df = spark.createDataFrame(_rows(), KIND).coalesce(1)
    for _ in range(2):
        database.write_table(df, f"{tmp_path}/t", ["symbol"])
    files = list((tmp_path / "t").iterdir())
    assert len(files) == 1 and sqlite3.connect(files[0]).execute("SELECT count(*) FROM rows").fetchone() == (62,)
    assert database.write_table(df.limit(0), f"{tmp_path}/none", ["symbol"]) == 0
    assert database.read_table(spark, f"{tmp_path}/none", df.schema).count() == 0
    with pytest.raises(ValueError):
        database.write_table(df.selectExpr("array(1) AS a"), f"{tmp_path}/bad", ["a"])
    with pytest.raises(ValueError):
        database.local("s3a://bucket/t")
