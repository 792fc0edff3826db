"""Sources, cleaning, joins, scalars, analyzers, streams, and the entry without the training-data folders."""

import datetime as dt
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import Row, functions as F

from tapeloom.functions import scalars, series
from tapeloom.operators import cleaning
from tapeloom.operators.base import IndicatorError
from tapeloom.plans import analyzers, features, observer
from tapeloom.sources import bars as source
from tapeloom.streaming import bars as stream
from tests.test_indicators import KIND, T0, make, walk


def test_asof_takes_the_last_known_row(spark):
    t = lambda m: T0 + dt.timedelta(minutes=m)
    left = spark.createDataFrame([("A", t(0), 1), ("A", t(10), 2), ("A", t(10), 3), ("B", t(10), 4), (None, t(1), 5)], "symbol string, ts timestamp, x int")
    right = spark.createDataFrame([("A", t(5), 50.0), ("A", t(10), 100.0), ("B", t(11), 7.0)], "symbol string, ts timestamp, y double")
    got = {r.x: r.y_d for r in source.asof(left, right, ["y"], suffix="_d").collect()}
    assert got == {1: None, 2: 100.0, 3: 100.0, 4: None, 5: None}


def test_reading_and_fetching(spark, tmp_path):
    rows = spark.createDataFrame(make(walk(30)) + make(walk(5), "B"), KIND)
    rows.write.parquet(f"{tmp_path}/p")
    rows.write.option("header", "true").csv(f"{tmp_path}/c")
    for kind, path in (("parquet", "p"), ("csv", "c")):
        got = source.read_bars(spark, f"{tmp_path}/{path}", kind)
        assert got.count() == 35 and got.schema == source.SCHEMA
        assert [r.ts for r in source.fetch(got, "A", 3).collect()] == [T0 + dt.timedelta(hours=i) for i in range(3)]
        assert source.fetch(got, "A", 2, newest=True).collect()[-1].ts == T0 + dt.timedelta(hours=29)
    source.write_report(rows.limit(2), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2


def test_cleaning(spark):
    rows = [("A", T0, 1.0, 2.0, 0.5, 1.5, 10.0), ("A", T0, 1.0, 2.0, 0.5, 1.7, 11.0), ("A", T0 + dt.timedelta(hours=1), float("nan"), 2.0, 1.0, 1.0, 5.0), ("A", T0 + dt.timedelta(hours=2), 1.0, 2.0, -1.0, 1.0, 5.0), ("A", T0 + dt.timedelta(hours=3), 1.0, 2.0, 1.0, 1.0, 0.0), ("B", T0, 1.0, 2.0, 1.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, KIND).toDF("Symbol", " ts", "OPEN", "high", "low", "close", "volume")
    got = cleaning.clean_ohlcv(df).collect()
    assert sorted((r.symbol, r.close) for r in got) == [("A", 1.7), ("B", 1.0)]
    report = {r.symbol: r for r in cleaning.validation_report(cleaning.standardize_column_names(df)).collect()}
    assert (report["A"].missing, report["A"].not_positive, report["A"].repeated_times) == (1, 1, 1)
    with pytest.raises(IndicatorError):
        cleaning.clean_ohlcv(df.drop("volume"))


def test_filling_and_timeframes(spark):
    closes = [1.0, None, None, 4.0, None]
    rows = [("A", T0 + dt.timedelta(hours=i), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, KIND)
    for method, want in (("ffill", [1, 1, 1, 4, 4]), ("bfill", [1, 4, 4, 4, None]), ("interpolate", [1, 2, 3, 4, 4])):
        assert [r.close for r in cleaning.fill_missing(df, method).orderBy("ts").collect()] == want
    assert cleaning.detect_timeframe(df).first().seconds == 3600 and cleaning.timeframe_name(3600) == "1h" and cleaning.timeframe_name(90) == "90s"
    assert cleaning.annualization_factor(86400) == 252 and cleaning.bars_per_day(3600) == 6.25
    assert [r.close for r in cleaning.slice_rows(df, 3, 9).orderBy("ts").collect()] == [4.0, None]
    assert cleaning.merge(df, df.limit(2)).count() == 2 and cleaning.common_times(df, df.limit(3)).count() == 3 and cleaning.all_times(df, df).count() == 5
    assert cleaning.rolling_apply(df, "volume", 2, sum, "s").where("s = 2").count() == 4


def test_rules_refuse_what_breaks_them(spark):
    good = spark.createDataFrame(make(walk(20)), KIND)
    rules = [cleaning.validate_numeric_columns, cleaning.validate_index, cleaning.validate_datetime_index, cleaning.validate_no_duplicates, cleaning.validate_missing_data, cleaning.validate_price, cleaning.validate_high_low, cleaning.validate_volume, cleaning.validate_ohlc, cleaning.validate_ohlcv, cleaning.validate_dataframe]
    for f in rules:
        assert f(good).count() == 20, f.__name__
    assert cleaning.validate_length(good, 20) is good and cleaning.validate_monotonic_index(good.withColumn("n", F.col("ts")), "n").count() == 20
    bad = [
        (cleaning.validate_numeric_columns, good.withColumn("close", F.lit("x"))), (cleaning.validate_index, good.withColumn("ts", F.lit(None).cast("timestamp"))), (cleaning.validate_datetime_index, good.withColumn("ts", F.lit(1))),
        (cleaning.validate_no_duplicates, good.union(good.limit(1))), (cleaning.validate_missing_data, good.withColumn("close", F.lit(float("nan")))), (cleaning.validate_price, good.withColumn("low", F.lit(-1.0))), (cleaning.validate_high_low, good.withColumn("high", F.lit(0.5))),
        (cleaning.validate_volume, good.withColumn("volume", F.lit(-1.0))), (cleaning.validate_ohlc, good.drop("open")), (cleaning.validate_ohlcv, good.withColumn("volume", F.lit(-1.0))), (cleaning.validate_dataframe, good.limit(0)),
    ]
    for f, table in bad:
        with pytest.raises(IndicatorError):
            f(table)
    with pytest.raises(IndicatorError):
        cleaning.validate_length(good, 21)
    with pytest.raises(IndicatorError):
        cleaning.validate_monotonic_index(good.withColumn("n", -F.unix_timestamp("ts")), "n")


def test_tables_are_converted(spark):
    df = spark.createDataFrame(make(walk(5)), KIND)
    assert cleaning.ensure_dataframe(df) is df and cleaning.ensure_copy(df) is df and cleaning.ensure_dataframe(df.toPandas(), spark).count() == 5
    with pytest.raises(IndicatorError):
        cleaning.ensure_series(df)
    assert cleaning.ensure_series(df, "close").columns == ["close"] and cleaning.ensure_numpy(df, "close").shape == (5,)
    kinds = dict(cleaning.ensure_integer(cleaning.ensure_float(df, ["open"]), ["volume"]).dtypes)
    assert kinds["open"] == "double" and kinds["volume"] == "bigint"
    text = df.withColumn("ts", F.col("ts").cast("string"))
    assert cleaning.ensure_datetime(text).schema["ts"].dataType.typeName() == "timestamp" and cleaning.ensure_datetime(text, tz="Asia/Kolkata").first().ts == T0 + dt.timedelta(hours=5, minutes=30)
    assert cleaning.infer_timezone(spark) == "UTC" and cleaning.validate_timezone(df) and not cleaning.validate_timezone(text)
    small = dict(cleaning.reduce_dataframe_memory(df.withColumn("n", F.lit(300).cast("bigint"))).dtypes)
    assert small["close"] == "float" and small["n"] == "smallint"
    assert cleaning.is_intraday(60) and cleaning.is_daily(86400) and cleaning.is_weekly(604800) and cleaning.is_monthly(30 * 86400)
    assert series.expanding_apply(df, "close", max, "top").where("top >= close").count() == 5


def test_observer_measures_and_tells_quality(spark):
    from tapeloom.plans import helpers

    table = features.features(spark.createDataFrame(make(walk(60)), KIND)).cache()
    got = observer.measured(table, ["candle", "trend"])
    assert [(r["analyzer"], r["rows"]) for r in got] == [("trend", 60), ("candle", 60)] and all(r["seconds"] > 0 for r in got)
    quality = {r.feature: r for r in helpers.feature_quality(table, ["ema_200", "close"]).collect()}
    assert (quality["ema_200"].missing, quality["close"].missing, quality["close"].n) == (60, 0, 60)
    table.unpersist()


def test_streamed_sessions_and_sliding_bars(spark, tmp_path):
    ticks = [("A", T0 + dt.timedelta(minutes=m), i, float(i)) for i, m in enumerate((0, 5, 10, 120, 121, 400))]
    kind = "symbol string, ts timestamp, seq long, value double"
    spark.createDataFrame(ticks, kind).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    for name, df in (("sessions_out", stream.stream_sessions(read)), ("slides_out", stream.stream_bars(read, "1 hour", "30 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert [(r.start, r.ticks, r.total) for r in spark.table("sessions_out").orderBy("start").collect()] == [(T0, 3, 3.0), (T0 + dt.timedelta(minutes=120), 2, 7.0)]
    slides = {r.ts: r for r in spark.table("slides_out").collect()}
    assert slides[T0].volume == 3 and slides[T0 - dt.timedelta(minutes=30)].volume == 3 and slides[T0 + dt.timedelta(minutes=90)].close == 4.0


def test_guarded_numbers(spark):
    df = spark.createDataFrame([Row(a=6.0, b=3.0), Row(a=1.0, b=0.0), Row(a=float("nan"), b=1.0), Row(a=None, b=1.0), Row(a=float("inf"), b=-1.0)])
    assert [r.x for r in df.select(scalars.safe_divide("a", "b", -1).alias("x")).collect()] == [2, -1, -1, -1, -1]
    assert [r.x for r in df.select(scalars.safe_sqrt("b", 9).alias("x")).collect()][3:] == [1, 9]
    one = df.limit(1)
    s = one.select(scalars.sigmoid(F.lit(-800.0)).alias("s"), scalars.safe_log(F.lit(-1.0)).alias("l"), scalars.safe_exp(F.lit(1000.0)).alias("e"), scalars.clip("a", 0, 5).alias("c"), scalars.is_close("a", F.lit(6.0000001)).alias("i")).first()
    assert (s.s, s.l, s.e, s.c, s.i) == (0.0, 0.0, scalars.MAX_FLOAT, 5.0, True)
    v = one.select(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("x"), F.array(F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("y"))
    assert v.select(scalars.cross_product("x", "y").alias("c")).first().c == [0, 0, 2] and v.select(scalars.cosine_similarity("x", "y").alias("c")).first().c == 0
    assert abs(df.where("a = 6 or b = 0").select(F.lit(1).alias("k"), "a").transform(lambda d: scalars.log_sum_exp(d, "a", ["k"])).first().log_sum_exp - 6.006715) < 1e-5


def test_analyzers_give_one_record_a_symbol(spark):
    table = features.features(spark.createDataFrame(make(walk(120)) + make(walk(15), "S"), KIND)).cache()
    for name in analyzers.ANALYZERS:
        got = analyzers.analyze(table, name).collect()
        assert sorted(r.symbol for r in got) == ["A", "S"], name
    with_text = {r.symbol: r for r in analyzers.analyze(table, "volume").collect()}["A"]
    assert with_text.evidence_confirmation and 0 <= with_text.institutional_probability <= 100
    trend = {r.symbol: r for r in analyzers.analyze(table, "trend").collect()}["A"]
    assert -100 <= trend.direction_score <= 100 and trend.evidence_direction and {e.polarity for e in trend.evidence_direction} <= {-1, 0, 1}
    found = observer.report(table.drop("rsi", "macd_histogram", "macd_line", "roc", "momentum", "adx"))
    assert {r.analyzer: r.passed for r in observer.summary(found).collect()}["momentum"] == 0
    table.unpersist()


def test_contracts_name_what_analyzers_read(spark):
    from tapeloom.plans import contracts

    rows = contracts.table(spark).collect()
    assert len(rows) == 8 and all(len(r.features) and len(r.outputs) and len(r.sha256) == 64 for r in rows)

    found = contracts.contracts()
    assert set(found) == set(analyzers.ANALYZERS) and {"ema_20", "vwap", "bos"} <= set(found["trend"].features) and "direction_score" in found["trend"].outputs
    assert contracts.problems(found, []).keys() >= {"trend"} and contracts.scan("import os\nx = df['a'] + df.get('b')\nf(x)") == {"columns": ["a", "b"], "calls": ["f", "get"], "modules": ["os"]}


def test_streamed_bars_and_state(spark, tmp_path):
    ticks = [("A", T0 + dt.timedelta(minutes=i), i, float(i)) for i in range(180)]
    kind = "symbol string, ts timestamp, seq long, value double"
    spark.createDataFrame(ticks, kind).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    q = stream.stream_bars(read).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.ts: r for r in spark.table("bars_out").collect()}
    assert (got[T0].open, got[T0].high, got[T0].close, got[T0].volume) == (0.0, 59.0, 59.0, 60.0)
    spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), float(i)) for i in range(6)], "symbol string, ts timestamp, close double").write.parquet(f"{tmp_path}/b")
    bars = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(f"{tmp_path}/b")
    q = stream.stream_ema(bars, 3).writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(90)
    y, want = None, []
    for x in range(6):
        y = float(x) if y is None else y + 0.5 * (x - y)
        want.append(y)
    assert [r.ema for r in spark.table("ema_out").orderBy("ts").collect()] == want


def test_entry_without_the_training_folders(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "tapeloom"):
        src = f"{repo}/{name}"
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, f"{tmp_path}/{name}")
    shutil.rmtree(f"{tmp_path}/tapeloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op1') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
