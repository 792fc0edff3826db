"""Checks, cleaning and reshaping of bar tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .base import IndicatorError

PRICES = ("open", "high", "low", "close")
COUNTRY_HOURS = 6.25  # trading hours a day that bars_per_day counts with


def by_time() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def validate_required_columns(df: DataFrame, needed: list[str]) -> None:
    if missing := [c for c in needed if c not in df.columns]:
        raise IndicatorError(f"missing columns: {', '.join(missing)}")


def validation_report(df: DataFrame) -> DataFrame:
    """(symbol, rows, and how many rows break each rule), in one pass; nothing is raised or hidden."""
    validate_required_columns(df, ["symbol", "ts", *PRICES, "volume"])
    before = df.withColumn("before_", F.lag("ts").over(by_time()))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    missing = F.greatest(*(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0) for c in (*PRICES, "volume")))
    return before.groupBy("symbol").agg(
        F.count("*").alias("rows"), n(missing == 1).alias("missing"), n(F.least(*PRICES) <= 0).alias("not_positive"), n(F.col("high") < F.col("low")).alias("high_below_low"),
        n(F.col("volume") < 0).alias("negative_volume"), n(F.col("before_") == F.col("ts")).alias("repeated_times"),
    )


# Each rule by itself: the ensure_* functions convert, the validate_* functions raise where a table breaks a rule, which takes
# an action for rules about rows. ``validation_report`` above counts instead.


def ensure_dataframe(data, spark=None) -> DataFrame:
    """A Spark table of a Spark or pandas table or of rows."""
    if isinstance(data, DataFrame):
        return data
    if spark is None:
        raise IndicatorError("a session is needed to make a table")
    return spark.createDataFrame(data)


def ensure_series(df: DataFrame, name: str | None = None) -> DataFrame:
    """The one column of a table, or the named one."""
    if name is not None:
        validate_required_columns(df, [name])
        return df.select(name)
    if len(df.columns) != 1:
        raise IndicatorError(f"one column is needed, not {len(df.columns)}")
    return df


def ensure_numpy(df: DataFrame, name: str) -> np.ndarray:
    """A column on the driver, for small tables."""
    return ensure_series(df, name).toPandas()[name].to_numpy(np.float64)


def ensure_float(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def ensure_integer(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


def ensure_datetime(df: DataFrame, name: str = "ts", tz: str | None = None) -> DataFrame:
    """``name`` as a timestamp (naive values are those of the session's zone), moved to ``tz``'s clock if it is given."""
    at = F.col(name).cast("timestamp")
    return df.withColumn(name, at if tz is None else F.from_utc_timestamp(at, tz))


def ensure_copy(df: DataFrame) -> DataFrame:
    """The table itself: nothing can change it."""
    return df


safe_copy = ensure_copy


def _refuse(df: DataFrame, bad, what: str) -> DataFrame:
    if not df.where(bad).isEmpty():
        raise IndicatorError(what)
    return df


def validate_numeric_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    wrong = [c for c in names or [c for c in kinds if c not in ("symbol", "ts")] if not kinds[c].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]
    if wrong:
        raise IndicatorError(f"not numeric: {', '.join(wrong)}")
    return df


def validate_index(df: DataFrame) -> DataFrame:
    """Every bar has a symbol and a time."""
    return _refuse(df, F.col("symbol").isNull() | F.col("ts").isNull(), "bars without symbol or time")


def validate_datetime_index(df: DataFrame) -> DataFrame:
    if dict(df.dtypes).get("ts") not in ("timestamp", "timestamp_ntz", "date"):
        raise IndicatorError("ts is no time")
    return df


def validate_monotonic_index(df: DataFrame, arrival: str) -> DataFrame:
    """Times don't fall in the order of the column ``arrival``."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy(arrival))
    return _refuse(df.withColumn("before_", before), F.col("before_") > F.col("ts"), "times fall").drop("before_")


def validate_length(df: DataFrame, least: int = 1) -> DataFrame:
    """Every symbol has at least ``least`` bars."""
    few = df.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") < least)
    if (least > 0 and df.isEmpty()) or not few.isEmpty():
        raise IndicatorError(f"under {least} bars")
    return df


def validate_no_duplicates(df: DataFrame) -> DataFrame:
    _refuse(df.groupBy("symbol", "ts").agg(F.count("*").alias("n")), F.col("n") > 1, "repeated times")
    return df


def _missing(df: DataFrame):
    kinds = dict(df.dtypes)
    out = F.lit(False)
    for c in df.columns:
        out = out | F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    return out


def validate_missing_data(df: DataFrame) -> DataFrame:
    return _refuse(df, _missing(df), "missing values")


def validate_price(df: DataFrame, names: tuple[str, ...] = PRICES) -> DataFrame:
    validate_numeric_columns(df, list(names))
    return _refuse(df, F.least(*(F.col(c) for c in names)) <= 0 if len(names) > 1 else F.col(names[0]) <= 0, "prices of zero or less")


def validate_high_low(df: DataFrame) -> DataFrame:
    return _refuse(df, F.col("high") < F.col("low"), "a high under its low")


def validate_volume(df: DataFrame) -> DataFrame:
    return _refuse(df, F.col("volume") < 0, "negative volumes")


def validate_ohlc(df: DataFrame) -> DataFrame:
    validate_required_columns(df, list(PRICES))
    return validate_high_low(validate_price(df))


def validate_ohlcv(df: DataFrame) -> DataFrame:
    validate_required_columns(df, [*PRICES, "volume"])
    return validate_volume(validate_ohlc(df))


def validate_dataframe(df: DataFrame) -> DataFrame:
    return validate_length(validate_datetime_index(df), 1)


def checks(df: DataFrame) -> DataFrame:
    """(symbol, one flag for each rule that the symbol's bars keep), in one pass over the bars."""
    before = F.lag("ts").over(by_time())
    kept = lambda bad: F.max(F.when(bad, 1).otherwise(0)) == 0
    return df.withColumn("before_", before).groupBy("symbol").agg(
        kept(F.col("ts").isNull()).alias("validate_index"), (F.count("*") >= 14).alias("validate_length"), kept(F.col("before_") == F.col("ts")).alias("validate_no_duplicates"), kept(F.col("before_") > F.col("ts")).alias("validate_monotonic_index"),
        kept(_missing(df)).alias("validate_missing_data"), kept(F.least(*PRICES) <= 0).alias("validate_price"), kept(F.col("high") < F.col("low")).alias("validate_high_low"), kept(F.col("volume") < 0).alias("validate_volume"),
        kept((F.least(*PRICES) <= 0) | (F.col("high") < F.col("low"))).alias("validate_ohlc"), kept((F.least(*PRICES) <= 0) | (F.col("high") < F.col("low")) | (F.col("volume") < 0)).alias("validate_ohlcv"),
    )


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(~_missing(df))


def sort_dataframe(df: DataFrame) -> DataFrame:
    return df.orderBy("symbol", "ts")


def safe_concat(tables: list[DataFrame], axis: int = 0) -> DataFrame:
    """Tables under each other (missing columns are null) or beside each other at the same symbol and time; tables without
    columns are left out."""
    there = [t for t in tables if t.columns]
    if not there:
        raise IndicatorError("nothing to put together")
    out = there[0]
    for t in there[1:]:
        out = out.unionByName(t, allowMissingColumns=True) if axis == 0 else merge(out, t, "outer")
    return out


def remove_duplicates(df: DataFrame, tie: str | None = None) -> DataFrame:
    """One bar for each symbol and time: the last by ``tie``, else by all values."""
    order = [F.col(tie).desc()] if tie else [F.col(c).desc() for c in df.columns if c not in ("symbol", "ts")]
    w = Window.partitionBy("symbol", "ts").orderBy(*order)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def replace_invalid_values(df: DataFrame, fill: float | None = None) -> DataFrame:
    """NaN and infinities become ``fill`` (NULL)."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(bad(F.col(c)) | F.col(c).isNull() if fill is not None else bad(F.col(c)), F.lit(fill)).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def remove_invalid_rows(df: DataFrame) -> DataFrame:
    return replace_invalid_values(df).na.drop()


def remove_zero_volume(df: DataFrame) -> DataFrame:
    return df.where("volume > 0")


def remove_negative_prices(df: DataFrame) -> DataFrame:
    return df.where(F.least(*PRICES) > 0)


def clip_prices(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)) for c in PRICES})


def remove_outliers(df: DataFrame, z: float = 3.0) -> DataFrame:
    """Rows in which no number lies ``z`` population deviations or more from its symbol's mean."""
    whole = Window.partitionBy("symbol")
    ok = F.lit(True)
    for c in (*PRICES, "volume"):
        ok = ok & (F.abs(F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(whole), F.stddev_pop(c).over(whole)), F.lit(0.0))) < z)
    return df.withColumn("ok_", ok).where("ok_").drop("ok_")


def clean_ohlcv(df: DataFrame) -> DataFrame:
    df = remove_invalid_rows(remove_duplicates(standardize_column_names(df)))
    validate_required_columns(df, ["symbol", "ts", *PRICES, "volume"])
    return remove_zero_volume(remove_negative_prices(df)).where("high >= low")


def fill_missing(df: DataFrame, method: str = "ffill") -> DataFrame:
    """ffill, bfill or interpolate (by rows, between known values; the last one is carried on)."""
    past, ahead = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(0, Window.unboundedFollowing)
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in ("symbol", "ts")]
    if method == "ffill":
        return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in numeric})
    if method == "bfill":
        return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in numeric})
    if method != "interpolate":
        raise IndicatorError(f"unknown method {method!r}")
    df = df.withColumn("n_", F.row_number().over(by_time()))
    out = {}
    for c in numeric:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("n_").alias("n"), F.col(c).cast("double").alias("v")))
        a, b = F.last(at, ignorenulls=True).over(past), F.first(at, ignorenulls=True).over(ahead)
        share = F.try_divide(F.col("n_") - a["n"], b["n"] - a["n"])
        out[c] = F.coalesce(F.col(c).cast("double"), a["v"] + (b["v"] - a["v"]) * share, a["v"])
    return df.withColumns(out).drop("n_")


def convert_timezone(df: DataFrame, tz: str = "Asia/Kolkata") -> DataFrame:
    return df.withColumn("ts", F.from_utc_timestamp("ts", tz))


def detect_timeframe(df: DataFrame) -> DataFrame:
    """(symbol, seconds): the median distance of neighbouring bars."""
    step = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by_time())
    return df.withColumn("step_", step).groupBy("symbol").agg((F.median("step_") / 1e6).alias("seconds"))


def timeframe_name(seconds: float) -> str:
    for size, unit in ((86400, "D"), (3600, "h"), (60, "min")):
        if seconds >= size and seconds % size == 0:
            return f"{int(seconds // size)}{unit}"
    return f"{int(seconds)}s"


def infer_timezone(spark: SparkSession) -> str:
    """The zone whose clock times are shown in."""
    return spark.conf.get("spark.sql.session.timeZone")


def validate_timezone(df: DataFrame, name: str = "ts") -> bool:
    """Whether the column knows its instants, not only a clock's times."""
    return dict(df.dtypes).get(name) == "timestamp"


DAY = 86400


def is_intraday(seconds: float) -> bool:
    return seconds < DAY


def is_daily(seconds: float) -> bool:
    return seconds == DAY


def is_weekly(seconds: float) -> bool:
    return seconds == 7 * DAY


def is_monthly(seconds: float) -> bool:
    return 28 * DAY <= seconds <= 31 * DAY


def timeframes(df: DataFrame) -> DataFrame:
    """(symbol, seconds, is_intraday ... annualization_factor): what the distance of a symbol's bars says."""
    got, x = detect_timeframe(df), F.col("seconds")
    day = F.when(x >= DAY, F.lit(1.0)).otherwise(COUNTRY_HOURS * 3600 / x)
    name = F.when((x >= DAY) & (x % DAY == 0), F.concat((x / DAY).cast("int").cast("string"), F.lit("D"))).when((x >= 3600) & (x % 3600 == 0), F.concat((x / 3600).cast("int").cast("string"), F.lit("h")))
    name = name.when((x >= 60) & (x % 60 == 0), F.concat((x / 60).cast("int").cast("string"), F.lit("min"))).otherwise(F.concat(x.cast("int").cast("string"), F.lit("s")))
    return got.select(
        "symbol", "seconds", name.alias("convert_timeframe"), (x < DAY).alias("is_intraday"), (x == DAY).alias("is_daily"), (x == 7 * DAY).alias("is_weekly"), x.between(28 * DAY, 31 * DAY).alias("is_monthly"),
        day.alias("bars_per_day"), (5 * day).alias("bars_per_week"), (21 * day).alias("bars_per_month"), (252.0 * day).alias("annualization_factor"),
    )


def bars_per_day(seconds: float) -> float:
    return 1.0 if seconds >= 86400 else COUNTRY_HOURS * 3600 / seconds


def bars_per_week(seconds: float) -> float:
    return 5 * bars_per_day(seconds)


def bars_per_month(seconds: float) -> float:
    return 21 * bars_per_day(seconds)


def annualization_factor(seconds: float, trading_days: float = 252.0) -> float:
    return trading_days * bars_per_day(seconds)


def slice_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Bars number start (from 0) up to end of each symbol."""
    return df.withColumn("n_", F.row_number().over(by_time()) - 1).where((F.col("n_") >= start) & (F.col("n_") < end)).drop("n_")


def optimize_float_dtype(df: DataFrame) -> DataFrame:
    """Doubles as floats: half the room, seven digits."""
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})


def optimize_integer_dtype(df: DataFrame) -> DataFrame:
    """Integer columns in the smallest type that holds their values."""
    names = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint")]
    if not names:
        return df
    found = df.agg(*(x for c in names for x in (F.min(c).alias(f"{c} low"), F.max(c).alias(f"{c} high")))).first()

    def kind(c: str) -> str:
        low, high = found[f"{c} low"] or 0, found[f"{c} high"] or 0
        return next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= low and high < 1 << bits)

    return df.withColumns({c: F.col(c).cast(kind(c)) for c in names})


def convert_object_to_category(df: DataFrame) -> DataFrame:
    """The table itself: Parquet keeps repeated strings as a dictionary of its own accord."""
    return df


def reduce_dataframe_memory(df: DataFrame) -> DataFrame:
    return convert_object_to_category(optimize_integer_dtype(optimize_float_dtype(df)))


def select_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(c for c in names if c in df.columns))


def merge(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Bars of two tables at the same symbol and time, each cleared of repeats first; clashing names get _right."""
    b = remove_duplicates(b)
    b = b.select("symbol", "ts", *(F.col(c).alias(f"{c}_right" if c in a.columns else c) for c in b.columns if c not in ("symbol", "ts")))
    return remove_duplicates(a).join(b, ["symbol", "ts"], how)


def common_times(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("symbol", "ts").distinct()
    for t in tables[1:]:
        out = out.join(t.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi")
    return out


def all_times(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("symbol", "ts")
    for t in tables[1:]:
        out = out.union(t.select("symbol", "ts"))
    return out.distinct()


def rolling_apply(df: DataFrame, column: str, n: int, f, name: str) -> DataFrame:
    """``f`` (numbers of a full window -> number) over the last n values, by Arrow batches of window arrays."""
    @F.pandas_udf("double")
    def run(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: None if w is None or len(w) < n else float(f(w)))

    return df.withColumn("w_", F.collect_list(column).over(by_time().rowsBetween(-(n - 1), 0))).withColumn(name, run("w_")).drop("w_")
