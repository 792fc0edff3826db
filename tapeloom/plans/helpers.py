"""Registered queries of the small functions, each beside SQL written by hand: (name -> column, the same in DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.functions import scalars, series
from tapeloom.functions.sheet import SHIFT
from tapeloom.operators import base, cleaning
from tapeloom.sources import bars as source

DIGITS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BARS = source.SQL["hour"]
W = "OVER (PARTITION BY symbol ORDER BY ts)"
ALL = "OVER (PARTITION BY symbol)"


def shown(c: Column) -> Column:
    return F.round(c.cast("double") + F.lit(SHIFT), DIGITS) + F.lit(0.0)


def shown_sql(e: str) -> str:
    return f"round(({e})::DOUBLE + {SHIFT!r}, {DIGITS}) + 0.0"


def per_bar(name: str, forms: dict[str, tuple[Column | Callable, str]], table: str = BARS) -> None:
    """A query with a column for each form beside symbol and ts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source.event_bars(spark, sf_dir).select("symbol", "ts", *(shown(c() if callable(c) and not isinstance(c, Column) else c).alias(k) for k, (c, _) in forms.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT symbol, ts, {', '.join(f'{shown_sql(e)} AS {k}' for k, (_, e) in forms.items())} FROM ({table})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {W}"


per_bar("helper_shifts", {
    "rolling_shift": (lambda: series.rolling_shift("close", 2), lag("close", 2)), "safe_shift": (lambda: series.safe_shift("close", 3, -1.0), f"coalesce({lag('close', 3)}, -1)"),
    "rolling_difference": (lambda: series.rolling_difference("close", 3), f"close - {lag('close', 3)}"), "rolling_ratio": (lambda: series.rolling_ratio("close"), f"close / {lag('close')}"),
    "rolling_return": (lambda: series.rolling_return("close", 5), f"close / {lag('close', 5)} - 1"), "price_change": (lambda: series.price_change("close"), f"close - {lag('close')}"), "percent_change": (lambda: series.percent_change("close"), f"100 * (close / {lag('close')} - 1)"),
    "simple_return": (lambda: series.simple_return("close"), f"close / {lag('close')} - 1"), "log_return": (lambda: series.log_return("close"), f"ln(close / {lag('close')})"),
    **{f"true_range_{i}": ((lambda i=i: series.true_range_inputs()[i]), e) for i, e in enumerate(("high - low", f"abs(high - {lag('close')})", f"abs(low - {lag('close')})"))},
    "price_range": (lambda: series.price_range(), "high - low"), "body_size": (lambda: series.body_size(), "abs(close - open)"), "upper_shadow": (lambda: series.upper_shadow(), "high - greatest(open, close)"), "lower_shadow": (lambda: series.lower_shadow(), "least(open, close) - low"),
    "candle_direction": (lambda: scalars.candle_direction(), "sign(close - open)"), "hl2": (lambda: scalars.hl2(), "(high + low) / 2"), "hlc3": (lambda: scalars.hlc3(), "(high + low + close) / 3"), "ohlc4": (lambda: scalars.ohlc4(), "(open + high + low + close) / 4"),
    "typical_price": (lambda: scalars.typical_price(), "(high + low + close) / 3"), "median_price": (lambda: scalars.median_price(), "(high + low) / 2"), "weighted_price": (lambda: scalars.weighted_price(), "(high + low + 2 * close) / 4"),
})

N = 10
R = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
S = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(e: str, least: int = N) -> str:
    return f"CASE WHEN count(close) {R} >= {least} THEN {e} END"


def agg(f: str) -> str:
    return full(f"{f} {R}")


per_bar("helper_rolling", {
    **{f"rolling_{k}": ((lambda k=k: getattr(series, f"rolling_{k}")("close", N)), agg(e)) for k, e in {"mean": "avg(close)", "sum": "sum(close)", "std": "stddev_samp(close)", "var": "var_samp(close)", "min": "min(close)", "max": "max(close)", "median": "median(close)", "skew": "skewness(close)", "kurtosis": "kurtosis(close)"}.items()},
    "rolling_quantile": (lambda: series.rolling_quantile("close", N, 0.3), agg("quantile_cont(close, 0.3)")), "rolling_percentile": (lambda: series.rolling_percentile("close", N, 80), agg("quantile_cont(close, 0.8)")),
    "rolling_iqr": (lambda: series.rolling_iqr("close", N), full(f"quantile_cont(close, 0.75) {R} - quantile_cont(close, 0.25) {R}")),
    "rolling_mad": (lambda: series.rolling_mad("close", N), full(f"list_avg(list_transform(list(close) {R}, lambda v: abs(v - avg_)))")), "rolling_rank": (lambda: series.rolling_rank("close", N), full(f"len(list_filter(list(close) {R}, lambda v: v < close)) + (len(list_filter(list(close) {R}, lambda v: v = close)) + 1) / 2.0")),
    "rolling_zscore": (lambda: series.rolling_zscore("close", N), full(f"(close - avg(close) {R}) / nullif(stddev_samp(close) {R}, 0)")), "rolling_volatility": (lambda: series.rolling_volatility("close", N), full(f"stddev_samp(close) {R} * sqrt(252)")),
    "rolling_drawdown": (lambda: series.rolling_drawdown("close", N), f"close / max(close) {R} - 1"), "rolling_correlation": (lambda: series.rolling_correlation("close", "open", N), agg("corr(close, open)")), "rolling_covariance": (lambda: series.rolling_covariance("close", "volume", N), agg("covar_samp(close, volume)")),
    "rolling_min_periods": (lambda: series.rolling_min_periods(F.avg, "close", N, 3), full(f"avg(close) {R}", 3)), "rolling_window_view": (lambda: F.element_at(series.rolling_window_view("close", N), 1), full(lag("close", N - 1))),
    "expanding_mean": (lambda: series.expanding_mean("close"), f"avg(close) {S}"), "expanding_std": (lambda: series.expanding_std("close"), f"stddev_samp(close) {S}"),
    "cumulative_return": (lambda: series.cumulative_return(series.simple_return("close")), f"close / first_value(close) {S} - 1"),
}, f"SELECT *, avg(close) {R} AS avg_ FROM ({BARS})")


def whole_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = source.event_bars(spark, sf_dir)
    forms = {
        "zscore": series.zscore("close"), "standardize_zero_mean": series.standardize_zero_mean("close"), "normalize_minmax": series.normalize_minmax("close"), "winsorize": series.winsorize("close"), "remove_outliers": series.without_outliers("close", 1.5),
        "stable_softmax": 1000 * series.stable_softmax(F.col("close") / 100), "robust_zscore": F.col("robust"),
    }
    return series.robust_zscore(b, "close", "robust").select("symbol", "ts", *(shown(c).alias(k) for k, c in forms.items()))


QUERIES["helper_whole_series"] = whole_series
_Z = f"(close - avg(close) {ALL}) / stddev_pop(close) {ALL}"
ORACLE_SQL["helper_whole_series"] = (
    f"WITH b AS (SELECT *, abs(close - avg(close) {ALL}) AS d FROM ({BARS})), c AS (SELECT *, avg(d) {ALL} AS mad, median(close) {ALL} AS mid, quantile_cont(close, 0.05) {ALL} AS p, quantile_cont(close, 0.95) {ALL} AS q, {_Z} AS z FROM b) "
    f"SELECT symbol, ts, {shown_sql('z')} AS zscore, {shown_sql('z')} AS standardize_zero_mean, {shown_sql(f'(close - min(close) {ALL}) / (max(close) {ALL} - min(close) {ALL})')} AS normalize_minmax, {shown_sql('least(greatest(close, p), q)')} AS winsorize, "
    f"{shown_sql('CASE WHEN abs(z) <= 1.5 THEN close END')} AS remove_outliers, {shown_sql(f'1000 * exp(close / 100) / sum(exp(close / 100)) {ALL}')} AS stable_softmax, {shown_sql('(close - mid) / (1.4826 * mad)')} AS robust_zscore FROM c"
)


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded functions of a step that is negative, zero or missing on some bars, and of a volume that is one on some."""
    b = source.event_bars(spark, sf_dir).withColumn("x", series.rolling_difference("close") / 10).withColumn("v", F.col("volume") - 1)
    forms = {
        "safe_divide": scalars.safe_divide("x", "v", -9.0), "safe_ratio": scalars.safe_ratio("x", "v"), "safe_inverse": scalars.safe_inverse("v"), "safe_percentage_change": scalars.safe_percentage_change("x", "v"), "safe_log": scalars.safe_log("x"), "safe_ln": scalars.safe_ln("x", 7.0),
        "safe_log10": scalars.safe_log10("x"), "safe_exp": scalars.safe_exp(F.col("x") / 20, -1.0), "safe_power": scalars.safe_power("v", 1.5), "safe_sqrt": scalars.safe_sqrt("x", -2.0), "safe_clip": scalars.safe_clip("x", -3, 5), "fast_clip": scalars.fast_clip("x", -3, 5),
        "fast_relu": scalars.fast_relu(F.coalesce("x", F.lit(0.0))), "fast_log": scalars.fast_log("x"), "fast_square": scalars.fast_square("x"), "fast_cube": scalars.fast_cube("x"), "fast_abs": scalars.fast_abs("x"), "fast_sigmoid": scalars.fast_sigmoid("x"), "stable_sigmoid": scalars.stable_sigmoid("x"),
        "stable_tanh": scalars.stable_tanh("x"), "is_close": scalars.is_close("x", F.col("x") * 1.000001).cast("int"), "epsilon": F.lit(scalars.epsilon()) * 1e16,
    }
    return b.select("symbol", "ts", *(shown(c).alias(k) for k, c in forms.items()))


QUERIES["helper_guards"] = guards
_G = {
    "safe_divide": "coalesce(x / nullif(v, 0), -9)", "safe_ratio": "coalesce(x / nullif(v, 0), 0)", "safe_inverse": "coalesce(1 / nullif(v, 0), 0)", "safe_percentage_change": "coalesce((x - v) / nullif(v, 0), 0)", "safe_log": "CASE WHEN x > 0 THEN ln(x) ELSE 0 END", "safe_ln": "CASE WHEN x > 0 THEN ln(x) ELSE 7 END",
    "safe_log10": "CASE WHEN x > 0 THEN log10(x) ELSE 0 END", "safe_exp": "coalesce(exp(x / 20), -1)", "safe_power": "power(v, 1.5)", "safe_sqrt": "CASE WHEN x >= 0 THEN sqrt(x) ELSE -2 END", "safe_clip": "least(greatest(coalesce(x, 0), -3), 5)", "fast_clip": "CASE WHEN x IS NOT NULL THEN least(greatest(x, -3), 5) END",
    "fast_relu": "greatest(coalesce(x, 0), 0)", "fast_log": "CASE WHEN x > 0 THEN ln(x) END", "fast_square": "x * x", "fast_cube": "x * x * x", "fast_abs": "abs(x)", "fast_sigmoid": "1 / (1 + exp(-x))", "stable_sigmoid": "1 / (1 + exp(-x))",
    "stable_tanh": "CASE WHEN x IS NOT NULL THEN tanh(least(greatest(x, -20), 20)) END", "is_close": "CASE WHEN x IS NULL THEN 0 ELSE 1 END", "epsilon": "2.220446049250313",
}
ORACLE_SQL["helper_guards"] = f"SELECT symbol, ts, {', '.join(f'{shown_sql(e)} AS {k}' for k, e in _G.items())} FROM (SELECT *, (close - {lag('close')}) / 10 AS x, volume - 1 AS v FROM ({BARS}))"


def of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = source.event_bars(spark, sf_dir).withColumn("y", F.round(F.col("close") / 10, 0)).withColumn("r", 1 + F.col("close") / 10000)
    forms = {
        "safe_min": scalars.safe_agg("min", "close"), "safe_max": scalars.safe_agg("max", "close"), "safe_prod": scalars.safe_agg("product", "r"), "safe_mean": scalars.safe_agg("mean", "close"), "safe_std": scalars.safe_agg("std", "close"), "safe_sum": scalars.safe_agg("sum", "close"), "safe_median": scalars.safe_agg("median", "close"),
        "mode": scalars.mode("y"), "variance": scalars.variance("close"), "std": scalars.std("close"), "sharpe_like_score": scalars.sharpe_like_score("close", 1.0),
    }
    out = b.groupBy("symbol").agg(*(shown(c).alias(k) for k, c in forms.items()))
    for name, df in (("mad", series.mean_distance(b, "close")), ("entropy", series.entropy(b, "y")), ("log_sum_exp", scalars.log_sum_exp(b, "y", ["symbol"]))):
        out = out.join(df.select("symbol", shown(F.col(name)).alias(name)), "symbol")
    return out


QUERIES["helper_series"] = of_series
_B = f"SELECT *, round(close / 10, 0) AS y, 1 + close / 10000 AS r, abs(close - avg(close) {ALL}) AS d FROM ({BARS})"
_O = {
    "safe_min": "min(close)", "safe_max": "max(close)", "safe_prod": "product(r)", "safe_mean": "avg(close)", "safe_std": "stddev_pop(close)", "safe_sum": "sum(close)", "safe_median": "median(close)", "variance": "var_samp(close)", "std": "stddev_samp(close)",
    "sharpe_like_score": "(avg(close) - 1) / stddev_pop(close)", "mad": "avg(d)", "entropy": "entropy(y)", "log_sum_exp": "ln(sum(exp(y - 40))) + 40",
}
ORACLE_SQL["helper_series"] = (
    f"WITH b AS ({_B}), m AS (SELECT symbol, arg_min(y, (-n, y)) AS mode FROM (SELECT symbol, y, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1) "
    f"SELECT b.symbol, {', '.join(f'{shown_sql(e)} AS {k}' for k, e in _O.items())}, {shown_sql('any_value(m.mode)')} AS mode FROM b JOIN m ON m.symbol = b.symbol GROUP BY b.symbol"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first one; of vectors as results, the first component and the length."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = v.crossJoin(F.broadcast(v.agg(F.min_by("a", "vec_id").alias("b"))))  # the other side is one row
    cross = scalars.cross_product("a", "b")
    forms = {"vector_norm": scalars.vector_norm("a"), "normalize_vector": scalars.normalize_vector("a")[0], "normalized_length": scalars.l2_norm(scalars.normalize_vector("a")), "vector_angle_cosine": scalars.vector_angle_cosine("a", "b"), "projection": scalars.projection("a", "b")[0], **{f"cross_product_{i}": cross[i] for i in range(3)}}
    return both.select("vec_id", *(shown(c).alias(k) for k, c in forms.items()))


QUERIES["helper_vectors"] = vectors
_V = {
    "vector_norm": "sqrt(list_dot_product(a, a))", "normalize_vector": "a[1] / sqrt(list_dot_product(a, a))", "normalized_length": "1.0", "vector_angle_cosine": "acos(least(greatest(list_cosine_similarity(a, b), -1), 1))", "projection": "list_dot_product(a, b) / list_dot_product(b, b) * b[1]",
    "cross_product_0": "a[2] * b[3] - a[3] * b[2]", "cross_product_1": "a[3] * b[1] - a[1] * b[3]", "cross_product_2": "a[1] * b[2] - a[2] * b[1]",
}
ORACLE_SQL["helper_vectors"] = f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), f AS (SELECT a AS b FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, {', '.join(f'{shown_sql(e)} AS {k}' for k, e in _V.items())} FROM v, f"


# bars that are out of order in known places: by the hour of the day -----------------------------------------------------


def soiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, h = source.event_bars(spark, sf_dir), F.hour("ts")
    b = b.withColumns({"close": F.when(h == 3, F.lit(float("nan"))).when(h == 4, F.lit(None).cast("double")).otherwise(F.col("close")), "volume": F.when(h == 5, F.lit(0.0)).when(h == 6, F.lit(-1.0)).otherwise(F.col("volume")), "low": F.when(h == 7, -F.col("low")).otherwise(F.col("low")), "high": F.when(h == 8, F.col("low") - 1).otherwise(F.col("high"))})
    return b.unionByName(b.where(F.hour("ts") == 9).withColumn("volume", F.col("volume") + 1))


_SOILED = f"""SELECT * FROM (SELECT symbol, ts, open, CASE hour(ts) WHEN 8 THEN low - 1 ELSE high END AS high, CASE hour(ts) WHEN 7 THEN -low ELSE low END AS low,
 CASE hour(ts) WHEN 3 THEN 'nan'::DOUBLE WHEN 4 THEN NULL ELSE close END AS close, CASE hour(ts) WHEN 5 THEN 0 WHEN 6 THEN -1 ELSE volume END AS volume FROM ({BARS}))
 UNION ALL SELECT symbol, ts, open, high, low, close, volume + 1 FROM ({BARS}) WHERE hour(ts) = 9"""
_STEPS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "remove_duplicates": (cleaning.remove_duplicates, "SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC) = 1"),
    "remove_invalid_rows": (cleaning.remove_invalid_rows, "SELECT * FROM s WHERE isfinite(close)"), "drop_missing": (cleaning.drop_missing, "SELECT * FROM s WHERE NOT isnan(close)"),
    "replace_invalid_values": (lambda d: cleaning.replace_invalid_values(d, 0.0), "SELECT * REPLACE (CASE WHEN close IS NULL OR isnan(close) THEN 0 ELSE close END AS close) FROM s"),
    "remove_zero_volume": (cleaning.remove_zero_volume, "SELECT * FROM s WHERE volume > 0"), "remove_negative_prices": (cleaning.remove_negative_prices, "SELECT * FROM s WHERE low > 0 AND high > 0"),
    "clip_prices": (lambda d: cleaning.clip_prices(cleaning.remove_invalid_rows(d), 50.0, 100.0), "SELECT * REPLACE (least(greatest(close, 50), 100) AS close, least(greatest(low, 50), 100) AS low) FROM s WHERE isfinite(close)"),
    "remove_outliers": (lambda d: cleaning.remove_outliers(cleaning.remove_invalid_rows(d), 2.0), f"SELECT * FROM s WHERE isfinite(close) QUALIFY {' AND '.join(f'abs({c} - avg({c}) {ALL}) / stddev_pop({c}) {ALL} < 2' for c in ('open', 'high', 'low', 'close', 'volume'))}"),
    "clean_ohlcv": (cleaning.clean_ohlcv, "SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC) = 1) WHERE isfinite(close) AND low > 0 AND high > 0 AND volume > 0 AND high >= low"),
    "safe_slice": (lambda d: cleaning.slice_rows(cleaning.remove_duplicates(d), 5, 20), "SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC) = 1) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) BETWEEN 6 AND 20"),
    "safe_concat": (lambda d: cleaning.safe_concat([d, d.where("volume > 2")]), "SELECT * FROM s UNION ALL SELECT * FROM s WHERE volume > 2"), "sort_dataframe": (cleaning.sort_dataframe, "SELECT * FROM s"),
    "standardize_column_names": (lambda d: cleaning.standardize_column_names(d.toDF(*(f" {c.upper()} " for c in d.columns))), "SELECT * FROM s"), "safe_select": (lambda d: cleaning.select_existing(d, ["symbol", "low", "volume", "none"]).withColumn("close", F.lit(0.0)), "SELECT symbol, low, volume, 0.0 AS close FROM s"),
}


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cleaning function and symbol, the rows it leaves and sums of what they hold."""
    s, out = soiled(spark, sf_dir), None
    for name, (f, _) in _STEPS.items():
        total = lambda c: shown(F.sum(F.when(~F.isnan(c), F.col(c))))
        one = f(s).groupBy("symbol").agg(F.count("*").alias("n"), total("close").alias("close"), total("low").alias("low"), total("volume").alias("volume")).select(F.lit(name).alias("step"), "*")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["helper_cleaning"] = cleaned
ORACLE_SQL["helper_cleaning"] = f"WITH s AS ({_SOILED}) " + " UNION ALL ".join(
    f"SELECT '{k}' AS step, symbol, count(*) AS n, {shown_sql('sum(CASE WHEN NOT isnan(close) THEN close END)')} AS close, {shown_sql('sum(low)')} AS low, {shown_sql('sum(volume)')} AS volume FROM ({q}) GROUP BY symbol" for k, (_, q) in _STEPS.items()
)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cleaning.replace_invalid_values(soiled(spark, sf_dir).where(F.hour("ts") != 9)).select("symbol", "ts", "close")
    out = b.select("symbol", "ts", F.from_utc_timestamp("ts", "Asia/Kolkata").alias("convert_timezone"))
    for name, method in (("forward_fill", "ffill"), ("backward_fill", "bfill"), ("interpolate", "interpolate")):
        out = out.join(cleaning.fill_missing(b, method).select("symbol", "ts", shown(F.col("close")).alias(name)), ["symbol", "ts"])
    return out


QUERIES["helper_fill"] = filled
ORACLE_SQL["helper_fill"] = f"""WITH b AS (SELECT symbol, ts, CASE WHEN isnan(close) THEN NULL ELSE close END AS close, row_number() {W} AS rn FROM ({_SOILED}) WHERE hour(ts) <> 9),
 c AS (SELECT *, last_value(close IGNORE NULLS) {S} AS p, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q,
 last_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) {S} AS i, first_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM b)
 SELECT symbol, ts, ts + INTERVAL '5 hours 30 minutes' AS convert_timezone, {shown_sql('p')} AS forward_fill, {shown_sql('q')} AS backward_fill, {shown_sql('CASE WHEN close IS NOT NULL THEN close WHEN q IS NULL THEN p ELSE p + (q - p) * (rn - i) / (j - i) END')} AS interpolate FROM c"""

QUERIES["helper_checks"] = lambda spark, sf_dir: cleaning.checks(soiled(spark, sf_dir).where((F.col("symbol") > "l") | ~F.hour("ts").isin(3, 4, 5, 6, 7, 8, 9)))
_BAD = {
    "validate_index": "ts IS NULL", "validate_no_duplicates": "before = ts", "validate_monotonic_index": "before > ts", "validate_missing_data": "close IS NULL OR isnan(close)", "validate_price": "least(open, high, low, CASE WHEN isnan(close) THEN NULL ELSE close END) <= 0", "validate_high_low": "high < low", "validate_volume": "volume < 0",
}
_BAD |= {"validate_ohlc": f"({_BAD['validate_price']}) OR high < low"}
_BAD |= {"validate_ohlcv": f"({_BAD['validate_ohlc']}) OR volume < 0"}
ORACLE_SQL["helper_checks"] = f"SELECT symbol, count(*) >= 14 AS validate_length, {', '.join(f'coalesce(bool_and(NOT coalesce({e}, false)), true) AS {k}' for k, e in _BAD.items())} FROM (SELECT *, {lag('ts')} AS before FROM ({_SOILED}) WHERE symbol > 'l' OR hour(ts) NOT IN (3, 4, 5, 6, 7, 8, 9)) GROUP BY symbol"

QUERIES["helper_timeframes"] = lambda spark, sf_dir: cleaning.timeframes(source.event_bars(spark, sf_dir)).unionByName(cleaning.timeframes(source.order_bars(spark, sf_dir)))
_T = "CASE WHEN seconds >= 86400 THEN 1.0 ELSE 22500 / seconds END"
ORACLE_SQL["helper_timeframes"] = " UNION ALL ".join(
    f"SELECT symbol, seconds, CASE WHEN seconds >= 86400 THEN concat((seconds / 86400)::INT, 'D') ELSE concat((seconds / 3600)::INT, 'h') END AS convert_timeframe, seconds < 86400 AS is_intraday, seconds = 86400 AS is_daily, seconds = 604800 AS is_weekly, seconds BETWEEN 2419200 AND 2678400 AS is_monthly, "
    f"{_T} AS bars_per_day, 5 * {_T} AS bars_per_week, 21 * {_T} AS bars_per_month, 252.0 * {_T} AS annualization_factor FROM (SELECT symbol, median(step)::DOUBLE AS seconds FROM (SELECT symbol, epoch(ts) - epoch({lag('ts')}) AS step FROM ({q})) GROUP BY symbol)"
    for q in (BARS, source.SQL["orders"])
)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sums of the ways in which two tables of bars come together."""
    a = source.event_bars(spark, sf_dir)
    b, c = a.where(F.hour("ts") % 2 == 0), a.where(F.hour("ts") % 3 == 0)
    right = F.col("close_right")
    tables = {
        "safe_merge": cleaning.merge(b, c).withColumn("x", right), "safe_merge_left": cleaning.merge(b, c, "left").withColumn("x", right), "align_dataframe": cleaning.merge(b, c, "outer").withColumn("x", right),
        "align_series": cleaning.merge(b.select("symbol", "ts", "close"), c.select("symbol", "ts", "close")).withColumn("x", right), "common_index": cleaning.common_times(a, b, c).withColumn("x", F.lit(0.0)),
        "intersection_index": cleaning.common_times(b, c).withColumn("x", F.lit(0.0)), "union_index": cleaning.all_times(b, c).withColumn("x", F.lit(0.0)), "safe_concat_beside": cleaning.safe_concat([b, c], axis=1).withColumn("x", right),
    }
    out = None
    for k, t in tables.items():
        one = t.groupBy("symbol").agg(F.count("*").alias("n"), shown(F.coalesce(F.sum("x"), F.lit(0.0))).alias("x")).select(F.lit(k).alias("step"), "*")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["helper_joins"] = joined
_J = {
    "safe_merge": "SELECT symbol, c.close AS x FROM b JOIN c USING (symbol, ts)", "safe_merge_left": "SELECT symbol, c.close AS x FROM b LEFT JOIN c USING (symbol, ts)", "align_dataframe": "SELECT symbol, c.close AS x FROM b FULL JOIN c USING (symbol, ts)", "align_series": "SELECT symbol, c.close AS x FROM b JOIN c USING (symbol, ts)",
    "common_index": "SELECT symbol, 0 AS x FROM b JOIN c USING (symbol, ts)", "intersection_index": "SELECT symbol, 0 AS x FROM b JOIN c USING (symbol, ts)", "union_index": "SELECT symbol, 0 AS x FROM (SELECT symbol, ts FROM b UNION SELECT symbol, ts FROM c)", "safe_concat_beside": "SELECT symbol, c.close AS x FROM b FULL JOIN c USING (symbol, ts)",
}
ORACLE_SQL["helper_joins"] = f"WITH a AS ({BARS}), b AS (SELECT * FROM a WHERE hour(ts) % 2 = 0), c AS (SELECT * FROM a WHERE hour(ts) % 3 = 0) " + " UNION ALL ".join(f"SELECT '{k}' AS step, symbol, count(*) AS n, {shown_sql('coalesce(sum(x), 0)')} AS x FROM ({q}) GROUP BY symbol" for k, q in _J.items())


# price sources, offsets and filling of an indicator --------------------------------------------------------------------

_SOURCES = {"close": "close", "hl2": "(high + low) / 2", "median_price": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "typical_price": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4", "weighted_price": "(high + low + 2 * close) / 4"}


def price_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean of three of every price source, two bars late and filled."""
    b = source.event_bars(spark, sf_dir)
    out = b.select("symbol", "ts")
    for name in _SOURCES:
        one = base.compute(b, {"ma.sma": {"length": 3, "source": name, "offset": 2, "fillna": -1.0}}, DIGITS)
        out = out.join(one.select("symbol", "ts", F.col("sma").alias(name)), ["symbol", "ts"])
    return out


QUERIES["price_sources"] = price_sources
_SMA = "CASE WHEN count(*) OVER q >= 3 THEN avg({e}) OVER q END"
ORACLE_SQL["price_sources"] = f"SELECT symbol, ts, {', '.join(f'{shown_sql(f'coalesce(lag({k}, 2) {W}, -1)')} AS {k}' for k in _SOURCES)} FROM (SELECT symbol, ts, {', '.join(f'{_SMA.format(e=e)} AS {k}' for k, e in _SOURCES.items())} FROM ({BARS}) WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


def feature_quality(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, n, missing, different, low, high) of numeric columns, in one pass: what a feature table holds."""
    one = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in names]
    x = F.col("f.x")
    return features.select(F.explode(F.array(*one)).alias("f")).groupBy(F.col("f.feature").alias("feature")).agg(F.count("*").alias("n"), F.sum(F.when(x.isNull() | F.isnan(x), 1).otherwise(0)).alias("missing"), F.countDistinct(shown(x)).alias("different"), shown(F.min(x)).alias("low"), shown(F.max(x)).alias("high"))
