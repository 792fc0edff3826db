"""Functions over a symbol's series as columns: shifts, rolling and expanding measures, whole-series standards, returns.

A rolling measure needs a full window of known values, and has none where it lacks one; NaN and infinities count as missing.
Every function takes a column of bars (symbol, ts, ...) and gives a column; the windows are by symbol and in order of time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .expanding import Accumulator, accumulate
from .scalars import known, or_default, safe_divide

TRADING_DAYS = 252


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def last_rows(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


# shifts ---------------------------------------------------------------------------------------------------------------


def rolling_shift(x, periods: int = 1) -> Column:
    return F.lag(known(x), periods).over(by_time()) if periods >= 0 else F.lead(known(x), -periods).over(by_time())


def safe_shift(x, periods: int = 1, fill: float = 0.0) -> Column:
    return F.coalesce(rolling_shift(x, periods), F.lit(fill))


def rolling_difference(x, periods: int = 1) -> Column:
    return known(x) - rolling_shift(x, periods)


price_change = rolling_difference


def rolling_ratio(x, periods: int = 1) -> Column:
    return safe_divide(x, rolling_shift(x, periods), None)


def rolling_return(x, periods: int = 1) -> Column:
    return rolling_ratio(x, periods) - 1


simple_return = rolling_return


def percent_change(x, periods: int = 1) -> Column:
    return 100 * rolling_return(x, periods)


def log_return(x) -> Column:
    r = rolling_ratio(x)
    return F.when(r > 0, F.log(r))


def true_range_inputs(high="high", low="low", close="close") -> tuple[Column, Column, Column]:
    """The three distances whose largest is the true range."""
    before = rolling_shift(close)
    return known(high) - known(low), F.abs(known(high) - before), F.abs(known(low) - before)


def price_range(high="high", low="low") -> Column:
    return known(high) - known(low)


def body_size(open_="open", close="close") -> Column:
    return F.abs(known(close) - known(open_))


def upper_shadow(open_="open", high="high", close="close") -> Column:
    return known(high) - F.greatest(known(open_), known(close))


def lower_shadow(open_="open", low="low", close="close") -> Column:
    return F.least(known(open_), known(close)) - known(low)


# rolling and expanding ------------------------------------------------------------------------------------------------


def rolling(f: Callable[[Column], Column], x, n: int, least: int | None = None) -> Column:
    """``f`` (an aggregate) of the last n values where at least ``least`` (n) of them are known."""
    v = known(x)
    return F.when(F.count(v).over(last_rows(n)) >= (n if least is None else least), f(v).over(last_rows(n)))


def rolling_min_periods(f: Callable[[Column], Column], x, n: int, least: int) -> Column:
    return rolling(f, x, n, least)


def rolling_mean(x, n: int) -> Column:
    return rolling(F.avg, x, n)


def rolling_sum(x, n: int) -> Column:
    return rolling(F.sum, x, n)


def rolling_std(x, n: int) -> Column:
    return rolling(F.stddev_samp, x, n)


def rolling_var(x, n: int) -> Column:
    return rolling(F.var_samp, x, n)


def rolling_min(x, n: int) -> Column:
    return rolling(F.min, x, n)


def rolling_max(x, n: int) -> Column:
    return rolling(F.max, x, n)


def rolling_quantile(x, n: int, q: float) -> Column:
    return rolling(lambda v: F.percentile(v, q), x, n)


def rolling_median(x, n: int) -> Column:
    return rolling_quantile(x, n, 0.5)


def rolling_percentile(x, n: int, p: float) -> Column:
    return rolling_quantile(x, n, p / 100)


def rolling_iqr(x, n: int) -> Column:
    return rolling_quantile(x, n, 0.75) - rolling_quantile(x, n, 0.25)


def rolling_window_view(x, n: int) -> Column:
    """The values of a full window as an array, oldest first."""
    return rolling(F.collect_list, x, n)


def rolling_mad(x, n: int) -> Column:
    """Mean distance of a window's values from their mean."""
    return F.aggregate(F.transform(rolling_window_view(x, n), lambda v: F.abs(v - rolling_mean(x, n))), F.lit(0.0), lambda a, b: a + b) / n


def rolling_rank(x, n: int) -> Column:
    """Rank of the last value in its window, ties in their middle."""
    held, v = rolling_window_view(x, n), known(x)
    return F.size(F.filter(held, lambda w: w < v)) + (F.size(F.filter(held, lambda w: w == v)) + 1) / 2.0


def rolling_zscore(x, n: int) -> Column:
    return safe_divide(known(x) - rolling_mean(x, n), rolling_std(x, n), None)


def rolling_skew(x, n: int) -> Column:
    """Sample skewness (G1)."""
    return rolling(F.skewness, x, n) * (n * (n - 1)) ** 0.5 / (n - 2)


def rolling_kurtosis(x, n: int) -> Column:
    """Sample excess kurtosis (G2)."""
    return ((n + 1) * rolling(F.kurtosis, x, n) + 6) * (n - 1) / ((n - 2) * (n - 3))


def rolling_volatility(x, n: int, periods: int = TRADING_DAYS) -> Column:
    return rolling_std(x, n) * periods**0.5


def rolling_drawdown(x, n: int) -> Column:
    top = rolling(F.max, x, n, 1)
    return safe_divide(known(x) - top, top, None)


def _paired(f, x, y, n: int) -> Column:
    a, b = known(x), known(y)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    return F.when(F.count(both).over(last_rows(n)) >= n, f(a, b).over(last_rows(n)))


def rolling_correlation(x, y, n: int) -> Column:
    return _paired(F.corr, x, y, n)


def rolling_covariance(x, y, n: int) -> Column:
    return _paired(F.covar_samp, x, y, n)


def expanding(f: Callable[[Column], Column], x, least: int = 1) -> Column:
    v = known(x)
    return F.when(F.count(v).over(so_far()) >= least, f(v).over(so_far()))


def expanding_mean(x, least: int = 1) -> Column:
    return expanding(F.avg, x, least)


def expanding_std(x, least: int = 1) -> Column:
    return expanding(F.stddev_samp, x, least)


def expanding_apply(df: DataFrame, column: str, f: Callable | Accumulator, name: str, least: int = 1) -> DataFrame:
    """``f`` at each bar: an accumulator, for series of any length; or a function (numbers so far -> number), for short series
    only, as the numbers so far are one array a bar."""
    if isinstance(f, Accumulator):
        return accumulate(df, {name: (column, f)}, least)

    @F.pandas_udf("double")
    def run(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: None if w is None or len(w) < least else float(f(w)))

    return df.withColumn("so far", F.collect_list(known(column)).over(so_far())).withColumn(name, run("so far")).drop("so far")


def cumulative_return(returns) -> Column:
    """Compounded returns; missing ones count as none. A return of -1 or less leaves nothing."""
    r = F.coalesce(known(returns), F.lit(0.0))
    gone = F.max(F.when(r <= -1, 1).otherwise(0)).over(so_far())
    return F.when(gone == 1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.when(r > -1, F.log1p(r))).over(so_far())) - 1)


# against the whole series ---------------------------------------------------------------------------------------------


def zscore(x) -> Column:
    """Distance from the mean in population deviations; zero where they don't vary."""
    v = known(x)
    return F.when(v.isNotNull(), safe_divide(v - F.avg(v).over(whole()), F.stddev_pop(v).over(whole()), 0.0))


standardize_zero_mean = zscore


def mean_distance(df: DataFrame, x: str, by: str = "symbol") -> DataFrame:
    """(symbol, mad): mean distance of a series' values from their mean."""
    centred = df.withColumn("distance", F.abs(known(x) - F.avg(known(x)).over(whole())))
    return centred.groupBy(by).agg(F.avg("distance").alias("mad"))


def robust_zscore(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with the distance from the median in mean absolute deviations (times 1.4826), zero where there is none."""
    v = known(x)
    centred = df.withColumns({"centre": F.median(v).over(whole()), "spread": F.abs(v - F.avg(v).over(whole()))}).withColumn("spread", F.avg("spread").over(whole()))
    return centred.withColumn(name, F.when(v.isNotNull(), safe_divide(v - F.col("centre"), 1.4826 * F.col("spread"), 0.0))).drop("centre", "spread")


def normalize_minmax(x) -> Column:
    v = known(x)
    low, high = F.min(v).over(whole()), F.max(v).over(whole())
    return F.when(v.isNotNull(), safe_divide(v - low, high - low, 0.0))


def winsorize(x, low: float = 0.05, high: float = 0.05) -> Column:
    """Values beyond the outer shares drawn in to their edges."""
    v = known(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.percentile(v, low).over(whole())), F.percentile(v, 1 - high).over(whole())))


def without_outliers(x, threshold: float = 3.0) -> Column:
    """x, missing where it lies more than ``threshold`` population deviations from the mean."""
    return F.when(F.abs(zscore(x)) <= threshold, known(x))


def stable_softmax(x) -> Column:
    """Share of each value's exponential in its series, taken from the largest value on."""
    v = known(x)
    e = F.exp(v - F.max(v).over(whole()))
    return e / F.sum(e).over(whole())


def entropy(df: DataFrame, x: str, by: str = "symbol") -> DataFrame:
    """(symbol, entropy): Shannon bits of the exact values of a series."""
    n = df.where(known(x).isNotNull()).groupBy(by, known(x).alias("value")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return n.withColumn("bits", -p * F.log2(p)).groupBy(by).agg(F.sum("bits").alias("entropy"))


__all__ = ["or_default"]
