"""Guarded numeric functions on columns. NaN and infinities count as missing; ``default`` stands in for what has no value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16
MAX_FLOAT = 1.7976931348623157e308


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def known(x) -> Column:
    """x as double, NULL where it is NaN or infinite."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def or_default(x: Column, default: float | None) -> Column:
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def safe_divide(a, b, default: float | None = 0.0) -> Column:
    return or_default(known(F.try_divide(known(a), known(b))), default)


safe_ratio = safe_divide


def safe_inverse(x, default: float | None = 0.0) -> Column:
    return safe_divide(1.0, x, default)


def safe_percentage_change(current, previous, default: float | None = 0.0) -> Column:
    return safe_divide(known(current) - known(previous), previous, default)


def safe_log(x, default: float | None = 0.0) -> Column:
    return or_default(F.when(known(x) > 0, F.log(known(x))), default)


safe_ln = safe_log


def safe_log10(x, default: float | None = 0.0) -> Column:
    return or_default(F.when(known(x) > 0, F.log10(known(x))), default)


def safe_exp(x, default: float | None = MAX_FLOAT) -> Column:
    return or_default(F.when(known(x) <= 709.78, F.exp(known(x))), default)


def safe_power(x, p, default: float | None = 0.0) -> Column:
    return or_default(known(F.pow(known(x), _c(p))), default)


def safe_sqrt(x, default: float | None = 0.0) -> Column:
    return or_default(F.when(known(x) >= 0, F.sqrt(known(x))), default)


def clip(x, low: float, high: float) -> Column:
    return F.when(known(x).isNotNull(), F.least(F.greatest(known(x), F.lit(float(low))), F.lit(float(high))))


def safe_clip(x, low: float, high: float) -> Column:
    return clip(or_default(known(x), 0.0), low, high)


def relu(x) -> Column:
    return F.greatest(known(x), F.lit(0.0))


def square(x) -> Column:
    return known(x) * known(x)


def cube(x) -> Column:
    return known(x) * known(x) * known(x)


def sigmoid(x) -> Column:
    """1 / (1 + e^-x), without overflow on either side."""
    e = F.exp(-F.abs(known(x)))
    return F.when(known(x) >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def stable_tanh(x) -> Column:
    return F.tanh(clip(x, -20.0, 20.0))


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.coalesce(F.abs(known(a) - known(b)) <= atol + rtol * F.abs(known(b)), F.lit(False))


def fast_abs(x) -> Column:
    return F.abs(known(x))


def fast_log(x) -> Column:
    return safe_log(x, None)


fast_relu, fast_clip, fast_square, fast_cube, fast_sigmoid, stable_sigmoid = relu, clip, square, cube, sigmoid, sigmoid


def epsilon() -> float:
    return EPSILON


def hl2(high="high", low="low") -> Column:
    return (_c(high) + _c(low)) / 2


def hlc3(high="high", low="low", close="close") -> Column:
    return (_c(high) + _c(low) + _c(close)) / 3


def ohlc4(open_="open", high="high", low="low", close="close") -> Column:
    return (_c(open_) + _c(high) + _c(low) + _c(close)) / 4


def weighted_price(high="high", low="low", close="close") -> Column:
    return (_c(high) + _c(low) + 2 * _c(close)) / 4


typical_price, median_price = hlc3, hl2


def candle_direction(open_="open", close="close") -> Column:
    return F.signum(_c(close) - _c(open_))


# whole-column statistics, as aggregates --------------------------------------------------------------------------


def safe_agg(f: str, x, default: float = 0.0) -> Column:
    """mean, sum, min, max, median, product or std (of the population) of the known values."""
    v = known(x)
    forms = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "product": F.product}
    if f == "std":
        return F.when(F.count(v) > 1, F.stddev_pop(v)).otherwise(F.lit(default))
    return F.coalesce(forms[f](v), F.lit(default))


def mode(x) -> Column:
    """The most frequent value, the smallest one of several."""
    return F.mode(known(x), deterministic=True)


def iqr(x) -> Column:
    return F.percentile(known(x), 0.75) - F.percentile(known(x), 0.25)


def percentile(x, q: float) -> Column:
    return F.percentile(known(x), q / 100)


def percentile_rank(x, score: float) -> Column:
    v = known(x)
    below, same = F.sum(F.when(v < score, 1.0).otherwise(0.0)), F.sum(F.when(v == score, 1.0).otherwise(0.0))
    return safe_divide(100 * (below + 0.5 * same), F.count(v), None)


def coefficient_of_variation(x) -> Column:
    return safe_divide(F.stddev_pop(known(x)), F.abs(F.avg(known(x))), 0.0)


def variance(x) -> Column:
    return F.var_samp(known(x))


def std(x) -> Column:
    return F.stddev_samp(known(x))


def standard_error(x) -> Column:
    return F.stddev_samp(known(x)) / F.sqrt(F.count(known(x)))


def sharpe_like_score(x, risk_free_rate: float = 0.0) -> Column:
    return safe_divide(F.avg(known(x)) - risk_free_rate, F.stddev_pop(known(x)), 0.0)


def signal_to_noise_ratio(x) -> Column:
    return safe_divide(F.avg(known(x)), F.stddev_pop(known(x)), 0.0)


def geometric_mean(x) -> Column:
    v = known(x)
    return F.when(F.min(v) > 0, F.exp(F.avg(F.when(v > 0, F.log(v)))))


def harmonic_mean(x) -> Column:
    v = known(x)
    return F.when(F.sum(F.when(v == 0, 1).otherwise(0)) == 0, F.count(v) / F.sum(F.try_divide(F.lit(1.0), v)))


def log_sum_exp(df, x: str, by: list[str]):
    """(by, log_sum_exp): ln of the summed exponentials of a column, taken from the group's largest value on."""
    top = df.groupBy(*by).agg(F.max(known(x)).alias("top_"))
    return df.join(top, by).groupBy(*by).agg((F.first("top_") + F.log(F.sum(F.exp(known(x) - F.col("top_"))))).alias("log_sum_exp"))


# vectors -----------------------------------------------------------------------------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _pairs(a, b, f) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot_product(a, b) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def l1_norm(a) -> Column:
    return _sum(F.transform(_c(a), lambda x: F.abs(x.cast("double"))))


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


vector_norm = l2_norm


def normalize_vector(a) -> Column:
    """a at length 1; zeros stay zeros."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan_distance(a, b) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def cosine_similarity(a, b) -> Column:
    return safe_divide(dot_product(a, b), l2_norm(a) * l2_norm(b), 0.0)


def vector_angle_cosine(a, b) -> Column:
    return F.acos(clip(cosine_similarity(a, b), -1.0, 1.0))


def projection(a, b) -> Column:
    k = safe_divide(dot_product(a, b), dot_product(b, b), 0.0)
    return F.transform(_c(b), lambda x: k * x.cast("double"))


def cross_product(a, b) -> Column:
    at = lambda v, i: F.element_at(_c(v), i).cast("double")
    return F.array(*(at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((2, 3), (3, 1), (1, 2))))
