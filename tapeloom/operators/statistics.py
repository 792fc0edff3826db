"""Rolling and whole-series statistics, regression, benchmark measures (names stats.*).

Benchmark indicators read the columns bench_open ... bench_volume (see sources.bars.with_benchmark).
"""

from __future__ import annotations

from math import sqrt

import numpy as np

from tapeloom.functions import concord
from tapeloom.functions.ordered import LONG_WINDOW
from tapeloom.functions.sheet import Sheet, numbers

from .base import IndicatorError, alias, indicator, positive, price
from .volume import rank_share, simple_return

TINY = "1e-10"


def rolled(f: str):
    def build(s: Sheet, length: int = 20, source: str = "close") -> str:
        return s.roll(f, price(s, source), positive(length))

    return build


def overall(f: str):
    def build(s: Sheet, source: str = "close") -> str:
        return s.all(f, price(s, source))

    return build


for _n, _f in (("mean", "avg"), ("variance", "var_samp"), ("standard_deviation", "stddev_samp")):
    indicator(f"stats.{_n}")(overall(_f))
    indicator(f"stats.rolling_{_n}")(rolled(_f))


@indicator("stats.median")
def median(s: Sheet, source: str = "close") -> str:
    return s.all_quantile(price(s, source), 0.5)


@indicator("stats.rolling_median")
def rolling_median(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.quantile(price(s, source), 0.5, positive(length))


@indicator("stats.mode")
def mode(s: Sheet, source: str = "close") -> str:
    """The smallest of the most frequent values."""
    x = price(s, source)
    n = s.put(f"count({x}) OVER (PARTITION BY {s.key}, {x})")
    top = s.all("max", n)
    return s.all("min", f"CASE WHEN {n} = {top} THEN {x} END")


@indicator("stats.mean_absolute_deviation")
def mean_absolute_deviation(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.roll("avg", f"abs({x} - {s.roll('avg', x, positive(length))})", length)


@indicator("stats.median_absolute_deviation")
def median_absolute_deviation(s: Sheet, length: int = 20, source: str = "close") -> str:
    x, n = price(s, source), positive(length)
    if n >= LONG_WINDOW:
        full = f"count({x}) {s.rows(n)} >= {n}"
        return s.put(f"({s.ordered(x, n, ('deviation',))[0]})", f"CASE WHEN {full} THEN mad({x}) {s.rows(n)} END")
    w, mid = s.values(x, n), s.quantile(x, 0.5, n)
    return s.put(
        f"CASE WHEN {w} IS NOT NULL THEN (element_at(array_sort(transform({w}, v -> abs(v - {mid}))), {(n + 1) // 2}) + element_at(array_sort(transform({w}, v -> abs(v - {mid}))), {n // 2 + 1})) / 2 END",
        f"CASE WHEN {w} IS NOT NULL THEN list_median(list_transform({w}, lambda v: abs(v - {mid}))) END",
    )


@indicator("stats.root_mean_square")
def root_mean_square(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"sqrt({s.roll('avg', f'{x} * {x}', positive(length))})")


@indicator("stats.coefficient_of_variation")
def coefficient_of_variation(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.put(s.div(s.roll("stddev_samp", x, positive(length)), s.roll("avg", x, length)))


@indicator("stats.range_stat")
def range_stat(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"{s.roll('max', x, positive(length))} - {s.roll('min', x, length)}")


@indicator("stats.interquartile_range")
def interquartile_range(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"{s.quantile(x, 0.75, positive(length))} - {s.quantile(x, 0.25, length)}")


@indicator("stats.quantile")
def quantile(s: Sheet, q: float = 0.5, length: int = 20, source: str = "close") -> str:
    if not 0 <= q <= 1:
        raise IndicatorError("q must lie between 0 and 1")
    return s.quantile(price(s, source), float(q), positive(length))


@indicator("stats.percentile")
def percentile(s: Sheet, p: float = 50.0, length: int = 20, source: str = "close") -> str:
    return quantile(s, p / 100, length, source)


alias("stats.rolling_percentile", "stats.percentile")


@indicator("stats.percentile_rank")
def percentile_rank(s: Sheet, length: int = 20, source: str = "close") -> str:
    return rank_share(s, price(s, source), length)


@indicator("stats.z_score")
def z_score(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.put(s.div(f"{x} - {s.roll('avg', x, positive(length))}", s.roll("stddev_samp", x, length)))


alias("stats.rolling_z_score", "stats.z_score")


def or_tiny(s: Sheet, x: str) -> str:
    return s.put(f"CASE WHEN {x} = 0 THEN {TINY} ELSE {x} END")


@indicator("stats.modified_z_score")
def modified_z_score(s: Sheet, length: int = 20, source: str = "close") -> str:
    mad = or_tiny(s, median_absolute_deviation(s, length, source))
    return s.put(f"0.6745 * ({price(s, source)} - {rolling_median(s, length, source)}) / {mad}")


@indicator("stats.min_max_scaling")
def min_max_scaling(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    low = s.roll("min", x, positive(length))
    return s.put(s.div(f"{x} - {low}", f"{s.roll('max', x, length)} - {low}"))


alias("stats.normalization", "stats.min_max_scaling")


@indicator("stats.robust_scaling")
def robust_scaling(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.put(f"({price(s, source)} - {rolling_median(s, length, source)}) / {or_tiny(s, interquartile_range(s, length, source))}")


@indicator("stats.winsorization")
def winsorization(s: Sheet, length: int = 20, limits: tuple[float, float] = (0.05, 0.95), source: str = "close") -> str:
    x = price(s, source)
    low, high = s.quantile(x, limits[0], positive(length)), s.quantile(x, limits[1], length)
    return s.put(f"CASE WHEN {low} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END")


def _central(s: Sheet, x: str, n: int, k: int) -> str:
    """DuckDB: the k-th central moment of a full window (its own window moments lose digits)."""
    w = s.values(x, n)
    return f"list_sum(list_transform({w}, lambda v: power(v - list_avg({w}), {k}))) / {n}"


def skew_of(s: Sheet, x: str, n: int | None) -> str:
    """Bias-corrected skewness; Spark's own is that of the population."""
    w, c = (s.whole, f"count({x}) {s.whole}") if n is None else (s.rows(n), str(n))
    full, grown = f"CASE WHEN count({x}) {w} >= {max(3, n or 3)} THEN", f"sqrt({c} * ({c} - 1.0)) / ({c} - 2)"
    duck = f"skewness({x}) {w}" if n is None else f"{_central(s, x, n, 3)} / power({_central(s, x, n, 2)}, 1.5) * {grown}"
    return s.put(f"{full} skewness({x}) {w} * {grown} END", f"{full} {duck} END")


def kurt_of(s: Sheet, x: str, n: int | None) -> str:
    """Bias-corrected excess kurtosis."""
    w, c = (s.whole, f"count({x}) {s.whole}") if n is None else (s.rows(n), str(n))
    full, grown = f"CASE WHEN count({x}) {w} >= {max(4, n or 4)} THEN", f"({c} - 1.0) / (({c} - 2.0) * ({c} - 3)) * (({c} + 1) * ({{}}) + 6)"
    duck = f"kurtosis({x}) {w}" if n is None else grown.format(f"{_central(s, x, n, 4)} / power({_central(s, x, n, 2)}, 2) - 3")
    return s.put(f"{full} {grown.format(f'kurtosis({x}) {w}')} END", f"{full} {duck} END")


@indicator("stats.skewness")
def skewness(s: Sheet, source: str = "close") -> str:
    return skew_of(s, price(s, source), None)


@indicator("stats.rolling_skewness")
def rolling_skewness(s: Sheet, length: int = 20, source: str = "close") -> str:
    return skew_of(s, price(s, source), positive(length))


@indicator("stats.kurtosis")
def kurtosis(s: Sheet, source: str = "close") -> str:
    return kurt_of(s, price(s, source), None)


@indicator("stats.rolling_kurtosis")
def rolling_kurtosis(s: Sheet, length: int = 20, source: str = "close") -> str:
    return kurt_of(s, price(s, source), positive(length))


@indicator("stats.entropy")
def entropy(s: Sheet, length: int = 20, bins: int = 10, source: str = "close") -> str:
    """Shannon entropy in nats over equal bins between the window's minimum and maximum; a flat window has none."""
    x, n = price(s, source), positive(length)
    w, low, high = s.values(x, n), s.roll("min", x, n), s.roll("max", x, n)
    width = s.put(f"nullif(({high} - {low}) / {positive(bins, 'bins')}, 0)")
    terms = []
    for b in range(bins):
        test = f"least(floor((v - {low}) / {width}), {bins - 1}) = {b}"
        share = s.put(f"{s.count_if(w, test)} / {float(n)!r}")
        terms.append(f"CASE WHEN {share} > 0 THEN -{share} * ln({share}) ELSE 0.0 END")
    return s.put(f"CASE WHEN {w} IS NULL THEN NULL WHEN {width} IS NULL THEN 0.0 ELSE {' + '.join(terms)} END")


alias("stats.shannon_entropy", "stats.entropy")


@indicator("stats.jarque_bera")
def jarque_bera(s: Sheet, length: int = 20, source: str = "close") -> str:
    a, b = rolling_skewness(s, length, source), rolling_kurtosis(s, length, source)
    return s.put(f"{length} / 6.0 * ({a} * {a} + {b} * {b} / 4)")


@indicator("stats.normality_score")
def normality_score(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.put(f"exp(-{jarque_bera(s, length, source)})")


def pair(s: Sheet, source: str, bench_source: str) -> tuple[str, str]:
    y = f"bench_{bench_source}"
    if y not in s.columns:
        raise IndicatorError(f"the bars have no column {y}; join a benchmark first")
    return price(s, source), y


@indicator("stats.pearson_correlation", bench=True)
def pearson_correlation(s: Sheet, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    return s.put(f"corr({x}, {y}) {s.whole}")


@indicator("stats.rolling_pearson", bench=True)
def rolling_pearson(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    return s.roll2("corr", *pair(s, source, bench_source), positive(length))


alias("stats.cross_correlation", "stats.rolling_pearson")


def average_rank(s: Sheet, x: str) -> str:
    return s.put(f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {s.key} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {s.key}, {x}) - 1) / 2.0 END")


@indicator("stats.spearman_correlation", bench=True)
def spearman_correlation(s: Sheet, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = s.put(f"CASE WHEN {both} THEN {x} END"), s.put(f"CASE WHEN {both} THEN {y} END")
    return s.put(f"corr({average_rank(s, a)}, {average_rank(s, b)}) {s.whole}")


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b in O(n log n): ties by counting, discordant pairs by merge sort."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]

    def tied(*v: np.ndarray) -> int:
        same = np.ones(n - 1, bool)
        for u in v:
            same &= u[1:] == u[:-1]
        runs = np.diff(np.flatnonzero(np.r_[True, ~same, True]))
        return int((runs * (runs - 1) // 2).sum())

    if n < 2:
        return np.nan
    tx, txy = tied(x), tied(x, y)
    a, swaps, width = y.tolist(), 0, 1
    while width < n:
        merged = []
        for i in range(0, n, 2 * width):
            p, q = a[i : i + width], a[i + width : i + 2 * width]
            j = 0
            for v in p:
                while j < len(q) and q[j] < v:
                    merged.append(q[j])
                    j += 1
                merged.append(v)
                swaps += j
            merged += q[j:]
        a, width = merged, 2 * width
    ty = tied(np.array(a))
    total = n * (n - 1) // 2
    d = sqrt((total - tx) * (total - ty))
    return (total - tx - ty + txy - 2 * swaps) / d if d else np.nan


def _pairs_sql(form: str, n: int):
    """SQL of a measure of the pairs of a full window without gaps, as lists xs_ and ys_."""

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        x, y = inputs
        w = sheet.rows(n)
        listed = f"SELECT *, CASE WHEN count({x}) {w} = {n} AND count({y}) {w} = {n} THEN list({x}) {w} END AS xs_, list({y}) {w} AS ys_ FROM {table}"
        ranks = lambda v: f"list_transform({v}, lambda a: len(list_filter({v}, lambda b: b < a)) + (len(list_filter({v}, lambda b: b = a)) + 1) / 2.0 - {(n + 1) / 2!r})"
        sides = lambda v: f"flatten(list_transform({v}, lambda a: list_transform({v}, lambda b: sign(a - b))))"
        made = f"SELECT *, {ranks('xs_') if form == 'spearman' else sides('xs_')} AS a_, {ranks('ys_') if form == 'spearman' else sides('ys_')} AS b_ FROM ({listed})"
        dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
        return f"SELECT * EXCLUDE (xs_, ys_, a_, b_), (CASE WHEN xs_ IS NOT NULL THEN {dot('a_', 'b_')} / nullif(sqrt({dot('a_', 'a_')} * {dot('b_', 'b_')}), 0) END)::DOUBLE AS {outputs[0]} FROM ({made})"

    return sql


def _all_pairs_sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
    x, y = inputs
    k = sheet.key
    sides = f"SELECT a.{k} AS k_, sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS c_, sum(abs(sign(a.{x} - b.{x}))) AS x_, sum(abs(sign(a.{y} - b.{y}))) AS y_ FROM {table} a JOIN {table} b ON a.{k} = b.{k} AND a.{x} IS NOT NULL AND a.{y} IS NOT NULL AND b.{x} IS NOT NULL AND b.{y} IS NOT NULL GROUP BY 1"
    return f"SELECT t.*, (z.c_ / nullif(sqrt(z.x_ * z.y_), 0))::DOUBLE AS {outputs[0]} FROM {table} t LEFT JOIN ({sides}) z ON z.k_ = t.{k}"


@indicator("stats.rolling_spearman", bench=True, machine=True)
def rolling_spearman(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    made = concord.window(positive(length), "spearman")
    sides = list(pair(s, source, bench_source))
    return s.machine(made, sides, ["r"], ("spearman", length, source, bench_source), sql=_pairs_sql("spearman", length), reach=length - 1)["r"]


@indicator("stats.rolling_kendall", bench=True, machine=True)
def rolling_kendall(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    made = concord.window(positive(length), "kendall")
    sides = list(pair(s, source, bench_source))
    return s.machine(made, sides, ["tau"], ("kendall", length, source, bench_source), sql=_pairs_sql("kendall", length), reach=length - 1)["tau"]


@indicator("stats.kendall_correlation", bench=True, machine=True)
def kendall_correlation(s: Sheet, source: str = "close", bench_source: str = "close") -> str:
    def make():
        def step(x, y):
            a = np.array([numbers(x), numbers(y)])
            good = ~np.isnan(a).any(0)
            return [[kendall(a[0][good], a[1][good])] * len(x)]

        return step

    return s.machine(make, list(pair(s, source, bench_source)), ["tau"], ("kendall all", source, bench_source), whole=True, sql=_all_pairs_sql)["tau"]


@indicator("stats.autocorrelation")
def autocorrelation(s: Sheet, lag: int = 1, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"corr({x}, {s.lag(x, positive(lag, 'lag'))}) {s.whole}")


@indicator("stats.lag_correlation", bench=True)
def lag_correlation(s: Sheet, lag: int = 1, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    return s.roll2("corr", x, s.lag(y, positive(lag, "lag")), positive(length))


@indicator("stats.covariance", bench=True)
def covariance(s: Sheet, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    return s.put(f"covar_samp({x}, {y}) {s.whole}")


@indicator("stats.rolling_covariance", bench=True)
def rolling_covariance(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    return s.roll2("covar_samp", *pair(s, source, bench_source), positive(length))


@indicator("stats.rolling_regression")
def rolling_regression(s: Sheet, length: int = 14, source: str = "close") -> dict[str, str]:
    """Least squares over the window against 0..n-1: value at the last bar, slope, intercept at the first, r2."""
    y, n = price(s, source), positive(length)
    at = s.put(f"cast(row_number() {s.over()} AS double)")
    w = s.rows(n)
    full = f"count({y}) {w} >= {n}"
    slope = s.put(f"CASE WHEN {full} THEN regr_slope({y}, {at}) {w} END") if n > 1 else s.put("cast(NULL AS double)")
    mean = s.roll("avg", y, n)
    first = s.put(f"{mean} - {slope} * {(n - 1) / 2!r}")
    r2 = s.put(f"CASE WHEN {full} THEN CASE WHEN max({y}) {w} = min({y}) {w} THEN 1.0 ELSE regr_r2({y}, {at}) {w} END END")
    return {"value": s.put(f"{mean} + {slope} * {(n - 1) / 2!r}"), "slope": slope, "intercept": first, "r2": r2}


alias("stats.linear_regression", "stats.rolling_regression")
for _n, _c in (("regression_line", "value"), ("regression_value", "value"), ("regression_intercept", "intercept"), ("regression_slope", "slope"), ("rolling_slope", "slope"), ("r_squared", "r2")):
    alias(f"stats.{_n}", "stats.rolling_regression", _c)


@indicator("stats.adjusted_r_squared")
def adjusted_r_squared(s: Sheet, length: int = 14, source: str = "close") -> str:
    return s.put(f"1 - (1 - {rolling_regression(s, length, source)['r2']}) * {(length - 1) / max(1, length - 2)!r}")


@indicator("stats.residual")
def residual(s: Sheet, length: int = 14, source: str = "close") -> str:
    return s.put(f"{price(s, source)} - {rolling_regression(s, length, source)['value']}")


@indicator("stats.residual_standard_error")
def residual_standard_error(s: Sheet, length: int = 14, source: str = "close") -> str:
    r = residual(s, length, source)
    return s.put(f"sqrt({s.roll('sum', f'{r} * {r}', length)} / {float(max(1, length - 2))!r})")


@indicator("stats.regression_channel")
def regression_channel(s: Sheet, length: int = 14, std_mult: float = 2.0, source: str = "close") -> dict[str, str]:
    mid, width = rolling_regression(s, length, source)["value"], residual_standard_error(s, length, source)
    return {"upper": s.put(f"{mid} + {std_mult!r} * {width}"), "middle": mid, "lower": s.put(f"{mid} - {std_mult!r} * {width}")}


@indicator("stats.beta", bench=True)
def beta(s: Sheet, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    own = s.put(f"CASE WHEN {x} IS NOT NULL THEN {y} END")
    return s.put(s.div(f"covar_samp({x}, {y}) {s.whole}", f"var_samp({own}) {s.whole}"))


@indicator("stats.rolling_beta", bench=True)
def rolling_beta(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    return s.put(s.div(s.roll2("covar_samp", x, y, positive(length)), s.roll("var_samp", y, length)))


@indicator("stats.alpha", bench=True)
def alpha(s: Sheet, risk_free_rate: float = 0.0, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    a, b = s.all("avg", simple_return(s, x)), s.all("avg", simple_return(s, y))
    return s.put(f"{a} - {risk_free_rate!r} - {beta(s, source, bench_source)} * ({b} - {risk_free_rate!r})")


@indicator("stats.rolling_alpha", bench=True)
def rolling_alpha(s: Sheet, length: int = 20, risk_free_rate: float = 0.0, source: str = "close", bench_source: str = "close") -> str:
    x, y = pair(s, source, bench_source)
    a, b = s.roll("avg", simple_return(s, x), positive(length)), s.roll("avg", simple_return(s, y), length)
    return s.put(f"{a} - {risk_free_rate!r} - {rolling_beta(s, length, source, bench_source)} * ({b} - {risk_free_rate!r})")


def active(s: Sheet, source: str, bench_source: str) -> str:
    x, y = pair(s, source, bench_source)
    return s.put(f"{simple_return(s, x)} - {simple_return(s, y)}")


@indicator("stats.tracking_error", bench=True)
def tracking_error(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    return s.roll("stddev_samp", active(s, source, bench_source), positive(length))


@indicator("stats.information_ratio", bench=True)
def information_ratio(s: Sheet, length: int = 20, source: str = "close", bench_source: str = "close") -> str:
    return s.put(s.div(s.roll("avg", active(s, source, bench_source), positive(length)), tracking_error(s, length, source, bench_source)))


@indicator("stats.outlier_detection")
def outlier_detection(s: Sheet, length: int = 20, z_thresh: float = 3.0, source: str = "close") -> str:
    return s.mark(s.flag(f"abs({z_score(s, length, source)}) > {z_thresh!r}"), "boolean")


alias("stats.three_sigma_rule", "stats.outlier_detection", z_thresh=3.0)


@indicator("stats.modified_z_outlier")
def modified_z_outlier(s: Sheet, length: int = 20, z_thresh: float = 3.5, source: str = "close") -> str:
    return s.mark(s.flag(f"abs({modified_z_score(s, length, source)}) > {z_thresh!r}"), "boolean")


@indicator("stats.slope_percentage")
def slope_percentage(s: Sheet, length: int = 14, source: str = "close") -> str:
    return s.put(f"100 * {s.div(rolling_regression(s, length, source)['slope'], price(s, source))}")


@indicator("stats.linear_trend_strength")
def linear_trend_strength(s: Sheet, length: int = 14, source: str = "close") -> str:
    return s.put(f"abs({slope_percentage(s, length, source)})")


@indicator("stats.trend_angle")
def trend_angle(s: Sheet, length: int = 14, source: str = "close") -> str:
    return s.put(f"degrees(atan({rolling_regression(s, length, source)['slope']}))")


@indicator("stats.coefficient_of_dispersion")
def coefficient_of_dispersion(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    a, b = s.quantile(x, 0.75, positive(length)), s.quantile(x, 0.25, length)
    return s.put(s.div(f"{a} - {b}", f"{a} + {b}"))


@indicator("stats.relative_standard_deviation")
def relative_standard_deviation(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.put(f"100 * {coefficient_of_variation(s, length, source)}")
