"""Rolling and cross-sectional statistics of a dense panel, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel

DAYS = 365
EPS = 1e-8


def half(window: int) -> int:
    return max(1, window // 2)


def mean(x: str, window: int) -> Column:
    return panel.rolling(F.avg, x, window, half(window))


def std(x: str, window: int) -> Column:
    return panel.rolling(F.stddev_samp, x, window, half(window))


def zscore(x: str, window: int, least: int | None = None) -> Column:
    m = half(window) if least is None else least
    return (F.col(x) - panel.rolling(F.avg, x, window, m)) / (panel.rolling(F.stddev_samp, x, window, m) + EPS)


def rolling_sum(x: str, window: int) -> Column:
    return panel.rolling(F.sum, x, window, 1)


def volatility(x: str, window: int = 20, least: int = 1) -> Column:
    return panel.rolling(F.stddev_samp, x, window, least) * F.sqrt(F.lit(DAYS))


def sharpe(x: str, window: int = 60, least: int = 20) -> Column:
    return panel.rolling(F.avg, x, window, least) / (panel.rolling(F.stddev_samp, x, window, least) + EPS) * F.sqrt(F.lit(DAYS))


def beta(x: str, m: str, window: int = 60, least: int = 20) -> Column:
    """Covariance of the pairs by the variance of the market plus a guard."""
    over = panel.frame(window)
    pairs = F.count(F.when(F.col(x).isNotNull() & F.col(m).isNotNull(), 1)).over(over)
    return F.when((pairs >= least) & (F.count(m).over(over) >= least), F.covar_samp(x, m).over(over) / (F.var_samp(m).over(over) + EPS))


def correlation(x: str, m: str, window: int = 60, least: int = 20) -> Column:
    over = panel.frame(window)
    both = F.col(x).isNotNull() & F.col(m).isNotNull()
    return F.when(F.count(F.when(both, 1)).over(over) >= least, F.corr(F.when(both, F.col(x)), F.when(both, F.col(m))).over(over))


def quantile(x: str, q: float, window: int) -> Column:
    """Exact, with linear interpolation."""
    over = panel.frame(window)
    return F.when(F.count(x).over(over) >= half(window), F.percentile(F.col(x), q).over(over))


def demeaned(x: str, window: int | None = None) -> Column:
    return F.col(x) - (panel.rolling(F.avg, x, window, 1) if window else F.avg(x).over(Window.partitionBy("date")))


def standardised(x: str) -> Column:
    within = Window.partitionBy("date")
    return (F.col(x) - F.avg(x).over(within)) / (F.stddev_samp(x).over(within) + EPS)


def signal_zscore(dense: DataFrame, x: str = "r", horizon: int = 5, window: int = 60, lag: int = 1, least: int = 20) -> DataFrame:
    """``signal``: the z-score of the sum over the horizon, one row late so it may be traded on."""
    out = dense.withColumn("_s", rolling_sum(x, horizon))
    return out.withColumn("_z", zscore("_s", window, least)).withColumn("signal", panel.lag("_z", lag)).drop("_s", "_z")


def outliers(x: str, window: int = 60, least: int = 20, limit: float = 5.0) -> Column:
    z = (F.col(x) - panel.rolling(F.avg, x, window, least)) / panel.rolling(F.stddev_samp, x, window, least)
    return F.coalesce(F.abs(z) > limit, F.lit(False))


def winsorised(x: str, window: int = 60, least: int = 20, limit: float = 5.0) -> Column:
    """Clipped to mean plus and minus so many deviations; as it is where there are no bounds."""
    m, s = panel.rolling(F.avg, x, window, least), panel.rolling(F.stddev_samp, x, window, least)
    return F.when(F.col(x).isNotNull(), F.coalesce(F.greatest(F.least(F.col(x), m + limit * s), m - limit * s), F.col(x)))


def ewm_zscore(x: str, halflife: float = 10, least: int = 5, key: str | list[str] = "id") -> Column:
    """``x`` less its exponentially weighted mean over its weighted deviation (bias-corrected, decay by position through
    gaps). Weights are powers of two of ``date_idx / halflife``, so running sums suffice; up to 400 half-lives."""
    over = panel.by_id(key).rowsBetween(Window.unboundedPreceding, 0)
    there = F.col(x).isNotNull()
    w = F.when(there, F.pow(F.lit(2.0), F.col("date_idx") / halflife))
    total = lambda c: F.sum(c).over(over)
    s, s2, sx, sxx = total(w), total(w * w), total(w * F.col(x)), total(w * F.col(x) * F.col(x))
    mu = sx / s
    var = (sxx / s - mu * mu) * (s * s) / F.nullif(s * s - s2, F.lit(0.0))
    return F.when(F.count(x).over(over) >= least, (F.col(x) - mu) / F.nullif(F.sqrt(var), F.lit(0.0)))


def half_life_scale(hl: str, target: float = 3.0) -> Column:
    """``target / half-life`` between a quarter and one; a quarter where it is missing."""
    return F.coalesce(F.greatest(F.least(F.lit(target) / F.col(hl), F.lit(1.0)), F.lit(0.25)), F.lit(0.25))


def factor_beta(x: str, m: str, window: int | None = None) -> Column:
    """Sample covariance over population variance (their degrees of freedom differ on purpose)."""
    if window is None:
        return F.covar_samp(x, m) / F.var_pop(m)
    over = panel.frame(window)
    return F.covar_samp(x, m).over(over) / F.nullif(F.var_pop(m).over(over), F.lit(0.0))


def monthly_sums(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(F.last_day("date").alias("month")).agg(F.sum(x).alias(x))


def weekly_compounded(df: DataFrame, x: str, key: str = "id") -> DataFrame:
    """Returns compounded over weeks that end on Mondays (the Monday included)."""
    end = F.next_day(F.date_sub("date", 1), "MON")
    return df.groupBy(key, end.alias("week")).agg((F.exp(F.sum(F.log1p(F.col(x)))) - 1).alias(x))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(F.width_bucket(F.col(x), F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


