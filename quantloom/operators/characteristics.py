"""Characteristics of ids on a dense panel, as columns. A missing value is null; frames count calendar rows.

Columns that a builder reads: ``price``, ``volume``, ``mcap``, ``r`` (log return) and ``m`` (market return of the date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import frame, lag, positive, rolling, sample_skew

YEAR = 365


def momentum(window: int) -> Column:
    return rolling(F.sum, "r", window, max(2, window // 2))


def size() -> Column:
    return F.ln(positive("mcap"))


def high(window: int = YEAR, least: int = 60) -> Column:
    return F.col("price") / rolling(F.max, "price", window, least)


def dollar_volume(window: int = 30, least: int = 5) -> Column:
    return rolling(F.avg, F.ln(positive("volume")), window, least)


def turnover(window: int = 30, least: int = 5) -> Column:
    return rolling(F.avg, F.try_divide(F.col("volume"), positive("mcap")), window, least)


def amihud(window: int = 30, least: int = 5) -> Column:
    return rolling(F.avg, F.abs("r") / positive("volume"), window, least) * 1e9


def volatility(window: int = 30, least: int = 5) -> Column:
    return rolling(F.stddev_samp, "r", window, least)


def max_return(window: int = 30, least: int = 5) -> Column:
    return rolling(F.max, "r", window, least)


def skew(window: int = 90, least: int = 20) -> Column:
    x, over = F.col("r"), frame(window)
    n = F.count(x).over(over)
    g1 = F.skewness(x).over(over) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n >= least) & (n >= 3), g1)


def covariance_over_variance(x: Column, m: Column, window: int, least: int) -> Column:
    """Covariance over the pairs present by the variance over *all* values of ``m`` in the frame."""
    over = frame(window)
    pairs = F.count(F.when(x.isNotNull() & m.isNotNull(), 1)).over(over)
    var = F.when(F.count(m).over(over) >= least, F.var_samp(m).over(over))
    return F.when(pairs >= least, F.try_divide(F.covar_samp(x, m).over(over), var))


def beta(window: int = 90, least: int = 20) -> Column:
    return covariance_over_variance(F.col("r"), F.col("m"), window, least)


def downside_beta(window: int = 90, least: int = 20) -> Column:
    down = F.col("m") < 0
    return covariance_over_variance(F.when(down, F.col("r")), F.when(down, F.col("m")), window, least)


def acceleration() -> Column:
    recent = rolling(F.sum, "r", 28, 14)
    return recent - (rolling(F.sum, "r", 84, 42) - recent) * (28 / 56)


def trend() -> Column:
    return F.ln(rolling(F.avg, "price", 28, 14) / rolling(F.avg, "price", 180, 90))


def turning_points(dense: DataFrame, window: int = 90, least: int = 20) -> DataFrame:
    """Share of rows in the frame where the return's sign flips; rows without a return count as no flip."""
    sign = F.signum("r")
    flip = F.coalesce((sign * lag(sign)) < 0, F.lit(False)).cast("double")
    return dense.withColumn("_flip", flip).withColumn("turning_points", F.when(F.count("r").over(frame(window)) >= least, F.avg("_flip").over(frame(window)))).drop("_flip")


def idiosyncratic_volatility(dense: DataFrame, window: int = 30, least: int = 5) -> DataFrame:
    """Deviation of what a rolling beta to the market leaves; the beta is that of the same row."""
    left = dense.withColumn("_e", F.col("r") - covariance_over_variance(F.col("r"), F.col("m"), window, least) * F.col("m"))
    return left.withColumn("ivol", rolling(F.stddev_samp, "_e", window, least)).drop("_e")


#: name -> (column builder, whether the short side is the high one)
REGISTRY = {
    "size": (size, True),
    **{f"mom_{n}w": ((lambda d: lambda: momentum(d))(7 * n), False) for n in (1, 2, 4, 8, 12, 26, 52)},
    "reversal_1w": (lambda: -momentum(7), False),
    "lt_reversal": (lambda: -momentum(364), False),
    "high_52w": (high, False),
    "dollar_volume": (dollar_volume, True),
    "turnover": (turnover, True),
    "amihud": (amihud, False),
    "volatility": (volatility, True),
    "max_return": (max_return, True),
    "skew": (skew, True),
    "beta": (beta, True),
    "downside_beta": (downside_beta, True),
    "acceleration": (acceleration, False),
    "trend": (trend, False),
}
#: Those that need a column of their own first: name -> (DataFrame step, sign).
STEPS = {"ivol": (idiosyncratic_volatility, True), "turning_points": (turning_points, False)}


def build(dense: DataFrame, names: list[str]) -> DataFrame:
    """``dense`` with the named characteristics; frames of one length share a window."""
    out = dense
    for name in (n for n in names if n in STEPS):
        out = STEPS[name][0](out)
    return out.withColumns({n: REGISTRY[n][0]() for n in names if n in REGISTRY})


def cross_rank(name: str) -> Column:
    """Place of the value among those of its date, from 0 to 1 by order and id."""
    w = Window.partitionBy("date").orderBy(F.col(name).asc_nulls_last(), "id")
    return F.when(F.col(name).isNotNull(), F.row_number().over(w))
