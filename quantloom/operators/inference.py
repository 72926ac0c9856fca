"""Sharpe statistics, paired differences, regressions and stepwise multiple testing."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import cut, sample_kurtosis, sample_skew

YEAR = 365
NORMAL = NormalDist()


def sharpe(x: Column, year: int = YEAR) -> Column:
    return F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.lit(year))


def moments(df: DataFrame, x: str) -> DataFrame:
    """One row: number, mean, deviation, bias-corrected skewness and excess kurtosis."""
    c = F.col(x)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), sample_skew(c).alias("skew"), sample_kurtosis(c).alias("kurtosis"))


def probabilistic_sharpe(df: DataFrame, x: str, benchmark: float = 0.0) -> DataFrame:
    """``z`` of the per-period Sharpe ratio over the benchmark, whose normal probability is the PSR."""
    m = moments(df, x).withColumn("s", F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)))
    spread = F.sqrt(1 - F.col("skew") * F.col("s") + (F.col("kurtosis") + 2) / 4 * F.col("s") * F.col("s"))
    return m.withColumn("z", (F.col("s") - benchmark) * F.sqrt(F.col("n") - 1) / spread)


def psr(z: float | None) -> float | None:
    return None if z is None else NORMAL.cdf(z)


def expected_max_sharpe(trials: int, variance: float, mean: float = 0.0) -> float:
    """Expected largest of so many normal Sharpe ratios."""
    if trials < 2 or variance <= 0:
        return mean
    euler = 0.5772156649015329
    return mean + math.sqrt(variance) * ((1 - euler) * NORMAL.inv_cdf(1 - 1 / trials) + euler * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, x: str, trial_sharpes: list[float]) -> float | None:
    """PSR against the expected maximum of the trials; their Sharpe ratios are per period."""
    bar = expected_max_sharpe(len(trial_sharpes), float(np.var(trial_sharpes, ddof=1)) if len(trial_sharpes) > 1 else 0.0)
    return psr(probabilistic_sharpe(df, x, bar).first()["z"])


def sharpe_by_year(df: DataFrame, x: str = "net", least: int = 30) -> DataFrame:
    out = df.groupBy(F.year("date").alias("year")).agg(F.count(x).alias("n"), sharpe(F.col(x)).alias("sharpe"))
    return out.where((F.col("n") >= least) & F.col("sharpe").isNotNull())


def best_days(df: DataFrame, x: str = "net", k: int = 10) -> DataFrame:
    """Sharpe with and without the ``k`` best days, and their share of the total. Dates are unique."""
    top = df.where(F.col(x).isNotNull()).orderBy(F.desc(x), "date").limit(k).select("date", F.lit(True).alias("best"))
    marked = df.join(F.broadcast(top), "date", "left")
    rest = F.when(F.col("best").isNull(), F.col(x))
    return marked.agg(F.count(x).alias("n"), sharpe(F.col(x)).alias("sharpe"), sharpe(rest).alias("sharpe_ex_best"), (F.sum(F.when(F.col("best"), F.col(x))) / F.sum(x)).alias("share_of_total"))


def paired_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and standard error of ``a - b`` over the dates that both have."""
    d = a.join(b, "date").select((F.col("a") - F.col("b")).alias("d")).where("d IS NOT NULL")
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


def ols_one(df: DataFrame, y: str, x: str) -> DataFrame:
    """Intercept, slope, its classical t and R-squared of one regressor."""
    f = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(
        F.count("*").alias("n"), F.regr_intercept(F.col(y), F.col(x)).alias("alpha"), F.regr_slope(F.col(y), F.col(x)).alias("beta"), F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.regr_syy(F.col(y), F.col(x)).alias("syy"), F.regr_sxx(F.col(y), F.col(x)).alias("sxx"),
    )
    return f.withColumn("t_beta", F.col("beta") / F.sqrt(F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2) / F.col("sxx")))


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``name, coef, t`` (with ``intercept``) from the normal equations, whose sums are all that leaves the cluster."""
    rows = df.dropna(subset=[y, *xs])
    cols = [F.lit(1.0), *(F.col(c) for c in xs)]
    k = len(cols)
    sums = rows.agg(F.count("*"), F.sum(F.col(y) * F.col(y)), *(F.sum(a * F.col(y)) for a in cols), *(F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k))).first()
    n, yy, xy, xx = sums[0], sums[1], np.array(sums[2 : 2 + k], float), np.array(sums[2 + k :], float).reshape(k, k)
    coef = np.linalg.solve(xx, xy)
    s2 = max(yy - coef @ xy, 0.0) / (n - k)
    t = coef / np.sqrt(s2 * np.diag(np.linalg.inv(xx)))
    return df.sparkSession.createDataFrame([(m, float(c), float(v)) for m, c, v in zip(["intercept", *xs], coef, t)], "name string, coef double, t double")


def block_indices(n: int, reps: int, block: int, seed: int) -> np.ndarray:
    """Rows of circular block bootstrap samples of ``n`` positions."""
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n, (reps, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(reps, -1)[:, :n]


def romano_wolf(returns: DataFrame, reps: int = 1000, alpha: float = 0.05, seed: int = 0, two_sided: bool = True) -> DataFrame:
    """``strategy, t, critical, significant`` for a long table ``date, strategy, ret`` without gaps.

    The positions of the bootstrap samples are counted on the driver (a row per replicate and block start) and joined
    to block sums, so the resampling itself runs as joins and sums over ``(replicate, strategy)``.
    """
    spark = returns.sparkSession
    days = returns.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    long = returns.join(days, "date")
    n = days.count()
    block = max(1, round(n ** (1 / 3)))
    idx = block_indices(n, reps, block, seed)
    picks = spark.createDataFrame([(r, int(p), int(c)) for r in range(reps) for p, c in zip(*np.unique(idx[r], return_counts=True))], "rep int, pos int, k int")
    base = long.groupBy("strategy").agg(F.avg("ret").alias("mu"), (F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("se")).withColumn("t", F.col("mu") / F.col("se"))
    drawn = long.join(picks, "pos").groupBy("rep", "strategy").agg((F.sum(F.col("ret") * F.col("k")) / n).alias("mb"), (F.sum(F.col("ret") * F.col("ret") * F.col("k")) / n).alias("m2"))
    sd = F.sqrt(F.greatest(F.col("m2") - F.col("mb") * F.col("mb"), F.lit(0.0)) * n / (n - 1) / n)
    null = drawn.join(base, "strategy").select("rep", "strategy", ((F.col("mb") - F.col("mu")) / F.nullif(sd, F.lit(0.0))).alias("tb"))
    sized = (lambda c: F.abs(c)) if two_sided else (lambda c: F.col(c))
    null = cut(null.select("rep", "strategy", sized("tb").alias("tb")))
    # a step needs the maxima of the replicates over the strategies still open: one number a replicate
    table = cut(base.select("strategy", "t", sized("t").alias("stat"), F.lit(None).cast("double").alias("critical"), F.lit(False).alias("significant")))
    while True:
        maxima = null.join(table.where(~F.col("significant")).select("strategy"), "strategy").groupBy("rep").agg(F.max("tb").alias("m"))
        bar = maxima.agg(F.percentile("m", 1 - alpha)).first()[0]
        if bar is None:
            break
        hit = ~F.col("significant") & (F.coalesce(F.col("stat"), F.lit(0.0)) > bar)
        new = table.where(hit).count()
        table = cut(table.withColumn("critical", F.when(F.col("significant"), F.col("critical")).otherwise(F.lit(float(bar)))).withColumn("significant", F.col("significant") | hit))
        if not new:
            break
    return table.select("strategy", "t", "critical", "significant")
