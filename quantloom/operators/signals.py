"""Mean-reversion signals on given clusters, and the weights made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel, rolling
from .rolling import EPS

def by_group():
    return Window.partitionBy("date", "cluster")


def composite(dense: DataFrame, r: str = "r", inverse_vol: bool = False) -> DataFrame:
    """``composite``: the cluster's mean return, equal or by inverse volatility over 20 rows."""
    if not inverse_vol:
        return dense.withColumn("composite", F.avg(r).over(by_group()))
    weighed = dense.withColumn("_v", 1 / (panel.rolling(F.stddev_samp, r, 20, 5) + EPS))
    v = F.when(F.col(r).isNotNull(), F.col("_v"))
    return weighed.withColumn("composite", F.sum(F.col(r) * v).over(by_group()) / F.sum(v).over(by_group())).drop("_v")


def deviation_signal(dense: DataFrame, r: str = "r", lookback: int = 5, window: int = 60, lag: int = 1) -> DataFrame:
    """``signal``: z-score of the summed deviation from the cluster, a row late."""
    out = composite(dense, r).withColumn("deviation", F.col(r) - F.col("composite"))
    return rolling.signal_zscore(out, "deviation", lookback, window, lag)


def balanced_legs(w: str = "w") -> Column:
    """Both legs of a cluster to the same gross (their mean); one-sided clusters to zero."""
    up, down = F.sum(F.greatest(F.col(w), F.lit(0.0))).over(by_group()), F.sum(F.greatest(-F.col(w), F.lit(0.0))).over(by_group())
    half = (up + down) / 2
    return F.when((up > 0) & (down > 0), F.when(F.col(w) > 0, F.col(w) * half / up).otherwise(F.col(w) * half / down)).otherwise(F.lit(0.0))


def quantile_weights(df: DataFrame, signal: str = "signal", q: float = 0.2) -> DataFrame:
    """``w``: equal long leg of the lowest signals, equal short leg of the highest, ``max(1, int(q m))`` names each."""
    x = F.col(signal)
    m = F.count(x).over(by_group())
    n = F.greatest(F.lit(1), F.floor(m * q))
    low = F.row_number().over(by_group().orderBy(x.asc_nulls_last(), "id"))
    high = F.row_number().over(by_group().orderBy(x.desc_nulls_last(), F.desc("id")))
    return df.withColumn("w", F.when(x.isNull(), 0.0).when(high <= n, -1.0 / n).when(low <= n, 1.0 / n).otherwise(0.0))


def threshold_weights(df: DataFrame, signal: str = "signal", limit: float = 1.5) -> DataFrame:
    """``w``: equal legs of the names beyond the threshold on either side."""
    x = F.col(signal)
    low, high = x < -limit, x > limit
    return df.withColumn("w", F.coalesce(F.when(low, 1.0 / F.count(F.when(low, 1)).over(by_group())).when(high, -1.0 / F.count(F.when(high, 1)).over(by_group())), F.lit(0.0)))


def inverse_vol_weights(df: DataFrame, r: str = "r") -> DataFrame:
    """``iv``: inverse volatility over 20 rows (10 at least), a row late, summing to one on each date."""
    raw = df.withColumn("_iv", panel.lag(1 / (panel.rolling(F.stddev_samp, r, 20, 10) + EPS)))
    return raw.withColumn("iv", F.col("_iv") / F.sum("_iv").over(Window.partitionBy("date"))).drop("_iv")


def vol_scaled(w: str = "w", iv: str = "iv") -> Column:
    """Weights by inverse volatility within the cluster: missing ones at par, renormalised, times the number of names."""
    m = F.count("*").over(by_group())
    filled = F.coalesce(F.col(iv), 1.0 / m)
    return F.col(w) * filled / F.sum(filled).over(by_group()) * m


def target_weights(df: DataFrame, signal: str = "signal", q: float = 0.2) -> DataFrame:
    """Quantile legs, volatility scale, balanced legs, then dollar neutrality over the names traded."""
    out = inverse_vol_weights(quantile_weights(df, signal, q)).withColumn("w", vol_scaled()).withColumn("w", balanced_legs())
    traded = F.col("w") != 0
    return out.withColumn("w", F.when(traded, F.col("w") - F.avg(F.when(traded, F.col("w"))).over(Window.partitionBy("date"))).otherwise(F.lit(0.0)))


def deviation_weights(df: DataFrame, signal: str = "signal", limit: float = 1.5) -> DataFrame:
    """Threshold legs, demeaned over the selected names of each cluster, then over all traded names."""
    out = threshold_weights(df, signal, limit)
    chosen = F.col("w") != 0
    out = out.withColumn("w", F.when(chosen, F.col("w") - F.avg(F.when(chosen, F.col("w"))).over(by_group())).otherwise(F.lit(0.0)))
    traded = F.abs("w") > 1e-12
    return out.withColumn("w", F.when(traded, F.col("w") - F.avg(F.when(traded, F.col("w"))).over(Window.partitionBy("date"))).otherwise(F.lit(0.0)))


def beta_residual_signal(dense: DataFrame, r: str = "r", window: int = 60, least: int = 20) -> DataFrame:
    """``signal``: what the beta of the row before leaves of the return, summed over 20 rows and scored over 20."""
    out = composite(dense, r)
    over = panel.frame(window)
    pairs = F.count(F.when(F.col(r).isNotNull() & F.col("composite").isNotNull(), 1)).over(over)
    out = out.withColumn("_b", F.when(pairs >= least, F.try_divide(F.covar_samp(r, "composite").over(over), F.var_samp("composite").over(over))))
    out = out.withColumn("_e", F.col(r) - panel.lag("_b") * F.col("composite")).withColumn("_s", panel.rolling(F.sum, "_e", 20, 5))
    return out.withColumn("_z", rolling.zscore("_s", 20, 5)).withColumn("signal", panel.lag("_z")).drop("_b", "_e", "_s", "_z")


def ou_scores(dense: DataFrame, x: str = "deviation", window: int = 60, max_half_life: float | None = None, max_missing: float = 0.2) -> DataFrame:
    """``s``: distance of the cumulated ``x`` within the window from its fitted mean, in equilibrium deviations.

    The window's cumulated sum is regressed on itself a row before; null unless 0 < b < 1. All of it comes from sums
    over the window by self-join on ``date_idx``; missing values count as zero where at most ``max_missing`` are.
    """
    a = dense.select("id", "date", F.col("date_idx").alias("now")).where(F.col("date_idx") >= window - 1)
    b = dense.select("id", F.col("date_idx").alias("t"), F.col(x).alias("x"))
    # each row goes to the windows that it is in, and meets them by equality
    within = b.withColumn("now", F.explode(F.sequence(F.col("t"), F.col("t") + window - 1))).join(a, ["id", "now"])
    over = Window.partitionBy("id", "now").orderBy("t")
    path = within.withColumn("y", F.sum(F.coalesce("x", F.lit(0.0))).over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("y0", F.lag("y").over(over))
    fit = path.groupBy("id", "date").agg(
        (F.covar_pop("y0", "y") / F.nullif(F.var_pop(F.when(F.col("y0").isNotNull(), F.col("y0"))), F.lit(0.0))).alias("b"),
        F.avg(F.when(F.col("y0").isNotNull(), F.col("y"))).alias("my"), F.avg("y0").alias("m0"), F.var_pop(F.when(F.col("y0").isNotNull(), F.col("y"))).alias("vy"), F.var_pop("y0").alias("v0"),
        F.max_by("y", "t").alias("last"), F.avg(F.col("x").isNull().cast("double")).alias("missing"),
    )
    ok = (F.col("b") > 0) & (F.col("b") < 1) & (F.col("missing") <= max_missing)
    if max_half_life is not None:
        ok = ok & (F.lit(0.6931471805599453) / -F.ln(F.col("b")) <= max_half_life)
    mean = (F.col("my") - F.col("b") * F.col("m0")) / (1 - F.col("b"))
    noise = F.greatest(F.col("vy") - F.col("b") * F.col("b") * F.col("v0"), F.lit(0.0))
    deviation = F.sqrt(noise / (1 - F.col("b") * F.col("b")))
    scored = fit.withColumn("s", F.when(ok, (F.col("last") - mean) / F.nullif(deviation, F.lit(0.0)))).withColumn("half_life", F.when(ok, F.lit(0.6931471805599453) / -F.ln(F.col("b"))))
    return dense.join(scored.select("id", "date", "s", "half_life"), ["id", "date"], "left")


def momentum_clusters(dense: DataFrame, r: str = "r", window: int = 28, share: float = 0.5) -> DataFrame:
    """``date, cluster``: the clusters with the highest mean return over the window before the date."""
    daily = dense.groupBy("cluster", "date").agg(F.avg(r).alias("r"))
    past = Window.partitionBy("cluster").orderBy("date").rowsBetween(-window, -1)
    ranked = daily.withColumn("m", F.sum("r").over(past)).where("m IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("m"), "cluster"))).withColumn("n", F.count("*").over(Window.partitionBy("date")))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).select("date", "cluster")


def between_cluster_weights(dense: DataFrame, r: str = "r", window: int = 28, least: int = 5) -> DataFrame:
    """``date, cluster, w``: clusters by the percentile of their momentum, centred, spread over members, gross one."""
    daily = dense.groupBy("date", "cluster").agg(F.avg(r).alias("c"), F.count("*").alias("members"))
    mom = panel.rolling(F.sum, "c", window, least, "cluster")
    out = daily.withColumn("_m", mom).withColumn("m", panel.lag("_m", key="cluster"))
    out = out.withColumn("s", (panel.rank_pct("m", "date") - 0.5) * 2)
    out = out.withColumn("s", (F.col("s") - F.avg("s").over(Window.partitionBy("date"))) / F.col("members"))
    gross = F.sum(F.abs("s") * F.col("members")).over(Window.partitionBy("date"))
    return out.select("date", "cluster", (F.col("s") / F.nullif(gross, F.lit(0.0))).alias("w"))


def cointegrated_pairs(dense: DataFrame, price: str = "price", least: float = 0.7, top: int = 5) -> DataFrame:
    """``cluster, a, b, corr, p_value``: pairs within a cluster whose prices correlate, by 1 - |corr|; the best few."""
    x = dense.select("date", "cluster", F.col("id").alias("a"), F.col(price).alias("x"))
    y = dense.select("date", "cluster", F.col("id").alias("b"), F.col(price).alias("y"))
    pairs = x.join(y, ["date", "cluster"]).where("a < b AND x IS NOT NULL AND y IS NOT NULL").groupBy("cluster", "a", "b").agg(F.corr("x", "y").alias("corr"))
    found = pairs.where(F.abs("corr") > least).withColumn("p_value", 1 - F.abs("corr"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("p_value", "a", "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def pair_weights(dense: DataFrame, pairs: DataFrame, price: str = "price", window: int = 20, least: int = 10, entry: float = 2.0, size: float = 0.1) -> DataFrame:
    """``date, a, b, z, w``: spread of the pair, its z-score, and the weight of ``a`` (``b`` gets the opposite), a row late."""
    leg = lambda n: dense.select("date", F.col("id").alias(n), F.col(price).alias(f"p{n}"))
    spread = pairs.select("a", "b").join(leg("a"), "a").join(leg("b"), ["date", "b"]).withColumn("spread", F.col("pa") - F.col("pb"))
    key = ["a", "b"]
    z = (F.col("spread") - panel.rolling(F.avg, "spread", window, least, key)) / (panel.rolling(F.stddev_samp, "spread", window, least, key) + EPS)
    signal = F.when(F.col("z") > entry, -1.0).when(F.col("z") < -entry, 1.0).otherwise(0.0)
    out = spread.withColumn("z", z).withColumn("_s", signal)
    return out.withColumn("w", F.coalesce(panel.lag("_s", key=key), F.lit(0.0)) * size).select("date", "a", "b", "z", "w")
