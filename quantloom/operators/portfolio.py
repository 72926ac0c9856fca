"""Weights, constraints, books and their costs, as windows over ``(date, id)`` rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel

EPS = 1e-8


def by_day():
    return Window.partitionBy("date")


def day_sum(c: Column) -> Column:
    return F.sum(c).over(by_day())


def position_cap(w: str = "w", cap: float = 0.10) -> Column:
    return F.greatest(F.least(F.col(w), F.lit(cap)), F.lit(-cap))


def group_cap(w: str = "w", group: str = "cluster", cap: float = 0.40) -> Column:
    """Scales a group down where its gross weight exceeds the cap."""
    gross = F.sum(F.abs(w)).over(Window.partitionBy("date", group))
    return F.when(gross > cap, F.col(w) * cap / gross).otherwise(F.col(w))


def dollar_neutral(w: str = "w", over: Column | None = None) -> Column:
    """Less the mean of the date; with ``over``, of the names for which it holds, the others left alone."""
    if over is None:
        return F.col(w) - F.avg(w).over(by_day())
    return F.when(over, F.col(w) - F.avg(F.when(over, F.col(w))).over(by_day())).otherwise(F.col(w))


def factor_neutral(w: str = "w", b: str = "beta") -> Column:
    """``w - (w.b / b.b) b``."""
    return F.col(w) - F.try_divide(day_sum(F.col(w) * F.col(b)), day_sum(F.col(b) * F.col(b))) * F.col(b)


def two_factor_neutral(w: str, f: str, g: str, ridge: float = EPS) -> Column:
    """``w - F (F'F + ridge I)^-1 F'w`` for two factors, in closed form."""
    ff, gg, fg = day_sum(F.col(f) * F.col(f)) + ridge, day_sum(F.col(g) * F.col(g)) + ridge, day_sum(F.col(f) * F.col(g))
    wf, wg = day_sum(F.col(w) * F.col(f)), day_sum(F.col(w) * F.col(g))
    det = ff * gg - fg * fg
    return F.col(w) - (gg * wf - fg * wg) / det * F.col(f) - (ff * wg - fg * wf) / det * F.col(g)


def factors_neutral(df: DataFrame, factors: list[str], w: str = "w", ridge: float = EPS, worst: float = 1e10) -> DataFrame:
    """``df`` with the weights of each date neutral to all factors at once: ``w - F (F'F + ridge I)^-1 F'w``.

    Where that matrix's condition number reaches ``worst``, to one factor after the other. A date is one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, x = pdf[factors].fillna(0.0).to_numpy(float), pdf[w].fillna(0.0).to_numpy(float)
        gram = f.T @ f + ridge * np.eye(len(factors))
        if np.linalg.cond(gram) < worst:
            x = x - f @ np.linalg.solve(gram, f.T @ x)
        else:
            for column in f.T:
                size = column @ column
                x = x - column * (column @ x / size if size > 0 else 0.0)
        return pdf.assign(**{w: x})

    return df.groupBy("date").applyInPandas(run, df.schema)


def leverage_cap(w: str = "w", cap: float = 1.5) -> Column:
    gross = day_sum(F.abs(w))
    return F.when(gross > cap, F.col(w) * cap / gross).otherwise(F.col(w))


def gross_to(w: str = "w", gross: float = 1.5) -> Column:
    total = day_sum(F.abs(w))
    return F.when(total > 0, F.col(w) * gross / total).otherwise(F.col(w))


def construct(df: DataFrame, beta: str | None = None) -> DataFrame:
    """Position cap, cluster cap, factor neutral, dollar neutral, leverage cap, in this order."""
    out = df.withColumn("w", position_cap()).withColumn("w", group_cap())
    if beta:
        out = out.withColumn("w", factor_neutral("w", beta))
    return out.withColumn("w", dollar_neutral()).withColumn("w", leverage_cap())


def vol_target(weights: DataFrame, returns: DataFrame, target: float = 0.10, window: int = 60, cap: float = 1.5, year: int = 365) -> DataFrame:
    """Weights scaled so that held fixed over the last ``window`` rows they would have had the target volatility.

    ``weights`` and ``returns`` carry ``date_idx``; the population deviation is annualised, the scale capped.
    """
    w = weights.select("date", F.col("date_idx").alias("now"), "id", "w").where("w <> 0")
    seen = returns.select("id", "date_idx", "r").withColumn("now", F.explode(F.sequence(F.col("date_idx") + 1, F.col("date_idx") + window)))
    past = w.join(seen, ["id", "now"])
    daily = past.groupBy("date", "date_idx").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("p"))
    vol = daily.groupBy("date").agg((F.stddev_pop("p") * F.sqrt(F.lit(year))).alias("vol"))
    scale = F.when(F.col("vol") > 0, F.least(F.lit(target) / F.col("vol"), F.lit(cap))).otherwise(F.lit(1.0))
    return weights.join(vol, "date", "left").withColumn("w", F.col("w") * F.coalesce(scale, F.lit(1.0))).drop("vol")


def exposures(df: DataFrame, w: str = "w", least: float = 0.001) -> DataFrame:
    x = F.col(w)
    return df.groupBy("date").agg(
        F.sum(F.abs(x)).alias("gross"), F.sum(x).alias("net"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("long"), F.sum(F.when(x < 0, x).otherwise(0.0)).alias("short"),
        F.count(F.when(x > least, 1)).alias("n_longs"), F.count(F.when(x < -least, 1)).alias("n_shorts"),
    )


def factor_exposure(weights: DataFrame, loadings: DataFrame, w: str = "w", b: str = "beta") -> DataFrame:
    return weights.join(loadings, "id").groupBy("date").agg(F.sum(F.col(w) * F.col(b)).alias("exposure"))


# -- books ----------------------------------------------------------------------------------------


def with_turnover(df: DataFrame, w: str = "w") -> DataFrame:
    """``trade``: change of weight from the row before; the first row trades nothing."""
    return df.withColumn("trade", F.coalesce(F.col(w) - panel.lag(w), F.lit(0.0)))


def book(df: DataFrame, cost_bps: float = 50.0, carry_bps: float = 0.0, w: str = "w", r: str = "r") -> DataFrame:
    """``date, gross, turnover, cost, net`` of weights on returns; a missing product is nothing."""
    day = with_turnover(df, w).groupBy("date").agg(
        F.coalesce(F.sum(F.col(w) * F.col(r)), F.lit(0.0)).alias("gross"), F.sum(F.abs("trade")).alias("turnover"), F.sum(F.abs(w)).alias("exposure")
    )
    return day.withColumn("cost", F.col("turnover") * cost_bps / 1e4 + F.col("exposure") * carry_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))


def cost_grid(day: DataFrame, grid=(10.0, 25.0, 50.0, 100.0, 200.0), year: int = 365) -> DataFrame:
    """Mean, deviation and Sharpe of the net return at each cost."""
    net = day.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(g)) for g in grid)))).withColumn("n", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 1e4)
    return net.groupBy("cost_bps").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std")).withColumn("sharpe", F.col("mean") / (F.col("std") + EPS) * F.sqrt(F.lit(year)))


def breakeven_cost(day: DataFrame, target: float = 0.0, high: float = 500.0, precision: float = 1.0, year: int = 365) -> float | None:
    """Basis points at which the Sharpe ratio falls to the target, by bisection on the moments of one row."""
    m = day.agg(F.avg("gross").alias("g"), F.avg("turnover").alias("t"), F.var_samp("gross").alias("vg"), F.var_samp("turnover").alias("vt"), F.covar_samp("gross", "turnover").alias("c")).first()
    if m["vg"] is None:
        return None

    def sharpe(bps: float) -> float:
        k = bps / 1e4
        var = max(m["vg"] - 2 * k * m["c"] + k * k * m["vt"], 0.0)
        return (m["g"] - k * m["t"]) / (var**0.5 + EPS) * year**0.5

    low = 0.0
    while high - low > precision:
        mid = (low + high) / 2
        low, high = (mid, high) if sharpe(mid) > target else (low, mid)
    return (low + high) / 2


def funding_pnl(weights: DataFrame, funding: DataFrame, w: str = "w", f: str = "funding") -> DataFrame:
    """What shorts receive and longs pay; unknown rates count as none, ``covered`` is the share of gross that has one."""
    both = weights.join(funding, ["date", "id"], "left")
    return both.groupBy("date").agg((-F.sum(F.col(w) * F.coalesce(f, F.lit(0.0)))).alias("pnl"), (F.sum(F.when(F.col(f).isNotNull(), F.abs(w)).otherwise(0.0)) / F.nullif(F.sum(F.abs(w)), F.lit(0.0))).alias("covered"))


def holding_periods(df: DataFrame, w: str = "w", least: float = 0.01) -> DataFrame:
    """Per id: number and lengths of completed holdings, runs of rows with weights beyond ``least``."""
    held = df.withColumn("on", F.coalesce(F.abs(w) > least, F.lit(False)))
    edge = held.withColumn("run", F.sum((~F.col("on") | ~F.coalesce(panel.lag("on"), F.lit(False))).cast("int")).over(panel.by_id().rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.withColumn("end", F.max("date").over(Window.partitionBy("id"))).where("on")
    runs = last.groupBy("id", "run").agg(F.count("*").alias("n"), F.max(F.col("date") == F.col("end")).alias("open")).where("NOT open")
    return runs.groupBy("id").agg(F.count("*").alias("n_holdings"), F.avg("n").alias("mean_days"), F.percentile(F.col("n"), 0.5).alias("median_days"), F.max("n").alias("max_days"))


def trade_summary(df: DataFrame, group: str = "cluster", least: float = 1e-6) -> DataFrame:
    t = F.col("trade")
    return with_turnover(df).groupBy("date", group).agg(
        F.sum(F.abs(t)).alias("turnover"), F.count(F.when(F.abs(t) > least, 1)).alias("n_trades"), F.sum(F.when(t > 0, t).otherwise(0.0)).alias("buys"), F.sum(F.when(t < 0, -t).otherwise(0.0)).alias("sells")
    )


# -- sorted portfolios ----------------------------------------------------------------------------


def quintile(rank: Column, n: Column, k: int = 5) -> Column:
    """Buckets 0 to ``k - 1`` of a first-rank; a rank that falls on an edge goes up."""
    out = F.lit(0)
    for i in range(1, k):
        out = out + (rank >= n * i / k).cast("int")
    return out


def quintile_long_short(dense: DataFrame, characteristic: str, short_high: bool = False, least: int = 10, cost_bps: float = 50.0, r: str = "r_simple", cap: str = "mcap") -> DataFrame:
    """``date, gross, turnover, net``: weekly cap-weighted top minus bottom quintile by the characteristic a row before.

    A row of ``dense`` is a week; the book earns the next row's returns. Dates with fewer than ``least`` names are
    skipped, and the next book trades against the last one held.
    """
    lagged = dense.withColumn("x", panel.lag(characteristic)).withColumn("fwd", F.lead(r).over(panel.by_id()))
    named = lagged.where(F.col("x").isNotNull() & (F.col(cap) > 0) & F.col("fwd").isNotNull())
    order = Window.partitionBy("date").orderBy("x", "id")
    ranked = named.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(by_day())).where(F.col("n") >= least)
    side = F.col("q").isin(0, 4)
    legs = ranked.withColumn("q", quintile(F.col("rank"), F.col("n"))).where(side)
    sign = F.when(F.col("q") == 4, -1.0 if short_high else 1.0).otherwise(1.0 if short_high else -1.0)
    weights = legs.withColumn("w", sign * F.col(cap) / F.sum(cap).over(Window.partitionBy("date", "q")))
    days = weights.select("date").distinct().withColumn("prev", F.lag("date").over(Window.orderBy("date")))
    now = weights.join(days, "date").select("date", "prev", "id", "w", "fwd")
    old = weights.select(F.col("date").alias("prev"), "id", F.col("w").alias("w0"))
    kept = now.join(old, ["prev", "id"], "left").select("date", "w", "fwd", F.abs(F.col("w") - F.coalesce("w0", F.lit(0.0))).alias("t"))
    gone = old.join(days, "prev").join(now.select("date", "id"), ["date", "id"], "left_anti").select("date", F.lit(0.0).alias("w"), F.lit(0.0).alias("fwd"), F.abs("w0").alias("t"))
    day = kept.unionByName(gone).groupBy("date").agg(F.sum(F.col("w") * F.col("fwd")).alias("gross"), F.sum("t").alias("turnover"))
    return day.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)
