"""Characteristic and rolling-statistics plans over the weekly panel, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import characteristics, panel, returns, rolling

from . import data


def _built(spark, sf, names, digits=6):
    return characteristics.build(data.dense_week(spark, sf), names).select("date", "id", *(F.round(n, digits).alias(n) for n in names))


def momentum_family(spark, sf):
    return _built(spark, sf, ["mom_1w", "mom_2w", "mom_4w", "mom_8w", "mom_12w", "mom_26w", "mom_52w", "reversal_1w", "lt_reversal"], 9)


def liquidity_family(spark, sf):
    return _built(spark, sf, ["size", "dollar_volume", "turnover", "amihud"])


def risk_family(spark, sf):
    return _built(spark, sf, ["volatility", "max_return", "skew", "ivol"])


def beta_family(spark, sf):
    return _built(spark, sf, ["beta", "downside_beta"])


def trend_family(spark, sf):
    return _built(spark, sf, ["high_52w", "acceleration", "trend", "turning_points"], 10)


def rolling_stats_suite(spark, sf):
    dense = data.dense_week(spark, sf)
    cols = {
        "roll_sum": rolling.rolling_sum("r", 5), "roll_mean": rolling.mean("r", 20), "roll_std": rolling.std("r", 20), "z": rolling.zscore("r", 20), "vol": rolling.volatility("r"),
        "sharpe": rolling.sharpe("r"), "beta": rolling.beta("r", "m"), "corr": rolling.correlation("r", "m"), "q25": rolling.quantile("r", 0.25, 20),
        "xdemeaned": rolling.demeaned("r"), "xstd": rolling.standardised("r"), "tdemeaned": rolling.demeaned("r", 10),
    }
    return dense.withColumns(cols).select("date", "id", *(F.round(c, 5).alias(c) for c in cols))


def signal_zscore(spark, sf):
    return rolling.signal_zscore(data.dense_week(spark, sf)).select("date", "id", F.round("signal", 5).alias("signal"))


def ewm_zscore(spark, sf):
    dense = data.dense_week(spark, sf)
    return dense.select("date", "id", F.round(rolling.ewm_zscore("r", 10, 5), 5).alias("z"))


def cross_rank(spark, sf):
    return data.dense_week(spark, sf).select("date", "id", F.round(panel.rank_pct("volume", "date"), 6).alias("pct"))


def outlier_cleaning(spark, sf):
    dense = data.dense_week(spark, sf)
    out = dense.withColumn("flag", rolling.outliers("r", limit=2.5)).withColumn("w", rolling.winsorised("r", limit=2.5))
    return out.groupBy("id").agg(F.sum(F.col("flag").cast("bigint")).alias("n_outliers"), F.round(F.sum("w"), 5).alias("winsorised_sum"))


def cumulative_drawdown(spark, sf):
    dense = data.dense_week(spark, sf).withColumn("c", returns.cumulative("r"))
    return dense.withColumn("dd", returns.drawdown("c")).select("date", "id", F.round("c", 9).alias("cum"), F.round("dd", 9).alias("drawdown"))


def filled_prices(spark, sf):
    return data.dense_week(spark, sf).select("date", "id", F.round(panel.fill_forward("price", 3), 6).alias("price"), F.round(returns.simple_return(), 6).alias("simple"))


def buy_and_hold(spark, sf):
    dense = data.dense_week(spark, sf).withColumn("r_simple", F.round(F.expm1("r"), 9))
    month = F.date_trunc("month", "date").cast("date")
    equal = returns.buy_and_hold(dense, month).withColumnRenamed("growth", "equal")
    weighted = returns.buy_and_hold(dense, month, weight="mcap").withColumnRenamed("growth", "weighted")
    return equal.join(weighted, "month").select("month", F.round("equal", 6).alias("equal"), F.round("weighted", 6).alias("weighted"))


def full_betas(spark, sf):
    return data.dense_week(spark, sf).groupBy("id").agg(F.round(rolling.factor_beta("r", "m"), 6).alias("beta"))


def report_tables(spark, sf):
    """Monthly sums and the histogram of returns that a report would draw."""
    dense = data.dense_week(spark, sf)
    months = rolling.monthly_sums(dense.where("r IS NOT NULL"), "m").select(F.lit("month").alias("kind"), F.col("month").cast("string").alias("at"), F.round("m", 9).alias("value"))
    hist = rolling.histogram(dense, "r", -2.0, 2.0, 20).select(F.lit("hist"), F.lpad(F.col("bucket").cast("string"), 2, "0"), F.col("n").cast("double"))
    return months.union(hist)


def weekly_resample(spark, sf):
    users = data.user_days(spark, sf).withColumn("x", F.round(F.col("value") / 1000, 6))
    return rolling.weekly_compounded(users, "x").select("id", "week", F.round("x", 6).alias("x"))


def characteristic_ranks(spark, sf):
    built = characteristics.build(data.dense_week(spark, sf), ["mom_4w"]).withColumn("mom_4w", F.round("mom_4w", 6))
    return built.select("date", "id", characteristics.cross_rank("mom_4w").alias("rank"))


QUERIES = [momentum_family, liquidity_family, risk_family, beta_family, trend_family, rolling_stats_suite, signal_zscore, ewm_zscore, cross_rank, outlier_cleaning, cumulative_drawdown, filled_prices, buy_and_hold, full_betas, report_tables, weekly_resample, characteristic_ranks]


def _w(n: int) -> str:
    return f"(PARTITION BY id ORDER BY date ROWS {n - 1} PRECEDING)"


def _roll(fn: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} >= {least} THEN {fn}({x}) OVER {_w(n)} END"


def _mom(d: int) -> str:
    return _roll("sum", "r", d, max(2, d // 2))


def _beta(x: str, m: str, n: int, least: int) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {m} IS NOT NULL THEN 1 END) OVER {_w(n)} >= {least} AND count({m}) OVER {_w(n)} >= {least} THEN covar_samp({x}, {m}) OVER {_w(n)} / var_samp({m}) OVER {_w(n)} END"


def _sel(cols: dict[str, str], n: int = 6, source: str = "dense") -> str:
    return "SELECT date, id, " + ", ".join(f"round({v}, {n}) AS {k}" for k, v in cols.items()) + f" FROM {source}"


_D = f"WITH {data.DENSE}"
SQL = {
    "momentum_family": f"{_D} " + _sel({**{f"mom_{w}w": _mom(7 * w) for w in (1, 2, 4, 8, 12, 26, 52)}, "reversal_1w": f"-({_mom(7)})", "lt_reversal": f"-({_mom(364)})"}, 9),
    "liquidity_family": f"{_D} " + _sel({"size": "ln(mcap)", "dollar_volume": _roll("avg", "ln(volume)", 30, 5), "turnover": _roll("avg", "(volume / mcap)", 30, 5), "amihud": f"({_roll('avg', '(abs(r) / volume)', 30, 5)}) * 1e9"}),
    "risk_family": f"{_D}, e AS (SELECT *, r - ({_beta('r', 'm', 30, 5)}) * m AS e FROM dense) "
    + _sel({"volatility": _roll("stddev_samp", "r", 30, 5), "max_return": _roll("max", "r", 30, 5), "skew": _roll("skewness", "r", 90, 20), "ivol": _roll("stddev_samp", "e", 30, 5)}, source="e"),
    "beta_family": f"{_D}, d AS (SELECT *, CASE WHEN m < 0 THEN r END AS rd, CASE WHEN m < 0 THEN m END AS md FROM dense) " + _sel({"beta": _beta("r", "m", 90, 20), "downside_beta": _beta("rd", "md", 90, 20)}, source="d"),
    "trend_family": f"{_D}, s AS (SELECT *, CASE WHEN coalesce(sign(r) * lag(sign(r)) OVER (PARTITION BY id ORDER BY date) < 0, FALSE) THEN 1.0 ELSE 0.0 END AS flip FROM dense) "
    + _sel({
        "high_52w": f"price / ({_roll('max', 'price', 365, 60)})",
        "acceleration": f"({_roll('sum', 'r', 28, 14)}) - (({_roll('sum', 'r', 84, 42)}) - ({_roll('sum', 'r', 28, 14)})) * 0.5",
        "trend": f"ln(({_roll('avg', 'price', 28, 14)}) / ({_roll('avg', 'price', 180, 90)}))",
        "turning_points": f"CASE WHEN count(r) OVER {_w(90)} >= 20 THEN avg(flip) OVER {_w(90)} END",
    }, 10, "s"),
    "rolling_stats_suite": f"{_D} " + _sel({
        "roll_sum": _roll("sum", "r", 5, 1), "roll_mean": _roll("avg", "r", 20, 10), "roll_std": _roll("stddev_samp", "r", 20, 10),
        "z": f"(r - ({_roll('avg', 'r', 20, 10)})) / (({_roll('stddev_samp', 'r', 20, 10)}) + 1e-8)", "vol": f"({_roll('stddev_samp', 'r', 20, 1)}) * sqrt(365)",
        "sharpe": f"({_roll('avg', 'r', 60, 20)}) / (({_roll('stddev_samp', 'r', 60, 20)}) + 1e-8) * sqrt(365)",
        "beta": _beta("r", "m", 60, 20).replace(f"var_samp(m) OVER {_w(60)}", f"(var_samp(m) OVER {_w(60)} + 1e-8)"),
        "corr": f"CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER {_w(60)} >= 20 THEN corr(r, m) OVER {_w(60)} END",
        "q25": f"CASE WHEN count(r) OVER {_w(20)} >= 10 THEN quantile_cont(r, 0.25) OVER {_w(20)} END",
        "xdemeaned": "r - avg(r) OVER (PARTITION BY date)", "xstd": "(r - avg(r) OVER (PARTITION BY date)) / (stddev_samp(r) OVER (PARTITION BY date) + 1e-8)", "tdemeaned": f"r - ({_roll('avg', 'r', 10, 1)})",
    }, 5),
    "signal_zscore": f"{_D}, s AS (SELECT *, {_roll('sum', 'r', 5, 1)} AS s FROM dense), z AS (SELECT *, (s - ({_roll('avg', 's', 60, 20)})) / (({_roll('stddev_samp', 's', 60, 20)}) + 1e-8) AS z FROM s) SELECT date, id, round(lag(z) OVER (PARTITION BY id ORDER BY date), 5) AS signal FROM z",
    "ewm_zscore": f"{_D}, p AS (SELECT a.id, a.date, a.r AS x, b.r AS y, pow(0.5, (a.date_idx - b.date_idx) / 10.0) AS w FROM dense a JOIN dense b ON a.id = b.id AND b.date_idx <= a.date_idx AND b.r IS NOT NULL), "
    "g AS (SELECT id, date, any_value(x) AS x, count(*) AS n, sum(w) AS w, sum(w * w) AS w2, sum(w * y) / sum(w) AS mu FROM p GROUP BY 1, 2), v AS (SELECT p.id, p.date, sum(p.w * (y - mu) * (y - mu)) AS s FROM p JOIN g ON p.id = g.id AND p.date = g.date GROUP BY 1, 2) "
    "SELECT d.date, d.id, round(CASE WHEN n >= 5 THEN (g.x - mu) / nullif(sqrt(s / w * (w * w) / nullif(w * w - w2, 0)), 0) END, 5) AS z FROM dense d LEFT JOIN g ON d.id = g.id AND d.date = g.date LEFT JOIN v ON d.id = v.id AND d.date = v.date",
    "cross_rank": f"{_D} SELECT date, id, round(CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY volume NULLS LAST) + (count(volume) OVER (PARTITION BY date, volume) - 1) / 2) / count(volume) OVER (PARTITION BY date) END, 6) AS pct FROM dense",
    "outlier_cleaning": f"{_D}, b AS (SELECT id, r, {_roll('avg', 'r', 60, 20)} AS a, {_roll('stddev_samp', 'r', 60, 20)} AS s FROM dense) SELECT id, CAST(sum(CASE WHEN coalesce(abs((r - a) / s) > 2.5, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, round(sum(CASE WHEN a IS NULL OR s IS NULL THEN r ELSE greatest(least(r, a + 2.5 * s), a - 2.5 * s) END) FILTER (r IS NOT NULL), 5) AS winsorised_sum FROM b GROUP BY 1",
    "cumulative_drawdown": f"{_D}, c AS (SELECT date, id, sum(r) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM dense) SELECT date, id, round(c, 9) AS cum, round(c - max(c) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING), 9) AS drawdown FROM c",
    "filled_prices": f"{_D} SELECT date, id, round(last_value(price IGNORE NULLS) OVER {_w(4)}, 6) AS price, round(price / lag(price) OVER (PARTITION BY id ORDER BY date) - 1, 6) AS simple FROM dense",
    "buy_and_hold": f"{_D}, g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, id, exp(sum(ln(1 + coalesce(round(exp(r) - 1, 9), 0)))) AS g, first(mcap ORDER BY date) AS w FROM dense GROUP BY 1, 2) SELECT month, round(avg(g), 6) AS equal, round(sum(g * w) / sum(w), 6) AS weighted FROM g GROUP BY 1",
    "full_betas": f"{_D} SELECT id, round(covar_samp(r, m) / var_pop(m), 6) AS beta FROM dense GROUP BY 1",
    "report_tables": f"{_D} SELECT 'month' AS kind, CAST(CAST(last_day(date) AS DATE) AS VARCHAR) AS at, round(sum(m), 9) AS value FROM dense WHERE r IS NOT NULL GROUP BY 2 UNION ALL SELECT 'hist', lpad(CAST(CASE WHEN r < -2 THEN 0 WHEN r >= 2 THEN 21 ELSE CAST(floor((r + 2) / 0.2) AS INTEGER) + 1 END AS VARCHAR), 2, '0'), CAST(count(*) AS DOUBLE) FROM dense WHERE r IS NOT NULL GROUP BY 2",
    "weekly_resample": f"WITH {data.USER} SELECT id, CAST(date - 1 + CAST((7 - (isodow(date - 1) - 1)) AS INTEGER) AS DATE) AS week, round(exp(sum(ln(1 + round(value / 1000, 6)))) - 1, 6) AS x FROM usr GROUP BY 1, 2",
    "characteristic_ranks": f"{_D}, c AS (SELECT date, id, round({_mom(28)}, 6) AS x FROM dense) SELECT date, id, CASE WHEN x IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST, id) AS INTEGER) END AS rank FROM c",
}
