"""Signal, weight, book and inference plans over the weekly panel, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import characteristics, inference, portfolio, signals

from . import data


def _dense(spark, sf):
    return data.clusters(data.dense_week(spark, sf)).where("r IS NOT NULL")


def _signal(spark, sf):
    """A given signal: the return itself, rounded, so that both engines rank the same numbers."""
    return _dense(spark, sf).withColumn("signal", F.round("r", 6))


def _weights(spark, sf):
    return signals.quantile_weights(_signal(spark, sf)).withColumn("w", F.round("w", 9))


def quantile_leg_weights(spark, sf):
    return signals.quantile_weights(_signal(spark, sf)).select("date", "id", F.round("w", 6).alias("w"))


def threshold_leg_weights(spark, sf):
    return signals.threshold_weights(_signal(spark, sf), limit=0.5).select("date", "id", F.round("w", 6).alias("w"))


def balanced_weights(spark, sf):
    w = signals.threshold_weights(_signal(spark, sf), limit=0.4).withColumn("w", signals.balanced_legs())
    return w.select("date", "id", F.round("w", 6).alias("w"))


def cluster_deviation_weights(spark, sf):
    return signals.deviation_weights(_signal(spark, sf), limit=0.4).select("date", "id", F.round("w", 6).alias("w"))


def cluster_composites(spark, sf):
    return signals.composite(_dense(spark, sf)).groupBy("date", "cluster").agg(F.round(F.max("composite"), 8).alias("composite"), F.count("*").alias("n"))


def deviation_signal(spark, sf):
    dense = data.clusters(data.dense_week(spark, sf))
    return signals.deviation_signal(dense).select("date", "id", F.round("signal", 5).alias("signal"))


def beta_residual_signal(spark, sf):
    dense = data.clusters(data.dense_week(spark, sf))
    return signals.beta_residual_signal(dense).select("date", "id", F.round("signal", 5).alias("signal"))


def ou_scores(spark, sf):
    dense = signals.composite(data.clusters(data.dense_week(spark, sf))).withColumn("deviation", F.round(F.col("r") - F.col("composite"), 9))
    return signals.ou_scores(dense).select("date", "id", F.round("s", 3).alias("s"), F.round("half_life", 3).alias("half_life"))


def momentum_clusters(spark, sf):
    return signals.momentum_clusters(_dense(spark, sf))


def between_cluster_momentum(spark, sf):
    return signals.between_cluster_weights(_dense(spark, sf)).select("date", "cluster", F.round("w", 6).alias("w"))


def cointegrated_pairs(spark, sf):
    dense = data.clusters(data.dense_week(spark, sf))
    return signals.cointegrated_pairs(dense, "mcap").select("cluster", "a", "b", F.round("p_value", 8).alias("p_value"))


def portfolio_constraints(spark, sf):
    return portfolio.construct(_weights(spark, sf)).select("date", "id", F.round("w", 6).alias("w"))


def factor_neutral_weights(spark, sf):
    w = _weights(spark, sf).withColumn("beta", F.round(F.ln("volume"), 6)).withColumn("w", portfolio.factor_neutral())
    return w.select("date", "id", F.round("w", 6).alias("w"))


def two_factor_neutral_weights(spark, sf):
    w = _weights(spark, sf).withColumn("f", F.round(F.ln("volume"), 6)).withColumn("one", F.lit(1.0))
    return w.withColumn("w", portfolio.two_factor_neutral("w", "f", "one")).select("date", "id", F.round("w", 4).alias("w"))


def exposure_stats(spark, sf):
    out = portfolio.exposures(_weights(spark, sf))
    return out.select("date", *(F.round(c, 6).alias(c) for c in ("gross", "net", "long", "short")), "n_longs", "n_shorts")


def backtest_net_returns(spark, sf):
    out = portfolio.book(_weights(spark, sf))
    return out.select("date", *(F.round(c, 6).alias(c) for c in ("gross", "turnover", "cost", "net")))


def cost_sensitivity(spark, sf):
    out = portfolio.cost_grid(portfolio.book(_weights(spark, sf)))
    return out.select("cost_bps", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("sharpe", 4).alias("sharpe"))


def holding_periods(spark, sf):
    out = portfolio.holding_periods(_weights(spark, sf))
    return out.select("id", "n_holdings", F.round("mean_days", 6).alias("mean_days"), "median_days", "max_days")


def trade_summary(spark, sf):
    out = portfolio.trade_summary(_weights(spark, sf))
    return out.select("date", "cluster", F.round("turnover", 6).alias("turnover"), "n_trades", F.round("buys", 6).alias("buys"), F.round("sells", 6).alias("sells"))


def quintile_long_short(spark, sf):
    dense = characteristics.build(data.dense_week(spark, sf), ["mom_2w"]).withColumn("mom_2w", F.round("mom_2w", 6)).withColumn("r_simple", F.round(F.expm1("r"), 9))
    return portfolio.quintile_long_short(dense, "mom_2w").select("date", *(F.round(c, 6).alias(c) for c in ("gross", "turnover", "net")))


def _book(spark, sf):
    return portfolio.book(_weights(spark, sf)).select("date", F.round("net", 9).alias("net"))


def sharpe_by_year(spark, sf):
    return inference.sharpe_by_year(_book(spark, sf)).select("year", "n", F.round("sharpe", 5).alias("sharpe"))


def best_days(spark, sf):
    return inference.best_days(_book(spark, sf)).select("n", *(F.round(c, 5).alias(c) for c in ("sharpe", "sharpe_ex_best", "share_of_total")))


def sharpe_moments(spark, sf):
    return inference.moments(_book(spark, sf), "net").select("n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "skew", "kurtosis")))


def probabilistic_sharpe(spark, sf):
    return inference.probabilistic_sharpe(_book(spark, sf), "net").select(F.round("z", 6).alias("z"))


def paired_delta(spark, sf):
    a, b = portfolio.book(_weights(spark, sf), 50.0).select("date", F.col("net").alias("a")), portfolio.book(_weights(spark, sf), 10.0).select("date", F.col("net").alias("b"))
    return inference.paired_delta(a, b).select("n", F.round("mean", 7).alias("mean"), F.round("se", 7).alias("se"))


def market_regression(spark, sf):
    both = _book(spark, sf).join(data.dense_week(spark, sf).groupBy("date").agg(F.max("m").alias("x")), "date")
    return inference.ols_one(both, "net", "x").select("n", *(F.round(c, 5).alias(c) for c in ("alpha", "beta", "t_beta", "r2")))


def funding_book(spark, sf):
    funding = _dense(spark, sf).where("cluster < 2").select("date", "id", F.round("r", 6).alias("funding"))
    return portfolio.funding_pnl(_weights(spark, sf), funding).select("date", F.round("pnl", 6).alias("pnl"), F.round("covered", 6).alias("covered"))


QUERIES = [
    quantile_leg_weights, threshold_leg_weights, balanced_weights, cluster_deviation_weights, cluster_composites, deviation_signal, beta_residual_signal, ou_scores, momentum_clusters, between_cluster_momentum,
    cointegrated_pairs, portfolio_constraints, factor_neutral_weights, two_factor_neutral_weights, exposure_stats, backtest_net_returns, cost_sensitivity, holding_periods, trade_summary, quintile_long_short,
    sharpe_by_year, best_days, sharpe_moments, probabilistic_sharpe, paired_delta, market_regression, funding_book,
]

_G = "(PARTITION BY date, cluster)"
_S = f"""WITH {data.DENSE}, full_ AS (SELECT *, {data.CLUSTER} AS cluster FROM dense), sig AS (SELECT *, round(r, 6) AS signal FROM full_ WHERE r IS NOT NULL)"""
_Q = _S + f""", rkd AS (SELECT *, greatest(1, floor(count(*) OVER {_G} * 0.2)) AS n, row_number() OVER (PARTITION BY date, cluster ORDER BY signal, id) AS lo, row_number() OVER (PARTITION BY date, cluster ORDER BY signal DESC, id DESC) AS hi FROM sig),
qw0 AS (SELECT * EXCLUDE (n, lo, hi), CASE WHEN hi <= n THEN -1.0 / n WHEN lo <= n THEN 1.0 / n ELSE 0.0 END AS w0 FROM rkd),
qw AS (SELECT * EXCLUDE (w0), round(w0, 9) AS w FROM qw0)"""


def _thr(limit: float) -> str:
    return _S + f", tw AS (SELECT *, CASE WHEN signal < -{limit} THEN 1.0 / count(CASE WHEN signal < -{limit} THEN 1 END) OVER {_G} WHEN signal > {limit} THEN -1.0 / count(CASE WHEN signal > {limit} THEN 1 END) OVER {_G} ELSE 0.0 END AS w FROM sig)"


_B = _Q + """, tr AS (SELECT *, coalesce(w - lag(w) OVER (PARTITION BY id ORDER BY date), 0) AS t FROM qw),
bk AS (SELECT date, coalesce(sum(w * r), 0) AS gross, sum(abs(t)) AS turnover FROM tr GROUP BY 1),
nt AS (SELECT date, gross, turnover, turnover * 50 / 1e4 AS cost, gross - turnover * 50 / 1e4 AS net FROM bk),
net AS (SELECT date, round(net, 9) AS net FROM nt)"""

_MOM2 = "CASE WHEN count(r) OVER (PARTITION BY id ORDER BY date ROWS 13 PRECEDING) >= 7 THEN sum(r) OVER (PARTITION BY id ORDER BY date ROWS 13 PRECEDING) END"


def _z(x: str, n: int, least: int) -> str:
    f = f"(PARTITION BY id ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} >= {least} THEN ({x} - avg({x}) OVER {f}) / (stddev_samp({x}) OVER {f} + 1e-8) END"


SQL = {
    "quantile_leg_weights": _Q + " SELECT date, id, round(w0, 6) AS w FROM qw0",
    "threshold_leg_weights": _thr(0.5) + " SELECT date, id, round(w, 6) AS w FROM tw",
    "balanced_weights": _thr(0.4) + f", l AS (SELECT *, sum(greatest(w, 0)) OVER {_G} AS u, sum(greatest(-w, 0)) OVER {_G} AS d FROM tw) SELECT date, id, round(CASE WHEN u > 0 AND d > 0 THEN CASE WHEN w > 0 THEN w * (u + d) / 2 / u ELSE w * (u + d) / 2 / d END ELSE 0 END, 6) AS w FROM l",
    "cluster_deviation_weights": _thr(0.4) + f", a AS (SELECT date, id, cluster, CASE WHEN w <> 0 THEN w - avg(CASE WHEN w <> 0 THEN w END) OVER {_G} ELSE 0 END AS w FROM tw) SELECT date, id, round(CASE WHEN abs(w) > 1e-12 THEN w - avg(CASE WHEN abs(w) > 1e-12 THEN w END) OVER (PARTITION BY date) ELSE 0 END, 6) AS w FROM a",
    "cluster_composites": _S + " SELECT date, cluster, round(avg(r), 8) AS composite, count(*) AS n FROM sig GROUP BY 1, 2",
    "deviation_signal": _S + f", c AS (SELECT *, r - avg(r) OVER {_G} AS x FROM full_), s AS (SELECT *, CASE WHEN count(x) OVER (PARTITION BY id ORDER BY date ROWS 4 PRECEDING) >= 1 THEN sum(x) OVER (PARTITION BY id ORDER BY date ROWS 4 PRECEDING) END AS s FROM c), z AS (SELECT *, {_z('s', 60, 20)} AS z FROM s) SELECT date, id, round(lag(z) OVER (PARTITION BY id ORDER BY date), 5) AS signal FROM z",
    "beta_residual_signal": _S + f", c AS (SELECT *, avg(r) OVER {_G} AS c FROM full_), b AS (SELECT *, CASE WHEN count(CASE WHEN r IS NOT NULL AND c IS NOT NULL THEN 1 END) OVER w >= 20 THEN covar_samp(r, c) OVER w / var_samp(c) OVER w END AS b FROM c WINDOW w AS (PARTITION BY id ORDER BY date ROWS 59 PRECEDING)), "
    f"e AS (SELECT *, r - lag(b) OVER (PARTITION BY id ORDER BY date) * c AS e FROM b), s AS (SELECT *, CASE WHEN count(e) OVER (PARTITION BY id ORDER BY date ROWS 19 PRECEDING) >= 5 THEN sum(e) OVER (PARTITION BY id ORDER BY date ROWS 19 PRECEDING) END AS s FROM e), z AS (SELECT *, {_z('s', 20, 5)} AS z FROM s) SELECT date, id, round(lag(z) OVER (PARTITION BY id ORDER BY date), 5) AS signal FROM z",
    "ou_scores": _S + f", c AS (SELECT id, date, date_idx, round(r - avg(r) OVER {_G}, 9) AS x FROM full_), p AS (SELECT a.id, a.date, b.date_idx AS t, b.x, sum(coalesce(b.x, 0)) OVER (PARTITION BY a.id, a.date ORDER BY b.date_idx ROWS UNBOUNDED PRECEDING) AS y FROM c a JOIN c b ON a.id = b.id AND b.date_idx <= a.date_idx AND b.date_idx > a.date_idx - 60 WHERE a.date_idx >= 59), "
    "q AS (SELECT *, lag(y) OVER (PARTITION BY id, date ORDER BY t) AS y0 FROM p), f AS (SELECT id, date, covar_pop(y0, y) / nullif(var_pop(y0), 0) AS b, avg(y) FILTER (y0 IS NOT NULL) AS my, avg(y0) AS m0, var_pop(y) FILTER (y0 IS NOT NULL) AS vy, var_pop(y0) AS v0, arg_max(y, t) AS last, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM q GROUP BY 1, 2), "
    "g AS (SELECT *, b > 0 AND b < 1 AND missing <= 0.2 AS ok FROM f) SELECT c.date, c.id, round(CASE WHEN ok THEN (last - (my - b * m0) / (1 - b)) / nullif(sqrt(greatest(vy - b * b * v0, 0) / (1 - b * b)), 0) END, 3) AS s, round(CASE WHEN ok THEN 0.6931471805599453 / -ln(b) END, 3) AS half_life FROM c LEFT JOIN g ON c.id = g.id AND c.date = g.date",
    "momentum_clusters": _S + ", d AS (SELECT cluster, date, avg(r) AS r FROM sig GROUP BY 1, 2), m AS (SELECT *, sum(r) OVER (PARTITION BY cluster ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS m FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY m DESC, cluster) AS rank, count(*) OVER (PARTITION BY date) AS n FROM m WHERE m IS NOT NULL) SELECT date, cluster FROM k WHERE rank <= greatest(1, round_even(n * 0.5, 0))",
    "between_cluster_momentum": _S + ", d AS (SELECT cluster, date, avg(r) AS c, count(*) AS members FROM sig GROUP BY 1, 2), m AS (SELECT *, CASE WHEN count(c) OVER w >= 5 THEN sum(c) OVER w END AS m0 FROM d WINDOW w AS (PARTITION BY cluster ORDER BY date ROWS 27 PRECEDING)), l AS (SELECT *, lag(m0) OVER (PARTITION BY cluster ORDER BY date) AS m FROM m), "
    "s AS (SELECT *, (CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY m NULLS LAST) + (count(m) OVER (PARTITION BY date, m) - 1) / 2) / count(m) OVER (PARTITION BY date) END - 0.5) * 2 AS s FROM l), t AS (SELECT *, (s - avg(s) OVER (PARTITION BY date)) / members AS v FROM s) SELECT date, cluster, round(v / nullif(sum(abs(v) * members) OVER (PARTITION BY date), 0), 6) AS w FROM t",
    "cointegrated_pairs": _S + ", p AS (SELECT x.cluster, x.id AS a, y.id AS b, 1 - abs(corr(x.mcap, y.mcap)) AS p FROM full_ x JOIN full_ y ON x.date = y.date AND x.cluster = y.cluster AND x.id < y.id WHERE x.mcap IS NOT NULL AND y.mcap IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, a, b) AS rank FROM p WHERE p < 0.3) SELECT cluster, a, b, round(p, 8) AS p_value FROM k WHERE rank <= 5",
    "portfolio_constraints": _Q + f", a AS (SELECT *, greatest(least(w, 0.1), -0.1) AS a FROM qw), b AS (SELECT *, CASE WHEN sum(abs(a)) OVER {_G} > 0.4 THEN a * 0.4 / sum(abs(a)) OVER {_G} ELSE a END AS b FROM a), c AS (SELECT *, b - avg(b) OVER (PARTITION BY date) AS c FROM b) SELECT date, id, round(CASE WHEN sum(abs(c)) OVER (PARTITION BY date) > 1.5 THEN c * 1.5 / sum(abs(c)) OVER (PARTITION BY date) ELSE c END, 6) AS w FROM c",
    "factor_neutral_weights": _Q + ", b AS (SELECT *, round(ln(volume), 6) AS b FROM qw) SELECT date, id, round(w - sum(w * b) OVER (PARTITION BY date) / sum(b * b) OVER (PARTITION BY date) * b, 6) AS w FROM b",
    "two_factor_neutral_weights": _Q + ", b AS (SELECT *, round(ln(volume), 6) AS f FROM qw), s AS (SELECT *, sum(f * f) OVER d + 1e-8 AS ff, count(*) OVER d + 1e-8 AS gg, sum(f) OVER d AS fg, sum(w * f) OVER d AS wf, sum(w) OVER d AS wg FROM b WINDOW d AS (PARTITION BY date)) "
    "SELECT date, id, round(w - (gg * wf - fg * wg) / (ff * gg - fg * fg) * f - (ff * wg - fg * wf) / (ff * gg - fg * fg), 4) AS w FROM s",
    "exposure_stats": _Q + " SELECT date, round(sum(abs(w)), 6) AS gross, round(sum(w), 6) AS net, round(sum(CASE WHEN w > 0 THEN w ELSE 0 END), 6) AS long, round(sum(CASE WHEN w < 0 THEN w ELSE 0 END), 6) AS short, count(CASE WHEN w > 0.001 THEN 1 END) AS n_longs, count(CASE WHEN w < -0.001 THEN 1 END) AS n_shorts FROM qw GROUP BY 1",
    "backtest_net_returns": _B + " SELECT date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(net, 6) AS net FROM nt",
    "cost_sensitivity": _B + ", g AS (SELECT c AS cost_bps, gross - turnover * c / 1e4 AS n FROM bk, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 200.0]::DOUBLE[]) AS c)) SELECT cost_bps, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(avg(n) / (stddev_samp(n) + 1e-8) * sqrt(365), 4) AS sharpe FROM g GROUP BY 1",
    "holding_periods": _Q + ", h AS (SELECT id, date, abs(w) > 0.01 AS held, coalesce(lag(abs(w) > 0.01) OVER (PARTITION BY id ORDER BY date), FALSE) AS before FROM qw), r AS (SELECT *, sum(CASE WHEN NOT held OR NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run, max(date) OVER (PARTITION BY id) AS fin FROM h), "
    "g AS (SELECT id, run, count(*) AS n FROM r WHERE held GROUP BY 1, 2 HAVING max(date) < any_value(fin)) SELECT id, count(*) AS n_holdings, round(avg(n), 6) AS mean_days, quantile_cont(n, 0.5) AS median_days, max(n) AS max_days FROM g GROUP BY 1",
    "trade_summary": _B + " SELECT date, cluster, round(sum(abs(t)), 6) AS turnover, count(CASE WHEN abs(t) > 1e-6 THEN 1 END) AS n_trades, round(sum(CASE WHEN t > 0 THEN t ELSE 0 END), 6) AS buys, round(sum(CASE WHEN t < 0 THEN -t ELSE 0 END), 6) AS sells FROM tr GROUP BY 1, 2",
    "quintile_long_short": f"WITH {data.DENSE}, c AS (SELECT *, round({_MOM2}, 6) AS x0, round(exp(r) - 1, 9) AS rs FROM dense), l AS (SELECT *, lag(x0) OVER (PARTITION BY id ORDER BY date) AS x, lead(rs) OVER (PARTITION BY id ORDER BY date) AS fwd FROM c), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, id) AS rank, count(*) OVER (PARTITION BY date) AS n FROM l WHERE x IS NOT NULL AND mcap > 0 AND fwd IS NOT NULL), q AS (SELECT *, CASE WHEN rank >= n * 4 / 5 THEN 4 WHEN rank < n / 5 THEN 0 END AS q FROM k WHERE n >= 10), "
    "w AS (SELECT date, id, fwd, CASE q WHEN 4 THEN 1.0 ELSE -1.0 END * mcap / sum(mcap) OVER (PARTITION BY date, q) AS w FROM q WHERE q IS NOT NULL), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM w)), "
    "o AS (SELECT d.date, w.id, w.w AS w0 FROM w JOIN d ON w.date = d.prev), f AS (SELECT coalesce(a.date, o.date) AS date, coalesce(a.w, 0) AS w, coalesce(a.fwd, 0) AS fwd, abs(coalesce(a.w, 0) - coalesce(o.w0, 0)) AS t FROM w a FULL JOIN o ON a.date = o.date AND a.id = o.id) "
    "SELECT date, round(sum(w * fwd), 6) AS gross, round(sum(t), 6) AS turnover, round(sum(w * fwd) - sum(t) * 50 / 1e4, 6) AS net FROM f GROUP BY 1",
    "sharpe_by_year": _B + " SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, round(avg(net) / stddev_samp(net) * sqrt(365), 5) AS sharpe FROM net GROUP BY 1 HAVING count(*) >= 30 AND stddev_samp(net) > 0",
    "best_days": _B + ", k AS (SELECT *, row_number() OVER (ORDER BY net DESC, date) AS rank FROM net) SELECT count(*) AS n, round(avg(net) / stddev_samp(net) * sqrt(365), 5) AS sharpe, round(avg(net) FILTER (rank > 10) / stddev_samp(net) FILTER (rank > 10) * sqrt(365), 5) AS sharpe_ex_best, round(sum(net) FILTER (rank <= 10) / sum(net), 5) AS share_of_total FROM k",
    "sharpe_moments": _B + " SELECT count(net) AS n, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS std, round(skewness(net), 6) AS skew, round(kurtosis(net), 6) AS kurtosis FROM net",
    "probabilistic_sharpe": _B + ", m AS (SELECT count(net) AS n, avg(net) / stddev_samp(net) AS s, skewness(net) AS g, kurtosis(net) AS k FROM net) SELECT round(s * sqrt(n - 1) / sqrt(1 - g * s + (k + 2) / 4 * s * s), 6) AS z FROM m",
    "paired_delta": _B + ", d AS (SELECT turnover * -40 / 1e4 AS d FROM bk) SELECT count(*) AS n, round(avg(d), 7) AS mean, round(stddev_samp(d) / sqrt(count(*)), 7) AS se FROM d",
    "market_regression": _B + ", j AS (SELECT net AS y, x FROM net JOIN (SELECT date, max(m) AS x FROM dense GROUP BY 1) USING (date)), f AS (SELECT count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx FROM j) "
    "SELECT n, round(a, 5) AS alpha, round(b, 5) AS beta, round(b / sqrt(syy * (1 - r2) / (n - 2) / sxx), 5) AS t_beta, round(r2, 5) AS r2 FROM f",
    "funding_book": _Q + ", f AS (SELECT date, id, round(r, 6) AS f FROM sig WHERE cluster < 2) SELECT date, round(-sum(w * coalesce(f, 0)), 6) AS pnl, round(sum(CASE WHEN f IS NOT NULL THEN abs(w) ELSE 0 END) / nullif(sum(abs(w)), 0), 6) AS covered FROM qw LEFT JOIN f USING (date, id) GROUP BY 1",
}
