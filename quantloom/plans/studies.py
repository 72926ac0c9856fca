"""Plans of the studies over the weekly panel, the snapshots and the driver's other tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import asof, characteristics, graph, inference, portfolio, returns, rolling, signals, studies

from . import books, data, universe

COSTS = (10.0, 25.0, 50.0, 100.0, 200.0)


def _arms(spark, sf):
    """One book at several costs: each an arm."""
    day = portfolio.book(books._weights(spark, sf))
    arms = day.withColumn("bps", F.explode(F.array(*(F.lit(c) for c in COSTS)))).withColumn("net", F.round(F.col("gross") - F.col("turnover") * F.col("bps") / 1e4, 9))
    return arms.select(F.concat(F.lit("c"), F.col("bps").cast("int").cast("string")).alias("arm"), "date", "net")


def leaderboard(spark, sf):
    out = studies.leaderboard(_arms(spark, sf))
    return out.select("arm", "n", F.round("mean", 6).alias("mean"), F.round("sharpe", 5).alias("sharpe"), F.round("z", 4).alias("z"), F.round("dsr_z", 4).alias("dsr_z"), "rank")


def best_arm_by_year(spark, sf):
    scores = _arms(spark, sf).groupBy(F.year("date").alias("year"), "arm").agg(F.round(inference.sharpe(F.col("net")), 6).alias("sharpe"))
    return studies.best_per_group(scores, "year")


def carry_grid(spark, sf):
    w = books._weights(spark, sf)
    day = portfolio.book(w).join(portfolio.exposures(w).select("date", "short"), "date")
    return studies.carry_grid(day).select("carry_bps", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("sharpe", 4).alias("sharpe"))


def pnl_by_year(spark, sf):
    out = studies.pnl_split(portfolio.book(books._weights(spark, sf)), F.year("date"))
    return out.select("period", "n", *(F.round(c, 6).alias(c) for c in ("gross", "cost", "net")), F.round("cost_ratio", 4).alias("cost_ratio"))


def lookback_grid(spark, sf):
    dense = data.clusters(data.dense_week(spark, sf)).withColumn("deviation", F.round(F.col("r") - F.avg("r").over(signals.by_group()), 6))
    out = studies.lookback_grid(dense)
    return out.select("lookback", "holding", "n", F.round("mean", 7).alias("mean"), F.round("sharpe", 4).alias("sharpe"))


def factor_sweep(spark, sf):
    dense = characteristics.build(data.dense_week(spark, sf), ["mom_2w"]).withColumn("mom_2w", F.round("mom_2w", 6)).withColumn("size", F.round(F.ln("mcap"), 6)).withColumn("r_simple", F.round(F.expm1("r"), 9))
    return studies.factor_sweep(dense, ["mom_2w", "size"]).select("factor", "n", F.round("mean", 6).alias("mean"), F.round("sharpe", 4).alias("sharpe"))


def book_verification(spark, sf):
    return studies.verify_book(portfolio.book(books._weights(spark, sf)).withColumn("net", F.round("net", 9)), cap=1.0, tolerance=1e-6)


def _perps(spark, sf):
    lines = data.table(spark, sf, "lineitem").where("l_quantity > 48 AND l_discount > 0.05").select("l_partkey", F.col("l_returnflag").alias("venue"))
    return lines.join(data.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("base")), F.col("l_partkey") == F.col("p_partkey")).select("base", "venue").distinct()


def _names(spark, sf):
    return data.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("base"))


def shortable_names(spark, sf):
    return studies.shortable(_names(spark, sf), _perps(spark, sf)).select("id", "base", "venues", "n_venues", "shortable")


def shortable_ids(spark, sf):
    return studies.shortable_only(_names(spark, sf), _perps(spark, sf)).select("id")


def shortable_coverage(spark, sf):
    out = studies.coverage(studies.shortable(_names(spark, sf), _perps(spark, sf)))
    return out.select("n", "n_shortable", F.round("share", 8).alias("share"))


def preferred_contracts(spark, sf):
    contracts = data.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("base"), F.concat((F.col("l_quantity") % 5).cast("int").cast("string"), F.when(F.col("l_linenumber") > 4, F.lit("USDT")).otherwise(F.lit("USD"))).alias("symbol")).distinct()
    return studies.preferred_contract(contracts)


def needed_months(spark, sf):
    contracts = data.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 7).cast("string")).alias("symbol"))
    return studies.needed_months(universe._assignments(spark, sf).where("bracket = 'B1'"), contracts)


def funding_mean_quantiles(spark, sf):
    u = data.user_days(spark, sf)
    return studies.mean_quantiles(u, "id", "value").select("q", F.round("value", 6).alias("value"))


def winsorised_returns(spark, sf):
    out = studies.winsorised(data.dense_week(spark, sf), limit=0.5, max_missing=0.2)
    return out.select("date", "id", F.round("r", 6).alias("r"))


def masked_returns(spark, sf):
    dense = data.dense_week(spark, sf)
    return studies.masked(dense, dense.where("volume > 100000").select("date", "id")).select("date", "id", F.round("r", 6).alias("r"))


def daily_members(spark, sf):
    users = data.user_days(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "id")))
    return studies.daily_members(users, top=20, cap="value", least=50.0)


def relative_caps(spark, sf):
    week = data.week_panel(spark, sf)
    out = studies.relative_cap(week, week.where("id = 'Brand#11'"))
    return out.select("date", "id", F.round("cap_proxy", 6).alias("cap_proxy"))


def listing_cross_check(spark, sf):
    week = data.week_panel(spark, sf)
    other = week.withColumn("price", F.col("price") * (1 + F.when(F.dayofyear("date") % 5 == 0, 0.05).otherwise(0.01)))
    out = studies.cross_check(week, other)
    return out.select("id", "n", F.round("median_gap", 6).alias("median_gap"), F.round("share_off", 6).alias("share_off"))


def network_value_ratio(spark, sf):
    dense = data.dense_week(spark, sf)
    activity = dense.where("date_idx % 10 = 0").select("id", "date", "volume")
    return studies.value_ratio(activity, dense.select("id", "date", "mcap"), "volume").select("date", "id", F.round("ratio", 5).alias("ratio"))


def bracket_years(spark, sf):
    out = studies.per_bracket_year(universe._assignments(spark, sf))
    return out.select("bracket", "year", "n_ids", "member_rows", F.round("avg_members", 6).alias("avg_members"), "min_members", F.round("least_ratio", 8).alias("least_ratio"), F.round("largest_ratio", 8).alias("largest_ratio"))


def _labels(spark, sf):
    return data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), "label")


def cluster_members(spark, sf):
    return studies.members(_labels(spark, sf)).select("label", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"), "size")


def cluster_matrix(spark, sf):
    return studies.assignment_matrix(_labels(spark, sf), list(range(10)))


def spearman_pairs(spark, sf):
    dense = data.dense_week(spark, sf).where("r IS NOT NULL").withColumn("r", F.round("r", 6))
    common = dense.groupBy("date").agg(F.count("*").alias("n")).where("n = 25").select("date")
    ranked = studies.average_ranks(dense.join(common, "date", "left_semi"), "r")
    return graph.correlations(ranked).select("a", "b", F.round("corr", 6).alias("corr"))


def ou_score_legs(spark, sf):
    scores = data.clusters(books.ou_scores(spark, sf)).where("s IS NOT NULL")
    return studies.score_legs(scores, 1.0).select("date", "id", F.round("w", 6).alias("w"))


# -- operators of the other modules that no plan reached --------------------------------------------


def target_weights(spark, sf):
    return signals.target_weights(books._signal(spark, sf)).select("date", "id", F.round("w", 5).alias("w"))


def inverse_vol(spark, sf):
    return signals.inverse_vol_weights(books._signal(spark, sf)).select("date", "id", F.round("iv", 6).alias("iv"))


def half_life_scales(spark, sf):
    scores = books.ou_scores(spark, sf).where("half_life IS NOT NULL")
    return scores.select("date", "id", F.round(rolling.half_life_scale("half_life"), 5).alias("scale"))


def factor_exposures(spark, sf):
    loadings = data.week_panel(spark, sf).groupBy("id").agg(F.round(F.ln(F.avg("volume")), 6).alias("beta"))
    return portfolio.factor_exposure(books._weights(spark, sf), loadings).select("date", F.round("exposure", 5).alias("exposure"))


def last_known_balance(spark, sf):
    orders = data.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("date"), "o_orderkey")
    known = data.user_days(spark, sf).where("n > 1").select("id", F.date_sub("date", 365 * 27).alias("date"), "value")
    return asof.latest_value(orders, known, ["id"], "value").select("o_orderkey", "value")


def simple_returns(spark, sf):
    dense = data.dense_week(spark, sf).where("r IS NOT NULL").withColumn("x", F.col("r") - F.col("m"))
    return dense.select("date", "id", F.round(returns.simple_from_excess("x", "m"), 7).alias("simple"))


def two_factor_regression(spark, sf):
    day = books._book(spark, sf).join(data.dense_week(spark, sf).groupBy("date").agg(F.max("m").alias("x1"), F.round(F.ln(F.sum(F.col("volume").cast(data.MONEY)).cast("double")), 6).alias("x2")), "date")
    return inference.ols(day, "net", ["x1", "x2"]).select("name", F.round("coef", 6).alias("coef"), F.round("t", 3).alias("t"))


def vol_targeted_weights(spark, sf):
    dense = books._dense(spark, sf)
    w = books._weights(spark, sf).select("date", "id", "date_idx", "w")
    return portfolio.vol_target(w, dense, target=0.5, window=26).select("date", "id", F.round("w", 5).alias("w"))


QUERIES = [
    leaderboard, best_arm_by_year, carry_grid, pnl_by_year, lookback_grid, factor_sweep, book_verification, shortable_names, shortable_ids, shortable_coverage, preferred_contracts, needed_months,
    funding_mean_quantiles, winsorised_returns, masked_returns, daily_members, relative_caps, listing_cross_check, network_value_ratio, bracket_years, cluster_members, cluster_matrix, spearman_pairs, ou_score_legs,
    target_weights, inverse_vol, half_life_scales, factor_exposures, last_known_balance, simple_returns, two_factor_regression, vol_targeted_weights,
]

_ARMS = books._B + """, arms AS (SELECT 'c' || CAST(CAST(c AS INTEGER) AS VARCHAR) AS arm, date, round(gross - turnover * c / 1e4, 9) AS net FROM bk, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 200.0]::DOUBLE[]) AS c))"""
_QLS = """k{i} AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {x}, id) AS rank, count(*) OVER (PARTITION BY date) AS n FROM l WHERE {x} IS NOT NULL AND mcap > 0 AND fwd IS NOT NULL), q{i} AS (SELECT *, CASE WHEN rank >= n * 4 / 5 THEN 4 WHEN rank < n / 5 THEN 0 END AS q FROM k{i} WHERE n >= 10),
w{i} AS (SELECT date, id, fwd, CASE q WHEN 4 THEN 1.0 ELSE -1.0 END * mcap / sum(mcap) OVER (PARTITION BY date, q) AS w FROM q{i} WHERE q IS NOT NULL), d{i} AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM w{i})),
o{i} AS (SELECT d.date, w.id, w.w AS w0 FROM w{i} w JOIN d{i} d ON w.date = d.prev), f{i} AS (SELECT coalesce(a.date, o.date) AS date, coalesce(a.w, 0) AS w, coalesce(a.fwd, 0) AS fwd, abs(coalesce(a.w, 0) - coalesce(o.w0, 0)) AS t FROM w{i} a FULL JOIN o{i} o ON a.date = o.date AND a.id = o.id),
n{i} AS (SELECT '{f}' AS factor, date, sum(w * fwd) - sum(t) * 50 / 1e4 AS net FROM f{i} GROUP BY date)"""
_PERPS = "perps AS (SELECT DISTINCT p_type AS base, l_returnflag AS venue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48 AND l_discount > 0.05), held AS (SELECT base, string_agg(DISTINCT venue, ',' ORDER BY venue) AS venues, count(DISTINCT venue) AS nv FROM perps GROUP BY 1)"
_MEAN = "r - avg(r) OVER (PARTITION BY date, cluster)"


def _signs(n: int) -> str:
    over = f"OVER (PARTITION BY id ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"SELECT {n} AS lookback, id, date, r, sign(lag(v) OVER (PARTITION BY id ORDER BY date)) AS s FROM (SELECT *, CASE WHEN count(x) {over} >= {max(2, n // 2)} THEN sum(x) {over} END AS v FROM dv)"


def _held(h: int) -> str:
    return f"SELECT lookback, {h} AS holding, date, r, -avg(s) OVER (PARTITION BY id, lookback ORDER BY date ROWS {h - 1} PRECEDING) AS p FROM sg"


SQL = {
    "leaderboard": _ARMS + f""", a AS (SELECT arm, count(net) AS n, avg(net) AS mean, avg(net) / nullif(stddev_samp(net), 0) AS s, skewness(net) AS g, kurtosis(net) AS k FROM arms GROUP BY 1), b AS (SELECT stddev_samp(s) * {studies.expected_best(len(COSTS))!r} AS bar FROM a)
SELECT arm, n, round(mean, 6) AS mean, round(s * sqrt(365), 5) AS sharpe, round(s * sqrt(n - 1) / sqrt(1 - g * s + (k + 2) / 4 * s * s), 4) AS z, round((s - bar) * sqrt(n - 1) / sqrt(1 - g * s + (k + 2) / 4 * s * s), 4) AS dsr_z, CAST(row_number() OVER (ORDER BY s DESC NULLS LAST, arm) AS INTEGER) AS rank FROM a, b""",
    "best_arm_by_year": _ARMS + ", s AS (SELECT CAST(year(date) AS INTEGER) AS year, arm, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(365), 6) AS sharpe FROM arms GROUP BY 1, 2) SELECT year, arm, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY sharpe DESC, arm) AS k FROM s WHERE sharpe IS NOT NULL) WHERE k = 1",
    "carry_grid": books._B + ", sh AS (SELECT date, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS short FROM qw GROUP BY 1), g AS (SELECT c AS carry_bps, net - short * c / 1e4 AS n FROM nt JOIN sh USING (date), (SELECT unnest([0.0, 3.0, 6.0, 10.0]::DOUBLE[]) AS c)) SELECT carry_bps, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(avg(n) / (stddev_samp(n) + 1e-8) * sqrt(365), 4) AS sharpe FROM g GROUP BY 1",
    "pnl_by_year": books._B + " SELECT CAST(year(date) AS INTEGER) AS period, count(*) AS n, round(sum(gross), 6) AS gross, round(sum(cost), 6) AS cost, round(sum(net), 6) AS net, round(sum(cost) / nullif(abs(sum(gross)), 0), 4) AS cost_ratio FROM nt GROUP BY 1",
    "lookback_grid": books._S + f", dv AS (SELECT *, round({_MEAN}, 6) AS x FROM full_), sg AS ({' UNION ALL '.join(map(_signs, (5, 20, 60)))}), hd AS ({' UNION ALL '.join(map(_held, (1, 5)))}), dy AS (SELECT lookback, holding, date, avg(p * r) AS net FROM hd WHERE p IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3) "
    "SELECT lookback, holding, count(*) AS n, round(avg(net), 7) AS mean, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(365), 4) AS sharpe FROM dy GROUP BY 1, 2",
    "factor_sweep": f"WITH {data.DENSE}, c AS (SELECT *, round({books._MOM2}, 6) AS x1, round(ln(mcap), 6) AS x2, round(exp(r) - 1, 9) AS rs FROM dense), l AS (SELECT *, lag(x1) OVER (PARTITION BY id ORDER BY date) AS y1, lag(x2) OVER (PARTITION BY id ORDER BY date) AS y2, lead(rs) OVER (PARTITION BY id ORDER BY date) AS fwd FROM c), "
    + _QLS.format(i=1, x="y1", f="mom_2w") + ", " + _QLS.format(i=2, x="y2", f="size")
    + " SELECT v.factor, count(net) AS n, round(avg(net), 6) AS mean, round(CASE WHEN count(net) >= 8 THEN avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) END, 4) AS sharpe FROM (VALUES ('mom_2w'), ('size')) v(factor) LEFT JOIN (SELECT * FROM n1 UNION ALL SELECT * FROM n2) USING (factor) GROUP BY 1",
    "book_verification": books._B + ", t AS (SELECT *, round(net, 9) AS nn FROM nt) SELECT 'net_is_gross_less_cost' AS rule, CAST(count(*) FILTER (abs(nn - (gross - cost)) > 1e-6) AS BIGINT) AS failures FROM t UNION ALL SELECT 'cost_not_negative', count(*) FILTER (cost < 0) FROM t UNION ALL SELECT 'turnover_in_bounds', count(*) FILTER (turnover < 0 OR turnover > 1.0 + 1e-6) FROM t UNION ALL SELECT 'nothing_missing', count(*) FILTER (nn IS NULL OR gross IS NULL OR cost IS NULL) FROM t",
    "shortable_names": f"WITH {_PERPS} SELECT p_partkey AS id, p_type AS base, venues, coalesce(nv, 0) AS n_venues, coalesce(nv, 0) > 0 AS shortable FROM part LEFT JOIN held ON p_type = base",
    "shortable_ids": f"WITH {_PERPS} SELECT p_partkey AS id FROM part WHERE p_type IN (SELECT base FROM perps)",
    "shortable_coverage": f"WITH {_PERPS} SELECT count(*) AS n, count(nv) AS n_shortable, round(avg(CASE WHEN nv IS NULL THEN 0.0 ELSE 1.0 END), 8) AS share FROM part LEFT JOIN held ON p_type = base",
    "preferred_contracts": "WITH c AS (SELECT DISTINCT l_returnflag AS base, CAST(CAST(l_quantity % 5 AS INTEGER) AS VARCHAR) || CASE WHEN l_linenumber > 4 THEN 'USDT' ELSE 'USD' END AS symbol FROM lineitem) SELECT base, symbol FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ends_with(symbol, 'USDT') DESC, symbol) AS k FROM c) WHERE k = 1",
    "needed_months": f"WITH {universe._ASSIGN} SELECT DISTINCT c_mktsegment || CAST(c_custkey % 7 AS VARCHAR) AS symbol, CAST(date_trunc('month', snapshot_date) + to_months(k) AS DATE) AS month FROM asg JOIN customer ON id = c_custkey, (SELECT unnest([0, 1]) AS k) WHERE bracket = 'B1'",
    "funding_mean_quantiles": f"WITH {data.USER}, m AS (SELECT id, avg(value) AS m FROM usr GROUP BY 1) SELECT q, round(quantile_cont(m, 0.05), 6) AS value FROM m, (SELECT 0.05::DOUBLE AS q) GROUP BY q"
    + "".join(f" UNION ALL SELECT {q}::DOUBLE, round(quantile_cont(m, {q}), 6) FROM m" for q in (0.25, 0.5, 0.75, 0.95)),
    "winsorised_returns": f"WITH {data.DENSE}, k AS (SELECT id FROM dense GROUP BY 1 HAVING avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2) SELECT date, id, round(CASE WHEN r IS NOT NULL THEN greatest(least(r, 0.5), -0.5) END, 6) AS r FROM dense WHERE id IN (SELECT id FROM k)",
    "masked_returns": f"WITH {data.DENSE} SELECT date, id, CASE WHEN volume > 100000 THEN round(r, 6) END AS r FROM dense",
    "daily_members": f"WITH {data.USER} SELECT date, id FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, id) AS rank FROM usr) WHERE rank <= 20 AND value > 50",
    "relative_caps": f"WITH {data.WEEK} SELECT w.date, w.id, round(w.volume * w.price / nullif(x.price * x.volume, 0), 6) AS cap_proxy FROM week w LEFT JOIN (SELECT * FROM week WHERE id = 'Brand#11') x ON w.date = x.date",
    "listing_cross_check": f"WITH {data.WEEK}, g AS (SELECT id, abs(price / (price * (1 + CASE WHEN dayofyear(date) % 5 = 0 THEN 0.05::DOUBLE ELSE 0.01::DOUBLE END)) - 1) AS gap FROM week WHERE price <> 0) SELECT id, count(*) AS n, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(avg(CASE WHEN gap > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS share_off FROM g GROUP BY 1 HAVING count(*) >= 10",
    "network_value_ratio": f"WITH {data.DENSE}, x AS (SELECT *, CASE WHEN date_idx % 10 = 0 THEN volume END AS a FROM dense) SELECT date, id, round(mcap / nullif(last_value(a IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS 7 PRECEDING), 0), 5) AS ratio FROM x",
    "bracket_years": f"WITH {universe._ASSIGN}, m AS (SELECT bracket, snapshot_date, count(*) AS m, min(cap_ratio) AS lo, max(cap_ratio) AS hi FROM asg GROUP BY 1, 2), s AS (SELECT bracket, CAST(year(snapshot_date) AS INTEGER) AS year, CAST(sum(m) AS BIGINT) AS member_rows, avg(m) AS am, min(m) AS min_members, avg(lo) AS lo, avg(hi) AS hi FROM m GROUP BY 1, 2), "
    "i AS (SELECT bracket, CAST(year(snapshot_date) AS INTEGER) AS year, count(DISTINCT id) AS n_ids FROM asg GROUP BY 1, 2) SELECT bracket, year, n_ids, member_rows, round(am, 6) AS avg_members, min_members, round(lo, 8) AS least_ratio, round(hi, 8) AS largest_ratio FROM s JOIN i USING (bracket, year)",
    "cluster_members": "SELECT label, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS members, count(*) AS size FROM embeddings GROUP BY 1",
    "cluster_matrix": "SELECT vec_id AS node, " + ", ".join(f"CAST(label = {c} AS INTEGER) AS c{c}" for c in range(10)) + " FROM embeddings",
    "spearman_pairs": f"WITH {data.DENSE}, x AS (SELECT date, id, round(r, 6) AS r FROM dense WHERE r IS NOT NULL), c AS (SELECT date FROM x GROUP BY 1 HAVING count(*) = 25), y AS (SELECT date, id, rank() OVER (PARTITION BY id ORDER BY r) + (count(*) OVER (PARTITION BY id, r) - 1) / 2 AS k FROM x WHERE date IN (SELECT date FROM c)) SELECT p.id AS a, q.id AS b, round(corr(p.k, q.k), 6) AS corr FROM y p JOIN y q ON p.date = q.date AND p.id < q.id GROUP BY 1, 2",
    "ou_score_legs": f"WITH ou AS ({books.SQL['ou_scores']}), c AS (SELECT *, {data.CLUSTER} AS cluster FROM ou WHERE s IS NOT NULL) SELECT date, id, round(CASE WHEN s < -1.0 THEN 0.5 / count(*) FILTER (s < -1.0) OVER (PARTITION BY date, cluster) WHEN s > 1.0 THEN -0.5 / count(*) FILTER (s > 1.0) OVER (PARTITION BY date, cluster) ELSE 0 END, 6) AS w FROM c",
    "inverse_vol": books._S + ", a AS (SELECT *, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END AS sd FROM sig WINDOW w AS (PARTITION BY id ORDER BY date ROWS 19 PRECEDING)), b AS (SELECT *, lag(1 / (sd + 1e-8)) OVER (PARTITION BY id ORDER BY date) AS iv FROM a) SELECT date, id, round(iv / sum(iv) OVER (PARTITION BY date), 6) AS iv FROM b",
    "half_life_scales": f"WITH ou AS ({books.SQL['ou_scores']}) SELECT date, id, round(coalesce(greatest(least(3.0 / half_life, 1.0), 0.25), 0.25), 5) AS scale FROM ou WHERE half_life IS NOT NULL",
    "factor_exposures": books._Q + ", l AS (SELECT id, round(ln(avg(volume)), 6) AS beta FROM week GROUP BY 1) SELECT date, round(sum(w * beta), 5) AS exposure FROM qw JOIN l USING (id) GROUP BY 1",
    "last_known_balance": f"WITH {data.USER}, k AS (SELECT id, CAST(date - 9855 AS DATE) AS date, value FROM usr WHERE n > 1 AND value IS NOT NULL), o AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders) SELECT o_orderkey, k.value FROM o ASOF LEFT JOIN k ON o.id = k.id AND o.date >= k.date",
    "simple_returns": f"WITH {data.DENSE} SELECT date, id, round(exp(r - m + m) - 1, 7) AS simple FROM dense WHERE r IS NOT NULL",
}
