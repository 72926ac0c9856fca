"""Universe plans and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import asof, panel, returns, universe

from . import data

_ASSIGN = data.SNAP + """,
ref AS (SELECT snapshot_date, CAST(sum(CAST(mcap AS DECIMAL(38,2))) AS DOUBLE) AS reference FROM snap WHERE mcap > 0 GROUP BY 1),
asg AS (SELECT * FROM (SELECT s.snapshot_date, id, mcap / reference AS cap_ratio,
  CASE WHEN mcap / reference >= 0.1 THEN 'B0' WHEN mcap / reference >= 0.01 THEN 'B1' WHEN mcap / reference >= 0.001 THEN 'B2' WHEN mcap / reference >= 0.0001 THEN 'B3' END AS bracket
  FROM snap s JOIN ref USING (snapshot_date) WHERE mcap > 0) WHERE bracket IS NOT NULL)
"""
_RANKED = data.SNAP + ", rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY mcap DESC, id) AS rank FROM snap)"


def _assignments(spark, sf):
    snaps = data.snapshots(spark, sf)
    return universe.assign_brackets(snaps, universe.reference_caps(snaps))


def _ranked(spark, sf):
    return data.snapshots(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_date").orderBy(F.desc("mcap"), "id")))


def bracket_membership_counts(spark, sf):
    held = asof.membership(_assignments(spark, sf), data.order_days(spark, sf))
    return universe.member_counts(held, ["date", "bracket"])


def bracket_assignments(spark, sf):
    return _assignments(spark, sf).withColumn("cap_ratio", F.round("cap_ratio", 9))


def bracket_dollar_bounds(spark, sf):
    bounds = universe.bracket_bounds(universe.reference_caps(data.snapshots(spark, sf)))
    return bounds.select("snapshot_date", "bracket", F.round("lo_usd", 2).alias("lo_usd"), F.round("hi_usd", 2).alias("hi_usd"))


def bracket_size_stats(spark, sf):
    counts = universe.member_counts(_assignments(spark, sf), ["snapshot_date", "bracket"])
    ids = _assignments(spark, sf).groupBy("bracket").agg(F.countDistinct("id").alias("tokens"))
    stats = counts.groupBy("bracket").agg(F.round(F.avg("n_members"), 6).alias("mean_members"), F.min("n_members").alias("min_members"), F.max("n_members").alias("max_members"), F.sum(F.col("clusterable").cast("bigint")).alias("n_clusterable"), F.count("*").alias("n_snapshots"))
    return stats.join(ids, "bracket")


def rank_band_asof(spark, sf):
    held = universe.rank_band(_ranked(spark, sf), data.order_days(spark, sf), 11, 40)
    return held.groupBy("date", "snapshot_date").agg(F.count("*").alias("n"), F.sum("rank").alias("rank_sum"))


def rank_cutoff(spark, sf):
    return universe.rank_cutoff_binds(_ranked(spark, sf), 50, F.lit(100_000.0)).select("snapshot_date", "max_rank", "cap_at_cutoff", "binds")


def rank_cutoff_by_year(spark, sf):
    binds = universe.rank_cutoff_binds(_ranked(spark, sf), 50, F.lit(300_000.0))
    return binds.groupBy(F.year("snapshot_date").alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("binds").cast("bigint")).alias("n_binding"), F.min("cap_at_cutoff").alias("least_cap"))


def membership_strictly_before(spark, sf):
    held = asof.day_to_snapshot(data.order_days(spark, sf), data.snapshots(spark, sf), strict=True)
    return held.groupBy("snapshot_date").agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"))


def month_end_snapshots(spark, sf):
    days = universe.month_ends(data.week_panel(spark, sf))
    return data.week_panel(spark, sf).join(days, "date", "left_semi").groupBy("date").agg(F.count("*").alias("n"))


def _listings(spark, sf):
    users = data.user_days(spark, sf)
    return users.select("date", "id", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "id")).alias("rank"), (F.col("value") / F.col("n")).alias("price"), "value", F.col("n").cast("double").alias("mcap")).withColumn("volume", F.col("value"))


_LIST = data.USER + """,
lst AS (SELECT date, id, row_number() OVER (PARTITION BY date ORDER BY value DESC, id) AS rank, value / n AS price, value AS volume, CAST(n AS DOUBLE) AS mcap FROM usr),
fin AS (SELECT max(date) AS window_end FROM lst)
"""


def _end(spark, sf):
    return data.user_days(spark, sf).agg(F.max("date")).first()[0]


def _universe(spark, sf):
    dead = data.user_days(spark, sf).select("id").distinct().where("id % 3 = 0")
    return universe.universe_table(_listings(spark, sf), dead, _end(spark, sf), stale_days=1, floor=100.0)


def universe_exit_table(spark, sf):
    return _universe(spark, sf).select("id", "first_date", "last_date", "n_obs", "best_rank", F.round("last_price", 6).alias("last_price"), "exit_kind", "delisting_rule", "delisted")


def universe_exits_by_year(spark, sf):
    return universe.exit_summary(_universe(spark, sf))


def delisting_rules(spark, sf):
    history = _listings(spark, sf).withColumn("price", F.when(F.col("id") % 7 == 0, -F.col("price")).otherwise(F.col("price")))
    return universe.classify_delisting(history, _end(spark, sf), stale_days=1)


def listing_lives(spark, sf):
    history = _listings(spark, sf).withColumn("price", F.when(F.col("id") % 7 == 0, -F.col("price")).otherwise(F.col("price")))
    snaps = _listings(spark, sf).where("day(date) % 10 = 0").select(F.col("date").alias("snapshot_date"), "id", F.concat(F.lit("u"), "id", F.lit("-"), F.month("date")).alias("symbol"), "rank")
    return universe.listing_table(history, snaps, history.select("id").distinct().where("id % 5 = 0"), _end(spark, sf), stale_days=1)


def survivor_treatments(spark, sf):
    weeks = data.week_panel(spark, sf)
    dense = data.dense_week(spark, sf)
    dead = weeks.select("id").distinct().where("substr(id, length(id), 1) IN ('1', '5')")
    books = universe.survivorship_books(weeks.select("date", "id"), dead, universe.complete_history(dense, "price", 0.998))
    return books.groupBy("treatment").agg(F.count("*").alias("member_weeks"), F.countDistinct("id").alias("ids"))


def redenominations(spark, sf):
    dense = data.dense_week(spark, sf).withColumn("flag", universe.redenomination_flags(still=0.5))
    return dense.groupBy(F.year("date").alias("year")).agg(F.sum(F.col("flag").cast("bigint")).alias("n_flags"), F.count("price").alias("n_prices"))


def implied_supply(spark, sf):
    return data.week_panel(spark, sf).select("date", "id", F.round(universe.implied_supply(), 4).alias("supply"))


def liquid_universe_mask(spark, sf):
    held = universe.liquid_universe(data.dense_week(spark, sf), 0.2, 0.9, 1000.0)
    return held.groupBy("date").agg(F.sum(F.col("member").cast("bigint")).alias("n"), F.round(F.avg(F.col("member").cast("double")), 6).alias("share"))


def value_weighted_market(spark, sf):
    out = returns.value_weighted_market(data.dense_week(spark, sf))
    return out.select("date", F.round("r_market", 6).alias("r_market"), F.round("level", 6).alias("level"))


def excess_returns_scrubbed(spark, sf):
    dense = data.dense_week(spark, sf).withColumn("x", returns.excess("r", "m"))
    return dense.select("date", "id", F.round(returns.scrubbed("x", 1.0), 6).alias("x"))


def extreme_returns_by_year(spark, sf):
    return data.dense_week(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count("r").alias("n"), returns.scrub_count("r", 1.0).alias("n_extreme"))


def terminal_shock(spark, sf):
    dense = data.dense_week(spark, sf).withColumn("x", returns.scrubbed("r"))
    ends = data.week_panel(spark, sf).groupBy("id").agg(F.when(F.max("id").like("%2"), F.lit("1999-06-30").cast("date")).alias("delisting_date"))
    return returns.with_terminal_shock(dense, ends, "x", "m").select("date", "id", F.round("x", 6).alias("x"))


def quality_report(spark, sf):
    out = panel.quality_report(data.dense_week(spark, sf), "r")
    return out.select("id", "n_obs", *(F.round(c, 6).alias(c) for c in ("missing", "mean", "std", "min", "max", "skew", "kurtosis")))


def availability_by_year(spark, sf):
    users = data.user_days(spark, sf)
    bases = users.select("id").distinct().withColumn("base", F.when(F.col("id") % 11 != 0, F.concat(F.lit("T"), (F.col("id") % 120).cast("string"))))
    venues = bases.where("id % 2 = 0").select("base")
    funding = users.where("id % 5 < 3").join(bases, "id").where("base IS NOT NULL").select("date", "base")
    out = universe.availability_rollup(universe.availability(users.select("date", "id"), bases, venues, funding))
    return out.select("year", "member_days", *(F.round(f"{c}_share", 6).alias(f"{c}_share") for c in ("ambiguous", "static", "supported", "unknown")))


QUERIES = [
    bracket_membership_counts, bracket_assignments, bracket_dollar_bounds, bracket_size_stats, rank_band_asof, rank_cutoff, rank_cutoff_by_year, membership_strictly_before, month_end_snapshots,
    universe_exit_table, universe_exits_by_year, delisting_rules, listing_lives, survivor_treatments, redenominations, implied_supply, liquid_universe_mask, value_weighted_market, excess_returns_scrubbed,
    extreme_returns_by_year, terminal_shock, quality_report, availability_by_year,
]

_UNIVERSE = _LIST + """,
lastp AS (SELECT id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_obs, min(rank) AS best_rank, arg_max(price, date) AS last_price, arg_max(volume, date) AS last_volume FROM lst GROUP BY id),
uni AS (SELECT *, CASE WHEN date_diff('day', last_date, window_end) <= 1 THEN 'alive' WHEN id % 3 = 0 THEN 'death' ELSE 'censored_by_rank' END AS exit_kind FROM lastp, fin)
"""

SQL = {
    "bracket_membership_counts": f"WITH {_ASSIGN}, {data.DAYS}, sd AS (SELECT DISTINCT snapshot_date FROM asg), held AS (SELECT d.date, s.snapshot_date FROM days d ASOF JOIN sd s ON d.date >= s.snapshot_date) "
    "SELECT date, bracket, count(*) AS n_members, count(*) >= 30 AS clusterable FROM held JOIN asg USING (snapshot_date) GROUP BY 1, 2",
    "bracket_assignments": f"WITH {_ASSIGN} SELECT snapshot_date, id, round(cap_ratio, 9) AS cap_ratio, bracket FROM asg",
    "bracket_dollar_bounds": f"WITH {_ASSIGN} SELECT snapshot_date, bracket, round(low * reference, 2) AS lo_usd, round(high * reference, 2) AS hi_usd FROM ref, (VALUES ('B0', 0.1::DOUBLE, NULL::DOUBLE), ('B1', 0.01, 0.1), ('B2', 0.001, 0.01), ('B3', 0.0001, 0.001)) b(bracket, low, high)",
    "bracket_size_stats": f"WITH {_ASSIGN}, c AS (SELECT snapshot_date, bracket, count(*) AS n FROM asg GROUP BY 1, 2), t AS (SELECT bracket, count(DISTINCT id) AS tokens FROM asg GROUP BY 1) "
    "SELECT bracket, round(avg(n), 6) AS mean_members, min(n) AS min_members, max(n) AS max_members, CAST(sum(CASE WHEN n >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_clusterable, count(*) AS n_snapshots, any_value(tokens) AS tokens FROM c JOIN t USING (bracket) GROUP BY 1",
    "rank_band_asof": f"WITH {_RANKED}, {data.DAYS}, band AS (SELECT * FROM rk WHERE rank BETWEEN 11 AND 40), sd AS (SELECT DISTINCT snapshot_date FROM band), held AS (SELECT d.date, s.snapshot_date FROM days d ASOF JOIN sd s ON d.date >= s.snapshot_date) "
    "SELECT date, snapshot_date, count(*) AS n, CAST(sum(rank) AS BIGINT) AS rank_sum FROM held JOIN band USING (snapshot_date) GROUP BY 1, 2",
    "rank_cutoff": f"WITH {_RANKED} SELECT snapshot_date, CAST(max(rank) AS INTEGER) AS max_rank, arg_max(mcap, rank) FILTER (mcap > 0) AS cap_at_cutoff, arg_max(mcap, rank) FILTER (mcap > 0) > 100000 AS binds FROM rk WHERE rank <= 50 GROUP BY 1",
    "rank_cutoff_by_year": f"WITH {_RANKED}, b AS (SELECT snapshot_date, arg_max(mcap, rank) FILTER (mcap > 0) AS cap FROM rk WHERE rank <= 50 GROUP BY 1) SELECT CAST(year(snapshot_date) AS INTEGER) AS year, count(*) AS n, CAST(sum(CASE WHEN cap > 300000 THEN 1 ELSE 0 END) AS BIGINT) AS n_binding, min(cap) AS least_cap FROM b GROUP BY 1",
    "membership_strictly_before": f"WITH {data.SNAP}, {data.DAYS}, sd AS (SELECT DISTINCT snapshot_date FROM snap) SELECT s.snapshot_date, count(*) AS n_days, min(d.date) AS first_day FROM days d ASOF JOIN sd s ON d.date > s.snapshot_date GROUP BY 1",
    "month_end_snapshots": f"WITH {data.WEEK}, e AS (SELECT max(date) AS date FROM week GROUP BY date_trunc('month', date)) SELECT date, count(*) AS n FROM week SEMI JOIN e USING (date) GROUP BY 1",
    "universe_exit_table": f"WITH {_UNIVERSE} SELECT id, first_date, last_date, n_obs, CAST(best_rank AS INTEGER) AS best_rank, round(last_price, 6) AS last_price, exit_kind, CASE exit_kind WHEN 'death' THEN CASE WHEN last_volume >= 100 THEN 'last_price' ELSE 'total_loss' END WHEN 'alive' THEN 'alive' ELSE 'censored' END AS delisting_rule, exit_kind = 'death' AS delisted FROM uni",
    "universe_exits_by_year": f"WITH {_UNIVERSE} SELECT CAST(year(last_date) AS INTEGER) AS year, count(*) FILTER (exit_kind = 'alive') AS alive, count(*) FILTER (exit_kind = 'death') AS death, count(*) FILTER (exit_kind = 'censored_by_rank') AS censored_by_rank FROM uni GROUP BY 1",
    "delisting_rules": f"WITH {_LIST}, h AS (SELECT id, date, CASE WHEN id % 7 = 0 THEN -price ELSE price END AS price, volume FROM lst), l AS (SELECT id, max(date) FILTER (price > 0) AS last_date, arg_max(volume, date) FILTER (price > 0) AS v, max(date) FILTER (price <= 0) AS dd FROM h GROUP BY 1) "
    "SELECT id, last_date, CASE WHEN coalesce(dd > last_date, last_date IS NULL) THEN 'total_loss' WHEN date_diff('day', last_date, window_end) <= 1 THEN 'alive' WHEN v > 0 THEN 'last_price' ELSE 'total_loss' END AS rule FROM l, fin",
    "listing_lives": f"WITH {_LIST}, h AS (SELECT id, date, CASE WHEN id % 7 = 0 THEN -price ELSE price END AS price, volume FROM lst), l AS (SELECT id, min(date) FILTER (price > 0) AS first_date, max(date) FILTER (price > 0) AS last_date, count(*) FILTER (price > 0) AS n_obs, "
    "arg_max(volume, date) FILTER (price > 0) AS v, max(date) FILTER (price <= 0) AS dd FROM h GROUP BY 1), b AS (SELECT id, arg_max('u' || id || '-' || month(date), date) AS symbol, min(rank) AS best_rank, count(*) AS months_in_band FROM lst WHERE day(date) % 10 = 0 GROUP BY 1), "
    "r AS (SELECT l.*, id % 5 = 0 AS untracked, coalesce(date_diff('day', last_date, window_end) > 1, FALSE) AS prices_stop, CASE WHEN coalesce(dd > last_date, last_date IS NULL) THEN 'total_loss' WHEN date_diff('day', last_date, window_end) <= 1 THEN 'alive' WHEN v > 0 THEN 'last_price' ELSE 'total_loss' END AS delisting_rule FROM l, fin) "
    "SELECT id, symbol, first_date, last_date, n_obs, CAST(best_rank AS INTEGER) AS best_rank, coalesce(months_in_band, 0) AS months_in_band, untracked, prices_stop, untracked OR prices_stop AS delisted, delisting_rule, CASE WHEN delisting_rule <> 'alive' THEN last_date END AS delisting_date, CASE WHEN delisting_rule = 'total_loss' THEN CAST(0.01 AS DOUBLE) END AS residual FROM r LEFT JOIN b USING (id)",
    "survivor_treatments": f"WITH {data.DENSE}, full_ AS (SELECT id FROM dense GROUP BY 1 HAVING count(price) / count(*) >= 0.998), surv AS (SELECT date, id FROM week WHERE right(id, 1) NOT IN ('1', '5')), "
    "b AS (SELECT 'pit' AS treatment, id FROM week UNION ALL SELECT 'survivor', id FROM surv UNION ALL SELECT 'snapshot', id FROM surv SEMI JOIN full_ USING (id)) SELECT treatment, count(*) AS member_weeks, count(DISTINCT id) AS ids FROM b GROUP BY 1",
    "redenominations": f"WITH {data.DENSE}, f AS (SELECT date, price, coalesce(abs(ln(price / lag(price) OVER w)) >= ln(2) AND abs(ln(mcap / lag(mcap) OVER w)) <= 0.5, FALSE) AS flag FROM dense WINDOW w AS (PARTITION BY id ORDER BY date)) SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS n_flags, count(price) AS n_prices FROM f GROUP BY 1",
    "implied_supply": f"WITH {data.WEEK} SELECT date, id, round(mcap / price, 4) AS supply FROM week",
    "liquid_universe_mask": f"WITH {data.DENSE}, p AS (SELECT *, CASE WHEN mcap IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY mcap NULLS LAST) + (count(mcap) OVER (PARTITION BY date, mcap) - 1) / 2) / count(mcap) OVER (PARTITION BY date) END AS pct, "
    "avg(volume) OVER w20 AS nv, count(volume) OVER w20 AS cv, count(r) OVER (PARTITION BY id ORDER BY date ROWS 59 PRECEDING) AS hist, lag(date) OVER (PARTITION BY id ORDER BY date) AS pd FROM dense WINDOW w20 AS (PARTITION BY id ORDER BY date ROWS 19 PRECEDING)), "
    "o AS (SELECT date, id, coalesce(pct >= 0.2 AND pct <= 0.9 AND cv >= 5 AND nv >= 1000 AND hist = 60, FALSE) AS ok, pd IS NULL OR date_trunc('month', date) <> date_trunc('month', pd) OR date = last_day(date) AS d FROM p), "
    "h AS (SELECT date, last_value(CASE WHEN d THEN ok END IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS member FROM o) SELECT date, CAST(sum(CASE WHEN member THEN 1 ELSE 0 END) AS BIGINT) AS n, round(avg(CASE WHEN member THEN 1.0 ELSE 0.0 END), 6) AS share FROM h GROUP BY 1",
    "value_weighted_market": f"WITH {data.DENSE}, w AS (SELECT date, r, lag(mcap) OVER (PARTITION BY id ORDER BY date) AS w FROM dense), d AS (SELECT date, sum(r * w) FILTER (r IS NOT NULL AND w > 0) / sum(w) FILTER (r IS NOT NULL AND w > 0) AS rm FROM w GROUP BY 1) "
    "SELECT date, round(rm, 6) AS r_market, round(exp(sum(coalesce(rm, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) AS level FROM d",
    "excess_returns_scrubbed": f"WITH {data.DENSE} SELECT date, id, round(CASE WHEN abs(r - m) <= 1.0 THEN r - m END, 6) AS x FROM dense",
    "extreme_returns_by_year": f"WITH {data.DENSE} SELECT CAST(year(date) AS INTEGER) AS year, count(r) AS n, CAST(coalesce(sum(CASE WHEN abs(r) > 1.0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_extreme FROM dense GROUP BY 1",
    "terminal_shock": f"WITH {data.DENSE}, a AS (SELECT date, id, CASE WHEN abs(r) <= ln(5) THEN r END AS r, m, CASE WHEN id LIKE '%2' THEN sum(CASE WHEN date > DATE '1999-06-30' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END AS k FROM dense) "
    "SELECT date, id, round(CASE WHEN k = 0 THEN r WHEN k = 1 THEN ln(0.01) - coalesce(m, 0) END, 6) AS x FROM a",
    "quality_report": f"WITH {data.DENSE} SELECT id, count(r) AS n_obs, round(1 - count(r) / count(*), 6) AS missing, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurtosis FROM dense GROUP BY 1",
    "availability_by_year": f"WITH {data.USER}, bs AS (SELECT id, CASE WHEN id % 11 <> 0 THEN 'T' || CAST(id % 120 AS VARCHAR) END AS base FROM (SELECT DISTINCT id FROM usr)), bn AS (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM bs), "
    "vn AS (SELECT DISTINCT base FROM bs WHERE id % 2 = 0 AND base IS NOT NULL), fd AS (SELECT DISTINCT u.date + 1 AS date, base FROM usr u JOIN bs USING (id) WHERE id % 5 < 3 AND base IS NOT NULL), "
    "k AS (SELECT u.date, coalesce(bn.base IS NOT NULL AND bn.n > 1, FALSE) AS amb, coalesce(bn.n = 1, FALSE) AND vn.base IS NOT NULL AS st, coalesce(bn.n = 1, FALSE) AND fd.base IS NOT NULL AS su, bn.base IS NULL AS un FROM usr u LEFT JOIN bn USING (id) LEFT JOIN vn ON bn.base = vn.base LEFT JOIN fd ON bn.base = fd.base AND u.date = fd.date) "
    "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS member_days, round(avg(CASE WHEN amb THEN 1.0 ELSE 0 END), 6) AS ambiguous_share, round(avg(CASE WHEN st THEN 1.0 ELSE 0 END), 6) AS static_share, round(avg(CASE WHEN su THEN 1.0 ELSE 0 END), 6) AS supported_share, round(avg(CASE WHEN un THEN 1.0 ELSE 0 END), 6) AS unknown_share FROM k GROUP BY ROLLUP (CAST(year(date) AS INTEGER))",
}
