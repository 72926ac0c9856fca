"""Comparisons of arms, parameter grids, shortability, cross-checks of sources, and other small studies of panels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inference, panel, portfolio

# -- arms -----------------------------------------------------------------------------------------


def expected_best(trials: int) -> float:
    """Expected largest of so many standard normal draws; zero for fewer than two."""
    return inference.expected_max_sharpe(trials, 1.0)


def leaderboard(day: DataFrame, arm: str = "arm", x: str = "net", year: int = 365) -> DataFrame:
    """``arm, n, mean, std, sharpe, z, dsr_z, rank`` of long daily returns, best first; arms without a Sharpe ratio come last.

    ``z`` is that of the Sharpe ratio over zero, ``dsr_z`` over the expected best of the pool of arms; their normal
    probabilities are the probabilistic and the deflated Sharpe ratio.
    """
    c = F.col(x)
    arms = day.groupBy(arm).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), panel.sample_skew(c).alias("skew"), panel.sample_kurtosis(c).alias("kurtosis"))
    arms = arms.withColumn("s", F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)))
    trials, spread = arms.agg(F.count("s"), F.stddev_samp("s")).first()
    bar = (spread or 0.0) * expected_best(trials)
    wide = F.sqrt(1 - F.col("skew") * F.col("s") + (F.col("kurtosis") + 2) / 4 * F.col("s") * F.col("s"))
    z = lambda over: (F.col("s") - over) * F.sqrt(F.col("n") - 1) / wide
    order = Window.orderBy(F.col("s").desc_nulls_last(), arm)  # a row per arm
    return arms.select(arm, "n", "mean", "std", (F.col("s") * math.sqrt(year)).alias("sharpe"), z(0.0).alias("z"), z(bar).alias("dsr_z"), F.row_number().over(order).alias("rank"))


def best_per_group(scores: DataFrame, group: str, arm: str = "arm", score: str = "sharpe") -> DataFrame:
    """The arm with the highest score of each group; missing scores never win, ties go to the first name."""
    best = F.min(F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(arm).alias("a"))))
    return scores.groupBy(group).agg(best.alias("b")).where("b IS NOT NULL").select(group, F.col("b.a").alias(arm), (-F.col("b.s")).alias(score))


def carry_grid(day: DataFrame, grid=(0.0, 3.0, 6.0, 10.0), year: int = 365) -> DataFrame:
    """Mean, deviation and Sharpe of ``net`` less a daily carry, in basis points, on ``short`` exposure."""
    net = day.withColumn("carry_bps", F.explode(F.array(*(F.lit(float(g)) for g in grid)))).withColumn("n", F.col("net") - F.abs("short") * F.col("carry_bps") / 1e4)
    out = net.groupBy("carry_bps").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))
    return out.withColumn("sharpe", F.col("mean") / (F.col("std") + portfolio.EPS) * math.sqrt(year))


def pnl_split(day: DataFrame, by: Column) -> DataFrame:
    """Gross, cost and net of each period, and the share of the gross (in size) that costs take."""
    out = day.groupBy(by.alias("period")).agg(F.count("*").alias("n"), F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("net").alias("net"))
    return out.withColumn("cost_ratio", F.try_divide(F.col("cost"), F.abs("gross")))


def lookback_grid(dense: DataFrame, lookbacks=(5, 20, 60), holdings=(1, 5), x: str = "deviation", r: str = "r", year: int = 365) -> DataFrame:
    """``lookback, holding, n, mean, sharpe`` of books against the sum of ``x`` over so many rows, averaged over the last holdings.

    Positions are minus the sign of the sum, a row late, spread equally over the names of a date; all settings share
    one pass over the panel's windows.
    """
    signs = [F.struct(F.lit(n).alias("lookback"), F.signum(panel.lag(panel.rolling(F.sum, x, n, max(2, n // 2)))).alias("s")) for n in lookbacks]
    long = dense.withColumns({f"_s{i}": s for i, s in enumerate(signs)}).select("id", "date", r, F.explode(F.array(*(F.col(f"_s{i}") for i in range(len(signs))))).alias("g")).select("id", "date", r, "g.*")
    held = [F.struct(F.lit(h).alias("holding"), (-F.avg("s").over(Window.partitionBy("id", "lookback").orderBy("date").rowsBetween(1 - h, 0))).alias("p")) for h in holdings]
    long = long.withColumns({f"_h{i}": h for i, h in enumerate(held)}).select("id", "date", "lookback", r, F.explode(F.array(*(F.col(f"_h{i}") for i in range(len(held))))).alias("g")).select("id", "date", "lookback", r, "g.*")
    day = long.where(F.col("p").isNotNull() & F.col(r).isNotNull()).groupBy("lookback", "holding", "date").agg(F.avg(F.col("p") * F.col(r)).alias("net"))
    return day.groupBy("lookback", "holding").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), inference.sharpe(F.col("net"), year).alias("sharpe"))


def factor_sweep(dense: DataFrame, characteristics: list[str], least: int = 8, year: int = 52, **rules) -> DataFrame:
    """``factor, n, mean, sharpe`` of the quintile book of each characteristic; Sharpe null under ``least`` rows."""
    out = None
    for name in characteristics:
        day = portfolio.quintile_long_short(dense, name, **rules)
        part = day.agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.when(F.count("net") >= least, inference.sharpe(F.col("net"), year)).alias("sharpe")).select(F.lit(name).alias("factor"), "n", "mean", "sharpe")
        out = part if out is None else out.unionByName(part)
    return out


def verify_book(day: DataFrame, cap: float | None = None, tolerance: float = 1e-9) -> DataFrame:
    """``rule, failures``: net is gross less cost, costs and turnover are not negative, turnover keeps its cap, nothing is missing."""
    rules = {
        "net_is_gross_less_cost": F.abs(F.col("net") - (F.col("gross") - F.col("cost"))) > tolerance,
        "cost_not_negative": F.col("cost") < 0,
        "turnover_in_bounds": (F.col("turnover") < 0) | (F.col("turnover") > F.lit(cap if cap is not None else math.inf) + tolerance),
        "nothing_missing": F.col("net").isNull() | F.col("gross").isNull() | F.col("cost").isNull(),
    }
    sums = day.agg(*(F.coalesce(F.sum(F.coalesce(bad, F.lit(False)).cast("long")), F.lit(0)).alias(name) for name, bad in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in rules))).alias("r")).select("r.*")


# -- who can be shorted ---------------------------------------------------------------------------


def preferred_contract(contracts: DataFrame, quote: str = "USDT") -> DataFrame:
    """One ``symbol`` for each ``base``: contracts in the preferred quote first, then the first name."""
    order = Window.partitionBy("base").orderBy(F.col("symbol").endswith(quote).desc(), "symbol")
    return contracts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def shortable(universe: DataFrame, perps: DataFrame) -> DataFrame:
    """``universe`` (with ``base``) with ``venues`` (their names in order, joined by commas), ``n_venues`` and ``shortable``.

    Venues are gathered for each base before the join, so a base of many contracts costs one row.
    """
    held = perps.where(F.col("base").isNotNull()).groupBy("base").agg(F.concat_ws(",", F.sort_array(F.collect_set("venue"))).alias("venues"), F.countDistinct("venue").cast("long").alias("n_venues"))
    return universe.join(held, "base", "left").withColumn("n_venues", F.coalesce("n_venues", F.lit(0))).withColumn("shortable", F.col("n_venues") > 0)


def shortable_only(universe: DataFrame, perps: DataFrame) -> DataFrame:
    return universe.join(perps.select("base").distinct(), "base", "left_semi")


def coverage(assessed: DataFrame) -> DataFrame:
    """One row: names, those that can be shorted, and their share."""
    return assessed.agg(F.count("*").alias("n"), F.count(F.when(F.col("shortable"), 1)).alias("n_shortable"), F.avg(F.col("shortable").cast("double")).alias("share"))


def needed_months(assignments: DataFrame, contracts: DataFrame, snapshot: str = "snapshot_date") -> DataFrame:
    """Distinct ``symbol, month`` of members: the month of each snapshot and the one after it. ``contracts``: ``id, symbol``."""
    months = assignments.select("id", F.explode(F.array(*(F.add_months(F.trunc(snapshot, "month"), i) for i in (0, 1)))).alias("month"))
    return months.join(contracts, "id").select("symbol", "month").distinct()


def mean_quantiles(rates: DataFrame, key: str, x: str, quantiles=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``q, value``: quantiles over the keys of their means."""
    means = rates.groupBy(key).agg(F.avg(x).alias("m"))
    row = means.agg(F.percentile("m", F.array(*(F.lit(q) for q in quantiles))).alias("v"))
    return row.select(F.explode(F.arrays_zip(F.array(*(F.lit(q) for q in quantiles)).alias("q"), F.col("v").alias("value"))).alias("x")).select(F.col("x.q").alias("q"), F.col("x.value").alias("value"))


# -- panels ---------------------------------------------------------------------------------------


def winsorised(dense: DataFrame, x: str = "r", limit: float = 2.0, max_missing: float = 0.2) -> DataFrame:
    """``dense`` with ``x`` held within the limits, without ids of which more than ``max_missing`` is missing."""
    kept = dense.groupBy("id").agg(F.avg(F.col(x).isNull().cast("double")).alias("gone")).where(F.col("gone") <= max_missing).select("id")
    held = F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.lit(limit)), F.lit(-limit)))
    return dense.join(kept, "id", "left_semi").withColumn(x, held)


def masked(dense: DataFrame, members: DataFrame, x: str = "r") -> DataFrame:
    """``dense`` with ``x`` null where the id is no member of its date. ``members``: ``date, id``, repeated or not."""
    flags = members.select("date", "id").distinct().withColumn("_in", F.lit(True))
    return dense.join(flags, ["date", "id"], "left").withColumn(x, F.when(F.col("_in"), F.col(x))).drop("_in")


def daily_members(dense: DataFrame, rank: str = "rank", top: int = 1000, cap: str = "mcap", least: float = 1e6) -> DataFrame:
    """``date, id`` of those ranked among the top and worth more than the least, day by day."""
    return dense.where((F.col(rank) <= top) & (F.col(cap) > least)).select("date", "id")


def relative_cap(dense: DataFrame, reference: DataFrame) -> DataFrame:
    """``dense`` with ``cap_proxy``: dollar volume over that of the reference (``date, price, volume``) on the date."""
    ref = reference.select("date", (F.col("price") * F.col("volume")).alias("_ref"))
    return dense.join(ref, "date", "left").withColumn("cap_proxy", F.try_divide(F.col("volume") * F.col("price"), F.col("_ref"))).drop("_ref")


def cross_check(panel_: DataFrame, histories: DataFrame, x: str = "price", tolerance: float = 0.02, least: int = 10) -> DataFrame:
    """``id, n, median_gap, share_off``: relative gaps of two sources on common dates, for ids with at least so many."""
    both = panel_.select("id", "date", F.col(x).alias("_a")).join(histories.select("id", "date", F.col(x).alias("_b")), ["id", "date"]).where("_a IS NOT NULL AND _b <> 0")
    gap = both.withColumn("gap", F.abs(F.col("_a") / F.col("_b") - 1))
    return gap.groupBy("id").agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("median_gap"), F.avg((F.col("gap") > tolerance).cast("double")).alias("share_off")).where(F.col("n") >= least)


def value_ratio(activity: DataFrame, caps: DataFrame, x: str, fill: int = 7) -> DataFrame:
    """``caps`` (``id, date, mcap``) with ``ratio`` of the cap to the activity, which holds for up to ``fill`` rows after its last value."""
    both = caps.join(activity.select("id", "date", F.col(x).alias("_x")), ["id", "date"], "left")
    last = F.last("_x", ignorenulls=True).over(panel.by_id().rowsBetween(-fill, 0))
    return both.withColumn("ratio", F.try_divide(F.col("mcap"), last)).drop("_x")


def matched_controls(dead: DataFrame, histories: DataFrame, least: int, tries: int = 40, seed: int = 0) -> DataFrame:
    """``id, control``: for each dead id the first of up to ``tries`` shuffled candidates of its bracket with so long a history.

    ``dead``: ``id, bracket``; ``histories``: ``id, bracket, n_obs`` of candidates. Candidates of a bracket are
    shuffled once and each dead id takes a run of ``tries`` of them, so no pair beyond these is made.
    """
    order = Window.partitionBy("bracket").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    pool = histories.select("bracket", F.col("id").alias("control"), "n_obs", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(Window.partitionBy("bracket")).alias("size"))
    sizes = pool.groupBy("bracket").agg(F.max("size").alias("size"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("size"))
    asked = dead.join(sizes, "bracket").select("id", "bracket", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.lit(tries), F.col("size").cast("int")) - 1), lambda i: F.pmod(start + i, F.col("size")))).alias("turn", "place"))
    found = asked.join(pool.drop("size"), ["bracket", "place"]).where((F.col("n_obs") >= least) & (F.col("control") != F.col("id")))
    return found.groupBy("id").agg(F.min(F.struct("turn", "control")).alias("b")).select("id", F.col("b.control").alias("control"))


def per_bracket_year(assignments: DataFrame, deaths: DataFrame | None = None) -> DataFrame:
    """``bracket, year, n_ids, member_rows, avg_members, min_members, least_ratio, largest_ratio`` (and ``n_deaths``) of monthly assignments."""
    year = F.year("snapshot_date").alias("year")
    months = assignments.groupBy("bracket", "snapshot_date").agg(F.count("*").alias("m"), F.min("cap_ratio").alias("lo"), F.max("cap_ratio").alias("hi"))
    sizes = months.groupBy("bracket", year).agg(F.sum("m").alias("member_rows"), F.avg("m").alias("avg_members"), F.min("m").alias("min_members"), F.avg("lo").alias("least_ratio"), F.avg("hi").alias("largest_ratio"))
    ids = assignments.groupBy("bracket", year).agg(F.countDistinct("id").alias("n_ids"))
    out = ids.join(sizes, ["bracket", "year"])
    if deaths is not None:
        dead = deaths.groupBy("bracket", F.year("date").alias("year")).agg(F.count("*").alias("n_deaths"))
        out = out.join(dead, ["bracket", "year"], "left").withColumn("n_deaths", F.coalesce("n_deaths", F.lit(0)))
    return out


# -- clusters and correlations ---------------------------------------------------------------------


def members(labels: DataFrame) -> DataFrame:
    """``label, members, size``: the nodes of each cluster, ascending."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size"))


def assignment_matrix(labels: DataFrame, clusters: list[int]) -> DataFrame:
    """``node`` and a column of zeros and ones for each cluster."""
    return labels.select("node", *(F.coalesce(F.col("label") == c, F.lit(False)).cast("int").alias(f"c{c}") for c in clusters))


def average_ranks(df: DataFrame, x: str, by: str = "id") -> DataFrame:
    """``df`` with ``x`` replaced by its average rank within ``by``; null stays null. Pearson of these is Spearman's."""
    present = F.when(F.col(x).isNotNull(), F.lit(1))
    rank = F.rank().over(Window.partitionBy(by).orderBy(F.col(x).asc_nulls_last())) + (F.count(x).over(Window.partitionBy(by, x)) - 1) / 2
    return df.withColumn(x, F.when(present == 1, rank.cast("double")))


def score_legs(scores: DataFrame, limit: float = 1.25, s: str = "s") -> DataFrame:
    """``w`` of reversion: long under ``-limit``, short over ``limit``, each leg of a cluster half a unit; zero elsewhere."""
    low, high = F.col(s) < -limit, F.col(s) > limit
    within = Window.partitionBy("date", "cluster")
    half = lambda leg, size: F.lit(size) / F.count(F.when(leg, 1)).over(within)
    return scores.withColumn("w", F.when(low, half(low, 0.5)).when(high, half(high, -0.5)).otherwise(F.lit(0.0)))
