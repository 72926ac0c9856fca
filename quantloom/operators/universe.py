"""Universes: caps relative to a reference, brackets, listing life, survivorship, liquidity, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, panel

#: Lower bounds of the cap ratio of each bracket, half-open decades.
BRACKETS = (("B0", 0.1), ("B1", 0.01), ("B2", 0.001), ("B3", 0.0001))
MIN_MEMBERS = 30


def bracket_of(ratio: Column) -> Column:
    out = None
    for name, low in BRACKETS:
        hit = (ratio >= low) & (ratio < float("inf"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def reference_caps(snapshots: DataFrame, reference_id=None) -> DataFrame:
    """``snapshot_date, reference``: the cap of one id (positive, the last per date), or of the whole date."""
    caps = snapshots.where(F.col("mcap") > 0)
    if reference_id is None:
        return caps.groupBy("snapshot_date").agg(F.sum(F.col("mcap").cast("decimal(38,2)")).cast("double").alias("reference"))
    return caps.where(F.col("id") == F.lit(reference_id)).groupBy("snapshot_date").agg(F.max("mcap").alias("reference"))


def assign_brackets(snapshots: DataFrame, reference: DataFrame, start=None, exclude=None) -> DataFrame:
    """``snapshot_date, id, cap_ratio, bracket``: only dates with a reference and ids that fall in a bracket."""
    s = snapshots.where(F.col("mcap") > 0)
    if start is not None:
        s = s.where(F.col("snapshot_date") >= F.lit(start))
    if exclude is not None:
        s = s.where(F.col("id") != F.lit(exclude))
    ratio = s.join(reference, "snapshot_date").withColumn("cap_ratio", F.col("mcap") / F.col("reference"))
    return ratio.select("snapshot_date", "id", "cap_ratio", bracket_of(F.col("cap_ratio")).alias("bracket")).where("bracket IS NOT NULL")


def member_counts(assignments: DataFrame, by: list[str], least: int = MIN_MEMBERS) -> DataFrame:
    return assignments.groupBy(*by).agg(F.count("*").alias("n_members")).withColumn("clusterable", F.col("n_members") >= least)


def bracket_bounds(reference: DataFrame) -> DataFrame:
    """Each bracket's bounds in money at each snapshot; the top one is open (null)."""
    highs = (None, *(low for _, low in BRACKETS[:-1]))
    rows = F.array(*(F.struct(F.lit(n).alias("bracket"), F.lit(low).alias("low"), F.lit(high).cast("double").alias("high")) for (n, low), high in zip(BRACKETS, highs)))
    return reference.select("snapshot_date", "reference", F.explode(rows).alias("b")).select(
        "snapshot_date", "b.bracket", (F.col("b.low") * F.col("reference")).alias("lo_usd"), (F.col("b.high") * F.col("reference")).alias("hi_usd")
    )


def rank_cutoff_binds(snapshots: DataFrame, depth: int, floor: Column) -> DataFrame:
    """Whether the ranking's depth cuts a bracket off: the last ranked id with a cap still lies above the floor."""
    ranked = snapshots.where(F.col("rank") <= depth).groupBy("snapshot_date").agg(
        F.max("rank").alias("max_rank"), F.max_by(F.when(F.col("mcap") > 0, F.col("mcap")), F.when(F.col("mcap") > 0, F.col("rank"))).alias("cap_at_cutoff")
    )
    return ranked.withColumn("binds", F.col("cap_at_cutoff") > floor)


def universe_table(listings: DataFrame, dead: DataFrame, window_end, stale_days: int = 7, policy: str = "volume_floor", floor: float = 10_000.0, residual: float = 0.01) -> DataFrame:
    """One row per id: life, last values, how it left, and the rule for its last return.

    ``listings``: ``date, id, rank, price, volume, mcap``; ``dead``: ``id``. An id is alive if seen within
    ``stale_days`` of the end; else dead if listed so, else censored by the ranking.
    """
    seen = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    per = listings.groupBy("id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_obs"), F.min("rank").alias("best_rank"),
        seen("price").alias("last_price"), seen("volume").alias("last_volume"), seen("mcap").alias("last_mcap"),
    )
    known = per.join(dead.select("id", F.lit(True).alias("dead")).distinct(), "id", "left")
    kind = F.when(F.datediff(F.lit(window_end), "last_date") <= stale_days, "alive").when(F.col("dead"), "death").otherwise("censored_by_rank")
    tradable = {"volume_floor": F.coalesce(F.col("last_volume") >= floor, F.lit(False)), "last_price": F.lit(True), "total_loss": F.lit(False)}[policy]
    rule = F.when(F.col("exit_kind") == "death", F.when(tradable, "last_price").otherwise("total_loss")).when(F.col("exit_kind") == "alive", "alive").otherwise("censored")
    return known.withColumn("exit_kind", kind).withColumn("delisting_rule", rule).select(
        "id", "first_date", "last_date", "n_obs", "best_rank", "last_price", "last_volume", "last_mcap", "exit_kind", "delisting_rule",
        F.when(F.col("exit_kind") == "death", F.col("last_date")).alias("delisting_date"), (F.col("exit_kind") == "death").alias("delisted"),
        F.when(F.col("delisting_rule") == "total_loss", F.lit(residual)).alias("residual"),
    )


def classify_delisting(history: DataFrame, window_end, stale_days: int = 7) -> DataFrame:
    """Per id of a price history: the last positive print, and the rule: a tail of non-positive prints is a total loss,
    a fresh print alive, an old one with volume its last price, one without a total loss."""
    last = history.groupBy("id").agg(F.max(F.when(F.col("price") > 0, F.col("date"))).alias("last_date"), F.max_by("volume", F.when(F.col("price") > 0, F.col("date"))).alias("last_volume"), F.max(F.when(F.col("price") <= 0, F.col("date"))).alias("last_dead"))
    tail = F.coalesce(F.col("last_dead") > F.col("last_date"), F.col("last_date").isNull())
    rule = F.when(tail, "total_loss").when(F.datediff(F.lit(window_end), "last_date") <= stale_days, "alive").when(F.col("last_volume") > 0, "last_price").otherwise("total_loss")
    return last.select("id", "last_date", rule.alias("rule"))


def listing_table(histories: DataFrame, snapshots: DataFrame, dead: DataFrame, window_end, stale_days: int = 7, residual: float = 0.01) -> DataFrame:
    """One row per id of ``histories`` (``date, id, price, volume``): its life, what the snapshots say of it, and how it left.

    ``snapshots``: ``snapshot_date, id, symbol, rank``; the last symbol, the best rank and the months in the band come
    from there, null and zero for ids it lacks. Delisted is who is listed in ``dead`` (``id``) or whose positive
    prices stop over ``stale_days`` before the end.
    """
    sound = F.col("price") > 0
    life = histories.groupBy("id").agg(F.min(F.when(sound, F.col("date"))).alias("first_date"), F.count(F.when(sound, 1)).alias("n_obs"))
    left = classify_delisting(histories, window_end, stale_days).withColumnRenamed("rule", "delisting_rule")
    band = snapshots.groupBy("id").agg(F.max_by("symbol", "snapshot_date").alias("symbol"), F.min("rank").alias("best_rank"), F.count("*").alias("months_in_band"))
    gone = dead.select("id", F.lit(True).alias("untracked")).distinct()
    out = life.join(left, "id").join(band, "id", "left").join(gone, "id", "left")
    out = out.withColumn("untracked", F.coalesce("untracked", F.lit(False)))
    stopped = F.coalesce(F.datediff(F.lit(window_end), "last_date") > stale_days, F.lit(False))
    return out.select(
        "id", "symbol", "first_date", "last_date", "n_obs", "best_rank", F.coalesce("months_in_band", F.lit(0)).alias("months_in_band"),
        "untracked", stopped.alias("prices_stop"), (F.col("untracked") | stopped).alias("delisted"), "delisting_rule",
        F.when(F.col("delisting_rule") != "alive", F.col("last_date")).alias("delisting_date"),
        F.when(F.col("delisting_rule") == "total_loss", F.lit(residual)).alias("residual"),
    )


def exit_summary(table: DataFrame, kinds=("alive", "death", "censored_by_rank")) -> DataFrame:
    """Ids by the year they were last seen and the way they left; a kind that a year lacks counts 0."""
    return table.groupBy(F.year("last_date").alias("year")).agg(*(F.count(F.when(F.col("exit_kind") == k, 1)).alias(k) for k in kinds))


def survivorship_books(members: DataFrame, dead: DataFrame, complete: DataFrame) -> DataFrame:
    """Membership under three treatments: as it was, without ids that died, and only ids with full histories."""
    survivors = members.join(dead.select("id"), "id", "left_anti")
    books = {"pit": members, "survivor": survivors, "snapshot": survivors.join(complete.select("id"), "id", "left_semi")}
    out = None
    for name, book in books.items():
        labelled = book.withColumn("treatment", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled)
    return out


def complete_history(dense: DataFrame, value: str, least: float = 0.99) -> DataFrame:
    return dense.groupBy("id").agg((F.count(value) / F.count("*")).alias("coverage")).where(F.col("coverage") >= least)


def rank_band(snapshots: DataFrame, days: DataFrame, low: int, high: int) -> DataFrame:
    """Ids ranked within the band, as of each day; only snapshots with someone in the band end a holding."""
    return asof.membership(snapshots.where(F.col("rank").between(low, high)), days)


def liquid_universe(dense: DataFrame, low: float, high: float, floor: float, window: int = 20, least: int = 5, history: int = 60) -> DataFrame:
    """Dense ``date, id, member``: rank band of the cap, mean notional above the floor, full history, held by month.

    Decisions are taken on the first row, on the first row of each month and on rows dated at a month's end; in
    between the last decision holds.
    """
    pct = panel.rank_pct("mcap", "date")
    ok = (pct >= low) & (pct <= high) & (panel.rolling(F.avg, "volume", window, least) >= floor) & (F.count("r").over(panel.frame(history)) == history)
    now = dense.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    month = F.date_trunc("month", "date")
    decides = (panel.lag("date").isNull()) | (month != F.date_trunc("month", panel.lag("date"))) | (F.col("date") == F.last_day("date"))
    held = F.last(F.when(decides, F.col("_ok")), ignorenulls=True).over(panel.by_id().rowsBetween(Window.unboundedPreceding, 0))
    return now.withColumn("member", held).drop("_ok")


def month_ends(panel_: DataFrame, date: str = "date") -> DataFrame:
    """The last date present in each month."""
    return panel_.groupBy(F.date_trunc("month", date).alias("_m")).agg(F.max(date).alias(date)).drop("_m")


def redenomination_flags(price: str = "price", cap: str = "mcap", jump: float = 2.0, still: float = 0.10) -> Column:
    """A price jump by ``jump`` or more while the cap barely moves."""
    move = lambda c: F.abs(F.ln(panel.positive(c) / panel.lag(panel.positive(c))))
    return F.coalesce((move(price) >= F.ln(F.lit(jump))) & (move(cap) <= still), F.lit(False))


def implied_supply(price: str = "price", cap: str = "mcap") -> Column:
    return F.try_divide(F.col(cap), F.nullif(F.col(price), F.lit(0.0)))


def availability(members: DataFrame, bases: DataFrame, venues: DataFrame, funding: DataFrame) -> DataFrame:
    """``members`` (``date, id``) with four masks about shorting them.

    ``bases``: ``id, base``; ``venues``: ``base``; ``funding``: ``date, base``. *ambiguous*: the base has several ids;
    *static*: an unambiguous base listed now; *supported*: funding was printed exactly one day before; *unknown*: no base.
    """
    shared = bases.withColumn("_n", F.count("*").over(Window.partitionBy("base")))
    listed = venues.select("base").distinct().withColumn("_listed", F.lit(True))
    paid = funding.select(F.date_add("date", 1).alias("date"), "base").distinct().withColumn("_paid", F.lit(True))
    m = members.join(shared, "id", "left").join(listed, "base", "left").join(paid, ["date", "base"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    one = flag((F.col("_n") == 1) & F.col("base").isNotNull())
    return m.select("date", "id", flag((F.col("_n") > 1) & F.col("base").isNotNull()).alias("ambiguous"), (one & flag(F.col("_listed"))).alias("static"), (one & flag(F.col("_paid"))).alias("supported"), F.col("base").isNull().alias("unknown"))


def availability_rollup(masks: DataFrame) -> DataFrame:
    """Member-days and the share under each mask, by year and over all (null year)."""
    return masks.rollup(F.year("date").alias("year")).agg(
        F.count("*").alias("member_days"), *(F.avg(F.col(c).cast("double")).alias(f"{c}_share") for c in ("ambiguous", "static", "supported", "unknown"))
    )
