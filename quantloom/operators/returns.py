"""Returns on a dense panel: log, simple, excess, scrubbed, shocked, cumulated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel

LOG_LIMIT = math.log(5)


def log_return(price: str = "price", key: str = "id") -> Column:
    """Null where either end is missing; the price before is that of the calendar row before."""
    return F.ln(panel.positive(price) / panel.lag(panel.positive(price), key=key))


def simple_return(price: str = "price", key: str = "id", pad: bool = False) -> Column:
    p = F.last(price, ignorenulls=True).over(panel.by_id(key).rowsBetween(Window.unboundedPreceding, 0)) if pad else F.col(price)
    before = F.lag(price).over(panel.by_id(key)) if not pad else F.last(price, ignorenulls=True).over(panel.by_id(key).rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(p, before) - 1


def excess(r: str, reference: str, fill: bool = False) -> Column:
    """``fill``: a missing reference counts as no move; otherwise it nulls the row."""
    return F.col(r) - (F.coalesce(F.col(reference), F.lit(0.0)) if fill else F.col(reference))


def scrubbed(r: str, limit: float = LOG_LIMIT) -> Column:
    return F.when(F.abs(r) <= limit, F.col(r))


def scrub_count(r: str, limit: float = LOG_LIMIT) -> Column:
    return F.sum(F.coalesce(F.abs(r) > limit, F.lit(False)).cast("bigint"))


def simple_from_excess(x: str, reference: str) -> Column:
    """``expm1`` of an excess log return plus the reference's own."""
    return F.expm1(F.col(x) + F.col(reference))


def cumulative(r: str, compounded: bool = False, key: str = "id") -> Column:
    over = panel.by_id(key).rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log1p(r)).over(over)) - 1 if compounded else F.sum(r).over(over)


def drawdown(path: str, key: str = "id") -> Column:
    """Below the highest value so far; the first value sets the first high."""
    return F.col(path) - F.max(path).over(panel.by_id(key).rowsBetween(Window.unboundedPreceding, 0))


def with_terminal_shock(dense: DataFrame, universe: DataFrame, r: str, reference: str, residual: float = 0.01) -> DataFrame:
    """``r`` set to ``ln(residual) - reference`` on an id's first calendar row after its delisting, null after that.

    ``universe``: ``id, delisting_date`` (null: none). Scrub first, or the shock is scrubbed away.
    """
    joined = dense.join(universe.select("id", "delisting_date"), "id", "left")
    after = F.sum((F.col("date") > F.col("delisting_date")).cast("int")).over(panel.by_id().rowsBetween(Window.unboundedPreceding, 0))
    shock = F.lit(math.log(residual)) - F.coalesce(F.col(reference), F.lit(0.0))
    value = F.when(F.coalesce(after, F.lit(0)) == 0, F.col(r)).when(after == 1, shock)
    return joined.withColumn(r, value).drop("delisting_date")


def value_weighted_market(dense: DataFrame, r: str = "r", cap: str = "mcap") -> DataFrame:
    """``date, r_market, level``: returns weighted by the caps of the row before, over ids that have a return."""
    weighed = dense.withColumn("w", panel.lag(panel.positive(cap)))
    day = weighed.where(F.col(r).isNotNull() & F.col("w").isNotNull()).groupBy("date").agg((F.sum(F.col(r) * F.col("w")) / F.sum("w")).alias("r_market"))
    out = dense.select("date").distinct().join(day, "date", "left")
    level = F.exp(F.sum(F.coalesce("r_market", F.lit(0.0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("level", level)


def buy_and_hold(dense: DataFrame, month: Column, r: str = "r_simple", weight: str | None = None) -> DataFrame:
    """``month, growth``: a book bought on the first row of each month and held through it, equal or by first weight."""
    held = dense.withColumn("month", month)
    first = F.min_by(F.col(weight), "date") if weight else F.lit(1.0)
    ids = held.groupBy("month", "id").agg(F.exp(F.sum(F.log1p(F.coalesce(F.col(r), F.lit(0.0))))).alias("growth"), first.alias("w"))
    return ids.groupBy("month").agg((F.sum(F.col("growth") * F.col("w")) / F.sum(F.when(F.col("growth").isNotNull(), F.col("w")))).alias("growth"))
