"""Long panels: calendars, dense spines, rolling frames, ranks and keep-last deduplication.

A panel is a long table keyed by ``(date, id)``; a missing value is null (never NaN). Rolling frames count rows of the
shared calendar, so a panel is made dense before it is rolled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """Null for NaN: the boundary through which outside floats enter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def positive(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, c)


def calendar(panel: DataFrame, date: str = "date") -> DataFrame:
    """Sorted distinct dates of the panel with their positions ``date_idx`` from 0; one row per date."""
    days = panel.select(date).where(F.col(date).isNotNull()).distinct()
    return days.withColumn("date_idx", (F.row_number().over(Window.orderBy(date)) - 1).cast("int"))


def date_range(panel: DataFrame, date: str = "date") -> DataFrame:
    """Every calendar day from the first to the last date of the panel."""
    ends = panel.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(date))


def densify(panel: DataFrame, days: DataFrame, key: str = "id", date: str = "date") -> DataFrame:
    """A row for every id and every row of ``days``; cells that the panel lacks are null.

    The spine is ids times dates, both distinct and far fewer than the panel's rows.
    """
    spine = panel.select(key).distinct().crossJoin(days)
    return spine.join(panel, [key, date], "left")


def dedup(panel: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order`` (for keep-last, order descending)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return panel.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def by_id(key: str | list[str] = "id", date: str = "date") -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(date)


def frame(window: int, key: str | list[str] = "id", date: str = "date"):
    """The row and the ``window - 1`` rows before it, on a dense panel."""
    return by_id(key, date).rowsBetween(1 - window, 0)


def rolling(fn: Callable[[Column], Column], x: Column | str, window: int, least: int, key: str | list[str] = "id", date: str = "date") -> Column:
    """``fn`` over the frame, null unless at least ``least`` of its values are present."""
    x = F.col(x) if isinstance(x, str) else x
    over = frame(window, key, date)
    return F.when(F.count(x).over(over) >= least, fn(x).over(over))


def lag(x: Column | str, n: int = 1, key: str | list[str] = "id", date: str = "date") -> Column:
    return F.lag(x, n).over(by_id(key, date))


def fill_forward(x: str, limit: int, key: str = "id", date: str = "date") -> Column:
    """The last value present among this row and the ``limit`` rows before it."""
    return F.last(x, ignorenulls=True).over(by_id(key, date).rowsBetween(-limit, 0))


def rank_pct(x: Column | str, *within: str) -> Column:
    """Average rank over the number of values present; null for a missing value."""
    x = F.col(x) if isinstance(x, str) else x
    rank = F.rank().over(Window.partitionBy(*within).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*within, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*within)))


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness (G1) as an aggregate; null under three values."""
    n = F.count(x)
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis (G2) as an aggregate; null under four values."""
    n = F.count(x)
    return F.when((n >= 4) & (F.var_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def quality_report(panel: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Per id: values present, share missing, moments and extremes, most missing first."""
    x = F.col(value)
    out = panel.groupBy(key).agg(
        F.count(x).alias("n_obs"), (1 - F.count(x) / F.count("*")).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), sample_skew(x).alias("skew"), sample_kurtosis(x).alias("kurtosis"),
    )
    return out.orderBy(F.desc("missing"), key)


def wide(panel: DataFrame, value: str, ids: list, key: str = "id", date: str = "date") -> DataFrame:
    """One column per id, ids ascending; the last value present wins. For the edge of dense algebra only."""
    return panel.where(F.col(value).isNotNull()).groupBy(date).pivot(key, sorted(ids)).agg(F.last(value, ignorenulls=True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only on a single machine that has set none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
