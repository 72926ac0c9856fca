"""As-of joins by intervals: snapshots become half-open spans of validity, joined on bounds instead of searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spans(dates: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """``date, until``: each distinct snapshot date with the next one (null for the last)."""
    return dates.select(date).distinct().withColumn("until", F.lead(date).over(Window.orderBy(date)))


def day_to_snapshot(days: DataFrame, snapshots: DataFrame, date: str = "date", snapshot: str = "snapshot_date", strict: bool = False) -> DataFrame:
    """Each day with the last snapshot date on or before it (``strict``: before it); days without one are left out.

    Dates of both sides are merged and carried forward in one ordered pass: no range join.
    """
    late = F.lit(1 if strict else 0)
    both = days.select(F.col(date).alias("d"), F.lit(True).alias("day"), (1 - late).alias("o")).distinct().union(
        snapshots.select(F.col(snapshot).alias("d"), F.lit(False).alias("day"), late.alias("o")).distinct()
    )
    order = Window.orderBy("d", "o").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("s", F.last(F.when(~F.col("day"), F.col("d")), ignorenulls=True).over(order))
    return carried.where("day AND s IS NOT NULL").select(F.col("d").alias(date), F.col("s").alias(snapshot))


def membership(assignments: DataFrame, days: DataFrame, reconstitutions: DataFrame | None = None, strict: bool = False, snapshot: str = "snapshot_date") -> DataFrame:
    """Rows of ``assignments`` held from their snapshot until the next one, for each day.

    ``reconstitutions``: the snapshots that end a holding; by default those of ``assignments`` itself, so that a
    snapshot in which a group is empty carries the group before it forward.
    """
    held = day_to_snapshot(days, assignments if reconstitutions is None else reconstitutions, snapshot=snapshot, strict=strict)
    return held.join(assignments, snapshot)


def latest_value(left: DataFrame, right: DataFrame, keys: list[str], value: str, date: str = "date", strict: bool = False) -> DataFrame:
    """``left`` with the ``value`` that ``right`` last had for the keys on or before (``strict``: before) its date."""
    late = 1 if strict else 0
    a = left.select(F.struct(*left.columns).alias("row"), *keys, F.col(date).alias("_d"), F.lit(1 - late).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.where(F.col(value).isNotNull()).select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *keys, F.col(date).alias("_d"), F.lit(late).alias("_o"), F.col(value).alias("_v"))
    order = Window.partitionBy(*keys).orderBy("_d", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("row IS NOT NULL").select("row.*", F.col("_v").alias(value))
