"""Walk-forward folds as a table, and the panel rows that belong to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of all spans together up to which they are broadcast.
BROADCAST_ROWS = 500_000
FOLD = "fold int, train_lo int, train_hi int, test_lo int, test_hi int"


def folds(spark: SparkSession, rows: int, train: int = 365, test: int = 28, gap: int = 0, step: int | None = None) -> DataFrame:
    """Half-open spans of positions: train ``[t - gap - train, t - gap)``, test ``[t, t + test)``, whole spans only."""
    starts = range(train + gap, rows - test + 1, step or test)
    return spark.createDataFrame([(i, t - gap - train, t - gap, t, t + test) for i, t in enumerate(starts)], FOLD)


def fold_rows(dense: DataFrame, table: DataFrame, context: int = 0) -> DataFrame:
    """Rows of every fold, ``part`` being ``train``, ``context`` (so many rows before the test) or ``test``."""
    def span(part, lo, hi):
        return F.struct(F.lit(part).alias("part"), lo.alias("lo"), hi.alias("hi"))

    c = F.col
    # the rows of the spans, at most 40 bytes each, are a few numbers of the driver's own table of folds
    small = (table.agg(F.sum(c("train_hi") - c("train_lo") + c("test_hi") - c("test_lo") + context)).first()[0] or 0) <= BROADCAST_ROWS
    spans = F.array(span("train", c("train_lo"), c("train_hi")), span("context", c("test_lo") - context, c("test_lo")), span("test", c("test_lo"), c("test_hi")))
    pieces = table.select("fold", F.explode(spans).alias("s")).where("s.lo < s.hi").select("fold", "s.part", F.explode(F.sequence("s.lo", F.col("s.hi") - 1)).alias("date_idx"))
    return dense.join(F.broadcast(pieces) if small else pieces, "date_idx")


def eligible(rows: DataFrame, value: str = "r", share: float = 0.8) -> DataFrame:
    """``fold, id`` with enough values in the training span."""
    return rows.where("part = 'train'").groupBy("fold", "id").agg(F.count(value).alias("n"), F.count("*").alias("of")).where(F.col("n") >= share * F.col("of")).select("fold", "id")


def run_folds(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over all folds at once (its windows partition by fold); the first fold wins on a date of two."""
    out = step(rows)
    rank = F.row_number().over(Window.partitionBy("date", "id").orderBy("fold"))
    return out.withColumn("_n", rank).where("_n = 1").drop("_n")
