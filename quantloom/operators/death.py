"""Survival: features of listings, purged yearly walk-forward classification, and its ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import panel

FEATURES = ("ret", "dvol", "drank", "age")


def build_features(listings: DataFrame, universe: DataFrame, horizon: int = 30, lookback: int = 30, every: int = 7, least: int | None = None) -> DataFrame:
    """``date, id, ret, dvol, drank, age, label`` on a grid of dates.

    Changes are over the id's own rows, not the calendar. The label is whether the id dies within ``horizon`` days.
    """
    least = 2 * lookback + 1 if least is None else least
    w = panel.by_id()
    seen = listings.withColumn("_v", panel.rolling(F.avg, "volume", lookback, 5)).withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy("id")))
    x = seen.select(
        "date", "id", "_n", "_all", F.ln(panel.positive("price") / F.lag(panel.positive("price"), lookback).over(w)).alias("ret"),
        F.ln(panel.positive("_v") / F.lag(panel.positive("_v"), lookback).over(w)).alias("dvol"), (F.col("rank") - F.lag("rank", lookback).over(w)).cast("double").alias("drank"),
        F.datediff("date", F.min("date").over(Window.partitionBy("id"))).cast("double").alias("age"),
    )
    grid = x.where((F.datediff("date", F.lit("1970-01-01").cast("date")) % every == 0) & (F.col("_all") >= least)).dropna(subset=list(FEATURES))
    left = F.datediff("delisting_date", "date")
    return grid.join(universe.select("id", "delisting_date"), "id", "left").select("date", "id", *FEATURES, F.coalesce(left.between(0, horizon), F.lit(False)).cast("int").alias("label"))


def purged(features: DataFrame, year: int, horizon: int = 30) -> DataFrame:
    """Rows whose label was known before the year began."""
    return features.where(F.col("date") < F.date_sub(F.make_date(F.lit(year), F.lit(1), F.lit(1)), horizon))


def auc(scored: DataFrame, score: str = "p", label: str = "label", *by: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null where a class is missing."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ties = Window.partitionBy(*by, score) if by else Window.partitionBy(score)
    ranked = scored.withColumn("_r", F.rank().over(w.orderBy(score)) + (F.count("*").over(ties) - 1) / 2)
    pos = F.sum(label)
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), pos.alias("n_pos"), F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"))
    return out.withColumn("auc", F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * (F.col("n") - F.col("n_pos")))).drop("_s")


def walk_forward(features: DataFrame, first: int, last: int, horizon: int = 30, min_positives: int = 20) -> DataFrame | None:
    """``date, id, label, year, p``: for each year a balanced ridge logistic regression of the purged past.

    Features are standardised on the training rows; the penalty is that of unit inverse strength. Years with too few
    positives in training are left out; null if all are.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows, out = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(features), None
    for year in range(first, last + 1):
        train = purged(rows, year, horizon)
        n, pos = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if pos < min_positives or n - pos < min_positives:
            continue
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="x").fit(train)
        weight = F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
        model = LogisticRegression(featuresCol="x", weightCol="weight", standardization=False, regParam=1.0 / n, maxIter=200).fit(scaler.transform(train).withColumn("weight", weight))
        test = model.transform(scaler.transform(rows.where(F.year("date") == year)))
        part = test.select("date", "id", "label", F.lit(year).alias("year"), vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def death_filter(weights: DataFrame, scores: DataFrame, worst: float = 0.1, least: int = 10) -> DataFrame:
    """Long weights of the worst decile by the last score before the date go to zero, where ten names are held."""
    from .asof import latest_value

    held = latest_value(weights, scores.select("date", "id", "p"), ["id"], "p", strict=True)
    on = F.when(F.col("w") != 0, F.col("p"))
    day = Window.partitionBy("date")
    cut = F.percentile(on, 1 - worst).over(day)
    return held.withColumn("w", F.when((F.count(on).over(day) >= least) & (F.col("p") >= cut) & (F.col("w") > 0), 0.0).otherwise(F.col("w"))).drop("p")


def event_study(listings: DataFrame, deaths: DataFrame, value: str = "price", before: int = 90) -> DataFrame:
    """``offset, n, mean``: the value in the rows up to the death over its first present, averaged over ids."""
    rows = listings.join(deaths.select("id", "delisting_date"), "id").where(F.col("date") <= F.col("delisting_date"))
    back = rows.withColumn("offset", 1 - F.row_number().over(Window.partitionBy("id").orderBy(F.desc("date")))).where(F.col("offset") >= -before)
    first = F.first(F.when(F.col(value) != 0, F.col(value)), ignorenulls=True).over(Window.partitionBy("id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return back.withColumn("y", F.col(value) / first).groupBy("offset").agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
