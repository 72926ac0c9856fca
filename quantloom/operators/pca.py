"""Market modes: principal components of a returns panel, and what they leave."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_modes(panel: DataFrame, n: int = 1, value: str = "r", fold: str | None = None) -> DataFrame:
    """``fold, pc, id, loading, mean, std``: standardised (population deviation) components, missing as zero.

    The second moments are sums over a self-join on the date, so only an ids-by-ids matrix reaches the kernel. The sign
    of a component is that of its largest loading.
    """
    key = [fold] if fold else []
    x = panel.select(*key, "date", "id", F.coalesce(value, F.lit(0.0)).alias("x"))
    live = panel.where(F.col(value).isNotNull()).select(*key, "date").distinct()
    x = x.join(live, [*key, "date"], "left_semi")
    stats = x.groupBy(*key, "id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))
    z = x.join(stats, [*key, "id"]).select(*key, "date", "id", F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("z"))
    second = z.select(*key, "date", F.col("id").alias("b"), F.col("z").alias("zb"))
    moments = z.withColumnRenamed("id", "a").join(second, [*key, "date"]).groupBy(*key, "a", "b").agg(F.avg(F.col("z") * F.col("zb")).alias("c"))
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]))
        m = pdf.pivot(index="a", columns="b", values="c").reindex(index=ids, columns=ids).fillna(0.0).to_numpy()
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        rows = []
        for pc in range(min(n, len(ids))):
            v = vectors[:, -1 - pc]
            v = v * np.sign(v[np.abs(v).argmax()])
            rows += [(pc, i, float(a), float(values[-1 - pc])) for i, a in zip(ids, v)]
        out = pd.DataFrame(rows, columns=["pc", "id", "loading", "variance"])
        return out.assign(**{fold: pdf[fold].iloc[0]}) if fold else out

    schema = (f"{fold} {kinds[fold]}, " if fold else "") + f"pc int, id {kinds['id']}, loading double, variance double"
    group = moments.groupBy(*key) if fold else moments.withColumn("_all", F.lit(0)).groupBy("_all")
    loadings = group.applyInPandas(lambda pdf: one(pdf)[[c.split()[0] for c in schema.split(", ")]], schema)
    return loadings.join(stats.select(*key, "id", "mean", "std"), [*key, "id"])


def factor_returns(panel: DataFrame, modes: DataFrame, value: str = "r") -> DataFrame:
    """``date, pc, score``."""
    x = panel.join(modes, "id").withColumn("z", F.when(F.col("std") > 0, (F.coalesce(value, F.lit(0.0)) - F.col("mean")) / F.col("std")).otherwise(0.0))
    return x.groupBy("date", "pc").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))


def residualise(panel: DataFrame, modes: DataFrame, value: str = "r") -> DataFrame:
    """``panel`` with ``residual``: the value less its projection on the modes, in its own units."""
    scores = factor_returns(panel, modes, value)
    explained = scores.join(modes.select("pc", "id", "loading", "std", "mean"), "pc").groupBy("date", "id").agg(F.sum(F.col("score") * F.col("loading") * F.col("std")).alias("fit"))
    return panel.join(explained, ["date", "id"], "left").withColumn("residual", F.coalesce(value, F.lit(0.0)) - F.coalesce("fit", F.lit(0.0))).drop("fit")


def factor_betas(panel: DataFrame, scores: DataFrame, value: str = "r") -> DataFrame:
    """``id, pc, beta``: covariance over variance plus a guard."""
    both = panel.join(scores, "date").where(F.col(value).isNotNull())
    return both.groupBy("id", "pc").agg((F.covar_samp(value, "score") / (F.var_samp("score") + 1e-8)).alias("beta"))


def neutral_to(w: str, b: str, *within: str) -> Column:
    over = Window.partitionBy(*within)
    return F.col(w) - F.try_divide(F.sum(F.col(w) * F.col(b)).over(over), F.sum(F.col(b) * F.col(b)).over(over)) * F.col(b)
