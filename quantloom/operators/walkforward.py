"""The walk-forward strategy as one plan: all folds at once, from the panel to the ledger.

Folds are rows. An id of a fold is ``fold|id`` and its dates are those of the fold, so the same correlation, neighbour
and signal operators serve every fold in the same joins and windows, and no fold waits for another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering, folds, graph, ledger, panel, portfolio, signals


@dataclass(frozen=True)
class Rules:
    """``signal``: panel with ``cluster`` and ``r`` to one with ``signal``; ``weigh``: that to one with ``w``."""

    train: int = 104
    test: int = 13
    gap: int = 0
    context: int = 70
    share: float = 0.8
    least_names: int = 5
    neighbours: int = 5
    clusters: int | None = 3
    kernel: str | Callable = "SPONGE"
    gross: float = 1.5
    drop_least_cohesive: bool = True
    signal: Callable[[DataFrame], DataFrame] = signals.deviation_signal
    weigh: Callable[[DataFrame], DataFrame] = signals.deviation_weights


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("real_id", F.col("id")).withColumn("id", F.concat_ws("|", F.lpad(F.col("fold").cast("string"), 6, "0"), F.col("id").cast("string")))


def fold_labels(rows: DataFrame, rules: Rules) -> DataFrame:
    """``id`` (of a fold) and ``cluster`` from the training rows; folds under ``least_names`` names have none."""
    able = folds.eligible(rows, share=rules.share)
    enough = able.groupBy("fold").agg(F.count("*").alias("names")).where(F.col("names") >= rules.least_names)
    train = rows.where("part = 'train'").join(able, ["fold", "id"], "left_semi").join(enough, "fold", "left_semi").withColumn("r", F.coalesce("r", F.lit(0.0)))
    pairs = graph.correlations(_keyed(train).withColumn("at", F.struct("fold", "date")), at="at")
    edges = graph.knn(pairs, rules.neighbours).withColumn("fold", F.substring("src", 1, 6))
    found = clustering.cluster_folds(edges, rules.kernel, rules.clusters)
    if not rules.drop_least_cohesive:
        return found.select(F.col("node").alias("id"), F.col("label").alias("cluster"))
    named = found.select("node", F.concat_ws("|", "fold", F.col("label").cast("string")).alias("label"), "fold", F.col("label").alias("cluster"))
    inner = graph.cohesion(pairs, named.select("node", "label")).select("label", "cohesion")
    worst = inner.withColumn("fold", F.substring("label", 1, 6)).groupBy("fold").agg(F.min(F.struct("cohesion", "label")).alias("w")).select(F.col("w.label").alias("label"))
    return named.join(worst, "label", "left_anti").select(F.col("node").alias("id"), "cluster")


def fold_weights(dense: DataFrame, rows: int, rules: Rules = Rules()) -> DataFrame:
    """``date, id, fold, cluster, w`` for the test dates of every fold.

    ``dense``: ``date, date_idx, id, r`` of ``rows`` dates. Signals see only the fold's context and test rows; missing
    returns there count as zero.
    """
    table = folds.folds(dense.sparkSession, rows, rules.train, rules.test, rules.gap)
    all_rows = folds.fold_rows(dense.select("date", "date_idx", "id", "r"), table, rules.context)
    labels = fold_labels(all_rows, rules)
    live = _keyed(all_rows.where("part <> 'train'")).join(labels, "id").withColumn("r", F.coalesce("r", F.lit(0.0)))
    live = live.withColumn("group", F.col("cluster")).withColumn("cluster", F.concat_ws("|", "fold", F.col("cluster").cast("string")))
    scored = rules.signal(live).where("part = 'test'")
    weighed = rules.weigh(scored).withColumn("w", portfolio.gross_to("w", rules.gross))
    return weighed.select("date", F.col("real_id").alias("id"), "fold", F.col("group").alias("cluster"), "w")


def run(dense: DataFrame, rows: int, costs=(0.0, 25.0, 50.0), rules: Rules = Rules(), **ledger_rules) -> DataFrame:
    """The ledger of each cost, one book each: ``book`` is the cost in basis points."""
    weights = fold_weights(dense, rows, rules)
    simple = dense.select("date", "id", F.expm1("r").alias("r"))
    held = panel.cut(weights.join(simple, ["date", "id"], "left").select("date", "id", F.col("w").alias("target"), "r"))
    out = None
    for bps in costs:
        part = ledger.ledger(held.withColumn("book", F.lit(float(bps))), cost_bps=float(bps), **ledger_rules)
        out = part if out is None else out.unionByName(part)
    return out
