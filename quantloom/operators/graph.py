"""Signed correlation graphs as edge tables ``src, dst, weight`` (both directions unless said otherwise)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import cut

EPS = 1e-8


def correlations(panel: DataFrame, value: str = "r", key: str = "id", at: str = "date", least: int = 2) -> DataFrame:
    """``a, b, corr`` with ``a < b``: Pearson over the positions that both have, from one self-join on position."""
    x = panel.where(F.col(value).isNotNull()).select(at, F.col(key).alias("a"), F.col(value).alias("x"))
    y = x.select(at, F.col("a").alias("b"), F.col("x").alias("y"))
    pairs = x.join(y, at).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))
    return pairs.where((F.col("n") >= least) & F.col("corr").isNotNull()).select("a", "b", "corr")


def both_ways(pairs: DataFrame, value: str = "corr") -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col(value).alias("weight")).union(pairs.select("b", "a", value))


def _top(edges: DataFrame, order: Column, k: int) -> DataFrame:
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(order, "dst"))).where(F.col("_n") <= k).drop("_n")


def symmetrised(chosen: DataFrame) -> DataFrame:
    """Average of an edge and its reverse; one chosen from one side only keeps half its weight."""
    turned = chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return chosen.unionByName(turned).groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight"))


def knn(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Each node's ``k`` strongest correlations by size, signs kept, symmetrised."""
    return symmetrised(_top(both_ways(pairs), F.abs("weight").desc(), k))


def signed_knn(pairs: DataFrame, k_pos: int = 5, k_neg: int = 5) -> DataFrame:
    """As ``knn`` for the most positive and the most negative ones apart; ``layer`` says which."""
    edges = both_ways(pairs)
    up = symmetrised(_top(edges.where("weight > 0"), F.desc("weight"), k_pos)).withColumn("layer", F.lit("pos"))
    down = symmetrised(_top(edges.where("weight < 0"), F.asc("weight"), k_neg)).withColumn("layer", F.lit("neg"))
    return up.unionByName(down)


def rank_weighted(edges: DataFrame) -> DataFrame:
    """Weights times a rank share: the strongest of ``n`` edges of a node gets ``n / n``, the weakest ``1 / n``."""
    within = Window.partitionBy("src")
    rank = F.row_number().over(within.orderBy(F.abs("weight").desc(), "dst"))
    n = F.count("*").over(within)
    return edges.withColumn("weight", F.col("weight") * (n - rank + 1) / n)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: least label reachable, passed on until nothing changes, however long the chains are.

    Labels jump to their labels' labels, so a step at least doubles the reach along most paths.
    """
    from pyspark import StorageLevel

    edges, labels = cut(edges.select("src", "dst")), nodes.select("node", F.col("node").alias("component"))
    while True:
        heard = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        near = labels.join(heard, labels["node"] == heard["src"], "left").select("node", F.least("component", "m").alias("component"))
        root = near.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = near.join(root, "component").select("node", F.least("component", "root").alias("component"))
        new = cut(new).persist(StorageLevel.MEMORY_AND_DISK)
        moved = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").count()
        labels = new
        if not moved:
            break
    return labels


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum(F.abs("weight")).alias("degree"))


def diagnostics(edges: DataFrame) -> DataFrame:
    """One row: nodes, weighted degrees, positive and negative edges (each counted once), balance."""
    d = degrees(edges).agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    e = edges.where("src < dst").agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("weight") > 0, 1)).alias("n_pos"), F.count(F.when(F.col("weight") < 0, 1)).alias("n_neg"))
    return d.crossJoin(e).withColumn("negative_share", F.try_divide(F.col("n_neg"), F.col("n_edges")))


def signed_laplacian(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """``src, dst, value`` of ``D - W``, or of ``I - D^-1/2 W D^-1/2``, with absolute degrees."""
    d = degrees(edges)
    a, b = d.select("src", F.col("degree").alias("da")), d.select(F.col("src").alias("dst"), F.col("degree").alias("db"))
    off = edges.join(a, "src").join(b, "dst").select("src", "dst", (-F.col("weight") / (F.sqrt(F.col("da") * F.col("db")) if normalised else F.lit(1.0))).alias("value"))
    return off.unionByName(d.select("src", F.col("src").alias("dst"), (F.lit(1.0) if normalised else F.col("degree")).alias("value")))


# -- with labels ``node, label`` given ------------------------------------------------------------


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return edges.where("src < dst").join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")


def cluster_quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weight of positive and negative edges within and between, share satisfied, frustration, objective."""
    same, w = F.col("ls") == F.col("ld"), F.col("weight")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.abs(w))), F.lit(0.0))
    out = _labelled(edges, labels).agg(part(same & (w > 0)).alias("pos_within"), part(same & (w < 0)).alias("neg_within"), part(~same & (w > 0)).alias("pos_between"), part(~same & (w < 0)).alias("neg_between"))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in out.columns))
    return out.withColumns({"satisfied": F.try_divide(F.col("pos_within") + F.col("neg_between"), total), "frustration": F.try_divide(F.col("neg_within") + F.col("pos_between"), total), "objective": F.col("neg_within") + 2 * F.col("pos_between")})


def balanced_cut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: positive weight cut plus negative weight kept, over the volume of its nodes."""
    l = labels.select(F.col("node").alias("src"), F.col("label").alias("ls"))
    m = labels.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
    e = edges.join(l, "src").join(m, "dst")
    same, w = F.col("ls") == F.col("ld"), F.col("weight")
    bad = F.sum(F.when((~same & (w > 0)) | (same & (w < 0)), F.abs(w)).otherwise(0.0))
    return e.groupBy(F.col("ls").alias("label")).agg(bad.alias("cut"), F.sum(F.abs(w)).alias("volume")).withColumn("ratio", F.col("cut") / F.col("volume"))


def cohesion(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, members, cohesion, dropped``: mean correlation within; -1 for a single member; the least goes."""
    inner = _labelled(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("corr").alias("weight")), labels).where("ls = ld").groupBy(F.col("ls").alias("label")).agg(F.avg("weight").alias("c"))
    out = labels.groupBy("label").agg(F.count("*").alias("members")).join(inner, "label", "left")
    out = out.withColumn("cohesion", F.when(F.col("members") < 2, F.lit(-1.0)).otherwise(F.col("c"))).drop("c")
    return out.withColumn("dropped", F.row_number().over(Window.orderBy("cohesion", "label")) == 1)


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``n, ari`` of two labellings over the nodes that both have."""
    both = a.select("node", F.col("label").alias("la")).join(b.select("node", F.col("label").alias("lb")), "node")
    two = lambda c: c * (c - 1) / 2
    cells = both.groupBy("la", "lb").agg(F.count("*").alias("n"))
    tot = cells.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("s"))
    ra = cells.groupBy("la").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    rb = cells.groupBy("lb").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return tot.crossJoin(ra).crossJoin(rb).select("n", F.when(top != 0, (F.col("s") - expected) / top).otherwise(1.0).alias("ari"))
