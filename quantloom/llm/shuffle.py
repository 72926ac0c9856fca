"""Uniform shuffle into shards of exact sizes by a communication matrix.

Main path: DataFrame functions only. The driver draws the matrix from the row counts of the partitions.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, rows_of

#: Rows that one task permutes at most, unless the matrix bound below asks for more.
ROWS_PER_TASK = 250_000
#: Cells of the matrix that the driver draws at most; larger inputs get larger parts and blocks instead.
MATRIX_CELLS = 1_000_000
#: Pieces of input partitions up to which the table that says which part they are in is broadcast (24 bytes each).
BROADCAST_PIECES = 200_000


def cell_sizes(rows: int, shards: int, blocks: int) -> list[list[int]]:
    """Rows of each block of each shard: shards differ by one row at most, and so do a shard's blocks."""
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [[m // blocks + (b < m % blocks) for b in range(blocks)] for m in sizes]


def draw_matrix(parts: list[int], cells: list[int], seed: int) -> np.ndarray:
    """Rows that each part sends to each cell, drawn as a uniform shuffle would deal them.

    Each part takes a multivariate hypergeometric draw from what the cells still lack, so row sums are the parts
    and column sums the cells exactly.
    """
    rng, left = np.random.default_rng(seed), np.array(cells, dtype=np.int64)
    out = np.zeros((len(parts), len(cells)), dtype=np.int64)
    for i, n in enumerate(parts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def parts_of(pieces: list[int], limit: int) -> list[int]:
    """The part that each piece is in: pieces in their order, as many to a part as stay within ``limit`` rows."""
    out, part, held = [], 0, 0
    for n in pieces:
        if held and held + n > limit:
            part, held = part + 1, 0
        out.append(part)
        held += n
    return out


def rows_in_a_part(total: int, shards: int, wanted: int) -> int:
    """``wanted``, or as many rows more as keep the matrix under its bound.

    Two parts in a row hold more than the limit, so there are at most ``2 * total / limit + 1`` parts, and a shard has
    ``total / (shards * limit)`` blocks, rounded up.
    """
    limit = max(wanted, 1)
    while (2 * total // limit + 1) * (total // limit + shards) > MATRIX_CELLS and limit < total:
        limit *= 2
    return limit


def shuffle_shards(df: DataFrame, shards: int, seed: int = 17, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, gapless from 0).

    Every assignment of rows to places is equally likely, and shard sizes differ by one row at most. The input's
    partitions are cut, or put together, to parts of ``rows_per_task`` rows; each is permuted in one task, exchanged
    by the matrix, and each destination block is permuted again in one task, so no task holds a whole shard. The
    driver sees a count for each piece of a partition, and a matrix of at most ``MATRIX_CELLS`` cells.

    Nulls and repeated rows are rows like any other: the order hangs on row numbers fixed by a written table, not
    on values, so no value can be hot. An empty table gives an empty result. Columns of ``df`` named ``shard`` or
    ``slot`` are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    staged = materialise(
        df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row") if kept else F.lit(None).alias("row"), F.monotonically_increasing_id().alias("uid")),
        "shuffle",
    )
    total = staged.count()
    limit = rows_in_a_part(total, shards, rows_per_task)
    # the upper bits of uid hold the partition, the lower 33 the row's place in it
    numbered = staged.select("row", "uid", F.shiftrightunsigned("uid", 33).alias("input"), F.floor(F.col("uid").bitwiseAND((1 << 33) - 1) / limit).alias("cut"))
    pieces = sorted((r["input"], r["cut"], r["n"]) for r in numbered.groupBy("input", "cut").agg(F.count("*").alias("n")).collect())
    parts = parts_of([n for *_, n in pieces], limit)
    sizes = [0] * (parts[-1] + 1 if parts else 0)
    for (*_, n), p in zip(pieces, parts):
        sizes[p] += n
    blocks = max(1, -(-total // (shards * limit)))
    cells = cell_sizes(total, shards, blocks)
    matrix = draw_matrix(sizes, [n for row in cells for n in row], seed)
    # the last places of each cell, shard by shard, within each part
    ends = matrix.cumsum(axis=1).reshape(len(sizes), shards, blocks)
    held = materialise(rows_of(spark, json.dumps([{"input": i, "cut": c, "part": p} for (i, c, _), p in zip(pieces, parts)]), "input:bigint,cut:bigint,part:int"), "pieces")
    table = materialise(rows_of(spark, json.dumps([{"part": p, "ends": e.tolist()} for p, e in enumerate(ends)]), "part:int,ends:array<array<bigint>>"), "matrix")

    key = lambda step: F.xxhash64(F.lit(seed), F.lit(step), F.col("uid"))
    numbered = numbered.join(F.broadcast(held) if len(pieces) <= BROADCAST_PIECES else held, ["input", "cut"]).drop("input", "cut")
    numbered = numbered.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(key(1), "uid")).cast("long"))
    dealt = numbered.join(F.broadcast(table), "part")  # its cells are bounded
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda b: F.element_at(b, -1) < F.col("place"))))
    dealt = dealt.withColumn("block", F.size(F.filter(F.element_at("ends", F.col("shard") + 1), lambda e: e < F.col("place"))))
    rows = F.lit(total)
    size = F.floor(rows / shards) + (F.col("shard") < rows % shards).cast("long")
    before = F.col("block") * F.floor(size / blocks) + F.least(F.col("block").cast("long"), size % blocks)
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy(key(2), "uid")) - 1
    out = dealt.select("row", "shard", (before + within).cast("long").alias("slot"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", "slot")
