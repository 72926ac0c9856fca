"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

The first packing is best fit by descending length over all pieces, made from the counts of the lengths alone. Its bins
are dealt at random into blocks of bounded size. Every block that its volume leaves a bin to gain in is bred on a few
islands, each in a task of its own: a chromosome is a whole packing of the block; crossover injects the well-filled bins
of one parent into the other, removes the bins that now hold a document twice, and best-fits the displaced documents.
Between epochs the islands of a block hand their elite to the next island. The bins that a round leaves with room are
dealt again, with those of other blocks, until one block holds them all or a round fills less than half of what it got.
A block's packing is one of its founders, so no step takes more sequences than the one before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_name, materialise, small_batches
from .encoding import encoder

CAPACITY = 2048
#: Pieces of a block, islands that breed it, epochs between which elites move, and what an island does in one.
BLOCK = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 3, 6
#: Fill (share of the capacity) from which a bin is injected.
WELL_FILLED = 0.995


# -- one packing: an array with the bin of each item ----------------------------------------------


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, rooms: dict[int, int], capacity: int) -> np.ndarray:
    """Place the items of ``order`` into the open bins of ``bins`` (-1: unplaced), each where it leaves least room.

    ``rooms``: room left in each open bin. Bins are found by a bit set over the amounts of room.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, room in rooms.items():
        by_room.setdefault(room, []).append(b)
        mask |= 1 << room
    following = max(int(bins.max(initial=-1)), *rooms, -1) + 1
    out = bins.copy()
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
            room -= n
        else:
            b, room = following, capacity - n
            following += 1
        out[i] = b
        if room:
            stack = by_room.setdefault(room, [])
            stack.append(b)
            mask |= 1 << room
    return out


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven the fill, the better (sum of squared fills)."""
    fill = np.bincount(bins, weights=lengths)
    fill = fill[fill > 0]
    return -len(fill), float(((fill / capacity) ** 2).sum())


def crossover(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``taker`` with well-filled bins of ``giver``, its bins that share a document with them dissolved."""
    fill = np.bincount(giver, weights=lengths)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(fill == fill.max(initial=0))
    good = good[rng.random(len(good)) < rng.uniform(0.2, 0.6)]
    injected = np.isin(giver, good)
    # of the taker's bins, those that hold a document injected go
    doomed = np.zeros(int(taker.max(initial=-1)) + 1, dtype=bool)
    doomed[taker[injected]] = True
    displaced = doomed[taker] & ~injected
    stays = ~injected & ~displaced
    child = np.full(len(lengths), -1, dtype=np.int64)
    _, child[injected] = np.unique(giver[injected], return_inverse=True)
    offset = int(child.max(initial=-1)) + 1
    _, kept = np.unique(taker[stays], return_inverse=True)
    child[stays] = kept + offset
    room = capacity - np.bincount(child[child >= 0], weights=lengths[child >= 0]).astype(np.int64)
    # mutation: a few of the emptiest kept bins are opened as well
    rooms = {b: r for b, r in enumerate(room.tolist()) if r > 0}
    slack = sorted(rooms, key=lambda b: -rooms[b])[: int(rng.integers(1, 6))]
    if slack:
        opened = np.isin(child, slack)
        child[opened] = -1
        displaced |= opened
        for b in slack:
            rooms[b] = capacity
    todo = np.flatnonzero(displaced)
    jitter = lengths[todo] * (1 + 0.05 * rng.standard_normal(len(todo)) * (rng.random() < 0.5))
    child = best_fit(todo[np.argsort(-jitter, kind="stable")], lengths, child, rooms, capacity)
    return np.unique(child, return_inverse=True)[1]


def bulk_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit by descending length of so many items of each length (1 to ``capacity``), without the items.

    ``(length, rank, items, bin)``: of the items of that length, those from ``rank`` on go to the bins from ``bin`` on,
    so many to a bin, up to the next entry. Bins of equal room are handled as ranges, so there are few entries.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}
    mask, following, out = 0, 0, []

    def put(first: int, n: int, room: int) -> None:
        nonlocal mask
        if n and room:
            by_room.setdefault(room, []).append((first, n))
            mask |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, n = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
            else:
                room, first, n = capacity, following, -(-left // (capacity // length))
                following += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, each, first))
                rank, left = rank + full * each, left - full * each
                put(first, full, room - each * length)
            if full < n and left:  # fewer than one more bin takes
                out.append((length, rank, left, first + full))
                put(first + full, 1, room - left * length)
                full, left = full + 1, 0
            put(first + full, n - full, room)
    return out


def founders(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit by descending length, and by orders that stray from it."""
    empty, out = np.full(len(lengths), -1, dtype=np.int64), []
    for i in range(size):
        key = lengths * (1 + (0.1 * rng.standard_normal(len(lengths)) if i else 0))
        out.append(best_fit(np.argsort(-key, kind="stable"), lengths, empty, {}, capacity))
    return out


def evolve(population: list[np.ndarray], lengths: np.ndarray, capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after so many generations, best first. Stops early at the volume bound."""
    bound = -(-int(lengths.sum()) // capacity)
    score = lambda c: fitness(c, lengths, capacity)
    population = sorted(population, key=score, reverse=True)
    size = len(population)
    for _ in range(generations):
        if -score(population[0])[0] <= bound:
            break
        children = []
        for _ in range(size):
            giver, taker = rng.choice(min(size, 4), 2, replace=False) if size > 1 else (0, 0)
            children.append(crossover(population[giver], population[taker], lengths, capacity, rng))
        population = sorted([*population, *children], key=score, reverse=True)[:size]
    return population


# -- pieces ---------------------------------------------------------------------------------------

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans of at most ``capacity`` ids, all full but the first, with the CRC-32 of their bytes."""
    n, at = len(ids) // 4, 0
    end = n % capacity or min(n, capacity)
    number = 0
    while at < n:
        yield number, at, end - at, zlib.crc32(ids[4 * at : 4 * end])
        number, at, end = number + 1, end, end + capacity


def cut(df: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id`` and the columns of ``PIECES`` for each piece of each document: its ids, then ``end_id``."""
    small_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType
    closing = end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = [(d, *p) for d, t in zip(batch["doc_id"], batch["text"]) for p in pieces_of(encode(t) + closing, capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": object, "piece": "int32"})

    texts = df.select(as_name(df, doc_id).alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.mapInPandas(run, f"doc_id string, {PIECES}").withColumn("doc_id", F.col("doc_id").cast(kind))


# -- packing on Spark -----------------------------------------------------------------------------


def _seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([p & 0xFFFFFFFF for p in parts])


def _breed(items: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """``uid, length, block, b``: the items in the bins of the best packing of their block.

    ``items``: ``block, uid, length, bin``. Islands meet only through the elites, one packing of a block each.
    """
    listed = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length"), "bin"))).alias("all"))
    fields = [F.col(f"all.{c}").alias(name) for c, name in (("uid", "uids"), ("length", "lengths"), ("bin", "start"))]
    worlds = materialise(listed.select("block", *fields, F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")).repartition(tasks, "block", "island"), "worlds")
    state = worlds.select("block", "island", "lengths", "start", F.lit(None).cast("array<array<int>>").alias("population"))
    for epoch in range(EPOCHS):

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
        def epoch_of(block: pd.Series, island: pd.Series, lengths: pd.Series, start: pd.Series, population: pd.Series) -> pd.Series:
            out = []
            for b, i, n, own, p in zip(block, island, lengths, start, population):
                n, rng = np.asarray(n, dtype=np.int64), _seed(b, i, epoch)  # noqa: B023
                first = np.unique(np.asarray(own, dtype=np.int64), return_inverse=True)[1]
                if -fitness(first, n, capacity)[0] <= -(-int(n.sum()) // capacity):
                    out.append([first.astype(np.int32)] * POPULATION)
                    continue
                begin = [first, *founders(n, capacity, POPULATION - 1, rng)] if p is None else [np.asarray(c, dtype=np.int64) for c in p]
                out.append([c.astype(np.int32) for c in evolve(begin, n, capacity, GENERATIONS, rng)])
            return pd.Series(out)

        bred = materialise(state.select("block", "island", "lengths", "start", epoch_of("block", "island", "lengths", "start", "population").alias("population")), "islands")
        if epoch + 1 < EPOCHS:  # the elite of each island goes to the next one, in place of the worst there
            elite = bred.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("population", 1).alias("guest"))
            state = bred.join(elite, ["block", "island"]).select("block", "island", "lengths", "start", F.concat(F.array("guest"), F.slice("population", 1, POPULATION - 1)).alias("population"))
    used = F.size(F.array_distinct(F.element_at("population", 1)))
    best = bred.groupBy("block").agg(F.min_by(F.element_at("population", 1), used).alias("bins"))
    return worlds.where("island = 0").join(best, "block").select("block", F.explode(F.arrays_zip("uids", "lengths", "bins")).alias("x")).select(
        "block", F.col("x.uids").alias("uid"), F.col("x.lengths").cast("bigint").alias("length"), F.col("x.bins").alias("b")
    )


def _first_bins(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (``uid, length``) with ``bin``, that of best fit by descending length over all of them.

    The driver sees one count for each length. Items of a length are ranked within the partitions of ``uid``, so a
    length that most items have is nobody's alone.
    """
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    table = np.array(sorted(bulk_best_fit(counts, capacity)), dtype=np.int64).reshape(-1, 4)
    held = items.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.LongType())
    def bin_of(length: pd.Series, rank: pd.Series) -> pd.Series:
        t, n, r = held.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((t[:, 0] << 48) | t[:, 1], (n << 48) | r, side="right") - 1
        return pd.Series(t[at, 3] + (r - t[at, 1]) // t[at, 2])

    own = items.withColumn("p", F.shiftrightunsigned("uid", 33))
    before = Window.partitionBy("length").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    passed = own.groupBy("p", "length").count().select("p", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("passed"))
    ranked = own.withColumn("i", F.row_number().over(Window.partitionBy("p", "length").orderBy("uid")) - 1).join(passed, ["p", "length"])
    return ranked.select("uid", "length", bin_of("length", F.col("i") + F.col("passed")).alias("bin"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, up to ``capacity``) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Takes no more sequences than best fit by descending length over all pieces. Rows are told apart by numbers of a
    written table, so null ids and repeated rows are packed like any others; pieces of no or null length get a
    sequence each; columns of ``pieces`` named like a result are replaced. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length"))
    staged = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    several = (F.col("length") > 0) & (F.col("length") < capacity)
    done, tasks = [staged.where(~several).select("uid", (-1 - F.col("uid")).alias("sequence_id"))], max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    open_ = staged.where(several).select("uid", "length")
    n, step = open_.count(), 0
    open_ = _first_bins(open_, capacity)
    while n:
        blocks = -(-n // BLOCK)
        dealt = open_.withColumn("block", F.pmod(F.xxhash64(F.lit(step), "bin"), F.lit(blocks)).cast("int"))
        placed = _breed(dealt, capacity, min(tasks, blocks * ISLANDS))
        # numbers of single pieces are negative; a block has about BLOCK pieces, far under 2 ** 20
        name = F.lit(step << 56) + F.col("block").cast("bigint") * (1 << 20) + F.col("b")
        placed = materialise(placed.withColumn("fill", F.sum("length").over(Window.partitionBy("block", "b"))).withColumn("bin", name), "placed")
        rest = placed.where(F.col("fill") < capacity).select("uid", "length", "bin")
        last, n = n, 0 if blocks == 1 else rest.count()
        if 2 * n > last:
            n = 0
        done.append((placed.where(F.col("fill") >= capacity) if n else placed).select("uid", F.col("bin").alias("sequence_id")))
        open_, step = rest, step + 1
    bins = done[0]
    for more in done[1:]:
        bins = bins.union(more)
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    out = staged.join(bins, "uid").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "sequence_id", "offset")


def pack_documents(df: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``df``.

    A row's ids are those of its whole text (null: empty) and ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` of which the first may be shorter. No sequence holds more than ``capacity`` ids. Ids may be of any
    type that its string form casts back to. Null ids and repeated rows are documents of their own; an empty table
    gives an empty result.
    """
    return pack(cut(df, vocabulary, text, doc_id, capacity, end_id), capacity)
