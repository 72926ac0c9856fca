"""SimHash fingerprints linked through Golay keys.

A fingerprint is cut into segments of at most 23 bits, each padded to a Golay word. However three differing bits fall,
those segments that differ least bound what must be tolerated there, so a key is the tuple of codeword indices of two
of three segments, or, for so many fingerprints that such keys would be crowded, of three of four. Keys are joined,
pairs are verified, and verified links become components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import materialise, small_batches
from .components import components
from .encoding import forget

BITS = 64
#: First bit and width of each segment, of the shorter and of the longer keys.
THREE, FOUR = ((0, 21), (21, 21), (42, 22)), ((0, 16), (16, 16), (32, 16), (48, 16))
#: Fingerprints beyond which keys are of three segments of four. Both kinds lose no pair within three bits.
LONG_KEYS_FROM = 1 << 26
SEED = 42
#: Shingles hashed at once; longer texts go in pieces.
PIECE = 1 << 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# -- fingerprints ---------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int):
    """XXH64 of the shingles (repeats included; the whole sequence if shorter), in arrays of up to ``PIECE``."""
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1) if words else 0
    for at in range(0, n, PIECE):
        end = min(n, at + PIECE)
        yield np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(at, end)), dtype="<u8", count=end - at)


def majority(pieces: list[np.ndarray]) -> int:
    """Bits set in over half of the hashes; zero without hashes."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(list(shingle_hashes(words_of(text or ""), shingle)))


def signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series(signed([fingerprint(t) for t in text]))


# -- keys -----------------------------------------------------------------------------------------


def _segments(prints: np.ndarray, cuts) -> list[np.ndarray]:
    x = prints.view(np.uint64)
    return [((x >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in cuts]


def keys_of(prints: np.ndarray, long: bool = False, side: int = 0) -> np.ndarray:
    """A row of keys for each fingerprint (some twice). Two within three bits share a key, one's of side 0, the other's of side 1.

    Of three differing bits over three segments, two segments have at most one each; over four, three segments have at
    most two in all, one each. So for every choice of two segments that may differ, keys of side 0 take the near
    indices of the first and the plain index of the second, those of side 1 the other way round; the third segment, if
    any, must be equal. Keys of side 0 alone meet where one of the two segments is in the same sphere.
    """
    cuts = FOUR if long else THREE
    plain, near = [golay.decode(x) for x in _segments(prints, cuts)], [golay.near_keys(x) for x in _segments(prints, cuts)]
    out = []
    for chosen in combinations(range(len(cuts)), len(cuts) - 1):
        for differ in combinations(chosen, 2):
            key = np.full((len(prints), 1), len(out), dtype=np.int64)
            for c in (*differ, *(c for c in chosen if c not in differ)):
                key = (key << 12) | (near[c] if c == differ[side] else plain[c][:, None])
            out.append(key)
    return np.concatenate(out, axis=1)


def keys_udf(long: bool, side: int = 0):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(fp: pd.Series) -> pd.Series:
        return pd.Series([np.unique(row) for row in keys_of(fp.to_numpy(np.int64), long, side)])

    return keys


# -- links within three bits ------------------------------------------------------------------------


def _several(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one group ``c``, with ``m``, the rows of their bucket."""
    keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    return rows.drop("m").join(keys, "key")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``c``, the group of their ``node``, which is its own where ``groups`` has none."""
    return rows.drop("c").join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def close_groups(prints: DataFrame, radius: int = 3, long: bool | None = None) -> DataFrame:
    """``node, component`` of the distinct fingerprints ``fp`` that others reach in steps of at most ``radius`` (up to 3) bits.

    No link between groups is left out. In each bucket the least row is tried against all others first, so a dense
    ball of fingerprints costs its rows, not their pairs; then all pairs of a bucket in different groups are tried.
    The least rows come from an aggregate, which combines a bucket of any size where it lies.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the keys tolerate at most three differing bits")
    long = prints.count() > LONG_KEYS_FROM if long is None else long
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    rows = prints.select(F.col("fp").alias("b"), F.explode(keys_udf(long)("fp")).alias("key"))
    lead = rows.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("hi")).where("a <> hi").select("key", "a")
    links = materialise(rows.join(lead, (rows["key"] == lead["key"]) & (F.col("a") != F.col("b")) & near("a", "b")).select("a", "b").distinct(), "led")
    placed = materialise(_grouped(prints.select(F.col("fp").alias("node")), components(links)), "placed")
    a, b = (placed.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"), F.explode(keys_udf(long, side)("node")).alias("key")) for side, x in enumerate("ab"))
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("ca") != F.col("cb")) & near("a", "b")).select("a", "b").distinct()
    return components(links.union(rest))


def fingerprint_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``df``.

    Fingerprints of 3-word shingles; rows link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest ``doc_id`` reachable, the row's own included. Null and wordless texts have fingerprint zero, which
    links like any other. Rows with a null id keep a row and never name a component (all-null components: null).
    Repeated rows each keep a row. Copies meet in one fingerprint before anything is joined, so groups of copies
    of any size cost one row. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    known = df.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint_udf(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("fp"))
    known = materialise(known, "prints")
    prints = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = close_groups(prints.select("fp"), radius).withColumnRenamed("node", "fp")
    placed = prints.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return known.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies: Golay keys, then prefixes of shingle sets for what those miss ---------------------

#: Differing bits up to which a pair from a bucket is verified.
REACH = 18
#: Rows of a key table up to which it is broadcast (at most 32 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Common shingles go last in the order of a set: those of so many documents at least of one in ``SAMPLE``, the most
#: common ``COMMON`` of them. Any order that is the same for all sets loses no pair; this one makes buckets small.
SAMPLE, COMMON, COMMON_IN = 16, 1 << 16, 3
#: Rows of a bucket that all others are tried against before the pairs between groups.
LEADS = 4
#: Bits of a sketch, and of the folded one, in as many numbers of 64 bits, that rows of crowded buckets carry.
SKETCH, FOLDED = 2048, 8
#: Rows from which a bucket is crowded.
CROWD = 32


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    pieces = list(shingle_hashes(words_of(text), shingle))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, "<u8")


def shingles_udf(shingle: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view("<i8") for t in text])

    return shingles


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that many documents have, rarer ones first."""
    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLE)) == 0).select(F.explode(shingles_udf(shingle)("text")).alias("s"))
    counts = some.groupBy("s").count().where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "s").limit(COMMON)
    return counts.toArrow().column("s").to_numpy()[::-1].view(np.uint64)


def prefix_of(hashes: np.ndarray, common: np.ndarray, by_hash: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a set in the common order: two sets of that similarity share one of these at least.

    ``common`` is in its order, ``by_hash`` its argsort.
    """
    n = len(hashes)
    wanted = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if not len(common):
        return hashes[:wanted]
    at = np.minimum(np.searchsorted(common, hashes, sorter=by_hash), len(common) - 1)
    known = common[by_hash[at]] == hashes
    return np.concatenate([hashes[~known], common[np.sort(by_hash[at[known]])]])[:wanted]


def sketch(hashes: np.ndarray) -> bytes:
    """The size of a set, and for each of so many classes of its elements whether it has an odd number of them."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return len(hashes).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_alike(x: bytes, y: bytes, similarity: float) -> bool:
    """False only if the sets are less alike: they differ in at least as many elements as their sketches in bits."""
    most = (1 - similarity) / (1 + similarity) * (int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little")) + 1e-6
    return (int.from_bytes(x[4:], "little") ^ int.from_bytes(y[4:], "little")).bit_count() <= most


@F.pandas_udf(T.StructType([T.StructField(f"s{i}", T.LongType()) for i in range(FOLDED)]))
def folded_udf(sketches: pd.Series) -> pd.DataFrame:
    """The parities of coarser classes: a sketch's parts, laid over each other."""
    bits = np.frombuffer(b"".join(k[4:] for k in sketches), "<i8").reshape(len(sketches), -1, FOLDED)
    return pd.DataFrame(np.bitwise_xor.reduce(bits, axis=1), columns=[f"s{i}" for i in range(FOLDED)])


def prints_udf(shingle: int, similarity: float, common):
    """Of a text's set of shingles: its number, by which texts of one set are one node, size, fingerprint, prefix, sketch."""
    kinds = {"node": T.LongType(), "n": T.IntegerType(), "fp": T.LongType(), "prefix": T.ArrayType(T.LongType()), "sketch": T.BinaryType()}

    @F.pandas_udf(T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))
    def prints(text: pd.Series) -> pd.DataFrame:
        forget()
        order, by_hash = common.value
        out = []
        for t in text:
            s = shingle_set(t, shingle)
            out.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), majority([s]), prefix_of(s, order, by_hash, similarity).view("<i8"), sketch(s)))
        columns = dict(zip(kinds, zip(*out), strict=True)) if out else dict.fromkeys(kinds, ())
        return pd.DataFrame({c: signed(v) if c in ("node", "fp") else pd.Series(v, dtype="int32" if c == "n" else object) for c, v in columns.items()})

    return prints


def set_udf(shingle: int):
    @F.pandas_udf(T.BinaryType())
    def sets(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).tobytes() for t in text])

    return sets


def alike_udf(similarity: float):
    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(x, y, similarity) for x, y in zip(a, b)], dtype=bool)

    return alike


@F.pandas_udf(T.DoubleType())
def jaccard_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
    return pd.Series(out)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs ``a, b`` of nodes whose sets have the similarity."""
    # most pairs are far from alike, which their sketches show without the sets
    pairs = materialise(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sought = materialise(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), "sought")
    sketches = nodes.select("node", "sketch").join(_small(sought), "node")
    seen = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("ka")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("kb")), "b")
    pairs = materialise(seen.where(alike_udf(similarity)("ka", "kb")).select("a", "b"), "close")
    wanted = nodes.select("node", "doc_id", "th").join(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), "node")
    wanted = _small(materialise(wanted, "wanted"))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"])).select(wanted["node"], "text")
    sets = materialise(found.select("node", set_udf(shingle)("text").alias("s")).dropDuplicates(["node"]), "sets")
    # the sets of many nodes are dealt out once for each pair, those of the few that many are compared with once
    led = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = led.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    return materialise(both.where(jaccard_udf("sa", "sb") >= similarity).select("a", "b"), "near")


def near_links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links ``a, b`` between node numbers, most of those between sets whose fingerprints are close.

    Each fingerprint in a bucket of a Golay key is tried against the bucket's least and greatest: as many pairs as rows,
    never all pairs of a bucket. These two come from an aggregate, so a bucket of any size is combined where it lies.
    Nodes of one fingerprint are tried against the least of them.
    """
    prints = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", "x.node", F.floor(F.log2(F.col("x.n") + 1)).alias("size")), "fingerprints")
    # sets that are alike are of one size within a factor, which keeps strangers out of the buckets
    keys = F.explode(keys_udf(prints.count() > LONG_KEYS_FROM)("fp")).alias("key")
    rows = prints.select("fp", "size", keys).select("fp", F.shiftleft("key", 6).bitwiseOR(F.col("size")).alias("key"))
    ends = rows.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    near = lambda a, b: (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= REACH)
    found = rows.join(ends, (rows["key"] == ends["key"]) & (near(F.col("fp"), F.col("lo")) | near(F.col("fp"), F.col("hi"))))
    tried = found.select("fp", F.explode(F.array("lo", "hi")).alias("other")).where(near(F.col("fp"), F.col("other"))).distinct()
    close = tried.join(prints.select(F.col("fp").alias("other"), F.col("node").alias("a")), "other").join(prints.select("fp", F.col("node").alias("b")), "fp").select("a", "b")
    same = nodes.select("fp", F.col("node").alias("b")).join(prints.select("fp", F.col("node").alias("a")), "fp").where("a <> b").select("a", "b")
    return verified(close.union(same), nodes, texts, shingle, similarity)


def _can_reach(a: dict, b: dict, similarity: float):
    """Whether a bucket's element may be the first that two sets of that similarity share: enough must follow in both."""
    after = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (a["c"] != b["c"]) & (after >= similarity / (1 + similarity) * (a["n"] + b["n"]) - 1e-6)


def missed_links(nodes: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links ``a, b`` that join groups of ``links`` to the groups of all links. None is missed.

    Two sets of that similarity share an element of their prefixes. Most elements are in one prefix alone and go
    first. Of the others, buckets of one group have nothing to add; in the rest each row is first tried against a few
    rows of the bucket, which joins large groups at the cost of their rows, and then all pairs in different groups.
    """
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    rows = materialise(rows.join(shared, "key", "left_semi"), "shared")
    rows = materialise(_several(_grouped(rows, components(links))), "several")
    one = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node", "n", "pos", "c"))
    leads = rows.groupBy("key").agg(F.array(*(one(seed) for seed in range(LEADS))).alias("leads"))
    led = rows.join(leads, "key").select(*rows.columns, F.explode("leads").alias("lead"))
    led = led.where(_can_reach({c: F.col(f"lead.{c}") for c in ("n", "pos", "c")}, {c: F.col(c) for c in ("n", "pos", "c")}, similarity))
    more = verified(led.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), nodes, texts, shingle, similarity)
    rows = materialise(_several(_grouped(rows, components(links.union(more)))), "several")
    calm, crowded = rows.where(F.col("m") < CROWD), rows.where(F.col("m") >= CROWD)
    folded = nodes.join(crowded.select("node").distinct(), "node").select("node", folded_udf("sketch").alias("s")).select("node", "s.*")
    pairs = _pairs(calm, similarity, []).union(_pairs(crowded.join(folded, "node"), similarity, folded.columns[1:])).distinct()
    return more.union(verified(pairs, nodes, texts, shingle, similarity))


def _pairs(rows: DataFrame, similarity: float, folded: list[str]) -> DataFrame:
    """``a, b``: the pairs of nodes of a bucket, in different groups, that may be alike by size, place and folded sketch."""
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "c", *folded))) for x in "ab")
    fits = _can_reach(*({c: F.col(f"{c}_{x}") for c in ("n", "pos", "c")} for x in "ab"), similarity)
    if folded:
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in folded), F.lit(0))
        fits = fits & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6)
    return a.join(b, (a["key"] == b["key"]) & (a["node_a"] < b["node_b"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_groups(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``doc_id, th, node`` of each row of ``texts`` (``doc_id, th, text``), and ``node, doc_id, th, component`` of each node."""
    spark = texts.sparkSession
    common = common_shingles(texts, shingle)
    common = spark.sparkContext.broadcast((common, np.argsort(common)))
    known = materialise(texts.select("doc_id", "th", prints_udf(shingle, similarity, common)("text").alias("p")).select("doc_id", "th", "p.*"), "prints")
    copies = known.groupBy("node").agg(F.min(F.struct("doc_id", "th", "n", "fp", "prefix", "sketch")).alias("least"))
    nodes = materialise(copies.select("node", "least.*"), "nodes")
    links = near_links(nodes, texts, shingle, similarity)
    groups = components(links.union(missed_links(nodes, texts, links, shingle, similarity)))
    return known.select("doc_id", "th", "node"), nodes.join(groups, "node", "left").select("node", "doc_id", "th", F.coalesce("component", "node").alias("component"))


def drop_near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each group of near copies: that of the smallest ``doc_id``.

    Two rows link if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more.
    Close ones are found among rows that share a Golay key of the fingerprints of their sets; the prefixes of the
    sets give all that these leave between groups. Rows with the same set
    of shingles are one node before anything is joined, so exact copies cost one row. Null and wordless
    texts are one group; shorter texts than a shingle count as one shingle. Rows with a null id come before all
    others; of rows repeated in full one stays. Columns pass through as they are.
    """
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    known, nodes = near_groups(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text")), shingle, similarity)
    kept = nodes.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("least")).select("least.doc_id", "least.th")
    kept = _small(materialise(kept, "kept"))
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(body).alias("_th"))
    stay = inner.join(kept, inner["_id"].eqNullSafe(kept["doc_id"]) & (inner["_th"] == kept["th"]), "left_semi")
    repeats = known.groupBy("doc_id", "th").count().where("count > 1")
    if not repeats.isEmpty():
        stay = stay.dropDuplicates(["_id", "_th"])
    return stay.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
