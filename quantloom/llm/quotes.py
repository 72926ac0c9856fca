"""Conversations in reply order without quotations.

Quote levels are parsed line by line. Normalised sentences of quoted passages are hashed and joined to the first message
of the conversation that holds them as its own words; the message replied to follows from the least quoted level.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches

#: Words from which a quoted sentence is evidence by itself; a passage without such a sentence counts as a whole.
MIN_WORDS = 3
#: Turns that one task orders at a time, and messages in a row of the result.
SPAN, PART = 1024, 256
#: Stands for a null turn: before all others.
NO_TURN = -(1 << 60)

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"(?:on|am|le|el)\b.{0,200}(?:wrote|schrieb|écrit|escribió)\b.{0,80}:\s*", re.I | re.S)
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
WORD = re.compile(r"\w+")


def level_of(line: str) -> tuple[int, str]:
    """Quote level of a line, and the line without its marks."""
    found = MARKS.match(line)
    return (found[1].count(">"), line[found.end() :]) if found else (0, line)


def normal(passage: str) -> str:
    return " ".join(WORD.findall(passage.lower()))


def hashed(passage: str) -> int:
    h = xxhash.xxh64_intdigest(passage.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def passages(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one level, paragraphs apart, in order."""
    out: list[tuple[int, list[str]]] = []
    fresh = True
    for line in text.split("\n"):
        level, content = level_of(line)
        if not content.strip():
            fresh = True
            continue
        if fresh or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(content.strip())
        fresh = False
    return [(level, "\n".join(lines)) for level, lines in out]


def own_words(text: str) -> str:
    """The text without quoted lines and the lines that announce them; outer white space goes only where some did."""
    lines = text.split("\n")
    if not any(level_of(line)[0] for line in lines):
        return text
    kept, quoted = [], False
    for line in reversed(lines):
        if level_of(line)[0]:
            quoted = True
            continue
        if quoted and line.strip():
            quoted = False
            if WROTE.fullmatch(line.strip()):
                continue
        kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(reversed(kept))).strip()


def keys(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Hashes of what a message says itself (sentences, lines, paragraphs), and ``(level, hash)`` of what it quotes."""
    said, quoted = set(), set()
    for level, passage in passages(text):
        sentences = [normal(s) for s in SENTENCE.split(passage.replace("\n", " "))]
        if level:
            strong = [s for s in sentences if s.count(" ") + 1 >= MIN_WORDS]
            quoted.update((level, hashed(s)) for s in strong or [normal(passage)] if s)
        else:
            said.update(hashed(s) for s in (*sentences, *map(normal, passage.split("\n")), normal(passage)) if s)
    return sorted(said), sorted(quoted)


_PARSED = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("said", T.ArrayType(T.LongType())),
    T.StructField("quoted", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.LongType())]))),
])


@F.pandas_udf(_PARSED)
def parsed_udf(text: pd.Series) -> pd.DataFrame:
    out = [(own_words(t), *keys(t)) for t in text]
    return pd.DataFrame({"body": [b for b, _, _ in out], "said": [s for _, s, _ in out], "quoted": [[{"level": v, "hash": h} for v, h in q] for _, _, q in out]})


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (``conv_id, turn, role, text``) as ``conv_id, turn, role, body, position, reply_to, linked``.

    A message replies to the first message of its conversation that says what it quotes (the least level decides,
    then the most sentences, then the latest turn), or else to the turn before its own; a first turn replies to
    nothing. ``position`` counts from 0 by turn, which puts every message after the one it replies to.

    Null text is empty. A null turn comes first and is never replied to; rows with equal turns keep an arbitrary but
    fixed order; rows with a null ``conv_id`` are one conversation. Repeated rows are messages of their own. Other
    columns are left out. An empty table gives an empty result.
    """
    small_batches(messages.sparkSession)
    base = messages.select(
        F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), parsed_udf(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("p"), F.monotonically_increasing_id().alias("uid")
    ).select("conv_id", F.coalesce("turn", F.lit(NO_TURN)).alias("turn"), "role", "uid", "p.*")
    base = materialise(base.withColumn("span", F.floor(F.col("turn") / SPAN)), "messages")

    quoted = base.select("uid", F.col("conv_id").alias("c"), "turn", F.explode("quoted").alias("q")).select("uid", "c", "turn", "q.level", "q.hash")
    # only what somebody quotes is looked for, and only its first speaker is kept
    sought = quoted.select("c", "hash").distinct()
    said = base.where(F.col("turn") > NO_TURN).select(F.col("conv_id").alias("c"), F.explode("said").alias("hash"), F.col("turn").alias("first"))
    said = said.groupBy("c", "hash").agg(F.min("first").alias("first"))
    same = lambda a, b, *more: [a["c"].eqNullSafe(b["c"]), *(a[m] == b[m] for m in more)]
    spoken = said.join(sought, same(said, sought, "hash"), "left_semi")
    found = quoted.join(spoken, [*same(quoted, spoken, "hash"), F.col("first") < F.col("turn")])
    counted = found.groupBy("uid", "level", "first").agg(F.count("*").alias("n"))
    target = counted.groupBy("uid").agg(F.max(F.struct(-F.col("level"), F.col("n"), F.col("first"))).alias("best")).select("uid", F.col("best.first").alias("quoted_turn"))

    # places in the conversation: within spans of turns, then over the spans
    spans = base.groupBy(F.col("conv_id").alias("c"), F.col("span").alias("s")).agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("c", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"), F.max("last").over(before).alias("last"))
    here = Window.partitionBy("conv_id", "span")
    local = base.select(
        "conv_id", "turn", "role", "body", "uid", "span",
        (F.row_number().over(here.orderBy("turn", "uid")) - 1).alias("at"), F.max("turn").over(here.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)).alias("near"),
    )
    placed = local.join(spans, [local["conv_id"].eqNullSafe(spans["c"]), local["span"] == spans["s"]]).join(target, "uid", "left")
    plain = lambda c: F.when(c > NO_TURN, c)
    return placed.select(
        "conv_id", plain(F.col("turn")).alias("turn"), "role", "body", (F.col("passed") + F.col("at")).alias("position"),
        F.coalesce("quoted_turn", plain(F.coalesce("near", "last"))).alias("reply_to"), F.col("quoted_turn").isNotNull().alias("linked"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, part, n_messages, n_linked, turns, replies, text``: conversations in parts of up to 256 messages.

    ``text`` is the chat text of the part: for each message its role (null: ``user``) and own words between marks.
    ``turns`` and ``replies`` are the turns of its messages and those they reply to (-1: none).
    """
    linked = link_quotes(messages)
    shown = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    entry = F.struct("position", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("reply_to", F.lit(-1)).alias("reply_to"), shown.alias("shown"))
    parts = linked.groupBy("conv_id", F.floor(F.col("position") / PART).cast("int").alias("part")).agg(F.count("*").alias("n_messages"), F.sum(F.col("linked").cast("bigint")).alias("n_linked"), F.sort_array(F.collect_list(entry)).alias("m"))
    return parts.select(
        "conv_id", "part", "n_messages", "n_linked", F.transform("m", lambda x: x["turn"]).alias("turns"), F.transform("m", lambda x: x["reply_to"]).alias("replies"), F.array_join(F.transform("m", lambda x: x["shown"]), "").alias("text"),
    )
