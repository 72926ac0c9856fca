"""Benchmark passages in documents by pigeonhole edit matching over words.

A test item of m words with an error budget of k is split into k + 1 pieces; a passage within k word edits holds at
least one piece unchanged. Exact piece hits come from one automaton over a block of items, each hit gives a window,
and Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_name, small_batches

#: Word edits per word of an item.
BUDGET = 0.2
#: Bytes of item text that one automaton holds; more items go in further blocks, each against all documents.
BLOCK_BYTES = 4 << 20

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def split_pieces(m: int, k: int) -> list[tuple[int, int]]:
    """``k + 1`` nearly equal spans over ``m`` words."""
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:]))


def best_match(masks: dict[str, int], m: int, window: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of ``window``, and the word after that part's last.

    Myers' recurrence with the pattern's words as bits of an integer; the top row is free, so a match may start
    anywhere. Of equal distances the first end wins.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(window, 1):
        eq = masks.get(word, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = minus | ~(zero | plus) & full
        h_minus = zero & plus
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus, h_minus = (h_plus << 1) & full, (h_minus << 1) & full
        plus = (h_minus | ~(zero | h_plus)) & full
        minus = zero & h_plus
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Items of one block. ``items``: pairs of id and text; null or wordless texts never match."""

    def __init__(self, items: list[tuple[object, str | None]], budget: float = BUDGET):
        self.items = []
        automaton, pieces = ahocorasick.Automaton(), {}
        for item_id, text in items:
            words = words_of(text or "")
            m = len(words)
            if not m:
                continue
            k, masks = int(budget * m), {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            for lo, hi in split_pieces(m, k):
                pieces.setdefault(" ".join(words[lo:hi]), []).append((len(self.items), lo))
            self.items.append((item_id, m, k, masks))
        for piece, owners in pieces.items():
            automaton.add_word(f" {piece} ", (len(piece) + 2, owners))
        self.automaton = automaton if pieces else None
        if pieces:
            automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """``item_id, distance, budget, end_word`` for each item within its budget; the best place of each."""
        words = words_of(text)
        if self.automaton is None or not words:
            return
        line = f" {' '.join(words)} "
        windows: dict[int, list[tuple[int, int]]] = {}
        seen_chars, seen_words = 0, 0
        for end, (length, owners) in self.automaton.iter(line):
            start = end - length + 1
            # hits come by ascending end and pieces have bounded length: words before a hit are counted onwards
            if start >= seen_chars:
                seen_words += line.count(" ", seen_chars, start)
                seen_chars = start
                at = seen_words
            else:
                at = seen_words - line.count(" ", start, seen_chars)
            for item, offset in owners:
                _, m, k, _ = self.items[item]
                windows.setdefault(item, []).append((max(0, at - offset - k), min(len(words), at - offset + m + k)))
        for item, spans in windows.items():
            item_id, m, k, masks = self.items[item]
            spans.sort()
            merged = [list(spans[0])]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            distance, end = min((d, lo + e) for lo, hi in merged for d, e in [best_match(masks, m, words[lo:hi])])
            if distance <= k:
                yield item_id, distance, k, end


def blocks_of(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about ``BLOCK_BYTES`` at most, one block on the driver at a time."""
    texts = items.select(as_name(items, item_id).alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for block in range(n):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield sorted(((r["item_id"], r["text"]) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """``doc_id, item_id, distance, budget, end_word``: a row for each row of ``docs`` and item that it leaks.

    An item leaks if some part of the document is within ``budget`` word edits per word of it, words being runs of
    letters and digits in lower case. ``end_word`` is the number of words up to the end of the best place (the
    first of the least distance). Items of one word to any number are looked for alike; those too short for an edit
    leak where their words stand in a row. Null and wordless texts match nothing; rows and items repeated in full
    count as rows of ``docs`` and as one item; null ids are carried, and ids are of any type that its string form
    casts back to. Whole texts are searched; either table empty gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {"doc_id": docs.schema[doc_id].dataType, "item_id": items.schema[item_id].dataType}
    base = docs.select(as_name(docs, doc_id).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")

    def search(block):
        held = spark.sparkContext.broadcast(block)

        def run(batches):
            matcher = Matcher(held.value, budget)
            for batch in batches:
                found = [(d, *hit) for d, t in zip(batch["doc_id"], batch["text"]) for hit in matcher.find(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "budget", "end_word"]).astype({"doc_id": object, "item_id": object, "distance": "int32", "budget": "int32", "end_word": "int64"})

        return base.mapInPandas(run, "doc_id string, item_id string, distance int, budget int, end_word bigint")

    return reduce(DataFrame.union, (search(b) for b in blocks_of(items, item_id, item_text))).withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that leak no item, as they are. Null texts stay."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs
    for block in blocks_of(items, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        @F.pandas_udf(T.BooleanType())
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(held.value, budget)  # noqa: B023  bound by the closure's own block
            for batch in batches:
                yield pd.Series([next(matcher.find(t), None) is None for t in batch], dtype=bool)

        out = out.where(clean(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    return out
