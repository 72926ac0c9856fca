"""Quality rules of documents and verdicts on their hosts.

Each document is measured once. Failures are summed by host, each host's rate is shrunk by a beta prior fitted to
all hosts, and the verdicts go back to the documents by a join on the host.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches

MIN_WORDS = 50
#: Repeated words per hundred words above which a document fails.
MAX_REPEATED = 50
#: Symbols per hundred word characters above which a document counts as a failure of its host.
MAX_SYMBOLS = 10
#: Shrunken failure rate above which a host, and with it each of its documents, is rejected: more of them fail than not,
#: so that a verdict on the host is right for most of its documents.
MAX_RATE = 0.5
#: Hosts up to which the table of verdicts is broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000

#: The characters counted as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measure_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures and ``base_failed``; null text has no words. Columns of these names are replaced."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in {*MEASURES, "base_failed"}]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None)
    out = df.select(row.alias("row"), measure_udf(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("measures"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "measures.*").withColumn("base_failed", base_failed())


def host_rates(docs: DataFrame, host: str = "source") -> DataFrame:
    """``host, n, failures, rate``: the failure rate of each host, shrunk by the prior of all hosts.

    A document counts as a failure if it fails the base rules or holds more than ``MAX_SYMBOLS`` symbols per hundred
    word characters. The prior is the beta distribution with the mean and variance of the hosts' raw rates (weights
    equal); where the variance is zero or leaves no beta distribution, the prior weighs as one document.
    """
    failed = F.col("base_failed") | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"))
    sums = docs.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failures"))
    sums = materialise(sums, "hosts")
    raw = F.col("failures") / F.col("n")
    m, v = (x if x is not None else 0.0 for x in sums.agg(F.avg(raw), F.var_pop(raw)).first())
    weight = m * (1 - m) / v - 1 if v > 0 else 1.0
    weight = weight if weight > 0 else 1.0
    return sums.withColumn("rate", (F.col("failures") + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))


def with_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measured ``docs`` with ``host_rate`` and ``kept``: false if the base rules fail or the host is rejected.

    Documents without a host are judged by the base rules alone. ``docs`` should be a written table, as it is read
    twice. Empty tables give empty results.
    """
    rates = host_rates(docs, host)
    rates = rates.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    if rates.count() <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    base = docs.drop("host_rate", "kept")
    out = base.join(rates, base[host] == rates["_host"], "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_rate") <= MAX_RATE, F.lit(True)))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("source"))
    tall = materialise(measured(rows).drop("text"), "measured")
    return with_verdicts(tall).where("kept").select(*(F.col("row").getField(c).alias(c) for c in columns))
