"""URL rules by host suffix and path prefix: expand, join on short hash prefixes, confirm the digest, rank.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses.
SHORT = 8
#: Rules up to which the rule table is broadcast; larger tables are joined by a shuffle.
BROADCAST_RULES = 20_000


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: then up to ``? #`` or the end.

    Both are empty for null and where there is no ``://``.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lowered(host), path


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` (``allow`` or ``block``).

    ``rules``: ``action, host, path``, hosts in any case. A rule fits its host and all subdomains where the url's path starts with the
    rule's. The longest rule (host and path together) wins; of equal length, the one with the longer host; of the
    same rule with both actions, ``block``. Where no rule fits the verdict is ``default``.

    Each distinct url is expanded once: its host suffixes, up to the labels that rules have, times its path
    prefixes of the lengths that rules have. Repeated urls, null urls and rows repeated in full keep a row each;
    columns of ``pages`` named like a result are replaced; empty tables give empty results.
    """
    known = rules.select(
        F.lower("action").alias("action"), lowered(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")
    ).where(F.col("rule_host") != "").withColumn("rule", F.concat("rule_host", "rule_path"))
    shape = known.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")
    ).first()
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in made]
    base = pages.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"))

    digest = lambda c: F.sha2(c.cast("binary"), 256)
    known = known.withColumn("digest", digest(F.col("rule")))
    known = known.groupBy("rule", "rule_host", "digest").agg(F.max("action").alias("action"))  # block over allow
    known = known.withColumn("short", F.substring("digest", 1, SHORT))
    if shape["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)

    labels = F.split("host", r"\.")
    many = F.least(F.size(labels), F.lit(shape["labels"] or 1))
    suffixes = F.transform(F.sequence(F.lit(1), many), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.transform(
        F.filter(F.array(*(F.lit(int(n)) for n in sorted(shape["lengths"] or [0]))), lambda n: n <= F.length("path")),
        lambda n: F.substr(F.col("path"), F.lit(1), n),
    )
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    urls = base.where(F.col("host") != "").select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(pairs).alias("tried")).withColumn("sha", digest(F.col("tried")))
    hits = tried.withColumn("short", F.substring("sha", 1, SHORT)).join(known, "short").where((F.col("sha") == F.col("digest")) & (F.col("tried") == F.col("rule")))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"), F.col("action"))).alias("best")
    ).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    out = base.join(best, ["host", "path"], "left")
    return out.select(*(F.col(f"`{c}`") for c in kept), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
