"""Files and payloads: wide CSV panels, nested JSON listings, funding archives, and a resumable fetch cache."""

from __future__ import annotations

import io
import os
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "array<struct<id:int,name:string,symbol:string,slug:string,cmcRank:int,quotes:array<struct<name:string,price:double,volume24h:double,marketCap:double>>>>"
HISTORY = "struct<data:struct<quotes:array<struct<timeOpen:string,quote:struct<open:double,high:double,low:double,close:double,volume:double,marketCap:double>>>>>"


# -- wide CSV -------------------------------------------------------------------------------------


def find_raw(name: str, path: str | None = None, variable: str = "RAW_PANEL_DIR", folder: str = "data") -> str:
    """The folder given, or else of the environment variable, or else the data folder."""
    return os.path.join(path or os.environ.get(variable) or folder, name)


def wide_csv(spark: SparkSession, path: str, suffix: str, exclude: Iterable[str] = (), date: str = "date") -> DataFrame:
    """``date, id, value`` of the columns that end in ``_<suffix>``, ids being what stands before, less the excluded."""
    raw = spark.read.csv(path, header=True)
    columns = [c for c in raw.columns if c.endswith(f"_{suffix}") and c[: -len(suffix) - 1].upper() not in set(exclude)]
    first = date if date in raw.columns else raw.columns[0]
    if not columns:
        return spark.createDataFrame([], "date date, id string, value double")
    long = raw.unpivot([first], sorted(columns), "id", "value")
    value = F.expr("try_cast(value AS double)")
    return long.select(F.to_date(F.col(first)).alias("date"), F.regexp_replace("id", f"_{suffix}$", "").alias("id"), F.when(~F.isnan(value), value).alias("value"))


def market_caps(spark: SparkSession, path: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Market caps, or volumes in their place where a file has none."""
    caps = wide_csv(spark, path, "market_cap", exclude)
    return wide_csv(spark, path, "volume", exclude) if caps.select("id").limit(1).count() == 0 else caps


def series_csv(spark: SparkSession, path: str, schema: str = "date date, close double, volume double") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def aligned(*panels: DataFrame) -> list[DataFrame]:
    """Each panel cut to the ids and the dates that all have."""
    ids = dates = None
    for p in panels:
        i, d = p.select("id").distinct(), p.select("date").distinct()
        ids, dates = (i, d) if ids is None else (ids.intersect(i), dates.intersect(d))
    return [p.join(ids, "id", "left_semi").join(dates, "date", "left_semi") for p in panels]


# -- JSON payloads in a string column -------------------------------------------------------------


def parse_listing(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per listed id, with the first of its quotes; the columns before ``payload`` stay."""
    keep = [c for c in df.columns if c != payload]
    e = df.select(*keep, F.explode(F.from_json(payload, LISTING)).alias("e"))
    q = F.element_at("e.quotes", 1)
    return e.select(
        *keep, F.col("e.id").alias("cmc_id"), "e.symbol", "e.name", "e.slug", F.col("e.cmcRank").alias("rank"),
        q["price"].alias("price_usd"), q["volume24h"].alias("volume_24h_usd"), q["marketCap"].alias("market_cap_usd"),
    ).dropDuplicates([*keep, "cmc_id"])


def parse_history(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Daily bars of paged payloads; a day met twice counts once."""
    keep = [c for c in df.columns if c != payload]
    e = df.select(*keep, F.explode(F.from_json(payload, HISTORY)["data"]["quotes"]).alias("e"))
    q = F.col("e.quote")
    return e.select(*keep, F.to_date(F.substring("e.timeOpen", 1, 10)).alias("date"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume_usd"), q["marketCap"].alias("market_cap_usd")).dropDuplicates([*keep, "date"])


def market_keys(df: DataFrame, payload: str = "payload", path: str = "markets") -> DataFrame:
    """The keys of a JSON map of markets, one per row."""
    return df.select(F.explode(F.map_keys(F.from_json(F.get_json_object(payload, f"$.{path}"), "map<string,string>"))).alias("symbol"))


def xml_prefixes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Symbols in the prefixes of a bucket listing in XML."""
    found = F.regexp_extract_all(payload, F.lit(r"<Prefix>[^<]*/([^/<]+)/</Prefix>"), F.lit(1))
    return df.select(F.explode(found).alias("symbol"))


# -- funding --------------------------------------------------------------------------------------


def funding_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, ts, rate`` of zipped monthly CSVs read as binary files; an archive is opened in memory in one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        t = pd.read_csv(z.open(member))
                        yield pd.DataFrame({"path": name, "ms": pd.to_numeric(t.iloc[:, 0], errors="coerce"), "rate": pd.to_numeric(t["last_funding_rate"], errors="coerce")}).dropna().astype({"ms": "int64"})

    return files.mapInPandas(run, "path string, ms bigint, rate double").select("path", F.timestamp_millis("ms").alias("ts"), "rate")


def daily_funding(rates: DataFrame, *keys: str) -> DataFrame:
    """Sums by day; days without a print between the first and the last are zero."""
    day = rates.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.sum("rate").alias("rate"))
    spine = day.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("date"))
    return spine.join(day, [*keys, "date"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def first_venue(funding: DataFrame) -> DataFrame:
    """One row per date and base: that of the first venue by name."""
    from quantloom.operators.panel import dedup

    return dedup(funding, ["date", "base"], F.col("venue").asc())


def funding_summary(daily: DataFrame, key: str = "base") -> DataFrame:
    return daily.groupBy(key).agg(F.count("*").alias("days"), F.avg("rate").alias("mean"), (F.avg("rate") * 365).alias("annual"), (F.avg("rate") * 1e4).alias("bps"), F.stddev_samp("rate").alias("vol"))


# -- fetching -------------------------------------------------------------------------------------


def fetch_missing(spark: SparkSession, wanted: DataFrame, cache: str, fetch: Callable[[dict], pd.DataFrame], schema: str, retries: int = 4, pause: float = 0.3) -> DataFrame:
    """Fetches each wanted key that the cache lacks and returns the cache; keys are rows of ``wanted``.

    A key fetched without rows is cached as well, so it is asked for once; one that keeps failing is left for the next
    call and sinks nothing. ``fetch`` runs on executors, a task per part of the keys.
    """
    keys = wanted.columns
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/keys")
    there = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    todo = wanted.distinct()
    if there:
        todo = todo.join(spark.read.parquet(f"{cache}/keys"), keys, "left_anti")
    row_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields) + f", ok boolean, rows array<struct<{schema}>>"

    def run(batches):
        for batch in batches:
            out = []
            for key in batch.to_dict("records"):
                for attempt in range(retries):
                    try:
                        out.append({**key, "ok": True, "rows": fetch(key).to_dict("records")})
                        break
                    except Exception:  # noqa: BLE001  whatever a source raises, the next key goes on
                        time.sleep(pause * 2**attempt)
            yield pd.DataFrame(out, columns=[*keys, "ok", "rows"])

    # one pass of fetching, written as it comes; keys and rows are read off that table
    batch = f"{cache}/batches/{uuid.uuid4().hex}"
    todo.mapInPandas(run, row_type).write.parquet(batch)
    got = spark.read.parquet(batch)
    got.select(*keys).write.mode("append").parquet(f"{cache}/keys")
    got.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*").write.mode("append").parquet(f"{cache}/rows")
    return spark.read.parquet(f"{cache}/rows")


# -- sinks ----------------------------------------------------------------------------------------


def write_panel(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV; infinities are empty."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    df.select(*(F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns)).write.mode("overwrite").csv(path, header=True)


def write_mask(members: DataFrame, ids: list, path: str) -> None:
    """Membership (``date, id``, repeated or not) as CSV: a row per date with members, a column of booleans per id."""
    wide = members.groupBy("date").pivot("id", list(ids)).agg(F.count(F.lit(1)) > 0)
    wide.select("date", *(F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(c) for c in wide.columns[1:])).write.mode("overwrite").csv(path, header=True)
