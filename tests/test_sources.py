"""Readers, the fetch cache, sinks and streaming twins."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators import ledger
from quantloom.sources import readers
from quantloom.streaming import panels


def test_wide_csv(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    pd.DataFrame({"date": ["2020-01-01", "2020-01-02"], "ZRX_close": [1.0, None], "AAVE_close": ["x", 2.5], "AAVE_volume": [5, 6], "USDT_close": [1, 1]}).to_csv(path, index=False)
    got = {(str(r.date), r.id): r.value for r in readers.wide_csv(spark, path, "close", ["USDT"]).collect()}
    assert got == {("2020-01-01", "ZRX"): 1.0, ("2020-01-02", "ZRX"): None, ("2020-01-01", "AAVE"): None, ("2020-01-02", "AAVE"): 2.5}
    assert readers.market_caps(spark, path).where("id = 'AAVE'").agg(F.sum("value")).first()[0] == 11.0


def test_payloads(spark):
    listing = json.dumps([{"id": 1, "name": "n", "symbol": "S", "slug": "s", "cmcRank": 3, "quotes": [{"price": 2.0, "volume24h": 1.0, "marketCap": 9.0}]}] * 2)
    row = readers.parse_listing(spark.createDataFrame([("d", listing)], "day string, payload string")).collect()
    assert len(row) == 1 and row[0].price_usd == 2.0 and row[0].rank == 3
    history = json.dumps({"data": {"quotes": [{"timeOpen": "2020-01-02T00:00:00Z", "quote": {"open": 1.0, "close": 2.0}}] * 2}})
    assert readers.parse_history(spark.createDataFrame([(1, history)], "id int, payload string")).collect()[0].close == 2.0
    keys = readers.market_keys(spark.createDataFrame([('{"markets": {"BTC-USD": {"a": 1}, "ETH-USD": {}}}',)], "payload string"))
    assert {r.symbol for r in keys.collect()} == {"BTC-USD", "ETH-USD"}
    xml = spark.createDataFrame([("<L><Prefix>data/x/</Prefix><P><Prefix>data/x/BTCUSDT/</Prefix></P></L>",)], "payload string")
    assert "BTCUSDT" in {r.symbol for r in readers.xml_prefixes(xml).collect()}


def test_funding(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", "calc_time,funding_interval_hours,last_funding_rate\n1577836800000,8,0.1\n1577865600000,8,0.2\n1578009600000,8,0.5\n")
    rates = readers.funding_archives(spark, str(tmp_path)).withColumn("base", F.lit("b"))
    got = {str(r.date): round(r.rate, 9) for r in readers.daily_funding(rates, "base").collect()}
    assert got == {"2020-01-01": 0.3, "2020-01-02": 0.0, "2020-01-03": 0.5}
    two = spark.createDataFrame([(dt.date(2020, 1, 1), "b", "z", 1.0), (dt.date(2020, 1, 1), "b", "a", 2.0)], "date date, base string, venue string, rate double")
    assert readers.first_venue(two).collect()[0].rate == 2.0


def test_fetch_cache(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def fetch(key):
        (log / f"{key['day']}-{len(list(log.iterdir()))}").touch()
        if key["day"] == 3:
            raise OSError("down")
        return pd.DataFrame({"x": [float(key["day"])] * (key["day"] % 2)})

    wanted = spark.createDataFrame([(1,), (2,), (3,)], "day int").coalesce(1)
    for _ in range(2):  # a key that fails is asked for again each time, the others once
        out = readers.fetch_missing(spark, wanted, str(tmp_path / "cache"), fetch, "x double", retries=2, pause=0.0)
    assert [(r.day, r.x) for r in out.collect()] == [(1, 1.0)]
    names = [p.name.split("-")[0] for p in log.iterdir()]
    assert (names.count("1"), names.count("2"), names.count("3")) == (1, 1, 4)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf")), (2, 1.5)], "k int, v double")
    readers.write_table(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).where("v IS NULL").count() == 1
    readers.write_panel(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_mask_sink(spark, tmp_path):
    rows = [(dt.date(2020, 1, 1), "a.x"), (dt.date(2020, 1, 1), "a.x"), (dt.date(2020, 1, 2), "b"), (dt.date(2020, 1, 2), None)]
    readers.write_mask(spark.createDataFrame(rows, "date date, id string"), ["a.x", "b", "never"], str(tmp_path / "m"))
    got = [tuple(r) for r in spark.read.csv(str(tmp_path / "m"), header=True).orderBy("date").collect()]
    assert got == [("2020-01-01", "true", "false", "false"), ("2020-01-02", "false", "true", "false")]


def run(query, name, mode="append"):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None


def test_streams_equal_batches(spark, tmp_path):
    base = dt.datetime(2020, 1, 1)
    events = [(i, base + dt.timedelta(hours=5 * i), i % 3, f"t{i % 2}", float(i)) for i in range(60)]
    df = spark.createDataFrame(events + events[:5], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    df.write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    run(panels.daily_resample(panels.deduplicated(source), late=None), "daily")
    batch = {(r.date, r.event_type): r.total for r in df.dropDuplicates().groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.sum("value").alias("total")).collect()}
    got = {(r.date, r.event_type): r.total for r in spark.table("daily").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    run(panels.sessions(source, gap="10 hours"), "sess")  # events of a user are 15 hours apart
    assert spark.table("sess").count() > 0


def test_streaming_ledger_equals_batch(spark, tmp_path):
    rows = [("b", dt.date(2020, 1, 1) + dt.timedelta(days=i), c, 0.1 * (i % 3), 0.01 * ((i + ord(c)) % 5 - 2)) for i in range(20) for c in "pq"]
    df = spark.createDataFrame(rows, "book string, date date, id string, target double, r double")
    df.coalesce(1).write.parquet(str(tmp_path / "l"))
    run(panels.ledger(spark.readStream.schema(df.schema).parquet(str(tmp_path / "l"))), "led")
    got = {r.date: round(r.equity, 10) for r in spark.table("led").collect()}
    want = {r.date: round(r.equity, 10) for r in ledger.ledger(df).collect()}
    assert got == want and len(got) == 20
