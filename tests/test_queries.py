"""Every registered query runs, and equals its SQL where it has one, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from pathlib import Path

import duckdb
import pytest

from quantloom.plans import registry

SF = "/root/testdata/sf0.001"


@cache
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    """Numbers to seven significant digits, dates and times alike, so that both engines' values compare."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float, decimal.Decimal)):
        return (2, f"{float(x) + 0.0:.7g}" if x else "0")
    if isinstance(x, datetime.datetime):
        return (3, x.replace(tzinfo=None).isoformat())
    if isinstance(x, datetime.date):
        return (3, datetime.datetime(x.year, x.month, x.day).isoformat())
    return (4, str(x))


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query, or the error; several run beside each other, as tiny ones mostly wait for planning."""

    def run(name):
        try:
            df = registry.queries()[name](spark, SF)
            return df.columns, [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001  each test shows its own query's error
            return e

    names = sorted(registry.queries())
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(names, pool.map(run, names)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    columns, rows = results[name]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows or name.startswith("walkforward")  # so few dates hold no whole fold
        return
    found = tables().sql(sql)
    want = found.fetchall()
    assert sorted(columns) == sorted(found.columns)
    got, want = sorted_rows(columns, rows), sorted_rows(found.columns, want)
    assert len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want) if g != w and any(a != b and not (a[0] == b[0] == 2 and abs(float(a[1]) - float(b[1])) <= 2e-5 * max(1.0, abs(float(b[1])))) for a, b in zip(g, w))]
    assert not off, off[:3]
