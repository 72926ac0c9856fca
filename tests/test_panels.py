"""Reference semantics against pandas and known answers, and plans that must look only backwards."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import symbols
from quantloom.operators import asof, characteristics, clustering, death, folds, graph, inference, ledger, panel, pca, portfolio, returns, rolling, signals, universe, walkforward

DAY = dt.date(2020, 1, 6)


def day(i):
    return DAY + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(0)
    p = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.05, (120, 6)), axis=0)), index=[day(i) for i in range(120)], columns=list("abcdef"))
    p.iloc[10:14, 0] = np.nan
    p.iloc[40, 2] = np.nan
    p.iloc[70:, 5] = np.nan
    return p


@pytest.fixture(scope="module")
def dense(spark, wide):
    rows = [(d, c, None if np.isnan(v) else float(v)) for d, r in wide.iterrows() for c, v in r.items()]
    prices = spark.createDataFrame(rows, "date date, id string, price double").where("price IS NOT NULL")
    out = panel.densify(prices, panel.calendar(prices)).withColumn("r", returns.log_return()).withColumn("volume", F.col("price") * 1000).withColumn("mcap", F.col("price") * 1e6)
    return out.withColumn("m", F.expr("avg(r) OVER (PARTITION BY date)")).cache()


def pivot(df, value):
    return df.select("date", "id", value).toPandas().pivot(index="date", columns="id", values=value).astype(float)


def same(df, value, expected):
    got = pivot(df, value).reindex(index=expected.index, columns=expected.columns)
    np.testing.assert_allclose(got.to_numpy(), expected.to_numpy(float), rtol=1e-8, atol=1e-10, equal_nan=True)


def test_returns_and_rolling_match_pandas(dense, wide):
    r = np.log(wide / wide.shift(1))
    m = r.mean(axis=1)
    same(dense, "r", r)
    checks = {
        "mom": (characteristics.momentum(14), r.rolling(14, min_periods=7).sum()),
        "vol": (characteristics.volatility(), r.rolling(30, min_periods=5).std()),
        "skew": (characteristics.skew(), r.rolling(90, min_periods=20).skew()),
        "high": (panel.rolling(F.max, "price", 50, 10), wide.rolling(50, min_periods=10).max()),
        "q": (rolling.quantile("r", 0.3, 20), r.rolling(20, min_periods=10).quantile(0.3)),
        "corr": (rolling.correlation("r", "m"), r.rolling(60, min_periods=20).corr(m)),
        "ewm": (rolling.ewm_zscore("r"), (r - r.ewm(halflife=10, min_periods=5).mean()) / r.ewm(halflife=10, min_periods=5).std()),
        "rank": (panel.rank_pct("price", "date"), wide.rank(axis=1, pct=True)),
        "ffill": (panel.fill_forward("price", 3), wide.ffill(limit=3)),
    }
    beta = pd.DataFrame({c: r[c].rolling(90, min_periods=20).cov(m) for c in r}).div(m.rolling(90, min_periods=20).var(), axis=0)
    checks["beta"] = (characteristics.beta(), beta)
    out = dense.withColumns({k: c for k, (c, _) in checks.items()})
    for k, (_, expected) in checks.items():
        same(out, k, expected)


def test_no_lookahead(spark, dense):
    names = ["mom_2w", "volatility", "beta", "ivol", "turning_points", "amihud"]
    cut = day(80)
    whole = characteristics.build(dense, names).where(F.col("date") <= cut)
    part = characteristics.build(dense.where(F.col("date") <= cut), names)
    for n in names:
        pd.testing.assert_frame_equal(pivot(whole, n), pivot(part, n))


def test_quality_report_matches_pandas(dense, wide):
    r = np.log(wide / wide.shift(1))
    got = panel.quality_report(dense, "r").toPandas().set_index("id")
    for c in r:
        np.testing.assert_allclose([got.loc[c, "skew"], got.loc[c, "kurtosis"], got.loc[c, "std"], got.loc[c, "missing"]], [r[c].skew(), r[c].kurt(), r[c].std(), r[c].isna().mean()])


def test_brackets_are_half_open(spark):
    ratios = [(1.0, "B0"), (0.10, "B0"), (0.0999, "B1"), (0.01, "B1"), (0.00999, "B2"), (0.001, "B2"), (0.00099, "B3"), (0.0001, "B3"), (0.00009, None), (0.0, None), (float("inf"), None)]
    df = spark.createDataFrame(ratios, "x double, want string")
    assert df.where(~universe.bracket_of(F.col("x")).eqNullSafe(F.col("want"))).count() == 0


def test_asof_and_strict(spark):
    days = spark.createDataFrame([(day(i),) for i in range(6)], "date date")
    snaps = spark.createDataFrame([(day(1), 1), (day(1), 2), (day(4), 1)], "snapshot_date date, id int")
    held = {(r.date, r.id) for r in asof.membership(snaps, days).collect()}
    assert held == {(day(i), j) for i in (1, 2, 3) for j in (1, 2)} | {(day(4), 1), (day(5), 1)}
    strict = {(r.date, r.snapshot_date) for r in asof.day_to_snapshot(days, snaps, strict=True).collect()}
    assert strict == {(day(2), day(1)), (day(3), day(1)), (day(4), day(1)), (day(5), day(4))}


def test_exit_kinds(spark):
    rows = [(day(i), k, 1, 10.0, v, 1e7) for k, n, v in ((1, 60, 1e6), (2, 60, 100.0), (3, 182, 1e6), (4, 60, 1e6)) for i in range(n)]
    table = universe.universe_table(spark.createDataFrame(rows, "date date, id int, rank int, price double, volume double, mcap double"), spark.createDataFrame([(1,), (2,), (3,)], "id int"), day(181))
    got = {r.id: (r.exit_kind, r.delisting_rule, r.delisting_date) for r in table.collect()}
    assert got == {1: ("death", "last_price", day(59)), 2: ("death", "total_loss", day(59)), 3: ("alive", "alive", None), 4: ("censored_by_rank", "censored", None)}


def test_terminal_shock_comes_once(spark, dense):
    ends = spark.createDataFrame([("a", day(50))], "id string, delisting_date date")
    got = pivot(returns.with_terminal_shock(dense, ends, "r", "m"), "r")["a"]
    m = pivot(dense, "m")["a"]
    assert math.isclose(got[day(51)], math.log(0.01) - m[day(51)]) and got[day(52) :].isna().all() and not np.isnan(got[day(50)])


def test_ledger_known_answers():
    run = lambda t, r, **k: list(ledger.replay(np.array(t, float), np.array(r, float), **{"cost_bps": 0, "max_turnover": None, **k}))
    (e, *_), = run([[-1]], [[-0.99]])
    assert math.isclose(e, 1.99)
    a, b = run([[0.5, 0.5], [0, 0]], [[0.1, 0.1], [0.1, 0.1]], every=2)
    assert math.isclose(a[0], 1.1) and math.isclose(b[0], 1.21) and b[5] == 0
    one = run([[0.5]], [[0.1]], cost_bps=100, funding=np.array([[0.02]]))
    assert math.isclose(one[0][0], 1.035)
    path = run([[-1], [-1]], [[2], [0]])
    assert len(path) == 1 and path[0][-1] == "insolvent"
    capped = run([[1.0]], [[0.0]], max_turnover=0.15)
    assert math.isclose(capped[0][5], 0.15)


def test_ledger_runs_by_book(spark):
    rows = [(b, day(i), c, 0.5, 0.1) for b in ("x", "y") for i in range(3) for c in "pq"]
    out = ledger.ledger(spark.createDataFrame(rows, "book string, date date, id string, target double, r double"), cost_bps=0.0, max_turnover=None).toPandas()
    assert len(out) == 6 and np.allclose(out.sort_values(["book", "date"])["equity"], [1.1, 1.21, 1.331] * 2)


@pytest.mark.parametrize("name", list(clustering.KERNELS))
def test_planted_clusters(name):
    rng = np.random.default_rng(1)
    for k in (2, 3, 4):
        labels = np.repeat(np.arange(k), 15)
        alike = labels[:, None] == labels[None]
        a = np.triu(np.where(alike, rng.uniform(0.6, 0.95, alike.shape), -rng.uniform(0.6, 0.95, alike.shape)), 1)
        found = clustering.KERNELS[name](a + a.T, k)
        assert len(set(zip(found, labels))) == k == len(set(found))
    for n in (2, 12):
        assert len(clustering.KERNELS[name](np.zeros((n, n)), min(n, 5))) == n


def test_number_of_clusters():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    labels = clustering.kmeans(x, 3)
    assert clustering.silhouette(x, labels) > 0.9 and clustering.davies_bouldin(x, labels) < 0.2 and clustering.calinski_harabasz(x, labels) > 1000
    assert clustering.gap_k(x, 2, 5) == 3 and clustering.eigengap_k(np.array([0, 0.01, 0.02, 1.0, 1.1])) == 3 and clustering.consensus_k({"a": 3, "b": 2, "c": 3}) == 3


def test_graph_operators(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.8), ("b", "c", 0.1), ("d", "e", 0.5)], "a string, b string, corr double")
    edges = {(r.src, r.dst): r.weight for r in graph.knn(pairs, 1).collect()}
    assert edges[("a", "b")] == edges[("b", "a")] == 0.9 and edges[("a", "c")] == -0.4
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    got = {r.node: r.component for r in graph.components(graph.both_ways(pairs).select("src", "dst"), nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    one = spark.createDataFrame([(i, i % 3) for i in range(30)], "node int, label int")
    assert graph.adjusted_rand(one, one).first()["ari"] == 1.0


def test_market_mode_matches_numpy(dense, wide):
    r = np.log(wide / wide.shift(1))
    x = r.dropna(how="all").fillna(0.0)
    z = (x - x.mean()) / x.std(ddof=0)
    values, vectors = np.linalg.eigh(z.T @ z)
    v = vectors[:, -1]
    residual = x - (z @ v).to_numpy()[:, None] * v[None] * x.std(ddof=0).to_numpy()[None]
    got = pivot(pca.residualise(dense, pca.fit_modes(dense, 1)), "residual").loc[x.index]
    np.testing.assert_allclose(got.to_numpy(), residual.to_numpy(), atol=1e-9)


def test_signals(spark):
    rows = [(day(0), c, i // 3, z) for i, (c, z) in enumerate(zip("abcdef", (-2.5, 0.0, 2.5, -2.5, 0.0, None)))]
    df = spark.createDataFrame(rows, "date date, id string, cluster int, signal double")
    q = {r.id: r.w for r in signals.quantile_weights(df).collect()}
    assert q == {"a": 1.0, "b": 0.0, "c": -1.0, "d": 1.0, "e": -1.0, "f": 0.0}
    t = {r.id: r.w for r in signals.threshold_weights(df).withColumn("w", signals.balanced_legs()).collect()}
    assert t == {"a": 1.0, "b": 0.0, "c": -1.0, "d": 0.0, "e": 0.0, "f": 0.0}


def test_ou_scores_recover_speed(spark):
    rng, x, out = np.random.default_rng(3), 0.0, []
    path = []
    for _ in range(400):
        x += 0.25 * (0 - x) + rng.normal(0, 0.1)
        path.append(x)
    steps = np.diff([0.0, *path])
    df = spark.createDataFrame([("a", day(i), i, float(v)) for i, v in enumerate(steps)], "id string, date date, date_idx int, deviation double")
    got = signals.ou_scores(df, window=300).where("s IS NOT NULL").agg(F.avg("half_life")).first()[0]
    assert 1.0 < got < 5.0 and not out


def test_costs_and_holdings(spark):
    rows = [(day(i), "a", w, r) for i, (w, r) in enumerate(zip((0.0, 0.5, 0.5, 0.0, 0.3), (0.1, 0.1, -0.1, 0.1, 0.1)))]
    df = spark.createDataFrame(rows, "date date, id string, w double, r double")
    book = portfolio.book(df, 100.0).orderBy("date").toPandas()
    assert np.allclose(book["turnover"], [0, 0.5, 0, 0.5, 0.3]) and np.allclose(book["net"], [0, 0.045, -0.05, -0.005, 0.027])
    held = portfolio.holding_periods(df).first()
    assert (held["n_holdings"], held["mean_days"]) == (1, 2.0)


def test_neutral_to_many_factors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2, 12, 4))
    rows = [(day(d), f"n{i}", *map(float, x[d, i])) for d in range(2) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, id string, w double, f double, g double, h double").withColumn("twin", F.col("f"))
    out = portfolio.factors_neutral(df, ["f", "g", "h"]).toPandas()
    assert all(abs((out["w"] * out[c]).groupby(out["date"]).sum()).max() < 1e-6 for c in "fgh")
    two = portfolio.factors_neutral(df, ["f", "g"]).toPandas().sort_values(["date", "id"])["w"]
    same = df.withColumn("w", portfolio.two_factor_neutral("w", "f", "g")).toPandas().sort_values(["date", "id"])["w"]
    assert np.allclose(two, same)
    assert abs((portfolio.factors_neutral(df, ["f", "twin"]).toPandas().pipe(lambda p: (p["w"] * p["f"]).groupby(p["date"]).sum()))).max() < 1e-6


def test_quintile_edges_go_up(spark):
    df = spark.range(1, 11).select(portfolio.quintile(F.col("id"), F.lit(10)).alias("q"))
    assert [r.q for r in df.collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 4]


def test_inference(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.05, 1, 300)
    df = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x)], "date date, net double")
    s = pd.Series(x)
    z = s.mean() / s.std() * math.sqrt(299) / math.sqrt(1 - s.skew() * s.mean() / s.std() + (s.kurt() + 2) / 4 * (s.mean() / s.std()) ** 2)
    assert math.isclose(inference.probabilistic_sharpe(df, "net").first()["z"], z, rel_tol=1e-9)
    assert 0 < inference.deflated_sharpe(df, "net", [0.01, 0.02, 0.05]) < 1
    y = 2 + 3 * x + rng.normal(0, 0.1, 300)
    fit = inference.ols(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x)], "y double, x double"), "y", ["x"]).toPandas().set_index("name")
    assert abs(fit.loc["x", "coef"] - 3) < 0.05 and fit.loc["x", "t"] > 100


def test_romano_wolf_finds_the_real_one(spark):
    rng = np.random.default_rng(7)
    r = rng.normal(0, 0.01, (300, 6))
    r -= r.mean(axis=0)  # no strategy but the planted one has a mean
    r[:, 3] += 0.004
    rows = [(day(i), f"s{j}", float(r[i, j])) for i in range(300) for j in range(6)]
    out = inference.romano_wolf(spark.createDataFrame(rows, "date date, strategy string, ret double"), reps=200, seed=1).toPandas().set_index("strategy")
    assert out["significant"].to_dict() == {f"s{j}": j == 3 for j in range(6)}


def test_folds(spark):
    got = [tuple(r) for r in folds.folds(spark, 100, 50, 10, 2).collect()]
    assert got[0] == (0, 0, 50, 52, 62) and got[-1][4] <= 100 and [g[3] for g in got] == list(range(52, 91, 10))


def test_survival_model(spark):
    rng, rows, ends = np.random.default_rng(4), [], []
    for i in range(60):
        dies = i % 2 == 0
        n = 700 if not dies else 400 + 5 * i
        price, rank = 100.0, 10.0
        for t in range(n):
            fading = dies and t > n - 60
            price *= math.exp(rng.normal(-0.05 if fading else 0, 0.02))
            rank += 2 if fading else 0
            rows.append((dt.date(2018, 1, 1) + dt.timedelta(days=t), i, float(rank), price, price * 10))
        ends.append((i, dt.date(2018, 1, 1) + dt.timedelta(days=n - 1) if dies else None))
    x = death.build_features(spark.createDataFrame(rows, "date date, id int, rank double, price double, volume double"), spark.createDataFrame(ends, "id int, delisting_date date")).cache()
    assert death.purged(x, 2019).agg(F.max("date")).first()[0] < dt.date(2018, 12, 2)
    assert death.walk_forward(x, 2018, 2018) is None
    scored = death.walk_forward(x, 2019, 2019, min_positives=1)
    assert scored is None or death.auc(scored).first()["auc"] > 0.8


def test_symbols(spark):
    cases = [("BTC-USD", "BTC"), ("AAVE_USDC-PERPETUAL", "AAVE"), ("1000BONKUSDT", "BONK"), ("USDT", "USDT"), (" eth ", "ETH"), ("MKR", "KR"), ("MX", "MX"), (None, ""), ("", "")]
    df = spark.createDataFrame(cases, "s string, want string")
    assert [(r.s, r.b) for r in df.select("s", symbols.normal_base(F.col("s")).alias("b")).collect()] == cases
    money = spark.createDataFrame([(1.5e12,), (2.0e9,), (3.4e6,), (7800.0,), (12.0,), (None,)], "v double")
    assert [r.m for r in money.select(symbols.money(F.col("v")).alias("m")).collect()] == ["1.5T", "2.0B", "3.4M", "7.8k", "12", None]


def test_walk_forward_looks_only_back(spark):
    rng = np.random.default_rng(9)
    common = rng.normal(0, 0.02, (120, 2))
    r = np.hstack([common[:, [0]] + rng.normal(0, 0.01, (120, 5)), common[:, [1]] + rng.normal(0, 0.01, (120, 5))])
    rows = [(day(i), i, f"n{j}", float(r[i, j])) for i in range(120) for j in range(10)]
    dense = spark.createDataFrame(rows, "date date, date_idx int, id string, r double").cache()
    rules = walkforward.Rules(train=60, test=10, context=40, clusters=2, kernel="SignedSpectral", neighbours=3, drop_least_cohesive=False, weigh=lambda df: signals.deviation_weights(df, limit=0.5))
    key = lambda df: {(x.date, x.id): round(x.w, 9) for x in df.collect()}
    whole = key(walkforward.fold_weights(dense, 120, rules))
    part = key(walkforward.fold_weights(dense.where("date_idx < 90"), 90, rules))
    assert len(whole) == 600 and part and all(whole[k] == w for k, w in part.items())
    assert any(w for w in whole.values())
    poked = dense.withColumn("r", F.when(F.col("date_idx") == 89, F.lit(9.0)).otherwise(F.col("r")))
    assert key(walkforward.fold_weights(poked.where("date_idx < 90"), 90, rules)) == part
    for d in {k[0] for k in whole}:
        gross = sum(abs(w) for (x, _), w in whole.items() if x == d)
        assert gross < 1e-9 or abs(gross - 1.5) < 1e-6
    book = walkforward.run(dense, 120, (0.0, 50.0), rules).toPandas()
    assert set(book["book"]) == {0.0, 50.0} and len(book) == 120
