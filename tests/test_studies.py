"""Studies, clustering by planted blocks, and what the ledger refuses."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.operators import clustering, graph, ledger, studies


def planted(rng, n=60, k=3, keep=0.5, flip=0.1):
    """A signed graph of ``k`` equal blocks: friends within, foes between, some edges gone and some signs turned."""
    truth = np.arange(n) % k
    sign = np.where(truth[:, None] == truth[None], 1.0, -1.0) * np.where(rng.random((n, n)) < flip, -1, 1)
    upper = np.triu(sign * (rng.random((n, n)) < keep), 1)
    return upper + upper.T, truth


def rand_index(a, b):
    same = lambda x: x[:, None] == x[None]
    return ((same(np.asarray(a)) == same(np.asarray(b))).sum() - len(a)) / (len(a) * (len(a) - 1))


@pytest.mark.parametrize("name", ["SPONGE", "SPONGEsym", "BNC", "SignedSpectral", "RegSignedSpectral", "RegSPONGE", "PowerMean(1)", "PowerMean(0)", "PowerMean(-10)"])
def test_kernels_find_planted_blocks(name):
    rng = np.random.default_rng(5)
    scores = []
    for _ in range(4):
        a, truth = planted(rng)
        scores.append(rand_index(clustering.KERNELS[name](a, 3), truth))
    assert np.mean(scores) > 0.9


def test_regularised_embeddings_in_plain_numpy():
    rng = np.random.default_rng(2)
    a, _ = planted(rng, 30, keep=0.3)
    n, d = len(a), np.abs(a).sum(1)
    gamma = max(1.0, ((a != 0).sum() / (n * (n - 1)) * (n - 1)) ** 0.875)
    root = np.diag((d + gamma) ** -0.5)
    _, v = np.linalg.eigh(np.eye(n) - root @ a @ root)
    want = clustering.kmeans(v[:, :2] / np.linalg.norm(v[:, :2], axis=1, keepdims=True), 3)
    assert rand_index(clustering.regularised_spectral(a, 3), want) == 1.0


def test_number_of_clusters():
    assert clustering.eigengap_k(np.array([0, 5, 5.1, 5.2, 6.5, 6.6])) == 2
    assert clustering.eigengap_k(np.array([0, 0.1, 0.2, 4, 4.1])) == 3 and clustering.eigengap_k(np.array([1.0])) == 2
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (20, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    for score in (clustering.silhouette, clustering.calinski_harabasz, clustering.davies_bouldin):
        assert clustering.scored_k(x, score, 2, 7) == 4


def test_long_chains_are_one_component(spark):
    rng = np.random.default_rng(8)
    order = rng.permutation(300).tolist()
    edges = [(a, b) for a, b in zip(order, order[1:])]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src bigint, dst bigint")
    nodes = spark.range(0, 305).withColumnRenamed("id", "node")
    got = {r.node: r.component for r in graph.components(df, nodes).collect()}
    assert got == {i: 0 if i < 300 else i for i in range(305)}


def test_ledger_refuses_what_it_cannot_replay():
    one = np.array([[0.5, -0.5]])
    for bad in (dict(targets=[[np.nan, 0.1]]), dict(returns=[[-1.5, 0.0]]), dict(returns=[[np.inf, 0.0]]), dict(funding=[[np.inf, 0.0]]), dict(cost_bps=np.nan), dict(cost_bps=-1.0), dict(every=0)):
        arrays = {"targets": one, "returns": np.zeros((1, 2)), "funding": None} | {k: np.array(v) for k, v in bad.items() if k in ("targets", "returns", "funding")}
        rules = {k: v for k, v in bad.items() if k in ("cost_bps", "every")}
        with pytest.raises(ValueError):
            list(ledger.replay(arrays["targets"], arrays["returns"], arrays["funding"], **rules))
    with pytest.raises(ValueError):
        list(ledger.replay(one, np.array([[np.nan, 0.0]]), missing="raise", max_turnover=None))
    (day,) = ledger.replay(np.array([[1.0, -0.5]]), np.array([[np.nan, 0.1]]), np.array([[0.01, np.nan]]), cost_bps=0.0, max_turnover=None)
    equity, gross, _, funding, net, turnover, exposure, stale, covered, status = day
    assert (turnover, exposure, stale, covered, status) == (1.5, 1.5, 1.0, 1.0, "ok")
    assert gross == pytest.approx(-0.05) and funding == pytest.approx(-0.01) and net == pytest.approx(equity - 1) == pytest.approx(-0.06)
    *_, last = ledger.replay(np.array([[-1.0], [0.0]]), np.array([[2.0], [0.0]]), cost_bps=0.0, max_turnover=None)
    assert last[-1] == "insolvent"


def test_matched_controls(spark):
    dead = spark.createDataFrame([(1, "B1"), (2, "B1"), (3, "B2"), (4, "B9")], "id bigint, bracket string")
    pool = spark.createDataFrame([(100 + i, "B1", 500 if i % 3 else 10) for i in range(50)] + [(3, "B2", 900), (200, "B2", 5)], "id bigint, bracket string, n_obs bigint")
    got = {r.id: r.control for r in studies.matched_controls(dead, pool, 100).collect()}
    assert set(got) == {1, 2} and all(c >= 100 and (c - 100) % 3 for c in got.values())
    assert got == {r.id: r.control for r in studies.matched_controls(dead.repartition(3), pool.repartition(5), 100).collect()}


def test_empty_studies(spark):
    day = spark.createDataFrame([], "arm string, date date, net double, gross double, cost double, turnover double")
    assert studies.leaderboard(day).count() == 0
    assert {r.failures for r in studies.verify_book(day).collect()} == {0}
    assert studies.best_per_group(spark.createDataFrame([("g", "a", None)], "g string, arm string, sharpe double"), "g").count() == 0
