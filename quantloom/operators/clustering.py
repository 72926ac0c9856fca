"""Clustering of small signed graphs: numpy kernels run per fold by grouped maps.

A kernel takes a symmetric signed adjacency matrix and a number of clusters and returns labels. ``cluster_folds`` runs
one for each group of an edge table; folds run beside each other, each in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEED, RESTARTS, RIDGE, FLOOR = 42, 10, 1e-6, 1e-8


# -- shared algebra -------------------------------------------------------------------------------


def layers(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.nan_to_num(np.asarray(a, float))
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0.0)
    return np.maximum(a, 0), np.maximum(-a, 0)


def kmeans(x: np.ndarray, k: int, seed: int = SEED, restarts: int = RESTARTS, rounds: int = 300) -> np.ndarray:
    """Lloyd's algorithm from k-means++ starts; the least inertia of the restarts."""
    rng, best, n = np.random.default_rng(seed), (np.inf, None), len(x)
    k = min(k, n)
    for _ in range(restarts):
        centres = x[[rng.integers(n)]]
        for _ in range(1, k):
            gap = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            p = gap / gap.sum() if gap.sum() > 0 else np.full(n, 1 / n)
            centres = np.vstack([centres, x[rng.choice(n, p=p)]])
        labels = None
        for _ in range(rounds):
            gaps = ((x[:, None] - centres[None]) ** 2).sum(-1)
            new = gaps.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centres = np.vstack([x[labels == j].mean(0) if (labels == j).any() else x[gaps.min(1).argmax()] for j in range(k)])
        inertia = ((x - centres[labels]) ** 2).sum()
        if inertia < best[0] - 1e-12:
            best = (inertia, labels)
    return best[1].astype(int)


def smallest_pencil(m: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least eigenvalues and vectors of ``m v = lambda s v`` by whitening with the Cholesky factor of ``s``."""
    inv = np.linalg.inv(np.linalg.cholesky(s))
    values, vectors = np.linalg.eigh(inv @ m @ inv.T)
    return values[:k], (inv.T @ vectors)[:, :k]


def unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def normal_laplacian(w: np.ndarray, d: np.ndarray, sign: float = -1.0) -> np.ndarray:
    r = 1 / np.sqrt(np.where(d > 0, d, 1))
    return np.eye(len(w)) + sign * r[:, None] * w * r[None]


# -- kernels --------------------------------------------------------------------------------------


def sponge(a: np.ndarray, k: int, tau_pos: float = 1.0, tau_neg: float = 1.0) -> np.ndarray:
    p, n = layers(a)
    dp, dn = np.diag(p.sum(1)), np.diag(n.sum(1))
    _, v = smallest_pencil(dp - p + tau_neg * dn, dn - n + tau_pos * dp + RIDGE * np.eye(len(p)), k)
    return kmeans(unit_rows(v), k)


def sponge_sym(a: np.ndarray, k: int, tau_pos: float = 1.0, tau_neg: float = 1.0) -> np.ndarray:
    p, n = layers(a)
    eye = np.eye(len(p))
    _, v = smallest_pencil(normal_laplacian(p, p.sum(1)) + tau_neg * eye, normal_laplacian(n, n.sum(1)) + tau_pos * eye, k)
    return kmeans(unit_rows(v), k)


def balanced_normalised_cut(a: np.ndarray, k: int) -> np.ndarray:
    p, n = layers(a)
    _, v = smallest_pencil(np.diag(p.sum(1)) - p + n, np.diag((p + n).sum(1)) + RIDGE * np.eye(len(p)), k)
    return kmeans(unit_rows(v), k)


def signed_spectral(a: np.ndarray, k: int) -> np.ndarray:
    p, n = layers(a)
    _, v = np.linalg.eigh(normal_laplacian(p - n, (p + n).sum(1)))
    return kmeans(unit_rows(v[:, :k]), k)


def regularisation(a: np.ndarray) -> float:
    """``max(1, (p (n - 1))^(7/8))`` with ``p`` the share of pairs that have an edge."""
    n = len(a)
    p = np.count_nonzero(np.triu(a, 1)) / max(1, n * (n - 1) / 2)
    return max(1.0, (p * (n - 1)) ** 0.875)


def regularised_spectral(a: np.ndarray, k: int) -> np.ndarray:
    p, n = layers(a)
    # the regulariser is split evenly over the layers, so its rank-one terms cancel and only the degrees take it
    _, v = np.linalg.eigh(normal_laplacian(p - n, (p + n).sum(1) + regularisation(p - n)))
    return kmeans(unit_rows(v[:, : max(1, k - 1)]), k)


def regularised_sponge(a: np.ndarray, k: int, tau: float = 1.0) -> np.ndarray:
    p, n = layers(a)
    g, eye = regularisation(p - n), np.eye(len(p))
    _, v = smallest_pencil(normal_laplacian(p, p.sum(1) + g) + tau * eye, normal_laplacian(n, n.sum(1) + g) + (tau + RIDGE) * eye, max(1, k - 1))
    return kmeans(unit_rows(v), k)


def power_mean_laplacian(a: np.ndarray, k: int, p: float = -10.0) -> np.ndarray:
    """Clusters by the matrix power mean of both layers' Laplacians; at zero their log-Euclidean mean."""
    pos, neg = layers(a)
    shift = np.log10(1 + abs(p)) + RIDGE if p < 0 else 0.0
    parts = [normal_laplacian(pos, pos.sum(1)) + shift * np.eye(len(pos)), normal_laplacian(neg, neg.sum(1), 1.0) + shift * np.eye(len(pos))]

    def through(m: np.ndarray, f: Callable) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        return vectors * f(np.maximum(values, FLOOR)) @ vectors.T

    if p == 0:
        _, v = np.linalg.eigh(sum(through(x, np.log) for x in parts) / 2)
    else:
        values, v = np.linalg.eigh(sum(through(x, lambda e: e**p) for x in parts) / 2)
        v = v[:, np.argsort(np.maximum(values, 1e-300) ** (1 / p))]
    return kmeans(unit_rows(v[:, :k]), k)


def hierarchical(a: np.ndarray, k: int) -> np.ndarray:
    """Average linkage on ``1 - a`` clipped to [0, 2], cut at ``k`` clusters; ties by the lowest pair."""
    p, n = layers(a)
    d = np.clip(1 - (p - n), 0, 2)
    np.fill_diagonal(d, np.inf)
    size, groups = np.ones(len(d)), {i: [i] for i in range(len(d))}
    while len(groups) > max(1, k):
        i, j = divmod(int(d.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        groups[i] += groups.pop(j)
    labels = np.zeros(len(d), int)
    for label, members in enumerate(groups.values()):
        labels[members] = label
    return labels


def loading_kmeans(a: np.ndarray, k: int) -> np.ndarray:
    p, n = layers(a)
    values, v = np.linalg.eigh(p - n)
    return kmeans(v[:, np.argsort(-np.abs(values))[:k]], k)


def pivot(a: np.ndarray, k: int | None = None, restarts: int = 10, seed: int = SEED) -> np.ndarray:
    """Random pivots take their positive neighbours; the least disagreement wins, then clusters merge down to ``k``."""
    p, n = layers(a)
    w, rng = p - n, np.random.default_rng(seed)

    def disagreement(labels: np.ndarray) -> float:
        same = labels[:, None] == labels[None]
        return float(n[same].sum() + p[~same].sum()) / 2

    best = (np.inf, None)
    for _ in range(restarts):
        labels, nxt = np.full(len(w), -1), 0
        for i in rng.permutation(len(w)):
            if labels[i] < 0:
                labels[(labels < 0) & ((w[i] > 0) | (np.arange(len(w)) == i))] = nxt
                nxt += 1
        cost = disagreement(labels)
        if cost < best[0]:
            best = (cost, labels)
    labels = best[1]
    while k and labels.max() + 1 > k:
        hot = np.eye(labels.max() + 1)[labels]
        between = hot.T @ w @ hot
        np.fill_diagonal(between, -np.inf)
        i, j = divmod(int(between.argmax()), len(between))
        labels = np.unique(np.where(labels == max(i, j), min(i, j), labels), return_inverse=True)[1]
    return labels


KERNELS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "SPONGE": sponge, "SPONGEsym": sponge_sym, "BNC": balanced_normalised_cut, "SignedSpectral": signed_spectral, "RegSignedSpectral": regularised_spectral, "RegSPONGE": regularised_sponge,
    "PowerMean(1)": lambda a, k: power_mean_laplacian(a, k, 1.0), "PowerMean(0)": lambda a, k: power_mean_laplacian(a, k, 0.0), "PowerMean(-10)": power_mean_laplacian,
    "Hierarchical": hierarchical, "PCAkmeans": loading_kmeans, "Pivot": pivot,
}


# -- number of clusters ---------------------------------------------------------------------------


def signflip_k(a: np.ndarray, replicates: int = 50, max_k: int = 12, seed: int = SEED) -> int:
    """Eigenvalues beyond the largest that random signs of the same edges give, from 2 to ``max_k``."""
    p, n = layers(a)
    w, rng, top = p - n, np.random.default_rng(seed), 0.0
    upper = np.triu(np.abs(w), 1)
    for _ in range(replicates):
        signs = np.triu(rng.choice([-1.0, 1.0], w.shape), 1)
        null = upper * signs
        top = max(top, np.abs(np.linalg.eigvalsh(null + null.T)).max(initial=0.0))
    return int(np.clip((np.abs(np.linalg.eigvalsh(w)) > top).sum(), 2, max_k))


def eigengap_k(values: np.ndarray, low: int = 2, high: int = 10) -> int:
    """The place of the largest of the first ``high`` gaps, then brought into the bounds."""
    gaps = np.diff(np.sort(values))[:high]
    return int(np.clip(np.argmax(gaps) + 1, low, high)) if len(gaps) else low


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette; a cluster of one scores zero."""
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), []
    for i, own in enumerate(labels):
        mates = (labels == own) & (np.arange(len(x)) != i)
        if not mates.any():
            out.append(0.0)
            continue
        inner = d[i, mates].mean()
        outer = min(d[i, labels == c].mean() for c in np.unique(labels) if c != own)
        out.append((outer - inner) / max(inner, outer) if max(inner, outer) > 0 else 0.0)
    return float(np.mean(out))


def calinski_harabasz(x: np.ndarray, labels: np.ndarray) -> float:
    ks, mean = np.unique(labels), x.mean(0)
    between = sum((labels == c).sum() * ((x[labels == c].mean(0) - mean) ** 2).sum() for c in ks)
    within = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in ks)
    return float(between / within * (len(x) - len(ks)) / (len(ks) - 1)) if within > 0 else 1.0


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    ks = np.unique(labels)
    centres = np.array([x[labels == c].mean(0) for c in ks])
    spread = np.array([np.linalg.norm(x[labels == c] - m, axis=1).mean() for c, m in zip(ks, centres)])
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(gap > 0, (spread[:, None] + spread[None]) / gap, 0.0)
    return float(ratio.max(1).mean())


def scored_k(x: np.ndarray, score: Callable[[np.ndarray, np.ndarray], float] = silhouette, low: int = 2, high: int = 10) -> int:
    """The number of k-means clusters with the best score (least for Davies-Bouldin, else most); ties to fewer clusters."""
    sign = -1.0 if score is davies_bouldin else 1.0
    found = {}
    for k in range(low, min(high, len(x) - 1) + 1):
        labels = kmeans(x, k, restarts=3)
        if len(np.unique(labels)) > 1:
            found[k] = sign * score(x, labels)
    return max(found, key=lambda k: (found[k], -k)) if found else low


def gap_k(x: np.ndarray, low: int = 2, high: int = 10, references: int = 10, seed: int = SEED) -> int:
    """The number with the largest gap between the log inertia of uniform references and that of the data."""
    rng = np.random.default_rng(seed)

    def spread(points: np.ndarray, k: int) -> float:
        labels = kmeans(points, k, restarts=3)
        return np.log(sum(((points[labels == c] - points[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels)) + 1e-12)

    gaps = [np.mean([spread(rng.uniform(x.min(0), x.max(0), x.shape), k) for _ in range(references)]) - spread(x, k) for k in range(low, high + 1)]
    return low + int(np.argmax(gaps))


def consensus_k(votes: dict[str, int], weights: dict[str, float] | None = None) -> int:
    total: dict[int, float] = {}
    for name, k in votes.items():
        total[k] = total.get(k, 0.0) + (weights or {}).get(name, 1.0)
    return min(total, key=lambda k: (-total[k], k))


# -- on Spark -------------------------------------------------------------------------------------


def adjacency(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    a[pdf["src"].map(at), pdf["dst"].map(at)] = pdf["weight"]
    return ids, a


def cluster_folds(edges: DataFrame, kernel: str | Callable, k: int | None, fold: str = "fold") -> DataFrame:
    """``fold, node, label, k`` for each fold of ``fold, src, dst, weight``; without ``k`` by the sign-flip test."""
    run = KERNELS[kernel] if isinstance(kernel, str) else kernel
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, a = adjacency(pdf)
        n = min(k or signflip_k(a), len(ids))
        return pd.DataFrame({fold: pdf[fold].iloc[0], "node": ids, "label": run(a, n), "k": n})

    return edges.groupBy(fold).applyInPandas(one, f"{fold} {kinds[fold]}, node {kinds['src']}, label int, k int")
