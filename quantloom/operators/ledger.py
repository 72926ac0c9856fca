"""The cash-and-holdings ledger and other rules that depend on yesterday's state: one sequential pass per book."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEDGER = "date date, equity double, gross double, cost double, funding double, net double, turnover double, exposure double, stale double, covered double, status string"


def replay(targets: np.ndarray, returns: np.ndarray, funding: np.ndarray | None = None, *, cost_bps: float = 50.0, band: float = 0.0, every: int = 1, max_turnover: float | None = 0.15, missing: str = "mark") -> Iterator[tuple]:
    """Daily ``equity, gross, cost, funding, net, turnover, exposure, stale, covered, status`` of a book that starts as one unit of cash.

    Each ``every`` rows the book trades towards its targets: weights within ``band`` stay, all changes scale down to
    ``max_turnover``; fees leave the cash; holdings move by returns; funding is paid on weights held. A missing return
    on a holding counts as zero and its weight is reported as ``stale`` (``missing='raise'`` forbids it). ``exposure``
    is the gross weight held over the day, ``covered`` that of holdings whose funding is known; all weights are shares
    of the equity before the day. Where equity is not above zero the path ends with that row as ``insolvent``.

    Targets must be finite, returns finite or missing and -1 or more, funding finite or missing, costs finite and not
    negative; anything else is refused before the first trade.
    """
    if not (np.isfinite(cost_bps) and cost_bps >= 0):
        raise ValueError("the cost must be finite and not negative")
    if every < 1 or band < 0 or (max_turnover is not None and not max_turnover > 0) or missing not in ("mark", "raise"):
        raise ValueError("bad trading rule")
    if not np.isfinite(targets).all():
        raise ValueError("targets must be finite")
    if np.isinf(returns).any() or (returns < -1).any():
        raise ValueError("returns must be finite or missing, and -1 or more")
    if funding is not None and np.isinf(funding).any():
        raise ValueError("funding must be finite or missing")
    days, n = targets.shape
    cash, held = 1.0, np.zeros(n)
    for t in range(days):
        before = cash + held.sum()
        turnover = cost = 0.0
        if t % every == 0:
            change = targets[t] * before - held
            change[np.abs(change) < band * before] = 0.0
            moved = np.abs(change).sum() / before
            if max_turnover is not None and moved > max_turnover:
                change *= max_turnover / moved
            turnover = float(np.abs(change).sum() / before)
            cost = turnover * before * cost_bps / 1e4
            held = held + change
            cash -= change.sum() + cost
        weights = np.abs(held) / before
        lost = np.isnan(returns[t]) & (weights > 1e-12)
        if lost.any() and missing == "raise":
            raise ValueError(f"row {t}: a holding has no return")
        base = before - cost
        paid = -float((held * np.nan_to_num(funding[t])).sum()) if funding is not None else 0.0
        gain = float((held * np.nan_to_num(returns[t])).sum())
        held = held * (1 + np.nan_to_num(returns[t]))
        cash += paid
        equity = cash + held.sum()
        status = "ok" if equity > 0 else "insolvent"
        yield equity, gain / before, cost / before, paid / before, equity / before - 1, turnover, float(weights.sum()), float(weights[lost].sum()), float(weights[np.isfinite(funding[t])].sum()) if funding is not None else 0.0, status
        if status != "ok" or not base:
            return


def ledger(rows: DataFrame, book: str = "book", **rules) -> DataFrame:
    """A row per book and date of ``book, date, id, target, r, funding``: each book is one sequential grouped map.

    A column ``cost_bps`` (one value to a book) overrides the rule, so books that differ in cost run beside each
    other. An id without a row on a date of its book has target zero; null targets and repeated rows are refused.
    """
    kind = rows.schema[book].dataType.simpleString()
    names = [c.split()[0] for c in LEDGER.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = lambda c: pdf.pivot(index="date", columns="id", values=c).sort_index().sort_index(axis=1)
        if pdf["target"].isna().any():
            raise ValueError("targets must be finite")
        targets = wide("target").fillna(0.0)
        own = {**rules, "cost_bps": float(pdf["cost_bps"].iloc[0])} if "cost_bps" in pdf else rules
        funding = wide("funding").to_numpy(float) if "funding" in pdf else None
        path = list(replay(targets.to_numpy(float), wide("r").to_numpy(float), funding, **own))
        out = pd.DataFrame(path, columns=names[1:])
        out.insert(0, "date", targets.index[: len(path)])
        out.insert(0, book, pdf[book].iloc[0])
        return out

    return rows.groupBy(book).applyInPandas(run, f"{book} {kind}, {LEDGER}")


def turnover_limited(targets: np.ndarray, limit: float, start: np.ndarray | None = None) -> np.ndarray:
    """Holdings that move towards each row of targets by at most ``limit`` in total; a first row without start is free."""
    out, last = np.zeros_like(targets), start
    for t, goal in enumerate(np.nan_to_num(targets)):
        if last is None:
            last = goal
        else:
            move = goal - last
            size = np.abs(move).sum()
            last = last + move * min(1.0, limit / size if size > 0 else 1.0)
        out[t] = last
    return out


def executed(targets: np.ndarray, band: float, every: int, cap: float | None, state: dict | None = None) -> np.ndarray:
    """Weights after a trading clock, a no-trade band and a turnover cap; ``state`` carries both over folds."""
    state = {} if state is None else state
    last, clock, out = state.get("last", np.zeros(targets.shape[1])), state.get("clock", 0), np.zeros_like(targets)
    for t, goal in enumerate(np.nan_to_num(targets)):
        if clock % every == 0:
            move = np.where(np.abs(goal - last) > band, goal - last, 0.0)
            size = np.abs(move).sum()
            last = last + move * (min(1.0, cap / size) if cap is not None and size > 0 else 1.0)
        clock += 1
        out[t] = last
    state.update(last=last, clock=clock)
    return out


def limited_weights(weights: DataFrame, limit: float, book: str = "book") -> DataFrame:
    """``book, date, id, w`` under the turnover limit."""
    kinds = {f.name: f.dataType.simpleString() for f in weights.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="id", values="w").sort_index().fillna(0.0)
        out = pd.DataFrame(turnover_limited(wide.to_numpy(float), limit), index=wide.index, columns=wide.columns).rename_axis(columns="id").stack().rename("w").reset_index()
        return out.assign(**{book: pdf[book].iloc[0]})[[book, "date", "id", "w"]]

    return weights.groupBy(book).applyInPandas(run, f"{book} {kinds[book]}, date {kinds['date']}, id {kinds['id']}, w double")
