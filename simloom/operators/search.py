"""Search over parameters with several goals: anchors, then generations by non-dominated sorting and crowding.

A trial is a Spark job or several; the search itself handles one row a trial and runs on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Parameter:
    """A value from a list, or a number from low to high; `when` says for which earlier parameters it is drawn at all."""

    name: str
    values: Sequence = ()
    low: float = 0.0
    high: float = 1.0
    integer: bool = False
    when: Callable[[dict], bool] = field(default=lambda earlier: True)
    otherwise: object = None

    def at(self, u: float) -> object:
        """The value at u in [0, 1)."""
        if self.values:
            return self.values[min(int(u * len(self.values)), len(self.values) - 1)]
        if self.integer:
            return int(self.low) + min(int(u * (self.high - self.low + 1)), int(self.high - self.low))
        return float(self.low + u * (self.high - self.low))

    def place(self, value: object) -> float:
        """A u that gives the value."""
        if self.values:
            return (list(self.values).index(value) + 0.5) / len(self.values)
        if self.integer:
            return (value - self.low + 0.5) / (self.high - self.low + 1)
        return min(float((value - self.low) / ((self.high - self.low) or 1.0)), 1 - 1e-12)


def parameters(space: Sequence[Parameter], genes: np.ndarray) -> dict:
    """Parameters of a point of the unit cube; one that isn't drawn has its `otherwise`."""
    out: dict = {}
    for p, u in zip(space, genes.tolist(), strict=True):
        out[p.name] = p.at(u) if p.when(out) else p.otherwise
    return out


def fronts(values: np.ndarray) -> list[np.ndarray]:
    """Rows (all goals least) by how often what beats them has to be taken away: the frontier first."""
    beats = (values[:, None] <= values[None]).all(axis=2) & (values[:, None] < values[None]).any(axis=2)
    left, out = np.arange(len(values)), []
    while len(left):
        first = left[~beats[np.ix_(left, left)].any(axis=0)]
        out.append(first)
        left = np.setdiff1d(left, first)
    return out


def crowding(values: np.ndarray) -> np.ndarray:
    """How far each row's neighbors are apart, over all goals; rows at an end count as far from everything."""
    far = np.zeros(len(values))
    for column in values.T:
        order = np.argsort(column, kind="stable")
        span = (column[order[-1]] - column[order[0]]) or 1.0
        far[order[[0, -1]]] = np.inf
        far[order[1:-1]] += (column[order[2:]] - column[order[:-2]]) / span
    return far


def _best(values: np.ndarray, n: int) -> np.ndarray:
    """n rows: whole fronts while they fit, then the least crowded of the next."""
    chosen: list[int] = []
    for front in fronts(values):
        room = n - len(chosen)
        order = front if len(front) <= room else front[np.argsort(-crowding(values[front]), kind="stable")[:room]]
        chosen += order.tolist()
        if len(chosen) >= n:
            break
    return np.array(chosen, int)


def search(space: Sequence[Parameter], run: Callable[[dict], dict], goals: dict[str, str], penalty: dict, trials: int, anchors: Sequence[dict] = (), gate: Callable[[dict], bool] | None = None, more: Callable[[dict, dict], dict] | None = None, done: Sequence[dict] = (), population: int = 16, seed: int = 0) -> list[dict]:
    """Rows of `trials` trials: trial_number, param_..., what the trial told, gated and error.

    run(params) gives the cheap results; more(params, results), the costly ones, is asked only if gate
    (or nothing) lets the results pass. goals: name to "most" or "least". A trial that fails, or that
    the gate stops, has the penalty for what it doesn't tell; the search goes on. Anchors (names and values) come
    first. done: rows of an earlier search, which stand for their trials. The same seed gives the same trials.
    """
    rows, genes = [], []
    sign = np.array([-1.0 if way == "most" else 1.0 for way in goals.values()])

    def draw(n: int, k: int) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{n}|{k}".encode()).digest()[:8], "little"))

    def child(n: int) -> np.ndarray:
        rng = draw(n, 0)
        if len(rows) < population:
            return rng.random(len(space))
        values = np.array([[float(r[g]) for g in goals] for r in rows]) * sign
        parents = _best(values, population)  # in order of rank, so that the lesser index wins a tournament
        one, two = (genes[parents[min(rng.integers(0, len(parents), 2))]] for _ in range(2))
        mixed = np.where(rng.random(len(space)) < 0.5, one, two)
        moved = rng.random(len(space)) < max(0.15, 1 / len(space))
        near = np.clip(mixed + rng.normal(0, 0.15, len(space)), 0, 1 - 1e-12)
        return np.where(moved, np.where(rng.random(len(space)) < 0.25, rng.random(len(space)), near), mixed)

    for n in range(trials):
        if n < len(anchors):
            own = draw(n, 1).random(len(space))
            own = np.array([p.place(anchors[n][p.name]) if anchors[n].get(p.name) is not None else u for p, u in zip(space, own, strict=True)])
        else:
            own = child(n)
        params = parameters(space, own)
        if n < len(done):
            rows.append(dict(done[n]))
        else:
            told = {"gated": False, "error": ""}
            try:
                told |= run(params)
                if gate is not None and not gate(told):
                    told["gated"] = True
                elif more is not None:
                    told |= more(params, told)
            except Exception as e:  # a trial may fail in any way; the search goes on
                told = {"gated": False, "error": f"{type(e).__name__}: {e}"}
            rows.append({"trial_number": n} | {f"param_{k}": v for k, v in params.items()} | penalty | told)
        genes.append(own)
    return rows


def frontier(rows: Sequence[dict], goals: dict[str, str]) -> list[dict]:
    """The trials that no other beats in all goals."""
    if not rows:
        return []
    sign = np.array([-1.0 if way == "most" else 1.0 for way in goals.values()])
    return [rows[k] for k in fronts(np.array([[float(r[g]) for g in goals] for r in rows]) * sign)[0]]
