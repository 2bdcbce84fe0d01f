import numpy as np

from simloom.operators import search as S

SPACE = [
    S.Parameter("swaps", low=0, high=2, integer=True),
    S.Parameter("chance", when=lambda p: p["swaps"] > 0, otherwise=0.0),
    S.Parameter("skew", values=["low", "high"]),
    S.Parameter("x"),
    S.Parameter("y"),
]
GOALS = {"a": "most", "b": "least"}
PENALTY = {"a": 0.0, "b": 9.0}


def run(p):
    return {"a": 1 - (p["x"] - 0.7) ** 2}


def more(p, told):
    return {"b": (p["x"] - 0.2) ** 2 + p["y"] + 0.3 * p["swaps"] + (p["skew"] == "high")}


def test_conditions_anchors_and_gate():
    anchors = [{"swaps": 0, "skew": "high", "x": 0.7, "y": 0.25}, {"swaps": 2, "chance": 0.5}]
    rows = S.search(SPACE, run, GOALS, PENALTY, 40, anchors, gate=lambda t: t["a"] > 0.9, more=more)
    first = rows[0]
    assert (first["param_swaps"], first["param_skew"], first["param_chance"]) == (0, "high", 0.0)
    assert abs(first["param_x"] - 0.7) < 1e-9 and abs(first["param_y"] - 0.25) < 1e-9
    assert rows[1]["param_swaps"] == 2 and abs(rows[1]["param_chance"] - 0.5) < 1e-9
    assert all((r["param_chance"] == 0.0) == (r["param_swaps"] == 0) for r in rows)
    assert {r["gated"] for r in rows} == {True, False} and all((r["b"] == 9.0) == r["gated"] for r in rows)
    assert [r["trial_number"] for r in rows] == list(range(40))


def test_same_seed_same_trials_and_resumed_ones():
    one = S.search(SPACE, run, GOALS, PENALTY, 50, more=more, seed=3)
    assert S.search(SPACE, run, GOALS, PENALTY, 50, more=more, seed=3) == one
    calls = []
    again = S.search(SPACE, lambda p: calls.append(p) or run(p), GOALS, PENALTY, 50, more=more, done=one[:30], seed=3)
    assert again == one and len(calls) == 20


def test_failures_do_not_end_the_search():
    def fails(p):
        if p["x"] > 0.5:
            raise ValueError("no")
        return run(p)

    rows = S.search(SPACE, fails, GOALS, PENALTY, 30, more=more)
    assert all(bool(r["error"]) == (r["param_x"] > 0.5) for r in rows)
    assert all(r["a"] == 0.0 for r in rows if r["error"])


def test_generations_beat_chance():
    def volume(rows):
        best = sorted((1 - r["a"], r["b"]) for r in S.frontier(rows, GOALS))
        total, low = 0.0, 2.0
        for a, b in best:
            total += max(0.0, low - b) * max(0.0, 1 - a)
            low = min(low, b)
        return total

    found = [volume(S.search(SPACE, run, GOALS, PENALTY, 120, more=more, seed=s)) for s in range(3)]
    chance = [volume(S.search(SPACE, run, GOALS, PENALTY, 120, more=more, population=1000, seed=s)) for s in range(3)]
    assert np.mean(found) > np.mean(chance)


def test_fronts_against_all_pairs():
    x = np.random.default_rng(2).integers(0, 6, (60, 3)).astype(float)
    beats = lambda p, q: (x[p] <= x[q]).all() and (x[p] < x[q]).any()
    want, left = [], set(range(60))
    while left:
        first = {q for q in left if not any(beats(p, q) for p in left)}
        want.append(sorted(first))
        left -= first
    assert [f.tolist() for f in S.fronts(x)] == want
    assert S.crowding(np.array([[0.0], [1.0], [3.0]])).tolist() == [np.inf, 1.0, np.inf]
