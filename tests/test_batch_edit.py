"""Batch edit kernels against plain tables for one pair."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from simloom.functions import batch_edit as B
from simloom.functions import distance as D


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def restricted_damerau(a: str, b: str) -> int:
    """Optimal string alignment: no substring is edited twice."""
    if a == b:
        return 0
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(rows[-1][j + 1] + 1, row[j] + 1, rows[-1][j] + (x != y))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                best = min(best, rows[-2][j - 1] + 1)
            row.append(best)
        rows = [rows[-1], row]
    return rows[-1][-1]


def full_damerau(a: str, b: str) -> int:
    """Damerau's distance with any number of edits between transposed characters."""
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        last_col = 0
        for j in range(1, len(b) + 1):
            k, m = last_row.get(b[j - 1], 0), last_col
            same = a[i - 1] == b[j - 1]
            if same:
                last_col = j
            swap = d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1)
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, swap)
        last_row[a[i - 1]] = i
    return d[len(a), len(b)]


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if not total else 2 * common_subsequence(a, b) / total


def token_set_indel(a: str, b: str) -> float:
    """0 to 100: the best insert-delete ratio between the shared tokens and each side; 100 if one side's are all shared."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, left, right = sorted(one & two), sorted(one - two), sorted(two - one)
    if both and (not left or not right):
        return 100.0
    shared, l_text, r_text = " ".join(both), " ".join(left), " ".join(right)
    gap = 1 if both else 0
    l_full, r_full = len(shared) + gap + len(l_text), len(shared) + gap + len(r_text)
    # both full texts begin with the shared tokens: only the rests differ
    apart = len(l_text) + len(r_text) - 2 * common_subsequence(l_text, r_text)
    best = 1 - apart / (l_full + r_full)
    if both:
        best = max(best, 1 - (gap + len(l_text)) / (len(shared) + l_full), 1 - (gap + len(r_text)) / (len(shared) + r_full))
    return 100 * best


def _decay(i: int, n: int) -> float:
    return 1.0 if n <= 1 else 1.0 - 0.5 * i / (n - 1)


_ALIKE = {p for x in D.CONFUSED for p in (x, x[::-1])}


def position_confusion(a: str, b: str) -> float:
    """Edits cost less towards the end, look-alike substitutions a quarter; over the longer length."""
    a, b = a.lower(), b.lower()
    n = max(len(a), len(b))
    if not n:
        return 1.0
    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + _decay(j, n))
    for i, x in enumerate(a, 1):
        new = [row[0] + _decay(i - 1, n)]
        for j, y in enumerate(b, 1):
            w = _decay(round((i + j) / 2) - 1, n)
            swap = 0.0 if x == y else w * D.CONFUSED_COST if x + y in _ALIKE else w
            new.append(min(row[j] + w, new[-1] + w, row[j - 1] + swap))
        row = new
    return min(1.0, max(0.0, 1 - row[-1] / n))


def position_visual(a: str, b: str, alike: dict[tuple[str, str], float], strength: float = 1.0, least: float = 0.1) -> float:
    """Edits weigh 1 to 1 + strength, more to the front; substitutions cost what a table of look-alikes leaves."""
    a, b = a.casefold(), b.casefold()
    s = max(0.0, strength)
    weights = lambda t: [1 + s if len(t) <= 1 else 1 + s * (1 - k / (len(t) - 1)) for k in range(len(t))]
    wa, wb = weights(a), weights(b)
    whole = max(sum(wa), sum(wb), 1.0)
    if a == b:
        return 1.0
    row = [0.0]
    for w in wb:
        row.append(row[-1] + w)
    for x, w in zip(a, wa, strict=True):
        new = [row[0] + w]
        for j, (y, v) in enumerate(zip(b, wb, strict=True), 1):
            like = alike.get((x, y))
            cost = 0.0 if x == y else 1.0 if like is None else max(least, 1 - like)
            new.append(min(row[j] + w, new[-1] + v, row[j - 1] + (w + v) / 2 * cost))
        row = new
    return max(0.0, 1 - row[-1] / whole)


def some_pairs(seed, n, longest=14, letters="abcdo0l1 éı漢\U0001d5c5"):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = [rng.choice(letters) for _ in range(rng.randrange(longest))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(3)] = b[i : i + 2][::-1] if rng.random() < 0.5 else [rng.choice(letters)] * rng.randrange(3)
        out.append(("".join(a), "".join(b) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randrange(longest)))))
    return [("", ""), ("", "ab"), ("ab", ""), *out]


LIKE = {("o", "0"): 0.95, ("0", "o"): 0.9, ("l", "1"): 0.4, ("ab", "c"): 1.0}
KERNELS = [(B.levenshtein, levenshtein), (B.restricted_damerau, restricted_damerau), (B.full_damerau, full_damerau), (B.common_subsequence, common_subsequence), (D.token_set_indels, token_set_indel), (D.position_confusions, position_confusion), (lambda p: D.position_visuals(p, LIKE, 0.7), lambda a, b: position_visual(a, b, LIKE, 0.7))]


@pytest.mark.parametrize("k", range(len(KERNELS)))
def test_kernels_equal_plain_tables(monkeypatch, k):
    batch, plain = KERNELS[k]
    for pairs in (some_pairs(k, 1500), some_pairs(k, 30, 150), [(a + "x" * 64, "y" * 64 + b) for a, b in some_pairs(k, 20)], [("x" * 64, "x" * 63 + "y"), ("x" * 65, "y" * 64)], []):
        assert batch(pairs).tolist() == pytest.approx([plain(a, b) for a, b in pairs], abs=1e-12)
    monkeypatch.setattr(B, "CELLS", 200)
    assert batch(some_pairs(9, 50)).tolist() == pytest.approx([plain(a, b) for a, b in some_pairs(9, 50)], abs=1e-12)


def test_kernels_are_fast():
    """Five times at least on 100,000 pairs, with plain code timed on some of them; splitting into tokens is plain code in both."""
    for batch, plain in KERNELS[1:]:
        pairs = some_pairs(3, 100_000, 24) if plain is not token_set_indel else [(f"{a} {b} x {a}", f"y {b} {a[:5]} z") for a, b in some_pairs(3, 100_000, 24)]
        began = time.perf_counter()
        batch(pairs)
        took = time.perf_counter() - began
        began = time.perf_counter()
        for a, b in pairs[:4000]:
            plain(a, b)
        assert took < (time.perf_counter() - began) * 25 / (1.2 if plain is token_set_indel else 5), batch


def test_nulls_and_repeats_in_a_batch():
    got = D._pairs(B.levenshtein)(pd.Series(["ab", None, "ab", "x"]), pd.Series(["b", "c", "b", None])).tolist()
    assert got == [1, None, 1, None]
    table = B.PairTable(LIKE, -1.0)
    value = lambda x, y: table.table[table.places(np.array([ord(x)])), table.places(np.array([ord(y)]))][0]
    assert (value("o", "0"), value("0", "o"), value("o", "l"), value("a", "c")) == (0.95, 0.9, -1.0, -1.0)
