"""Edit distances of many pairs at once in numpy, for Arrow batches: bit-parallel where a text fits in a word, else tables for all pairs together.

Pairs are rows of padded code-point matrices, sorted so that those which are still running stand first: a step works
on a slice of all pairs. A text of up to 64 characters is one 64-bit word, a bit for each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Longest text that is a word of bits, and cells of the tables that are made together.
WORD_BITS, CELLS = 64, 2**22
_ONE = np.uint64(1)

Pairs = Sequence[tuple[str, str]]


def _matrix(texts: np.ndarray, width: int) -> np.ndarray:
    """Code points, padded with 0 and of the least type that holds them."""
    codes = texts.astype(f"<U{max(1, width)}").view("<u4").reshape(len(texts), max(1, width))
    top = codes.max(initial=0)
    return codes.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def _columns(pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First texts, second texts, and their lengths."""
    both = np.empty((len(pairs), 2), object)
    if len(pairs):
        both[:] = pairs
    sizes = np.fromiter(map(len, both.ravel()), np.int64, both.size).reshape(-1, 2)
    return both[:, 0], both[:, 1], sizes[:, 0], sizes[:, 1]


def _chunks(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places, and matrix of a, its lengths, that of b, its lengths: longest b first, in chunks of CELLS cells (a pair alone may have more)."""
    kind = np.frexp(la.astype(float))[1]  # a's of like lengths
    order = np.lexsort((-lb, kind))
    ends = np.append(np.flatnonzero(np.diff(kind[order])) + 1, len(order))
    at = 0
    while at < len(order):
        end = ends[np.searchsorted(ends, at, side="right")]
        n = max(1, CELLS // ((2 ** int(kind[order[at]]) + 1) * (int(lb[order[at]]) + 1)))
        some = order[at : min(at + n, end)]
        yield some, _matrix(a[some], int(la[some].max())), la[some], _matrix(b[some], int(lb[some[0]])), lb[some]
        at += len(some)


def _running(lengths: np.ndarray, j: int) -> int:
    """How many pairs, sorted by length from the longest, have a place j."""
    return int(np.searchsorted(-lengths, -j, side="right"))


def _masks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair and place of b a word with the places of a that are equal."""
    packed = np.packbits(a[:, :, None] == b[:, None, :], axis=1, bitorder="little")
    out = np.zeros((len(a), b.shape[1]), np.uint64)
    for k in range(packed.shape[1]):
        out |= packed[:, k, :].astype(np.uint64) << np.uint64(8 * k)
    return out


def _by_words(pairs: Pairs, words: Callable, tables: Callable) -> np.ndarray:
    """words where the shorter text fits in a word, tables for the others; both are symmetric."""
    out = np.zeros(len(pairs), np.int64)
    a, b, la, lb = _columns(pairs)
    swap = la > lb
    a, b, la, lb = np.where(swap, b, a), np.where(swap, a, b), np.minimum(la, lb), np.maximum(la, lb)
    for run, held in ((words, la <= WORD_BITS), (tables, la > WORD_BITS)):
        at = np.flatnonzero(held)
        for some, *texts in _chunks(a[at], b[at], la[at], lb[at]):
            out[at[some]] = run(*texts)
    return out


def _words_distance(transposed: bool) -> Callable:
    def run(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        equal = _masks(a, b)
        n = len(a)
        up, down, zero, before = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        top = np.maximum(la - 1, 0).astype(np.uint64)
        out = np.where(la > 0, la, lb).astype(np.int64)
        for j in range(b.shape[1]):
            k = _running(lb, j + 1)
            if not k:
                break
            m, p, q = equal[:k, j], up[:k], down[:k]
            d = (((m & p) + p) ^ p) | m | q
            if transposed:
                d |= ((~zero[:k] & m) << _ONE) & before[:k]
            rise, fall = q | ~(d | p), d & p
            step = ((rise >> top[:k]) & _ONE).astype(np.int64) - ((fall >> top[:k]) & _ONE).astype(np.int64)
            out[:k] += np.where(la[:k] > 0, step, 0)
            rise, fall = (rise << _ONE) | _ONE, fall << _ONE
            up[:k], down[:k] = fall | ~(d | rise), rise & d
            zero[:k], before[:k] = d, m
        return out

    return run


def _words_common(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    equal = _masks(a, b)
    free = np.full(len(a), ~np.uint64(0))
    for j in range(b.shape[1]):
        k = _running(lb, j + 1)
        if not k:
            break
        s = free[:k]
        u = s & equal[:k, j]
        free[:k] = (s + u) | (s - u)
    held = np.where(la >= 64, ~np.uint64(0), (_ONE << np.minimum(la, 63).astype(np.uint64)) - _ONE)
    return np.bitwise_count(~free & held).astype(np.int64)


def _tables_distance(transposed: bool) -> Callable:
    def run(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        n, rows = len(a), np.arange(len(a))
        two = one = None
        row = np.tile(np.arange(b.shape[1] + 1, dtype=np.int32), (n, 1))
        out = np.where(la == 0, lb, 0).astype(np.int64)
        for i in range(a.shape[1]):
            two, one, row = one, row, np.empty_like(row)
            row[:, 0] = i + 1
            for j in range(b.shape[1]):
                best = np.minimum(np.minimum(one[:, j + 1], row[:, j]) + 1, one[:, j] + (a[:, i] != b[:, j]))
                if transposed and i and j:
                    best = np.where((a[:, i] == b[:, j - 1]) & (a[:, i - 1] == b[:, j]), np.minimum(best, two[:, j - 1] + 1), best)
                row[:, j + 1] = best
            done = la == i + 1
            out[done] = row[rows[done], lb[done]]
        return out

    return run


def _tables_common(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, rows = len(a), np.arange(len(a))
    row = np.zeros((n, b.shape[1] + 1), np.int32)
    out = np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        old, row = row, np.zeros_like(row)
        for j in range(b.shape[1]):
            row[:, j + 1] = np.where(a[:, i] == b[:, j], old[:, j] + 1, np.maximum(old[:, j + 1], row[:, j]))
        done = la == i + 1
        out[done] = row[rows[done], lb[done]]
    return out


def levenshtein(pairs: Pairs) -> np.ndarray:
    return _by_words(pairs, _words_distance(False), _tables_distance(False))


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, padded, and lengths: what levenshtein_rows takes."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return _matrix(np.array(texts, object), int(lengths.max(initial=0))), lengths


def levenshtein_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of one encoded table to rows j of another."""
    out = np.zeros(len(i), np.int64)
    order = np.argsort(-lb[j], kind="stable")
    n = max(1, CELLS // ((a.shape[1] + 1) * (b.shape[1] + 1)))
    for at in range(0, len(order), n):
        some = order[at : at + n]
        x, y = i[some], j[some]
        short = la[x] <= WORD_BITS
        for run, held in ((_words_distance(False), short), (_tables_distance(False), ~short)):
            if held.any():
                x, y = i[some[held]], j[some[held]]
                out[some[held]] = run(a[x, : max(1, int(la[x].max()))], la[x], b[y, : max(1, int(lb[y].max()))], lb[y])
    return out


def restricted_damerau(pairs: Pairs) -> np.ndarray:
    """Optimal string alignment: no substring is edited twice."""
    return _by_words(pairs, _words_distance(True), _tables_distance(True))


def common_subsequence(pairs: Pairs) -> np.ndarray:
    return _by_words(pairs, _words_common, _tables_common)


def full_damerau(pairs: Pairs) -> np.ndarray:
    """Damerau's distance with any number of edits between transposed characters."""
    out = np.zeros(len(pairs), np.int64)
    for some, a, la, b, lb in _chunks(*_columns(pairs)):
        n, rows, x, y = len(a), np.arange(len(a)), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        d = np.zeros((len(x) + 2, len(y) + 2, n), np.int32)  # one more row and column in front
        d[0], d[:, 0] = la + lb, la + lb
        d[1:, 1] = np.arange(len(x) + 1)[:, None]
        d[1, 1:] = np.arange(len(y) + 1)[:, None]
        flat, width = d.reshape(-1), len(y) + 2
        last_row = np.zeros((len(y), n), np.int32)  # of the character at b's place
        for i in range(1, len(x) + 1):
            last_col = np.zeros(n, np.int32)
            for j in range(1, len(y) + 1):
                same = x[i - 1] == y[j - 1]
                k = last_row[j - 1]
                swap = flat[(k * width + last_col).astype(np.int64) * n + rows] + (i - k) + (j - last_col) - 1
                best = np.minimum(np.minimum(d[i, j + 1], d[i + 1, j]) + 1, d[i, j] + ~same)
                np.minimum(best, swap, out=d[i + 1, j + 1])
                last_col[same] = j
            last_row[x[i - 1] == y] = i
        out[some] = d[la + 1, lb + 1, rows]
    return out


class PairTable:
    """What pairs of single characters are worth, by code points; `missing` for all others."""

    def __init__(self, values: dict[tuple[str, str], float], missing: float):
        kept = {k: v for k, v in values.items() if len(k[0]) == len(k[1]) == 1}
        letters = sorted({ord(c) for pair in kept for c in pair})
        self.letters = np.array(letters or [0], np.uint32)
        place = {c: k for k, c in enumerate(letters)}
        self.table = np.full((len(self.letters) + 1, len(self.letters) + 1), missing)
        for (x, y), v in kept.items():
            self.table[place[ord(x)], place[ord(y)]] = v

    def places(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, len(self.letters))


def weighted(pairs: Pairs, table: PairTable, costs: Callable) -> np.ndarray:
    """The cheapest way from a to b by costs of each place.

    costs(la, lb, longest a, longest b) gives deletion(i, j), insertion(i, j) and replacement(i, j, same, worth), which give a
    cost for each pair; i and j count from 1 (0 where the other text hasn't begun), worth is what the table has for the characters.
    """
    out = np.zeros(len(pairs))
    for some, a, la, b, lb in _chunks(*_columns(pairs)):
        rows, x, y = np.arange(len(a)), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        px, py = table.places(x) * table.table.shape[1], table.places(y)
        worth = table.table.reshape(-1)
        deletion, insertion, replacement = costs(la, lb, len(x), len(y))
        row = np.zeros((len(y) + 1, len(a)))
        for j in range(1, len(y) + 1):
            row[j] = row[j - 1] + insertion(0, j)
        got = row[lb, rows]
        for i in range(1, len(x) + 1):
            old, row = row, np.empty_like(row)
            row[0] = old[0] + deletion(i, 0)
            for j in range(1, len(y) + 1):
                swap = old[j - 1] + replacement(i, j, x[i - 1] == y[j - 1], worth[px[i - 1] + py[j - 1]])
                np.minimum(np.minimum(old[j] + deletion(i, j), row[j - 1] + insertion(i, j)), swap, out=row[j])
            done = la == i
            got[done] = row[lb[done], rows[done]]
        out[some] = got
    return out
