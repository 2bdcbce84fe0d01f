"""Distances and similarities of two strings or vectors.

Variants with the same name elsewhere differ in case, denominators or transpositions, so each has a
name of its own. What SQL functions can say is a Column; the others are Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions import batch_edit
from simloom.functions.text import collapse_spaces, tokens

# Character pairs that look alike, in both orders, for position_confusion.
CONFUSED = ["0o", "0O", "oO", "1l", "1I", "lI", "rn", "nm", "vw", "vu", "cl", "cd"]
CONFUSED_COST = 0.25
# Characters that positionwise compares.
NAME_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-"


def normalized(distance: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / F.greatest(F.length(a), F.length(b), F.lit(1)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """Case counts."""
    return normalized(F.levenshtein(a, b), a, b)


def levenshtein_similarity_folded(a: Column, b: Column) -> Column:
    """The distance is of lower case, the denominator of the texts as they are."""
    return normalized(F.levenshtein(F.lower(a), F.lower(b)), a, b)


def _pairs(f: Callable[[list[tuple[str, str]]], np.ndarray]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """f over the distinct pairs of a batch, which don't hold nulls."""

    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        place: dict[tuple[str, str], int] = {}
        at = [None if x is None or y is None else place.setdefault((x, y), len(place)) for x, y in zip(a, b, strict=True)]
        got = f(list(place)).tolist()
        return pd.Series([None if k is None else got[k] for k in at], dtype="object")

    return scored


def token_set_indels(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 100: the best insert-delete ratio between the shared tokens and each side; 100 if one side's are all shared."""
    out, rests = np.zeros(len(pairs)), []
    for n, (a, b) in enumerate(pairs):
        one, two = set(a.split()), set(b.split())
        both = one & two
        if both and (len(both) == len(one) or len(both) == len(two)):
            out[n] = 100.0
        elif one and two:
            rests.append((n, len(" ".join(both)), " ".join(sorted(one - two)), " ".join(sorted(two - one))))
    common = batch_edit.common_subsequence([(left, right) for _, _, left, right in rests])
    for (n, shared, left, right), c in zip(rests, common.tolist(), strict=True):
        gap = 1 if shared else 0
        l_full, r_full = shared + gap + len(left), shared + gap + len(right)
        # both full texts begin with the shared tokens: only the rests differ
        best = 1 - (len(left) + len(right) - 2 * c) / (l_full + r_full)
        if shared:
            best = max(best, 1 - (gap + len(left)) / (shared + l_full), 1 - (gap + len(right)) / (shared + r_full))
        out[n] = 100 * best
    return out


_ALIKE = {(p[0], p[1]): 1.0 for x in CONFUSED for p in (x, x[::-1])}


def position_confusions(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edits cost less towards the end, look-alike substitutions a quarter; over the longer length."""

    def costs(la: np.ndarray, lb: np.ndarray, most_a: int, most_b: int) -> tuple[Callable, Callable, Callable]:
        n = np.maximum(la, lb)
        decay = [np.where(n <= 1, 1.0, 1.0 - 0.5 * place / np.maximum(n - 1, 1)) for place in range(max(most_a, most_b, 1))]
        like = [w * CONFUSED_COST for w in decay]
        place = lambda i, j: max(i, j) - 1 if not i or not j else round((i + j) / 2) - 1
        edit = lambda i, j: decay[place(i, j)]
        return edit, edit, lambda i, j, same, worth: np.where(same, 0.0, np.where(worth > 0, like[place(i, j)], decay[place(i, j)]))

    lower = [(a.lower(), b.lower()) for a, b in pairs]
    n = np.array([max(len(a), len(b), 1) for a, b in lower])
    return np.clip(1 - batch_edit.weighted(lower, batch_edit.PairTable(_ALIKE, 0.0), costs) / n, 0.0, 1.0)


def position_visuals(pairs: list[tuple[str, str]], alike: dict[tuple[str, str], float], strength: float = 1.0, least: float = 0.1) -> np.ndarray:
    """Edits weigh 1 to 1 + strength, more to the front; substitutions cost what a table of look-alikes leaves."""
    s = max(0.0, strength)
    table = batch_edit.PairTable({k: max(least, 1 - v) for k, v in alike.items()}, 1.0)

    def costs(la: np.ndarray, lb: np.ndarray, most_a: int, most_b: int) -> tuple[Callable, Callable, Callable]:
        weights = lambda n, most: [np.where(n <= 1, 1 + s, 1 + s * (1 - place / np.maximum(n - 1, 1))) for place in range(most)]
        wa, wb = weights(la, most_a), weights(lb, most_b)
        return lambda i, j: wa[i - 1], lambda i, j: wb[j - 1], lambda i, j, same, worth: np.where(same, 0.0, (wa[i - 1] + wb[j - 1]) / 2 * worth)

    folded = [(a.casefold(), b.casefold()) for a, b in pairs]
    total = lambda n: sum(1 + s if n <= 1 else 1 + s * (1 - k / (n - 1)) for k in range(n))
    totals = {n: total(n) for n in {len(t) for pair in folded for t in pair}}
    whole = np.array([max(totals[len(a)], totals[len(b)], 1.0) for a, b in folded])
    return np.where([a == b for a, b in folded], 1.0, np.maximum(0.0, 1 - batch_edit.weighted(folded, table, costs) / whole))


# The same for a single pair.


def restricted_damerau(a: str, b: str) -> int:
    return int(batch_edit.restricted_damerau([(a, b)])[0])


def full_damerau(a: str, b: str) -> int:
    return int(batch_edit.full_damerau([(a, b)])[0])


def token_set_indel(a: str, b: str) -> float:
    return float(token_set_indels([(a, b)])[0])


def position_confusion(a: str, b: str) -> float:
    return float(position_confusions([(a, b)])[0])


def position_visual(a: str, b: str, alike: dict[tuple[str, str], float], strength: float = 1.0, least: float = 0.1) -> float:
    return float(position_visuals([(a, b)], alike, strength, least)[0])


restricted_damerau_distance = F.pandas_udf(_pairs(batch_edit.restricted_damerau), T.LongType())
full_damerau_distance = F.pandas_udf(_pairs(batch_edit.full_damerau), T.LongType())
token_set_indel_ratio = F.pandas_udf(_pairs(token_set_indels), T.DoubleType())
position_confusion_similarity = F.pandas_udf(_pairs(position_confusions), T.DoubleType())


def position_visual_similarity(alike: dict[tuple[str, str], float], strength: float = 1.0, least: float = 0.1) -> Callable[..., Column]:
    return F.pandas_udf(_pairs(lambda pairs: position_visuals(pairs, alike, strength, least)), T.DoubleType())


def full_damerau_similarity(a: Column, b: Column) -> Column:
    return normalized(full_damerau_distance(a, b), a, b)


def token_set_similarity(a: Column, b: Column) -> Column:
    """The best of the edit similarities between shared tokens, and shared with each side's own; two empty sets are alike."""
    one, two = F.array_sort(F.array_distinct(tokens(F.lower(a)))), F.array_sort(F.array_distinct(tokens(F.lower(b))))
    both = F.array_sort(F.array_intersect(one, two))
    left, right = F.array_sort(F.array_except(one, two)), F.array_sort(F.array_except(two, one))
    join = lambda *parts: F.array_join(F.concat(*parts), " ")
    base, l_all, r_all = join(both), join(both, left), join(both, right)
    return F.when((F.size(one) == 0) & (F.size(two) == 0), 1.0).otherwise(F.greatest(levenshtein_similarity(base, l_all), levenshtein_similarity(base, r_all), levenshtein_similarity(l_all, r_all)))


def positionwise(a: Column, b: Column) -> Column:
    """Shares of places with equal and with comparable characters, .65 and .35, less for unequal lengths."""
    x, y = collapse_spaces(a), collapse_spaces(b)
    n = F.greatest(F.length(x), F.length(y))
    known = lambda c: F.contains(F.lit(NAME_CHARACTERS), c) & (c != "")
    chars = lambda t: F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))
    pairs = F.zip_with(chars(x), chars(y), lambda p, q: F.struct(F.coalesce(p, F.lit("")).alias("p"), F.coalesce(q, F.lit("")).alias("q")))
    same = F.size(F.filter(pairs, lambda t: (t["p"] == t["q"]) & (t["p"] != "")))
    over = F.size(F.filter(pairs, lambda t: (known(t["p"]) & known(t["q"])) | ((t["p"] == t["q"]) & (t["p"] != ""))))
    score = (0.65 * (same / n) + 0.35 * (over / n)) * (1 - 0.5 * (F.abs(F.length(x) - F.length(y)) / n))
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def length_delta(a: Column, b: Column) -> Column:
    return F.abs(F.length(collapse_spaces(a)) - F.length(collapse_spaces(b)))


def shared_characters(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; 0 for two empty texts."""
    chars = lambda t: F.array_remove(F.array_distinct(F.split(collapse_spaces(t), "")), "")
    return F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.size(F.array_union(chars(a), chars(b))), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """Each norm counts as floor at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def cosine_clipped(a: Column, b: Column) -> Column:
    """0 for a zero vector, and nothing outside 0 to 1."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / (norm(a) * norm(b)))))


def shape_similarity(a: Column, b: Column) -> Column:
    """Cosine times the ratio of the smaller to the larger sum."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return cosine(a, b) * F.try_divide(F.least(total(a), total(b)), F.greatest(total(a), total(b)))


def match_rate(outputs: Column, target: Column) -> Column:
    """The share of outputs that equal the target; 0 for none."""
    return F.size(F.filter(outputs, lambda v: v == target)) / F.greatest(F.size(outputs), F.lit(1))


def mean_score(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / len(scores)


#: Scorers by name: Column builders and UDFs alike take (real name, candidate).
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "levenshtein": levenshtein_similarity,
    "levenshtein_folded": levenshtein_similarity_folded,
    "damerau_restricted": lambda a, b: normalized(restricted_damerau_distance(F.lower(a), F.lower(b)), a, b),
    "damerau": full_damerau_similarity,
    "token_set": token_set_similarity,
    "token_set_indel": lambda a, b: token_set_indel_ratio(a, b) / 100,
    "position_confusion": position_confusion_similarity,
    "positionwise": positionwise,
    "shared_characters": shared_characters,
}


def score_columns(a: Column, b: Column, names: list[str] | None = None) -> list[Column]:
    """One column for each scorer; nulls count as empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return [SCORERS[n](a, b).alias(n) for n in names or SCORERS]
