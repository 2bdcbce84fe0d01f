"""Generators of variants: swaps, edits, seeded pipelines and grids."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions.distance import levenshtein_similarity
from simloom.functions.text import EDIT, apply_edits
from simloom.operators.assignment import assign_lists
from simloom.operators.sampling import SKEWS
from simloom.operators.similarity_join import contains_join
from simloom.storage import materialize, shuffled


def pair_samples(pairs: DataFrame) -> DataFrame:
    """Each pair as two labelled samples: the candidate with its label, the real name with 0."""
    both = F.array(F.struct(F.col("fraudulent_name").alias("name"), F.col("label").cast("double").alias("label")), F.struct(F.col("real_name").alias("name"), F.lit(0.0).alias("label")))
    return pairs.select(F.explode(both).alias("s")).select("s.*")


def design_grid(spark: SparkSession, axes: dict[str, list], extra: list[dict] | None = None) -> DataFrame:
    """All combinations of the axes, with stride_px = slice_width // stride_div where both exist, and any extra rows."""
    rows = [dict(zip(axes, c, strict=True)) for c in itertools.product(*axes.values())] + (extra or [])
    for r in rows:
        if r.get("slice_width") and r.get("stride_div"):
            r["stride_px"] = max(1, r["slice_width"] // r["stride_div"])
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


def run_name(*parts: Column) -> Column:
    return F.concat_ws("__", *[p.cast("string") for p in parts])


def adjacent_swaps(names: DataFrame, shortest: int = 8, first: int = 2) -> DataFrame:
    """Each name with two unequal neighbours swapped, from place `first` on: name, swap_i, swap_j, swapped."""
    i = F.when(F.length("name") >= shortest, F.sequence(F.lit(first), F.length("name") - 2)).otherwise(F.array().cast("array<int>"))
    rows = names.select("name", F.explode(i).alias("swap_i"))
    a, b = F.substring("name", F.col("swap_i") + 1, F.lit(1)), F.substring("name", F.col("swap_i") + 2, F.lit(1))
    swapped = F.overlay("name", F.concat(b, a), F.col("swap_i") + 1, F.lit(2))
    return rows.filter(a != b).select("name", "swap_i", (F.col("swap_i") + 1).alias("swap_j"), swapped.alias("swapped"))


def infer_swap(real: Column, other: Column) -> Column:
    """The place (from 2 on) where two neighbours of real are swapped in other, if that is all that differs."""
    pairs = F.zip_with(F.split(real, ""), F.split(other, ""), lambda x, y: x != y)
    at = F.filter(F.transform(pairs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    i = F.try_element_at(at, F.lit(1))
    crossed = (F.substring(real, i + 1, F.lit(1)) == F.substring(other, i + 2, F.lit(1))) & (F.substring(real, i + 2, F.lit(1)) == F.substring(other, i + 1, F.lit(1)))
    return F.when((F.length(real) == F.length(other)) & (F.size(at) == 2) & (F.try_element_at(at, F.lit(2)) == i + 1) & (i >= 2) & crossed, i)


def candidate_edits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """names with edits: every place where a rule applies, by priority, score (best first), place and replacement.

    names: name. rules: family, source (any length), replacement, score, priority, operation.
    """
    found = contains_join(rules, names.select("name").distinct().withColumn("row_idx", F.lit(0)))
    edit = F.struct(F.col("priority").cast("int"), (-F.col("score")).alias("negscore"), F.col("start").alias("position"), "replacement", "family", "source", F.col("score").cast("double"), "operation").cast(EDIT)
    edits = found.join(rules, "source").groupBy("name").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    return names.join(shuffled(edits), "name", "left").withColumn("edits", F.coalesce("edits", F.array().cast(f"array<{EDIT}>")))


def distinct_variants(edited: DataFrame, pairs_of: int = 48, max_edits: int = 2) -> DataFrame:
    """What one or two edits make of names: name, generated, operations, distance, and i, j, _p, _s, which tell how it arose.

    edited: what candidate_edits returns. Two edits come from the first pairs_of. A variant counts
    once by its lower case, the first way that it arises; variants with .com go.
    """
    one = edited.select("name", F.posexplode("edits").alias("i", "a")).select("name", "i", F.lit(-1).alias("j"), F.array("a").alias("set"), F.col("a.priority").alias("_p"), F.col("a.negscore").alias("_s"))
    rows = one
    if max_edits >= 2:
        cap = edited.select("name", F.slice("edits", 1, pairs_of).alias("e"))
        left = cap.select("name", "e", F.posexplode("e").alias("i", "a"))
        right = left.select("name", "i", "a", F.explode(F.transform("e", lambda x, j: F.struct(j.alias("j"), x.alias("b")))).alias("r")).filter("r.j > i").select("name", "i", F.col("r.j").alias("j"), "a", F.col("r.b").alias("b"))
        apart = (F.col("a.position") + F.length("a.source") <= F.col("b.position")) | (F.col("b.position") + F.length("b.source") <= F.col("a.position"))
        two = right.filter(apart).select("name", "i", "j", F.array("a", "b").alias("set"), (F.greatest("a.priority", "b.priority") + 5).alias("_p"), ((F.col("a.negscore") + F.col("b.negscore")) / 2).alias("_s"))
        rows = one.unionByName(two)
    done = rows.withColumn("r", apply_edits(F.col("name"), F.col("set"))).filter("r IS NOT NULL").select("name", "i", "j", "_p", "_s", F.col("r.generated").alias("generated"), F.col("r.operations").alias("operations"))
    done = done.filter((F.col("generated") != F.col("name")) & ~F.contains(F.lower("generated"), F.lit(".com")))
    seen = Window.partitionBy("name", F.lower("generated")).orderBy((F.col("j") >= 0).cast("int"), "i", "j")
    return done.withColumn("_n", F.row_number().over(seen)).filter("_n = 1").withColumn("distance", F.levenshtein("generated", "name")).drop("_n")


def ranked_variants(variants: DataFrame, preferred: int = 1) -> DataFrame:
    """distinct_variants with rank: by the preferred distance, at least and near to it, then priority and score."""
    order = Window.partitionBy("name").orderBy((F.col("distance") < preferred).cast("int"), F.abs(F.col("distance") - preferred), "_p", "_s", "i", "j")
    return variants.withColumn("rank", F.row_number().over(order)).select("name", "generated", "operations", "distance", "rank")


def edit_variants(edited: DataFrame, preferred: int = 1, pairs_of: int = 48, max_edits: int = 2) -> DataFrame:
    """Variants with one or two edits, ranked: name, generated, operations, distance, rank."""
    return ranked_variants(distinct_variants(edited, pairs_of, max_edits), preferred)


def rule_examples(rules: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """Names in which a rule applies, with the name after it: source, replacement, name, start, generated."""
    found = contains_join(rules, names, most).join(rules.select("source", "replacement"), "source")
    return found.select("source", "replacement", "name", "start", F.overlay("name", F.col("replacement"), F.col("start") + 1, F.length("source")).alias("generated"))


# Seeded pipelines: the state is a list of characters, each edited once at most. A row is small, so rows go
# to workers in Arrow batches, with the rules in the closure.


def seed_of(*parts: object) -> int:
    """The same number as functions.text.stable_seed."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little") % (2**32 - 1)


class Spelling:
    """A name under edit; each step takes one of the places that no step has touched."""

    def __init__(self, name: str):
        self.name, self.chars, self.free, self.log = name, list(name), [True] * len(name), []

    def text(self) -> str:
        return "".join(self.chars)

    def put(self, at: int, width: int, new: str, family: str, operation: str, score: float) -> None:
        before, old = self.text(), "".join(self.chars[at : at + width])
        self.chars[at : at + width] = list(new)
        self.free[at : at + width] = [False] * len(new)
        self.log.append({"family": family, "operation": operation, "position": at, "source": old, "replacement": new, "score": float(score), "before": before, "after": self.text()})

    def places(self, source: str) -> list[int]:
        w = len(source)
        return [i for i in range(len(self.chars) - w + 1) if w and all(self.free[i : i + w]) and "".join(self.chars[i : i + w]) == source]


def _drawn(scores: list[float], temperature: float, rng: np.random.Generator) -> int:
    s = np.asarray(scores, float)
    w = np.isclose(s, s.max(), rtol=1e-9, atol=0).astype(float) if temperature <= 0 else np.exp((s - s.max()) / temperature)
    return int(rng.choice(len(s), p=w / w.sum()))


def step(state: Spelling, family: str, rules: list[dict], temperature: float, rng: np.random.Generator) -> bool:
    """One edit of a family, drawn by score; False where nothing applies. Swaps: rules with real_name and swap_i."""
    if family == "adjacent":
        ok = [r for r in rules if r["real_name"] == state.name and r["swap_i"] >= 2 and len(state.chars) >= 8 and r["swap_i"] + 1 < len(state.chars) and all(state.free[r["swap_i"] : r["swap_i"] + 2]) and state.chars[r["swap_i"] : r["swap_i"] + 2] == list(state.name[r["swap_i"] : r["swap_i"] + 2])]
        if not ok:
            return False
        r = ok[_drawn([x["score"] for x in ok], temperature, rng)]
        i = r["swap_i"]
        state.put(i, 2, state.chars[i + 1] + state.chars[i], family, "scored_adjacent_swap", r["score"])
        return True
    if family == "multichar_forward":
        fit = [(r, p) for r in rules if (p := state.places(r["source"]))]
        if not fit:
            return False
        r, p = fit[_drawn([x["score"] for x, _ in fit], temperature, rng)]
        state.put(p[int(rng.integers(0, len(p)))], len(r["source"]), r["replacement"], family, r["operation"], r["score"])
        return True
    fit = [(i, r) for i, c in enumerate(state.chars) if state.free[i] for r in rules if r["source"] == c]
    if not fit:
        return False
    i, r = fit[_drawn([x["score"] for _, x in fit], temperature, rng)]
    state.put(i, 1, r["replacement"], family, r["operation"], r["score"])
    return True


FAMILIES = ("adjacent", "multichar_forward", "ocr", "exact")


def _valid(state: Spelling) -> bool:
    return bool(state.log) and state.text() != state.name and ".com" not in state.text().casefold()


_OPS = "array<struct<family:string,operation:string,position:int,source:string,replacement:string,score:double,before:string,after:string>>"


def spelled(plans: DataFrame, rules: dict[str, list[dict]], temperatures: dict[str, float] | None = None) -> DataFrame:
    """The ordered pipeline on each row: swaps, then multi-character rules, then OCR and exact look-alikes.

    plans: row_idx, name, attempt_seed and a count for each family. Adds generated, operations, valid.
    """
    t = temperatures or {}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rng, state = np.random.default_rng(int(r["attempt_seed"])), Spelling(r["name"])
                for f in FAMILIES:
                    for _ in range(int(r[f])):
                        if not step(state, f, rules.get(f, []), t.get(f, 0.0), rng):
                            break
                out.append((r["row_idx"], r["name"], state.text(), state.log, _valid(state)))
            yield pd.DataFrame(out, columns=["row_idx", "name", "generated", "operations", "valid"])

    return plans.select("row_idx", "name", "attempt_seed", *FAMILIES).mapInPandas(run, f"row_idx long, name string, generated string, operations {_OPS}, valid boolean")


def _single_edits(name: str, family: str, rules: list[dict], temperature: float) -> tuple[list[Spelling], np.ndarray]:
    """All that one step of a family can make of a name, with the chance of each."""
    made, chances = [], []
    if family == "adjacent":
        ok = [(r, [r["swap_i"]]) for r in rules if r["real_name"] == name and 2 <= r["swap_i"] < len(name) - 1 and len(name) >= 8]
    elif family == "multichar_forward":
        blank = Spelling(name)
        ok = [(r, p) for r in rules if (p := blank.places(r["source"]))]
    else:
        ok = [(r, [i]) for i, c in enumerate(name) for r in rules if r["source"] == c]
    if not ok:
        return made, np.zeros(0)
    scores = np.array([r["score"] for r, _ in ok], float)
    weights = np.exp((scores - scores.max()) / temperature)
    for (r, places), w in zip(ok, weights / weights.sum(), strict=True):
        for p in places:
            s = Spelling(name)
            if family == "adjacent":
                s.put(p, 2, name[p + 1] + name[p], family, "scored_adjacent_swap", r["score"])
            else:
                s.put(p, len(r["source"]), r["replacement"], family, r["operation"], r["score"])
            made.append(s)
            chances.append(w / len(places))
    return made, np.array(chances)


def fallbacks(names: DataFrame, rules: dict[str, list[dict]], tries: int = 256) -> DataFrame:
    """One-edit variants by seeded tries that cycle through the families: row_idx, name, pref, generated, operations.

    A name's single edits are listed once, with their chances; tries draw from that list.
    """

    def of(name: str) -> Iterator[tuple[int, str, list[dict]]]:
        rng, seen = np.random.default_rng(seed_of("fallback", name)), {name.casefold()}
        drawn: list[tuple[int, Spelling]] = []
        for n, family in enumerate(FAMILIES):
            made, chances = _single_edits(name, family, rules.get(family, []), 2.0)
            if made:
                which = rng.choice(len(made), -(-(tries - n) // 4), p=chances / chances.sum())
                first = {int(k): t for t, k in reversed(list(enumerate(which)))}
                drawn += [(4 * t + n, made[k]) for k, t in first.items()]
        for t, s in sorted(drawn, key=lambda x: x[0]):
            if _valid(s) and s.text().casefold() not in seen:
                seen.add(s.text().casefold())
                yield t + 2, s.text(), s.log

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(idx, name, *v) for idx, name in zip(pdf["row_idx"], pdf["name"], strict=True) for v in of(name)]
            yield pd.DataFrame(out, columns=["row_idx", "name", "pref", "generated", "operations"])

    return names.select("row_idx", "name").mapInPandas(run, f"row_idx long, name string, pref int, generated string, operations {_OPS}")


def legal_variants(names: DataFrame, rules: dict[str, list[dict]], most: int = 10_000, places: int = 4) -> DataFrame:
    """All variants in a fixed order, up to `most` a name: swaps, multi-character rules, then combinations of up to
    `places` substitutions. row_idx, name, pref, generated, operations; each once by lower case."""

    def of(name: str) -> Iterator[tuple[str, list[dict]]]:
        if len(name) >= 8:
            for r in rules.get("adjacent", []):
                if r["real_name"] == name and 2 <= r["swap_i"] < len(name) - 1:
                    s = Spelling(name)
                    s.put(r["swap_i"], 2, name[r["swap_i"] + 1] + name[r["swap_i"]], "adjacent", "capacity_adjacent_swap", r["score"])
                    yield s.text(), s.log
        for r in rules.get("multichar_forward", []):
            for p in Spelling(name).places(r["source"]):
                s = Spelling(name)
                s.put(p, len(r["source"]), r["replacement"], "multichar_forward", r["operation"], r["score"])
                yield s.text(), s.log
        options = []
        for i, c in enumerate(name):
            fit = [(f, r) for f in ("ocr", "exact") for r in rules.get(f, []) if r["source"] == c]
            if fit:
                options.append((i, sorted(fit, key=lambda x: (-x[1]["score"], x[1]["replacement"]))))
        for n in range(1, min(places, len(options)) + 1):
            for at in itertools.combinations(options, n):
                for chosen in itertools.product(*[o for _, o in at]):
                    s = Spelling(name)
                    for (i, _), (f, r) in zip(at, chosen, strict=True):
                        s.put(i, 1, r["replacement"], f, r["operation"], r["score"])
                    yield s.text(), s.log

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for idx, name in zip(pdf["row_idx"], pdf["name"], strict=True):
                seen, out = {name.casefold()}, []
                for text, log in of(name):
                    if text.casefold() not in seen:
                        seen.add(text.casefold())
                        out.append((idx, name, len(out) + 1000, text, log))
                        if len(out) >= most:
                            break
                if out:
                    yield pd.DataFrame(out, columns=["row_idx", "name", "pref", "generated", "operations"])

    return names.select("row_idx", "name").mapInPandas(run, f"row_idx long, name string, pref int, generated string, operations {_OPS}")


def count_plans(names: DataFrame, params: dict) -> DataFrame:
    """How many edits of each family a name gets: row_idx, name, bucket, percentage, the families' counts and attempt_seed.

    params: short_max, medium_max (lengths); short, medium, long (low, high): characters, or shares of
    the length; skew; least and most characters; caps and chances by family; ocr_share; replaceable
    (characters that rules cover); seed.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for idx, name in zip(pdf["row_idx"], pdf["name"], strict=True):
                rng, n = np.random.default_rng(seed_of(params["seed"], "plan", name, idx)), len(name)
                bucket = "short" if n <= params["short_max"] else "medium" if n <= params["medium_max"] else "long"
                low, high = params[bucket]
                u = rng.beta(*SKEWS[params["skew"]]) if params["skew"] in SKEWS else rng.random()
                x = low + u * (high - low) if high > low else low
                total = round(x) if bucket == "short" else round(n * x)
                total = min(max(params["least"], total), params["most"], sum(c in params["replaceable"] for c in name))
                caps = {f: int(rng.binomial(params["caps"][f], params["chances"][f])) for f in FAMILIES}
                if n < 8:
                    caps["adjacent"] = 0
                ocr = min(round(total * params["ocr_share"]), caps["ocr"], total)
                exact = min(total - ocr, caps["exact"])
                more = min(total - ocr - exact, caps["ocr"] - ocr)
                ocr += more
                exact += min(total - ocr - exact, caps["exact"] - exact)
                out.append((idx, name, bucket, None if bucket == "short" else float(x), caps["adjacent"], caps["multichar_forward"], ocr, exact, seed_of(params["seed"], "attempt", name, idx)))
            yield pd.DataFrame(out, columns=["row_idx", "name", "bucket", "percentage", *FAMILIES, "attempt_seed"])

    return names.select("row_idx", "name").mapInPandas(run, "row_idx long, name string, bucket string, percentage double, adjacent int, multichar_forward int, ocr int, exact int, attempt_seed long")


def generate_unique(names: DataFrame, plans: DataFrame, rules: dict[str, list[dict]], taken: DataFrame | None = None, tries: int = 256, most: int = 10_000) -> DataFrame:
    """One variant for each row that nobody else has: the planned one, else a fallback, then for rows left any legal one.

    A row has up to `tries` fallbacks and `most` legal variants to choose from. Both depend on the name
    alone, so they are made once a name; legal ones only for names with rows left. Rows choose in the
    order of row_idx (assignment.assign_lists, where rows of a name share its list). Returns row_idx, name, generated, operations, phase.
    """
    names = materialize(names.select("row_idx", "name"), "names")
    real = names.select(F.lower("name").alias("key")).distinct()
    used = materialize(real if taken is None else real.unionByName(taken.select("key")).distinct(), "used")
    columns = ["row_idx", "name", "generated", "operations"]

    def made(options: DataFrame) -> DataFrame:
        one = options.withColumn("key", F.lower("generated")).groupBy("name", "key").agg(F.min_by(F.struct("pref", "generated", "operations"), "pref").alias("o"))
        return materialize(one.select("name", "key", "o.pref", "o.generated", "o.operations"), "variants")

    def chosen(got: DataFrame, options: DataFrame) -> DataFrame:
        return got.join(names, "row_idx").join(options.drop("pref"), ["name", "key"]).select(*columns)

    other = made(fallbacks(names.groupBy("name").agg(F.min("row_idx").alias("row_idx")), rules, tries))
    planned = materialize(spelled(plans, rules).filter("valid").select("row_idx", "name", F.lower("generated").alias("key"), "generated", "operations"), "planned")
    asked = names.join(planned.select("row_idx", F.col("key").alias("first")), "row_idx", "left").select("row_idx", F.col("name").alias("list"), "first")
    got = materialize(assign_lists(asked, other.select(F.col("name").alias("list"), "pref", "key"), used), "assigned")
    first = got.filter("pref = 0").join(planned.drop("key"), "row_idx").select(*columns)
    second = chosen(got.filter("pref > 0"), other)
    left = materialize(names.join(got.select("row_idx"), "row_idx", "left_anti"), "left")
    legal = made(legal_variants(left.groupBy("name").agg(F.min("row_idx").alias("row_idx")), rules, most))
    third = chosen(assign_lists(left.select("row_idx", F.col("name").alias("list")), legal.select(F.col("name").alias("list"), "pref", "key"), used.unionByName(got.select("key"))), legal)
    return first.unionByName(second).withColumn("phase", F.lit(1)).unionByName(third.withColumn("phase", F.lit(2)))


def retried(names: DataFrame, rules: DataFrame, count: int, least_similarity: float = 0.55, seed: int = 0) -> DataFrame:
    """The first `count` usable one-edit candidates in hash order, and why others are not: name, generated, similarity, reason.

    reason is null for what is kept: same, low_similarity and duplicate name the rejects.
    """
    made = rule_examples(rules, names.withColumn("row_idx", F.lit(0)) if "row_idx" not in names.columns else names)
    made = made.withColumn("similarity", levenshtein_similarity(F.col("name"), F.col("generated"))).withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), "name", "generated").cast("binary"), 256))
    made = made.withColumn("_n", F.row_number().over(Window.partitionBy("name", "generated").orderBy("start", "source")))
    reason = F.when(F.col("generated") == F.col("name"), "same").when(F.col("similarity") < least_similarity, "low_similarity").when(F.col("_n") > 1, "duplicate")
    made = made.withColumn("reason", reason)
    kept = made.filter("reason IS NULL").orderBy("_h").limit(count)
    return kept.unionByName(made.filter("reason IS NOT NULL")).select("name", "generated", "similarity", "reason")
