"""Building labelled pairs: positives by visits, negatives at a distance, hard negatives, and trials of policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.text import has_dot_com, hash_order, hash_uniform, number_or, ocr_rule_score
from simloom.operators.assignment import assign_lists, assign_unique
from simloom.operators.metrics import running_totals
from simloom.operators.nearest import nearest_texts
from simloom.operators.similarity_join import length_ring, range_join
from simloom.storage import materialize, shuffled

#: Candidates of a step, of these those that a choice looks at, and of these those that it is drawn from.
LIMIT, USABLE, POOL = 512, 64, 32
#: Names within 2 that a list begins with, and names that it gets when these are too few.
CLOSE, FEW = 16, 8


def one_per_key(names: DataFrame) -> DataFrame:
    """The least name of each key, without names that have no key or hold .com. names: name, key."""
    return names.filter((F.col("key") != "") & (F.col("name") != "") & ~has_dot_com(F.col("name"))).groupBy("key").agg(F.min("name").alias("name"))


def visits(pool: DataFrame, count: int) -> DataFrame:
    """`count` visits of the pool's names in their order, again from the first after the last: row_idx, name.

    pool: name, place (0, 1, 2 ...; each once).
    """
    n = pool.count()
    every = F.explode(F.sequence(F.lit(0), F.floor((F.lit(count) - 1 - F.col("place")) / max(n, 1)).cast("long")))
    return pool.filter(F.col("place") < count).select("name", "place", every.alias("_cycle")).select((F.col("place") + F.col("_cycle") * n).alias("row_idx"), "name")


def _list(*columns: str) -> Column:
    """The name of a list of wishes."""
    return F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]).alias("list")


def positives_to_count(pool: DataFrame, variants: DataFrame, count: int, second_share: float = 0.65, taken: DataFrame | None = None, seed: int = 0, attempts: int = 100) -> DataFrame:
    """The first `count` visits that get a variant whose key nobody has: row_idx, name, preferred, generated, key.

    pool: name, key, place. variants: name, preferred (1 or 2), rank, generated, key. A visit prefers
    distance 2 with the given share, by hash, and takes the variants for 1 if there are none for 2. A
    variant with the key of its own name, or one in taken (key), is passed over. Visits are made in
    doubling numbers, as a longer list of visits begins with the same choices; after `attempts`
    visits a row wanted it is an error.
    """
    if not pool.limit(1).count():
        raise ValueError("no names to visit")
    own = materialize(variants.select("name", "preferred", "rank", "generated", "key").join(shuffled(pool.select("name", F.col("key").alias("_own"))), "name").filter("key != _own"), "variants")
    offered = materialize(variants.filter("preferred = 2").select("name").distinct(), "offered")
    lists = own.select(_list("name", "preferred"), F.col("rank").alias("pref"), "key")
    tries = count
    while True:
        made = visits(pool, tries).withColumn("_two", hash_uniform(seed, F.col("row_idx")) < second_share)
        wish = made.join(shuffled(offered.withColumn("_has", F.lit(True))), "name", "left")
        wish = wish.select("row_idx", "name", F.when(F.col("_two") & F.col("_has"), 2).otherwise(1).alias("preferred"))
        got = assign_lists(wish.select("row_idx", _list("name", "preferred")), lists, taken)
        if tries > count:  # more visits than asked for may all have got one: the first ones by a running count, not in one task
            got = running_totals(materialize(got.withColumn("_one", F.lit(1)), "assigned"), "row_idx", ["_one"]).filter(F.col("cum__one") <= count).drop("_one", "cum__one")
        got = materialize(got, "positives")
        if got.count() == count:
            break
        if tries > count * attempts:
            raise ValueError(f"{got.count()} of {count} positives after {tries} visits")
        tries *= 2
    best = own.groupBy("name", "preferred", "key").agg(F.min_by("generated", "rank").alias("generated"))
    return got.select("row_idx", "key").join(shuffled(wish), "row_idx").join(shuffled(best), ["name", "preferred", "key"]).select("row_idx", "name", "preferred", "generated", "key")


def expanding_candidates(targets: DataFrame, names: DataFrame, reach: int = 4) -> DataFrame:
    """Names near each target, in the first of four steps that has enough: name, candidate, candidate_key, distance, step.

    targets: name, key, wanted (how many different candidates are needed). names: name, key. Steps widen
    the cutoff of the edit distance and the window of lengths: (reach, 5), (reach + 2, 8), (reach + 6, 12)
    and (64, 64). Each gives up to LIMIT names, nearest first, then by length and name. A later step
    serves only targets that the ones before left short, so the wide ones meet few targets.
    """
    firsts = materialize(one_per_key(names), "names")
    left, found = materialize(targets.select("name", "key", "wanted"), "targets"), None
    keys = firsts.select(F.col("name").alias("right_name"), F.col("key").alias("candidate_key"))
    for step, (cutoff, window) in enumerate(((reach, 5), (reach + 2, 8), (reach + 6, 12), (64, 64)), 1):
        pairs = nearest_texts(left.select("name"), firsts.select("name"), LIMIT, cutoff, window)
        order = Window.partitionBy("left_name").orderBy("distance", F.length("right_name"), "right_name")
        pairs = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= LIMIT)
        pairs = pairs.join(keys, "right_name").join(left.select(F.col("name").alias("left_name"), "key"), "left_name").filter("candidate_key != key")
        pairs = pairs.select(F.col("left_name").alias("name"), F.col("right_name").alias("candidate"), "candidate_key", "distance", F.lit(step).alias("step"))
        if found is not None:
            pairs = pairs.join(found.select("name", "candidate_key"), ["name", "candidate_key"], "left_anti")
        pairs = materialize(pairs, "candidates")
        found = pairs if found is None else found.unionByName(pairs)
        have = found.groupBy("name").agg(F.count(F.lit(1)).alias("_have"))
        left = materialize(left.join(have, "name", "left").filter(F.coalesce("_have", F.lit(0)) < F.col("wanted")).drop("_have"), "targets")
        if not left.limit(1).count():
            break
    return found


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def expanding_negatives(asked: DataFrame, names: DataFrame, reach: int = 4, seed: int = 0) -> DataFrame:
    """A name for each visit, at its goal distance if one is among the nearest, else the nearest to it.

    asked: row_idx, name, key, goal (at most reach); names: name, key. No two visits of a name get the
    same key. A choice looks at the first USABLE candidates of the first step that has any left, and is
    drawn by hash from up to POOL of them. Returns row_idx, name, neighbor, distance, mode
    (exact_target or nearest_available); visits without any name left get no row. A name's visits
    should number less than LIMIT - USABLE.
    """
    targets = asked.groupBy("name", "key").agg(F.count(F.lit(1)).alias("wanted"))
    near = expanding_candidates(targets, names, reach)
    order = F.array_sort(F.collect_list(F.struct("step", "distance", F.length("candidate").alias("length"), "candidate", "candidate_key")))
    wishes = F.array_sort(F.collect_list(F.struct("row_idx", "goal", hash_uniform(seed, F.col("row_idx")).alias("u"))))
    both = near.groupBy("name").agg(order.alias("near")).join(asked.groupBy("name").agg(wishes.alias("wishes")), "name")

    def choose(state: Column, wish: Column) -> Column:
        left = state["left"]
        same = F.slice(F.filter(left, lambda c: c["step"] == F.get(left, 0)["step"]), 1, USABLE)

        def drawn(usable: Column) -> Column:
            exact = F.filter(usable, lambda c: c["distance"] == wish["goal"])
            gap = lambda c: F.struct(F.abs(c["distance"] - wish["goal"]).alias("g"), c["distance"].alias("d"), c["candidate"].alias("n"), c.alias("c"))
            nearest = F.transform(F.array_sort(F.transform(usable, gap)), lambda x: x["c"])
            options = F.struct((F.size(exact) > 0).alias("exact"), F.slice(F.when(F.size(exact) > 0, exact).otherwise(nearest), 1, POOL).alias("of"))
            return _let(options, lambda o: F.struct(wish["row_idx"].alias("row_idx"), o["exact"].alias("exact"), F.get(o["of"], F.floor(wish["u"] * F.size(o["of"])).cast("int")).alias("c")))

        done = lambda got: F.struct(F.filter(left, lambda c: c["candidate_key"] != got["c"]["candidate_key"]).alias("left"), F.concat(state["got"], F.array(got)).alias("got"))
        return F.when(F.size(left) == 0, state).otherwise(_let(_let(same, drawn), done))

    empty = F.array().cast("array<struct<row_idx:bigint,exact:boolean,c:struct<step:int,distance:int,length:int,candidate:string,candidate_key:string>>>")
    got = both.withColumn("got", F.aggregate("wishes", F.struct(F.col("near").alias("left"), empty.alias("got")), choose, lambda s: s["got"]))
    out = got.select("name", F.explode("got").alias("g"))
    return out.select(F.col("g.row_idx").alias("row_idx"), "name", F.col("g.c.candidate").alias("neighbor"), F.col("g.c.distance").alias("distance"), F.when(F.col("g.exact"), "exact_target").otherwise("nearest_available").alias("mode"))


#: The share of goal distance 2 in each policy; the others have 1.
POLICIES = {"neg_d1": 0.0, "neg_d2": 1.0, "neg_mix12": 0.65}


def goals(rows: DataFrame, policy: str, seed: int = 0) -> DataFrame:
    """rows (row_idx) with goal, by the policy's share of 2, drawn by hash."""
    return rows.withColumn("goal", F.when(hash_uniform(f"{seed}{policy}", F.col("row_idx")) < POLICIES[policy], 2).otherwise(1))


def distance_negatives(rows: DataFrame, names: DataFrame, reach: int = 4, most: int = LIMIT, spare: int = 64, taken: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """A name that no other row has for each row in turn: row_idx, name, neighbor, distance, mode, and policy if rows have it.

    rows: row_idx, name, key, goal (at most reach) and maybe policy: rows of one policy don't see what others take. names: name,
    key; taken: key. A row takes the first free name at its
    goal distance, else below it, nearest first, else above it; a hash orders names of one distance.
    Rows that find none within reach choose after the others, within reach + 8, and then of the
    `spare` nearest in length. mode is exact_target, nearest_fallback_radius_N or global_length_fallback.

    Rows of one name and goal share a list (assignment.assign_lists). Lists begin with the names within 2, found by deletions;
    who comes to the end of one gets the FEW nearest within reach, then the `most` nearest, and then all of them, by cuts of space.
    """
    columns = ["policy", "row_idx"] if "policy" in rows.columns else ["row_idx"]
    policy = F.col("policy").cast("string") if "policy" in rows.columns else F.lit("")
    firsts = materialize(one_per_key(names), "names")
    keyed = firsts.select(F.col("name").alias("candidate"), F.col("key").alias("candidate_key"))
    asked = rows.select(F.struct("row_idx", policy.alias("policy")).alias("row_idx"), "name", "key", "goal", policy.alias("policy"))
    left = materialize(asked.withColumn("list", F.concat_ws("\x1f", "policy", F.col("goal").cast("string"), "name")), "rows")
    policies = left.select("policy").distinct()
    used = None if taken is None else materialize(taken.select("key").distinct().crossJoin(F.broadcast(policies)).select(F.concat_ws("\x1f", "policy", "key").alias("key")), "taken")
    within_2 = min(reach, max(2, left.agg(F.max("goal")).first()[0] or 0))
    at = F.greatest("distance", "goal")
    few = firsts.limit(most + 1).count() <= most  # the nearest of them are all of them
    done = None

    def offers(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Rows of lists: what tells the order, and what the choice is."""
        one = of.select("list", "name", "key", "goal", "policy").distinct().join(pairs, "name").join(keyed, "candidate").filter("candidate_key != key")
        pref = F.struct(at.alias("at"), F.abs(F.col("distance") - F.col("goal")).alias("gap"), hash_order(seed, F.col("name"), F.col("candidate_key")).alias("hash"), "distance", "candidate")
        return one.select("list", pref.alias("pref"), F.concat_ws("\x1f", "policy", "candidate_key").alias("key"))

    def found(of: DataFrame, k: int | None, low: int, high: int) -> DataFrame:
        near = nearest_texts(of.select("name").distinct(), firsts.select("name"), k, high)
        return near.filter(F.col("distance") > low).select(F.col("left_name").alias("name"), F.col("right_name").alias("candidate"), "distance")

    def lists(of: DataFrame, low: int, high: int, start: DataFrame | None = None) -> tuple[DataFrame, Callable]:
        """Lists as they begin, and how they go on, each list step by step: with what of start there is (first CLOSE of a list), then by search."""
        every = [None] if few else [FEW, most, None]
        steps = [lambda some, k=k: offers(found(some, k, low, high), some) for k in (every if high > low else [])]
        if start is None:
            begin = steps.pop(0)(of)
        else:
            whole = materialize(offers(start, of).withColumn("_n", F.row_number().over(Window.partitionBy("list").orderBy("pref"))), "offers")
            begin = whole.filter(F.col("_n") <= CLOSE).drop("_n")
            steps.insert(0, lambda some: whole.filter(F.col("_n") > CLOSE).drop("_n").join(some.select("list").distinct(), "list", "left_semi"))
        served = of.select("list").distinct().withColumn("step", F.lit(0))

        def more(ended: DataFrame) -> DataFrame | None:
            nonlocal served
            at = materialize(served.join(ended.withColumn("_ended", F.lit(True)), "list", "left"), "steps")
            waiting = sorted(r.step for r in at.filter(F.col("_ended") & (F.col("step") < len(steps))).select("step").distinct().collect())
            out = None
            for n in waiting:
                one = steps[n](of.join(at.filter(F.col("_ended") & (F.col("step") == n)), "list", "left_semi"))
                out = one if out is None else out.unionByName(one)
            served = at.select("list", (F.col("step") + F.coalesce(F.col("_ended").cast("int"), F.lit(0))).alias("step"))
            return out

        return begin, more

    def by_length(of: DataFrame) -> DataFrame:
        ring = length_ring(of.select("name").distinct(), firsts.select("name"), spare)
        return ring.select(F.col("target").alias("name"), "candidate", F.levenshtein("target", "candidate").alias("distance"))

    radius = F.concat(F.lit("nearest_fallback_radius_"), F.col("pref.at").cast("string"))
    for phase in range(3):
        if not left.limit(1).count():
            break
        if phase == 0:
            close = range_join(left.select("name").distinct(), firsts.select("name"), within_2) if within_2 <= 2 else nearest_texts(left.select("name").distinct(), firsts.select("name"), None, within_2)
            close = close.select(F.col("left_name").alias("name"), F.col("right_name").alias("candidate"), "distance")
            wishes, more = lists(left, within_2, reach, close)
        elif phase == 1:
            wishes, more = lists(left, reach, reach + 8)
        else:
            wishes, more = offers(by_length(left), left), None
        got = materialize(assign_lists(left.select("row_idx", "list"), wishes, used, more), "assigned")
        mode = F.lit("global_length_fallback") if phase == 2 else F.when(F.col("pref.gap") == 0, "exact_target").otherwise(radius)
        new = got.join(left.select("row_idx", "name", "policy"), "row_idx").select("row_idx", "policy", "name", F.col("pref.candidate").alias("neighbor"), F.col("pref.distance").alias("distance"), mode.alias("mode"), "key")
        new = materialize(new, "negatives")
        done = new if done is None else done.unionByName(new)
        used = done.select("key") if taken is None else used.select("key").unionByName(new.select("key"))
        left = materialize(left.join(new.select("row_idx"), "row_idx", "left_anti"), "rows")
    if done is None:
        return rows.limit(0).select(*columns, "name", F.lit("").alias("neighbor"), F.lit(0).alias("distance"), F.lit("").alias("mode"))
    return done.withColumn("row_idx", F.col("row_idx.row_idx")).select(*columns, "name", "neighbor", "distance", "mode")


def distance_trials(rows: DataFrame, names: DataFrame, policies: dict[str, float] | None = None, seed: int = 0, **options) -> DataFrame:
    """distance_negatives under each policy, compared: policy, distance, mode, n. All policies are served by the same jobs."""
    asked = None
    for policy in policies or POLICIES:
        some = goals(rows.select("row_idx", "name", "key"), policy, seed).withColumn("policy", F.lit(policy))
        asked = some if asked is None else asked.unionByName(some)
    made = distance_negatives(asked, names, seed=seed, **options)
    return made.groupBy("policy", "distance", "mode").agg(F.count(F.lit(1)).alias("n")).select("policy", "distance", "mode", "n")


def hard_negatives(rows: DataFrame, neighbors: DataFrame, names: DataFrame, positives: DataFrame, features: list[str], featured, spare: int = 64, taken: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """For each row in turn the nearest of its neighbors that is free, else a name that looks like a positive: row_idx, name, neighbor, mode.

    rows: row_idx, name, key. neighbors: name, neighbor, neighbor_key, rank. positives: id, distance and
    the features. featured(pairs of name, candidate) adds the features and distance. Rows without a free
    neighbor draw a positive by hash, and take of the `spare` names of the nearest lengths those
    whose features and distance are nearest to it. taken: key.
    """
    rows = materialize(rows.select("row_idx", "name", "key"), "rows")
    first = rows.select("name", F.col("key").alias("_own")).distinct().join(neighbors, "name").filter("neighbor_key != _own AND neighbor_key != ''").filter(~has_dot_com(F.col("neighbor")))
    first = materialize(first.select(_list("name", "_own"), F.col("neighbor_key").alias("key"), F.col("rank").alias("pref"), F.col("neighbor").alias("candidate")), "neighbors")
    one = materialize(assign_lists(rows.select("row_idx", _list("name", "key")), first.select("list", "key", "pref"), taken), "assigned")
    left = materialize(rows.join(one.select("row_idx"), "row_idx", "left_anti"), "rows")
    n = positives.count()
    numbered = running_totals(positives.withColumn("_one", F.lit(1)), "id", ["_one"]).withColumn("_p", F.col("cum__one") - 1)
    drawn = left.withColumn("_p", F.floor(hash_uniform(seed, F.col("row_idx")) * max(n, 1))).join(numbered.select("_p", *features, "distance"), "_p").drop("_p")
    firsts = one_per_key(names)
    ring = length_ring(left.select("name").distinct(), firsts.select("name"), spare).select(F.col("target").alias("name"), "candidate")
    options = featured(ring).join(firsts.select(F.col("name").alias("candidate"), F.col("key").alias("candidate_key")), "candidate")
    other = options.select("name", "candidate", "candidate_key", F.col("distance").alias("_d"), *[F.col(f).alias(f"_{f}") for f in features])
    gap = F.sqrt(sum(((F.col(f) - F.col(f"_{f}")) ** 2 for f in features[1:]), (F.col(features[0]) - F.col(f"_{features[0]}")) ** 2))
    second = drawn.join(other, "name").filter("candidate_key != key").withColumn("objective", F.round(gap + 0.15 * F.abs(F.col("distance") - F.col("_d")), 9))
    second = second.withColumn("pref", F.row_number().over(Window.partitionBy("row_idx").orderBy("objective", "candidate")))
    second = materialize(second.select("row_idx", F.col("candidate_key").alias("key"), "pref", "candidate"), "options")
    used = one.select("key") if taken is None else one.select("key").unionByName(taken.select("key"))
    two = assign_unique(second.select("row_idx", "key", "pref"), used)
    named = rows.select("row_idx", "name", _list("name", "key"))
    best = first.groupBy("list", "key").agg(F.min_by("candidate", "pref").alias("candidate"))
    near = one.join(named, "row_idx").join(best, ["list", "key"]).select("row_idx", "name", F.col("candidate").alias("neighbor"), F.lit("nearest_neighbor_table").alias("mode"))
    alike = two.select("row_idx", "key").join(second.select("row_idx", "key", "candidate"), ["row_idx", "key"]).join(named, "row_idx")
    return near.unionByName(alike.select("row_idx", "name", F.col("candidate").alias("neighbor"), F.lit("feature_fallback").alias("mode")))


#: Columns of the rule table.
RULE_COLUMNS = ["source_character", "replacement_character", "primary_sub", "unicode_name", "example_original_text", "example_substituted_text", "review_label", "legit_q25", "ocr_attack_contexts", "visual_similarity_score"]
_NUMBERS = ("legit_q25", "ocr_attack_contexts", "visual_similarity_score")


def combined_rules(tables: list[tuple[DataFrame, str]], removed: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """One table of single-character rules from several, each with the name of its source, first ones preferred.

    Tables: source_character (or real_span), replacement_character (or candidate_span) and any of
    RULE_COLUMNS; rows reviewed as other than keep, or of another family than ocr_confusable, go.
    removed: pairs to leave out. A pair counts once, with its best generation_score, which must be at
    least `least`. Returns RULE_COLUMNS, source, replacement_codepoint, generation_score.
    """
    every = None
    for place, (df, source) in enumerate(tables):
        for old, new in (("real_span", "source_character"), ("candidate_span", "replacement_character")):
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        for column, value in (("review_label", "keep"), ("substitution_family", "ocr_confusable")):
            if column in df.columns:
                df = df.filter(F.coalesce(F.col(column).cast("string"), F.lit(value)) == value)
        rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("double" if c in _NUMBERS else "string").alias(c) for c in RULE_COLUMNS], F.lit(source).alias("source"), F.lit(place).alias("_place"))
        every = rows if every is None else every.unionByName(rows)
    pair = ["source_character", "replacement_character"]
    every = every.filter((F.length(pair[0]) == 1) & (F.length(pair[1]) == 1) & (F.col(pair[0]) != F.col(pair[1])))
    if removed is not None:
        every = every.join(removed.select(*pair).distinct(), pair, "left_anti")
    score = ocr_rule_score(F.col("visual_similarity_score"), F.col("ocr_attack_contexts"), F.col("legit_q25"), F.col("source"))
    every = every.withColumn("generation_score", score).withColumn("replacement_codepoint", F.format_string("U+%04X", F.ascii("replacement_character")))
    rest = [c for c in every.columns if c not in (*pair, "_place")]
    order = F.struct((-F.col("generation_score")).alias("s"), "_place", *[F.col(c) for c in rest])
    best = every.groupBy(*pair).agg(F.min(order).alias("_r")).select(*pair, *[F.col(f"_r.{c}") for c in rest])
    return best.filter(F.col("generation_score") >= least)


def first_replacements(rules: DataFrame, order: dict[str, bool] | None = None) -> DataFrame:
    """source_character and the first replacement that isn't null: by the columns of `order` that are there (True: ascending), nulls last.

    Rows reviewed as other than keep, or of another family than ocr_confusable, go; ties go to the lesser replacement.
    """
    order = order or {"source_rank": True, "proxy_rank": True, "visual_similarity_score": False, "legit_q25": False, "legit_median": False}
    for column, value in (("review_label", "keep"), ("substitution_family", "ocr_confusable")):
        if column in rules.columns:
            rules = rules.filter(F.coalesce(F.col(column).cast("string"), F.lit(value)) == value)
    number = {c: number_or(F.col(c), F.lit(None).cast("double")) for c in order if c in rules.columns}
    keys = [x for c, v in number.items() for x in (v.isNull().alias(f"{c}_null"), (v if order[c] else -v).alias(c))]
    row = F.struct(*keys, F.col("replacement_character").cast("string").alias("replacement_character"))
    kept = rules.filter("replacement_character IS NOT NULL").groupBy(F.col("source_character").cast("string").alias("source_character"))
    return kept.agg(F.min(row).alias("_r")).select("source_character", "_r.replacement_character")
