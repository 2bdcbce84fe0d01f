"""Queries over joins, metrics, ranking, sampling, assignment and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import distance as D
from simloom.functions import text as X
from simloom.operators import assignment, checks, datasets, forest, metrics, ranking, registry, sampling, scoring
from simloom.operators import generators, similarity_join
from simloom.operators import similarity_join as J
from simloom.plans import text_queries
from simloom.plans.inputs import PAIRS_SQL, SCORED_SQL, TOKENS_SQL, pairs, part_names, scored, spoof, token_rows, tokens
from simloom.plans.registry import query
from simloom.sources import runs
from simloom.storage import join_small, materialize, new_path, table
from simloom.streaming import registry as streams

#: functions.text.hash_uniform of what is hashed.
_UNIFORM = "((('0x' || substr(sha256({}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS target, b.name AS neighbor, levenshtein(a.name, b.name) AS distance FROM n a, n b
        WHERE a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 5 AND levenshtein(a.name, b.name) <= 8),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance > 5, distance, neighbor) AS rank FROM p)
    SELECT target, neighbor, CAST(distance AS BIGINT) AS distance, CAST(length(neighbor) - length(target) AS BIGINT) AS length_delta, rank FROM r WHERE rank <= 3""")
def nearest_names_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir).withColumn("key", F.lower("name"))
    near = J.nearest_names(names, names, k=3, window=5, cutoff=5, fallback=8)
    return near.select("target", "neighbor", F.col("distance").cast("long").alias("distance"), F.col("length_delta").cast("long").alias("length_delta"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT a.c_name AS left_name, b.c_name AS right_name, CAST(levenshtein(a.c_name, b.c_name) AS BIGINT) AS distance
    FROM customer a JOIN customer b ON a.c_name < b.c_name WHERE levenshtein(a.c_name, b.c_name) <= 2""")
def range_join_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = materialize(table(spark, sf_dir, "customer").filter("c_name IS NOT NULL").groupBy(F.col("c_name").alias("name")).agg(F.count(F.lit(1)).alias("copies")), "names")
    near = J.range_join(names, names, 2).filter("left_name < right_name")
    again = materialize(names.filter("copies > 1"), "copies")
    if again.limit(1).count():  # a pair comes for each copy of both names
        for side in ("left", "right"):
            near = join_small(near, again.select(F.col("name").alias(f"{side}_name"), "copies"), f"{side}_name", "left")
            near = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).drop("copies", "_copy")
    return near.select("left_name", "right_name", F.col("distance").cast("long").alias("distance"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS left_name, b.name AS right_name, CAST(levenshtein(a.name, b.name) AS BIGINT) AS distance
    FROM n a JOIN n b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 4""")
def range_join_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    return J.range_join(names, names, 4).filter("left_name < right_name").select("left_name", "right_name", F.col("distance").cast("long").alias("distance"))


@query()
def range_join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct tokens within distance 2; comparing all pairs takes SQL too long, so tests do on few."""
    names = materialize(tokens(spark, sf_dir), "tokens")
    return J.range_join(names, names, 2).filter("left_name < right_name").select("left_name", "right_name", F.col("distance").cast("long").alias("distance"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS l, b.name AS r, levenshtein(a.name, b.name) AS d FROM n a, n b WHERE a.name <> b.name),
    t AS (SELECT *, CASE WHEN d <= 2 THEN 2 ELSE d END AS tier FROM p WHERE d <= 6), m AS (SELECT *, min(tier) OVER (PARTITION BY l) AS least, bool_or(d = 2) OVER (PARTITION BY l) AS exact FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY abs(d - 2), d, abs(length(l) - length(r)), r) AS i FROM m WHERE tier = least AND (d = 2 OR NOT exact)),
    h AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY sha256('0|' || l || '|' || r)) AS j FROM k WHERE i <= 16),
    f AS (SELECT l, r, d, row_number() OVER (PARTITION BY l ORDER BY abs(length(r) - length(l)), r) AS j FROM p WHERE l NOT IN (SELECT l FROM t))
    SELECT l AS target, r AS neighbor, CAST(d AS BIGINT) AS distance, CASE WHEN exact THEN 'exact_target' ELSE 'nearest_available' END AS mode FROM h WHERE j = 1
    UNION ALL SELECT l, r, CAST(d AS BIGINT), 'global_length_fallback' FROM f WHERE j = 1""")
def pick_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    return J.pick_at_distance(names, names, goal=2, reach=6).select("target", "neighbor", F.col("distance").cast("long").alias("distance"), "mode")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), l AS (SELECT length(name) AS l, count(*) AS n FROM n GROUP BY 1),
    t AS (SELECT DISTINCT length(name) AS t FROM n), r AS (SELECT t, l, abs(l - t) AS r, n FROM t, l WHERE abs(l - t) <= 4),
    b AS (SELECT *, coalesce((SELECT sum(n) FROM r q WHERE q.t = r.t AND q.r < r.r), 0) AS before FROM r)
    SELECT a.name AS target, c.name AS candidate, CAST(b.r AS BIGINT) AS radius FROM n a JOIN b ON b.t = length(a.name) JOIN n c ON length(c.name) = b.l WHERE b.before < 12 AND a.name <> c.name""")
def length_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    return J.length_ring(names, names, 12).select("target", "candidate", F.col("radius").cast("long").alias("radius"))


@query(f"""WITH {TOKENS_SQL}, r AS (SELECT unnest(['m', 'w', 'th', 'ing']) AS source), o AS (SELECT source, name, unnest(list_filter(range(0, length(name)), lambda i: substr(name, i + 1, length(source)) = source)) AS start FROM tokens, r)
    SELECT source, name, CAST(start AS BIGINT) AS start FROM o""")
def contains_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("m",), ("w",), ("th",), ("ing",)], "source string")
    found = J.contains_join(rules, tokens(spark, sf_dir).withColumn("row_idx", F.lit(0)))
    return found.select("source", "name", F.col("start").cast("long").alias("start"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM e q, e v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    near = J.knn_cosine(q, v, 5)
    return near.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), p AS (SELECT label, arg_min(e, vec_id) AS p FROM e GROUP BY label),
    s AS (SELECT e.vec_id AS id, p.label, round(list_inner_product(e.e, p.p), 9) AS s FROM e, p), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS n FROM s)
    SELECT id, CAST(label AS BIGINT) AS label, round(s, 6) AS similarity FROM r WHERE n = 1""")
def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    prototypes = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("prototype"))
    near = J.nearest_prototype(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), prototypes)
    return near.select("id", F.col("label").cast("long").alias("label"), F.round("similarity", 6).alias("similarity"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), p AS (SELECT label AS source, arg_min(e, vec_id) AS p FROM e GROUP BY label),
    s AS (SELECT e.vec_id AS id, p.source, round(list_cosine_similarity(e.e, p.p), 9) AS similarity FROM e, p),
    m AS (SELECT s.id, s.source, s.similarity, round(s.similarity - coalesce((SELECT max(o.similarity) FROM s o WHERE o.id = s.id AND o.source <> s.source), 0), 9) AS margin FROM s)
    SELECT CAST(source AS BIGINT) AS source, id, round(similarity, 6) AS similarity, round(margin, 6) AS margin FROM m WHERE similarity >= 0.1 AND margin >= 0""")
def source_identity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    sources = e.groupBy(F.col("label").alias("source")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    got = J.similar_to_sources(sources, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), least=0.1)
    return got.select(F.col("source").cast("long").alias("source"), "id", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"))


@query("""WITH r AS (SELECT s_suppkey AS id, s_nationkey AS block, s_acctbal AS d, length(s_name)::DOUBLE AS f FROM supplier), c AS (SELECT c_custkey AS candidate, c_nationkey AS block, c_acctbal AS d, length(c_name)::DOUBLE AS f FROM customer),
    p AS (SELECT id, candidate, round(abs(r.f - c.f) + 0.15 * abs(r.d - c.d), 9) AS o FROM r JOIN c USING (block)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, candidate) AS n FROM p),
    h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sha256('0|' || id || '|' || candidate)) AS m FROM k WHERE n <= 8) SELECT id, candidate, round(o, 6) AS objective FROM h WHERE m = 1""")
def feature_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"), F.col("s_acctbal").alias("distance"), F.length("s_name").cast("double").alias("f"))
    cands = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.col("c_acctbal").alias("distance"), F.length("c_name").cast("double").alias("f"))
    return J.nearest_by_features(rows, cands, ["f"]).select("id", "candidate", F.round("objective", 6).alias("objective"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def forbidden_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return registry.unfinished(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), used, ["c_custkey"])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey AND r.l_returnflag = 'R')")
def tuple_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return registry.unfinished(items.select("l_partkey", "l_suppkey").distinct(), items.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def validated_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = J.checked_join(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), right, ["o_custkey"], complete=True)
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH l AS (SELECT n_regionkey AS key, arg_min(n_name, sha256('0left|' || n_regionkey || '|' || n_name)) AS left_value FROM nation GROUP BY 1),
    r AS (SELECT r_regionkey AS key, arg_min(r_name, sha256('0right|' || r_regionkey || '|' || r_name)) AS right_value FROM region GROUP BY 1) SELECT key, left_value, right_value FROM l JOIN r USING (key)""")
def group_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value"))
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return J.sample_of_both(left, right, "key")


# Metrics


@query(f"WITH {SCORED_SQL} SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, round(count(*) FILTER (label = 1) / count(*)::DOUBLE, 9) AS positive_share FROM scored")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.label_counts(scored(spark, sf_dir)).withColumn("positive_share", F.round("positive_share", 9))


@query(f"""WITH {SCORED_SQL} SELECT CAST(label AS BIGINT) AS label, CAST(grouping(label) AS BIGINT) AS overall, count(score) AS count, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.5), 9) AS median,
    round(min(score), 9) AS min, round(stddev_pop(score), 9) AS std FROM scored GROUP BY GROUPING SETS ((label), ())""")
def score_stats_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.stats_by(scored(spark, sf_dir), "score", "label")
    return out.select(F.col("label").cast("long").alias("label"), F.col("overall").cast("long").alias("overall"), "count", *[F.round(c, 9).alias(c) for c in ("mean", "q25", "median", "min", "std")])


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT label, levenshtein(real_name, fraudulent_name) AS d, length(real_name) AS l FROM pairs)
    SELECT label, count(*) AS n, round(avg(d), 9) AS abs_mean, quantile_cont(d, 0.25) AS abs_q25, quantile_cont(d, 0.5) AS abs_median, quantile_cont(d, 0.75) AS abs_q75,
    round(avg(d / l::DOUBLE), 9) AS rel_mean, round(quantile_cont(d / l::DOUBLE, 0.25), 9) AS rel_q25, round(quantile_cont(d / l::DOUBLE, 0.5), 9) AS rel_median, round(quantile_cont(d / l::DOUBLE, 0.75), 9) AS rel_q75 FROM d GROUP BY label""")
def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir).select("label", F.levenshtein("real_name", "fraudulent_name").alias("d"), F.length("real_name").alias("l"))
    out = metrics.distance_summary(d, "d", "l", ["label"])
    return out.select("label", "n", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


_RATES = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
    round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 0), 9) AS accuracy,
    round((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2, 9) AS balanced_accuracy,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1,
    round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS mcc"""


def _rated(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")], *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "f1", "mcc")])


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn,
    count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored GROUP BY lang) SELECT lang, {_RATES} FROM c""")
def confusion_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(metrics.confusion(scored(spark, sf_dir), 0.5, ["lang"]), "lang")


@query(f"""WITH {SCORED_SQL} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 9) AS roc_auc, round(0.5 + abs(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)::DOUBLE - 0.5), 9) AS predictability
    FROM (SELECT score FROM scored WHERE label = 1) p, (SELECT score FROM scored WHERE label = 0) n""")
def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    auc = metrics.roc_auc(scored(spark, sf_dir))
    return auc.select(F.round("roc_auc", 9).alias("roc_auc"), F.round(metrics.predictability(F.col("roc_auc")), 9).alias("predictability"))


_CURVE = f"""{SCORED_SQL}, b AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
    c AS (SELECT *, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp, (SELECT count(*) FROM scored WHERE label = 1) AS ap, (SELECT count(*) FROM scored WHERE label = 0) AS an FROM b)"""


@query(f"WITH {_CURVE} SELECT round(sum(pos / ap::DOUBLE * (tp / (tp + fp)::DOUBLE)), 9) AS average_precision FROM c")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {_CURVE} SELECT score AS threshold, round(2 * tp / (tp + fp + ap)::DOUBLE, 12) AS f1 FROM c ORDER BY f1 DESC, score LIMIT 1")
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1(scored(spark, sf_dir))


_FIT = f"""{_CURVE}, m AS (SELECT coalesce((score + lead(score) OVER (ORDER BY score DESC)) / 2, min(score) OVER () - 1e-9) AS threshold, tp, fp, ap, an FROM c
    UNION ALL SELECT max(score) + 1e-9, 0, 0, max(ap), max(an) FROM c),
    s AS (SELECT threshold, round((tp / ap::DOUBLE + (an - fp) / an::DOUBLE) / 2, 9) AS balanced_accuracy, round(2 * tp / (tp + fp + ap)::DOUBLE, 9) AS f1 FROM m),
    best AS (SELECT * FROM s ORDER BY balanced_accuracy DESC, f1 DESC, threshold LIMIT 1)"""


@query(f"WITH {_FIT} SELECT round(threshold, 12) AS threshold, balanced_accuracy, f1 FROM best")
def fit_threshold_ba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fit_threshold(scored(spark, sf_dir)).withColumn("threshold", F.round("threshold", 12))


@query(f"""WITH {_FIT}, a AS (SELECT 'before' AS stage, score, label FROM scored UNION ALL SELECT 'after', sqrt(score), label FROM scored), t AS (SELECT stage, score >= threshold AS up, label FROM a, best),
    n AS (SELECT stage, count(*) FILTER (up AND label = 1) AS tp, count(*) FILTER (up AND label = 0) AS fp, count(*) FILTER (NOT up AND label = 0) AS tn, count(*) FILTER (NOT up AND label = 1) AS fn FROM t GROUP BY stage) SELECT stage, {_RATES} FROM n""")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = scored(spark, sf_dir)
    return _rated(metrics.threshold_on_before(before, before.withColumn("score", F.sqrt("score"))), "stage")


@query("""WITH r AS (SELECT p_type AS source, p_brand AS replacement, p_retailprice AS s FROM part) SELECT source, replacement, quantile_cont(s, 0) AS score_min, round(quantile_cont(s, 0.25), 6) AS score_q25, round(quantile_cont(s, 0.5), 6) AS score_median, quantile_cont(s, 1) AS score_max,
    round(avg(s), 6) AS score_mean, count(s) AS num_scored_examples, count(s) >= 20 AS meets_min_support FROM r GROUP BY ALL""")
def rule_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("source"), F.col("p_brand").alias("replacement"), F.col("p_retailprice").alias("s"))
    out = metrics.rule_quantiles(rows, ["source", "replacement"], "s", 20)
    return out.withColumns({c: F.round(c, 6) for c in ("score_q25", "score_median", "score_mean")})


@query("SELECT n.n_name, count(c.c_custkey) AS support, arg_min(c.c_name, c.c_custkey) AS first_example FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("c_nationkey"))
    return metrics.rule_support(rules, table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name").select("n_name", "support", "first_example")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) SELECT user_id, n AS times, event_type FROM r WHERE k = 1""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, c_acctbal FROM r WHERE k = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_custkey", "c_acctbal")
    return ranking.first_per_key(rows, ["c_nationkey"], [-F.col("c_acctbal"), F.col("c_custkey")])


@query("""WITH l AS (SELECT unnest([struct_pack(axis := 'l_returnflag', level := l_returnflag), struct_pack(axis := 'l_linestatus', level := l_linestatus), struct_pack(axis := 'l_linenumber', level := l_linenumber::VARCHAR)], recursive := true), l_quantity AS v FROM lineitem)
    SELECT axis, level, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most FROM l GROUP BY axis, level""")
def axis_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.axis_marginals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("""SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY 1""")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return p.select("o_orderpriority", *[F.round(s, 4).alias(s.lower()) for s in ("F", "O", "P")])


@query("""SELECT CASE WHEN l_linenumber < ceil(l_quantity / 10) THEN 'overlapping' ELSE 'non-overlapping' END AS overlap, CAST(ceil(l_quantity / 10) AS BIGINT) AS width, CAST(l_linenumber AS BIGINT) AS stride,
    CAST(round_even((1 - l_linenumber / ceil(l_quantity / 10)::DOUBLE) * 100, 0) AS BIGINT) AS percent, count(*) AS n, round(avg(l_discount), 9) AS mean, round(stddev_samp(l_discount), 9) AS sample_std FROM lineitem GROUP BY ALL""")
def stride_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, stride = F.ceil(F.col("l_quantity") / 10), F.col("l_linenumber")
    groups = [X.overlap_type(stride, width).alias("overlap"), width.cast("long").alias("width"), stride.cast("long").alias("stride"), X.overlap_percent(stride, width).cast("long").alias("percent")]
    return table(spark, sf_dir, "lineitem").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 9).alias("mean"), F.round(F.stddev_samp("l_discount"), 9).alias("sample_std"))


@query("SELECT count(*) - count(DISTINCT p_name) AS duplicates FROM part")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplicates(table(spark, sf_dir, "part"), ["p_name"])


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y, (SELECT count(*) FROM a JOIN b USING (k)) AS z)
    SELECT x AS left_size, y AS right_size, z AS shared, round(z / x::DOUBLE, 9) AS left_share, round(z / y::DOUBLE, 9) AS right_share, x = z AND y = z AS equal_sets FROM s""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    out = metrics.overlap_report(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"), "l_partkey")
    return out.withColumn("left_share", F.round("left_share", 9)).withColumn("right_share", F.round("right_share", 9))


@query(f"""WITH {SCORED_SQL}, v AS (SELECT 'raw' AS version, score, label FROM scored UNION ALL SELECT 'squared', score * score, label FROM scored)
    SELECT version, count(*) AS n_rows, count(*) FILTER (label = 1) AS positive, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.25), 9) AS q25, round(stddev_pop(score), 9) AS std FROM v GROUP BY version""")
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("score", "label")
    v = ranking.stack_by_name(s.withColumn("version", F.lit("raw")), s.withColumn("score", F.col("score") * F.col("score")).withColumn("version", F.lit("squared")))
    out = v.groupBy("version").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("positive"), *metrics.stats(F.col("score")))
    return out.select("version", "n_rows", "positive", *[F.round(c, 9).alias(c) for c in ("mean", "q25", "std")])


@query("""WITH d AS (SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, * FROM customer) SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, rank, round(c_acctbal - 0.01 * (rank - 1), 6) AS penalised FROM d WHERE rank <= 3""")
def penalised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_custkey", "c_acctbal")
    top = ranking.penalised_top(rows, ["c_nationkey"], "c_acctbal", [F.col("c_custkey")], 3)
    return top.select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"), F.round("penalised", 6).alias("penalised"))


@query("""SELECT p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND b.p_partkey % 97 <= a.p_partkey % 97
    AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size OR b.p_partkey % 97 < a.p_partkey % 97))""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", (F.col("p_partkey") % 97).alias("m"))
    return ranking.pareto_frontier(rows, ["p_retailprice"], ["p_size", "m"]).select("p_partkey", "p_retailprice", F.col("p_size").cast("long").alias("p_size"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_totalprice < 400000)::INT, CAST(round_even(o_totalprice / 100000 / 0.01, 0) AS BIGINT), o_orderkey LIMIT 1""")
def bucketed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 100000).alias("b"))
    return ranking.bucketed_choice(rows, F.col("o_totalprice") >= 400000, ["b"], [F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("""WITH o AS (SELECT user_id, event_type, value, ts, 0 AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, value, ts, 1 FROM events WHERE event_id % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, n DESC) AS k FROM o) SELECT user_id, event_type, value FROM r WHERE k = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", "event_id")
    merged = registry.upsert(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id"), ["user_id"], "ts")
    return merged.select("user_id", "event_type", "value")


@query("SELECT p.p_partkey, p.p_name, length(p.p_name)::DOUBLE AS score FROM part p")
def score_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    memo = asked.select("p_name").distinct().filter(F.length("p_name") % 2 == 0).withColumn("score", F.length("p_name").cast("double"))
    got, _, _ = registry.scored_with_memo(asked, memo, ["p_name"], lambda df: df.withColumn("score", F.length("p_name").cast("double")))
    return got.select("p_partkey", "p_name", "score")


@query(f"""WITH {SCORED_SQL}, t AS (SELECT greatest(0.3, quantile_cont(score, 0.2)) AS t FROM scored WHERE label = 1) SELECT doc_id, score, CAST(label AS BIGINT) AS label FROM scored, t WHERE label = 0 OR score > t""")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = registry.above_threshold(scored(spark, sf_dir), 0.3, 0.2)
    return kept.select("doc_id", "score", F.col("label").cast("long").alias("label"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN lower(c_name) ELSE c_name END AS fraudulent_name FROM customer WHERE c_nationkey < 10 OR c_mktsegment = 'BUILDING'""")
def replace_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.col("c_name").alias("fraudulent_name"), "c_mktsegment", "c_nationkey")
    new = rows.filter("c_nationkey < 10").select("row_idx", F.lower("fraudulent_name").alias("generated"))
    return registry.replaced(rows, new, F.col("c_mktsegment") == "BUILDING").select(F.col("row_idx").alias("c_custkey"), "fraudulent_name")


@query("""WITH d AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'keep' ELSE 'discard' END AS decision, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_type = 'purchase' THEN 'keep' ELSE 'discard' END DESC) AS k FROM events),
    c AS (SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, coalesce(d.decision, 'open') AS s FROM customer c LEFT JOIN d ON d.user_id = c.c_custkey AND d.k = 1)
    SELECT c_custkey, CASE WHEN s <> 'open' THEN s WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_acctbal >= 5000 THEN 'keep' ELSE 'discard' END ELSE 'open' END AS review_state FROM c""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"), F.col("c_acctbal").alias("score"))
    told = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "purchase", "keep").otherwise("discard").alias("decision"), F.col("ts").alias("at"))
    thresholds = spark.createDataFrame([("BUILDING", 5000.0)], "source string, keep_threshold double")
    return registry.auto_labelled(registry.reviewed(rules, told, ["c_custkey"]), "source", thresholds).select("c_custkey", "review_state")


@query("""WITH s AS (SELECT l_partkey, bool_and(l_discount >= 0.01) AS a, bool_or(l_tax >= 0.07) AS b, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, a AND b AND n = 1 AS accepted FROM s""")
def screen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_discount").alias("clean"), F.col("l_tax").alias("attack"), F.col("l_linestatus").alias("label"))
    return registry.screened(rows, ["l_partkey"], 0.01, 0.07).select("l_partkey", "accepted")


# Sampling and sets


@query("""WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_custkey), c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS a FROM customer)
    SELECT c_custkey, c_mktsegment, n <= CASE WHEN a < 2 THEN 0 ELSE greatest(1, round_even(a * 0.1, 0)) END AS held_out FROM h""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.holdout(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.1, 7)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('11|' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, 11, "o_orderkey")


@query("""WITH h AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('3|' || o_orderkey), o_orderkey) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM h WHERE n <= 1000 // (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_cap(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 1000, 3)


@query("""WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('5|' || c_custkey)) AS n, count(*) OVER () AS a FROM customer)
    SELECT c_custkey, CASE WHEN n <= round_even(a * 0.8, 0) THEN 'train' WHEN n <= round_even(a * 0.8, 0) + round_even(a * 0.1, 0) THEN 'test' ELSE 'validation' END AS pool FROM h""")
def name_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.name_pools(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"train": 0.8, "test": 0.1, "validation": 0.1}, 5)


@query("""SELECT l_partkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS l_returnflag FROM lineitem GROUP BY l_partkey""")
def disjoint_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.disjoint_pools(table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag"), "l_partkey", "l_returnflag", ["R", "A", "N"])


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distinct_in_order(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query(f"""WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal / 1000 AS score, {_UNIFORM.format("'13|' || c_nationkey || '|' || c_custkey")} AS u FROM customer),
    k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score / 2.0 - ln(-ln(u)) DESC) AS n FROM r) SELECT c_nationkey, c_custkey, round(score, 9) AS score FROM k WHERE n = 1""")
def softmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 1000).alias("score"))
    return sampling.softmax_choice(rows, ["c_nationkey"], "c_custkey", "score", 2.0, 13).withColumn("score", F.round("score", 9))


@query(f"""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), d AS (SELECT i AS draw, floor({_UNIFORM.format("'17|' || i")} * (SELECT count(*) FROM customer)) AS n FROM range(500) t(i))
    SELECT draw, c_custkey FROM d JOIN c USING (n)""")
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_with_replacement(table(spark, sf_dir, "customer").select("c_custkey"), 500, 17, "c_custkey")


# Assignment and checks


@query("""WITH RECURSIVE c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n, ['k' || c_custkey * 7 % 701, 'k' || c_custkey * 11 % 701, 'k' || c_custkey * 13 % 701] AS w FROM customer),
    g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::BIGINT AS row_idx, NULL::VARCHAR AS key, NULL::INTEGER AS pref
    UNION ALL SELECT c.n, CASE WHEN x.p > 0 THEN list_append(g.used, c.w[x.p]) ELSE g.used END, c.c_custkey, CASE WHEN x.p > 0 THEN c.w[x.p] END, CASE WHEN x.p > 0 THEN x.p - 1 END::INTEGER
        FROM g JOIN c ON c.n = g.n + 1, LATERAL (SELECT coalesce(list_position(list_transform(c.w, lambda k: NOT list_contains(g.used, k)), true), 0)::INTEGER AS p) x)
    SELECT row_idx, key, pref FROM g WHERE key IS NOT NULL""")
def greedy_unique_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in turn take the first free of three part keys."""
    wishes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.posexplode(F.array(*[F.concat(F.lit("k"), (F.col("c_custkey") * m % 701).cast("string")) for m in (7, 11, 13)])).alias("pref", "key"))
    return assignment.assign_unique(wishes)


@query()
def matched_negative_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("real_name"), F.col("fraudulent_name")
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    rows = pairs(spark, sf_dir).withColumn("m", X.match_bin(D.levenshtein_similarity(a, b), ratio)).select(F.col("real_name").alias("id"), "label", F.col("m.similarity").alias("b1"), F.col("m.length").alias("b2"))
    rows = materialize(rows, "bins")
    split = F.when(F.pmod(F.xxhash64("id"), F.lit(10)) == 0, "test").otherwise("train")
    told = assignment.matched_negatives(rows.filter("label = 0").drop("label"), rows.filter("label = 1").withColumn("split", split))
    return told.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"))


@query(f"""WITH {PAIRS_SQL} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS bad_labels, count(*) FILTER (fraudulent_name = '' OR real_name = '') AS empty_names, count(*) FILTER (contains(fraudulent_name, '.com') OR contains(real_name, '.com')) AS dot_com FROM pairs""")
def quality_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.pair_violations(pairs(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1) SELECT count(*) FILTER (n > 1) AS shared_keys FROM s""")
def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.disjoint(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus")


@query()
def rf_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    both = names.select("name", spoof(F.col("name")).alias("fraudulent_name"), F.lit(1.0).alias("label")).unionByName(names.select("name", F.reverse("name").alias("fraudulent_name"), F.lit(0.0).alias("label")))
    rows = both.select(F.col("name").alias("real_name"), "fraudulent_name", "label", F.concat_ws("|", "name", "fraudulent_name").alias("id"))
    return forest.held_out_scores(rows, "id", share=0.1, trees=400).select("real_name", "fraudulent_name", "label", F.round("score", 6).alias("score"))


_NAMED = """n AS (SELECT name, lower(name) AS key, min(row_idx) AS row_idx FROM (SELECT p_name AS name, p_partkey AS row_idx FROM part UNION ALL SELECT p_type || ' ' || p_brand, p_partkey + 1000000 FROM part) GROUP BY name)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("row_idx")).unionByName(part.select(F.concat_ws(" ", "p_type", "p_brand").alias("name"), (F.col("p_partkey") + 1000000).alias("row_idx")))
    return both.groupBy("name").agg(F.min("row_idx").alias("row_idx")).withColumn("key", F.lower("name"))


@query(f"""WITH {_NAMED}, f AS (SELECT key, min(name) AS name FROM n WHERE name <> '' AND NOT contains(lower(name), '.com') GROUP BY key),
    a AS (SELECT name, key, row_idx, CASE WHEN {_UNIFORM.format("'0neg_mix12|' || row_idx")} < 0.65 THEN 2 ELSE 1 END AS goal FROM n),
    p AS (SELECT a.row_idx, a.name, a.goal, f.name AS r, f.key <> a.key AS other, levenshtein(a.name, f.name) AS d, abs(length(a.name) - length(f.name)) AS w FROM a, f),
    s AS (SELECT *, CASE WHEN d <= 4 AND w <= 5 THEN 1 WHEN d <= 6 AND w <= 8 THEN 2 WHEN d <= 10 AND w <= 12 THEN 3 WHEN d <= 64 AND w <= 64 THEN 4 END AS step FROM p),
    m AS (SELECT *, min(step) OVER (PARTITION BY row_idx) AS least FROM s WHERE step IS NOT NULL AND other),
    u AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY d, length(r), r) AS i FROM m WHERE step = least),
    e AS (SELECT *, bool_or(d = goal) OVER (PARTITION BY row_idx) AS exact FROM u WHERE i <= 64),
    k AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY CASE WHEN exact THEN i ELSE 0 END, abs(d - goal), d, r) - 1 AS j FROM e WHERE d = goal OR NOT exact),
    c AS (SELECT *, least(32, count(*) OVER (PARTITION BY row_idx)) AS size FROM k)
    SELECT row_idx, name, r AS neighbor, CAST(d AS BIGINT) AS distance, CASE WHEN exact THEN 'exact_target' ELSE 'nearest_available' END AS mode FROM c WHERE j = CAST(floor({_UNIFORM.format("'0|' || row_idx")} * size) AS BIGINT)""")
def expanding_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _named(spark, sf_dir)
    made = datasets.expanding_negatives(datasets.goals(names, "neg_mix12"), names)
    return made.select("row_idx", "name", "neighbor", F.col("distance").cast("long").alias("distance"), "mode")


@query()
def distance_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives under three policies of distances, compared; tested against brute force."""
    names = _named(spark, sf_dir)
    return datasets.distance_trials(names, names).select("policy", F.col("distance").cast("long").alias("distance"), "mode", "n")


@query()
def positives_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many positives as there are document tokens, by visits over a cycling pool; tested against brute force."""
    names = token_rows(spark, sf_dir)
    pool = metrics.running_totals(names.withColumn("_one", F.lit(1)), "name", ["_one"]).select("name", "key", (F.col("cum__one") - 1).alias("place"))
    made = materialize(generators.distinct_variants(generators.candidate_edits(names.select("name"), text_queries.rule_table(spark))).withColumn("operations", F.lit(None).cast("string")), "variants")
    every = [generators.ranked_variants(made, p).withColumn("preferred", F.lit(p)) for p in (1, 2)]
    variants = every[0].unionByName(every[1]).select("name", "preferred", "rank", "generated", F.lower("generated").alias("key"))
    made = datasets.positives_to_count(pool, variants, names.count())
    return made.select("row_idx", "name", F.col("preferred").cast("long").alias("preferred"), "generated")


@query()
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest free neighbor of each name, else one like a positive in its features; tested against brute force."""
    names = _named(spark, sf_dir)
    near = similarity_join.nearest_names(names, names, k=2).select(F.col("target").alias("name"), "neighbor", F.lower("neighbor").alias("neighbor_key"), "rank")

    def featured(pairs: DataFrame) -> DataFrame:
        a, b = F.col("name"), F.col("candidate")
        return pairs.withColumn("positionwise", D.positionwise(a, b)).withColumn("shared", D.shared_characters(a, b)).withColumn("distance", F.levenshtein(a, b).cast("double"))

    positives = featured(names.select("name", spoof(F.col("name")).alias("candidate"), F.col("row_idx").alias("id")))
    return datasets.hard_negatives(names, near, names, positives, ["positionwise", "shared"], featured).select("row_idx", "name", "neighbor", "mode")


@query("""WITH r AS (SELECT substr(p_name, 1, 1) AS s, substr(p_type, 2, 1) AS t, p_retailprice / 1000 AS v, p_size AS c, CASE WHEN p_size % 3 = 0 THEN p_size / 10.0 END::DOUBLE AS q, 'ranked' AS source, 1 AS place, CASE WHEN p_size % 7 = 0 THEN 'discard' ELSE 'keep' END AS label FROM part
    UNION ALL SELECT lower(substr(p_type, 1, 1)), substr(p_brand, 7, 1), NULL, NULL, NULL, 'manual_user', 0, 'keep' FROM part),
    k AS (SELECT *, v IS NULL AS no_v, coalesce(v, 0) * 10 + least(coalesce(c, 0), 10) + CASE WHEN q IS NOT NULL THEN q * 20 WHEN starts_with(source, 'manual_user') THEN 35 ELSE 0 END AS score FROM r WHERE label = 'keep' AND length(s) = 1 AND length(t) = 1 AND s <> t AND NOT (s = 'a' AND t = 'T')),
    b AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY score DESC, place) AS n FROM k)
    SELECT s AS source_character, t AS replacement_character, source, printf('U+%04X', unicode(t)) AS replacement_codepoint, round(score, 6) AS generation_score FROM b WHERE n = 1 AND score >= 15""")
def combined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    manual = part.select(F.lower(F.substring("p_type", 1, 1)).alias("source_character"), F.substring("p_brand", 7, 1).alias("replacement_character"))
    ranked = part.select(
        F.substring("p_name", 1, 1).alias("real_span"), F.substring("p_type", 2, 1).alias("candidate_span"), (F.col("p_retailprice") / 1000).alias("visual_similarity_score"), F.col("p_size").alias("ocr_attack_contexts"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 10).alias("legit_q25"), F.when(F.col("p_size") % 7 == 0, "discard").otherwise("keep").alias("review_label"),
    )
    removed = spark.createDataFrame([("a", "T")], "source_character string, replacement_character string")
    rules = datasets.combined_rules([(manual, "manual_user"), (ranked, "ranked")], removed, 15.0)
    return rules.select("source_character", "replacement_character", "source", "replacement_codepoint", F.round("generation_score", 6).alias("generation_score"))


@query("""WITH r AS (SELECT substr(p_name, 1, 1) AS s, CASE WHEN p_size % 2 = 0 THEN p_brand END AS t, p_size AS k, p_retailprice AS v FROM part)
    SELECT s AS source_character, t AS replacement_character FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, v DESC, t) AS n FROM r WHERE t IS NOT NULL) WHERE n = 1""")
def first_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select(F.substring("p_name", 1, 1).alias("source_character"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("replacement_character"), F.col("p_size").alias("source_rank"), F.col("p_retailprice").alias("visual_similarity_score"))
    return datasets.first_replacements(rules)


@query("SELECT o_orderkey, CASE WHEN try_cast(trim(substr(o_orderpriority, 1, 1)) AS DOUBLE) IN (0, 1) THEN try_cast(trim(substr(o_orderpriority, 1, 1)) AS DOUBLE) END AS label FROM orders")
def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.binary_label(F.substring("o_orderpriority", 1, 1)).alias("label"))


# Streaming extension


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a streaming query that runs over the table until nothing is new."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    counted = streams.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour")
    path = new_path(spark, "windowed")
    q = counted.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/counts")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/counts").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) = 0 THEN -1.0 ELSE 5.0 * len(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = substr(reverse(p_name), i, 1))) / length(p_name) - 1 END::DOUBLE AS score FROM part""")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = scoring.batch_scorer(scoring.text_scorer)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("real_name"), F.reverse("p_name").alias("fraudulent_name"))
    done = scoring.score_distinct(rows, ["real_name", "fraudulent_name"], scorer(F.col("real_name"), F.col("fraudulent_name")))
    return done.select("p_partkey", "score")


@query("""WITH r AS (SELECT lower(substr(p_name, 1, 1)) AS a, lower(substr(p_type, 1, 1)) AS b, least(1.0, greatest(0.0, (p_size - 5) / 40.0))::DOUBLE AS s FROM part), d AS (SELECT a AS l, b AS r, s FROM r WHERE a <> b UNION ALL SELECT b, a, s FROM r WHERE a <> b)
    SELECT l AS "left", r AS "right", round(max(s), 9) AS similarity FROM d GROUP BY l, r""")
def symmetric_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select(F.substring("p_name", 1, 1).alias("source"), F.substring("p_type", 1, 1).alias("replacement"), ((F.col("p_size") - 5) / 40.0).alias("score"))
    return scoring.symmetric_confusions(rules).withColumn("similarity", F.round("similarity", 9))


@query("""SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS before, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS after,
    max(CASE WHEN l_linenumber = 2 THEN l_quantity END) - max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS delta FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey""")
def example_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "before").otherwise("after").alias("stage"), F.col("l_quantity").alias("score"))
    return scoring.before_and_after(rows, ["l_orderkey"])


@query(f"WITH {PAIRS_SQL} SELECT CAST(levenshtein(real_name, fraudulent_name) AS BIGINT) AS distance, count(*) AS n FROM pairs GROUP BY 1")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.histogram(pairs(spark, sf_dir).select(F.levenshtein("real_name", "fraudulent_name").cast("long").alias("distance")), "distance")


@query("SELECT count(*) FILTER (starts_with(o_orderpriority, '1')) AS n_1, count(*) FILTER (starts_with(o_orderpriority, '5-L')) AS \"n_5-L\" FROM orders")
def mode_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mode_counts(table(spark, sf_dir, "orders"), "o_orderpriority", ["1", "5-L"])


@query("""WITH c AS (SELECT c_custkey AS run, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS pooling, CASE WHEN c_nationkey % 4 = 0 THEN 'n/a' END AS bad, c_acctbal AS width FROM customer),
    l AS (SELECT user_id AS run, event_id AS epoch, CASE WHEN event_type IN ('purchase', 'click') THEN value END AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    b AS (SELECT run, count(*) AS n_rows, max(m) AS best, arg_min(epoch, struct_pack(a := -m, b := epoch)) FILTER (m IS NOT NULL) AS best_at, CAST(sum(k) AS BIGINT) AS k FROM l GROUP BY run)
    SELECT run, n_rows, best, best_at, coalesce(pooling, 'unknown') AS pooling, CASE WHEN bad IS NULL THEN width ELSE -1.0 END::DOUBLE AS slice_width, k FROM c JOIN b USING (run)""")
def run_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer as a run: a configuration of changing fields, and a log whose rows have the metric for some events only."""
    customer, events = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    model = F.when(F.col("c_nationkey") % 3 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("pooling")).alias("model"))))
    width = F.when(F.col("c_nationkey") % 4 == 0, F.lit('"n/a"')).otherwise(F.col("c_acctbal").cast("string"))
    config = F.concat(F.expr("regexp_replace({0}, '}}$', '')".format("m")), F.when(F.col("m") == "{}", "").otherwise(","), F.lit('"slicing":{"slice_width":'), width, F.lit("}}"))
    configs = customer.withColumn("m", model).select(F.col("c_custkey").alias("run"), F.parse_json(config).alias("config"))
    metric = F.when(F.col("event_type").isin("purchase", "click"), F.concat(F.lit(',"val_auc":'), F.col("value").cast("string"))).otherwise(F.concat(F.lit(',"'), "event_type", F.lit('":'), F.col("value").cast("string")))
    logs = events.select(F.col("user_id").alias("run"), F.parse_json(F.concat(F.lit('{"epoch":'), F.col("event_id").cast("string"), metric, F.lit(',"props":'), "props", F.lit("}"))).alias("row"))
    told = runs.summarized(configs, logs, {"pooling": ("$.model.pooling", "string", "unknown"), "slice_width": ("$.slicing.slice_width", "double", -1.0)})
    k = logs.groupBy("run").agg(F.sum(F.try_variant_get("row", "$.props.k", "long")).alias("k"))
    return told.join(k, "run")
