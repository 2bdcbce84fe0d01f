"""Queries over text functions, distances and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import distance as D
from simloom.functions import text as X
from simloom.operators import generators as G
from simloom.operators import sampling
from simloom.plans.inputs import PAIRS_SQL, TOKENS_SQL, pairs, token_rows, tokens
from simloom.plans.registry import query
from simloom.storage import table

_WIDE = "concat('  ', c_name, ' .c.comom', c_mktsegment, '.COM.com.com ')"
_CLEAN = "regexp_replace(lower({}), '\\s+', '', 'g')"
_FIX = "trim(replace(replace(replace(replace(replace({}, '.com', ''), '.com', ''), '.com', ''), '.com', ''), '.com', ''), '.')"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_WIDE).alias("raw"))


@query(f"SELECT c_custkey, regexp_replace({_CLEAN.format(_WIDE)}, '(\\.*\\.com)+$', '') AS cleaned FROM customer")
def clean_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select("c_custkey", X.clean_suffix(F.col("raw")).alias("cleaned"))


@query(f"SELECT c_custkey, {_FIX.format(_CLEAN.format(_WIDE))} AS cleaned FROM customer")
def clean_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select("c_custkey", X.clean_anywhere(F.col("raw")).alias("cleaned"))


@query(f"SELECT c_custkey, {_FIX.format('replace(lower(trim(' + _WIDE + ')), chr(32), chr(0)[1:0])')} AS cleaned FROM customer".replace("chr(0)[1:0]", "''"))
def clean_space_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select("c_custkey", X.clean_space_only(F.col("raw")).alias("cleaned"))


@query(f"SELECT c_custkey, lower({_FIX.format(_CLEAN.format(_WIDE))}) AS key FROM customer")
def uniqueness_key_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select("c_custkey", X.uniqueness_key_ascii(F.col("raw")).alias("key"))


@query()
def uniqueness_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", X.uniqueness_key(F.col("url")).alias("key"), X.canonical_ocr(F.col("url"), hyphen=True).alias("ocr"))
    return urls


@query("SELECT page_id, translate(regexp_replace(url, '\\s', '', 'g'), '013457', 'oleast') AS normalized FROM pages")
def char_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = X.merged_table({"0": "x", "1": "l", "3": "e"}, {"0": "o", "4": "a", "5": "s", "7": "t"})
    return table(spark, sf_dir, "pages").select("page_id", X.char_normalize(F.col("url"), source, target).alias("normalized"))


@query("SELECT page_id, regexp_replace(translate(lower(url), '013457', 'olesat'), '[^a-z0-9-]', '', 'g') AS normalized, regexp_replace(translate(lower(url), '013457', 'olesat'), '[^a-z0-9-]', '', 'g') || '12fi' AS with_ligatures FROM pages")
def table_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the character tables, and by what NFKD makes of characters that no table has."""
    normalize = X.table_normalizer({"0": "x", "1": "l", "3": "e"}, {"0": "o", "4": "s", "5": "a", "7": "t"})
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", normalize(url).alias("normalized"), normalize(F.concat(url, F.lit(" ½ \u3000ﬁ漢"))).alias("with_ligatures"))


@query(f"""WITH {TOKENS_SQL}, n AS (SELECT unnest([3, 4, 5, 6]) AS n),
    g AS (SELECT '<' || name || '>' AS m, n FROM tokens, n),
    x AS (SELECT substr(m, i, n) AS gram FROM (SELECT m, n, unnest(range(1, length(m) - n + 2)) AS i FROM g))
    SELECT gram, count(*) AS n FROM x GROUP BY gram""")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select(F.explode(X.char_ngrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT name, list_filter(range(0, length(name)), lambda i: substr(name, i + 1, 2) = 'th') AS x FROM tokens)
    SELECT name, array_to_string(x, ',') AS starts FROM s WHERE len(x) > 1""")
def find_starts_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens(spark, sf_dir).withColumn("x", X.find_starts(F.col("name"), F.lit("th"))).filter(F.size("x") > 1)
    return found.select("name", F.array_join(F.col("x").cast("array<string>"), ",").alias("starts"))


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT name, string_split(name, 'nn') AS parts FROM tokens WHERE contains(name, 'nn'))
    SELECT name, array_to_string(list_transform(range(1, len(parts)), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 2 * (k - 1) AS BIGINT)), ',') AS starts FROM p""")
def find_starts_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens(spark, sf_dir).filter(F.contains("name", F.lit("nn")))
    return found.select("name", F.array_join(X.find_starts_apart(F.col("name"), F.lit("nn")).cast("array<string>"), ",").alias("starts"))


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT name, strpos(name, 'm') AS m, strpos(name, 'o') AS o, contains(name, 'mo') AND strpos(name, 'mo') = strpos(name, 'm') AS meet FROM tokens WHERE contains(name, 'm') AND contains(name, 'o')),
    a AS (SELECT name, m, o, meet, CASE WHEN m < o THEN substr(name, 1, m - 1) || 'rn' || substr(name, m + 1) ELSE substr(name, 1, o - 1) || '0' || substr(name, o + 1) END AS one,
        CASE WHEN m < o THEN substr(name, 1, m - 1) || 'rn' || substr(name, m + 1, o - m - 1) || '0' || substr(name, o + 1) ELSE substr(name, 1, o - 1) || '0' || substr(name, o + 1, m - o - 1) || 'rn' || substr(name, m + 1) END AS two FROM p)
    SELECT name, CASE WHEN NOT meet THEN two END AS generated, CASE WHEN NOT meet THEN (least(m, o) - 1) || ',' || (greatest(m, o) - 1) END AS positions, CASE WHEN NOT meet THEN name || ',' || one END AS before, CASE WHEN NOT meet THEN one || ',' || two END AS after FROM a""")
def edit_apply_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits, given from right to left or otherwise; where m and o touch, a third one overlaps them and nothing is made."""
    one = "named_struct('priority', 1, 'negscore', -1.0D, 'position', instr(name, '{0}') - 1, 'replacement', '{1}', 'family', 'f', 'source', '{0}', 'score', 1.0D, 'operation', '{0}_to_{1}')"
    both = f"array({one.format('o', '0')}, {one.format('m', 'rn')})"
    edits = F.expr(f"if(instr(name, 'mo') > 0 AND instr(name, 'mo') = instr(name, 'm'), concat({both}, array({one.format('mo', 'nno')})), {both})").cast(f"array<{X.EDIT}>")
    done = tokens(spark, sf_dir).filter(F.contains("name", F.lit("m")) & F.contains("name", F.lit("o"))).withColumn("r", X.apply_edits(F.col("name"), edits))
    joined = lambda c: F.array_join(F.transform("r.operations", lambda o: o[c].cast("string")), ",")
    return done.select("name", F.col("r.generated").alias("generated"), joined("position").alias("positions"), joined("before").alias("before"), joined("after").alias("after"))


_LEV = "greatest(0.0, 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)::DOUBLE)"


@query(f"WITH {PAIRS_SQL} SELECT real_name, fraudulent_name, label, CAST(levenshtein(real_name, fraudulent_name) AS BIGINT) AS distance, round({_LEV.format('real_name', 'fraudulent_name')}, 6) AS similarity FROM pairs")
def lev_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("real_name"), F.col("fraudulent_name")
    return pairs(spark, sf_dir).select(a, b, "label", F.levenshtein(a, b).cast("long").alias("distance"), F.round(D.levenshtein_similarity(a, b), 6).alias("similarity"))


@query(f"WITH {PAIRS_SQL} SELECT real_name, fraudulent_name, label, CAST(damerau_levenshtein(real_name, fraudulent_name) AS BIGINT) AS distance FROM pairs")
def damerau_unrestricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("real_name"), F.col("fraudulent_name")
    return pairs(spark, sf_dir).select(a, b, "label", D.full_damerau_distance(a, b).alias("distance"))


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat_ws(" ", F.reverse("p_name"), F.split("p_name", " ")[0], "p_type").alias("b"))


@query()
def edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted Damerau, both position-weighted scores and the insert-delete token ratio."""
    a, b = F.col("a"), F.col("b")
    alike = {(x, y): s for p, q, s in (("m", "n", 0.6), ("o", "0", 0.95), ("l", "1", 0.9)) for x, y in ((p, q), (q, p))}
    return _part_pairs(spark, sf_dir).select("p_partkey", D.restricted_damerau_distance(a, b).alias("osa"), F.round(D.position_confusion_similarity(a, b), 6).alias("position_confusion"), F.round(D.position_visual_similarity(alike)(a, b), 6).alias("position_visual"), F.round(D.token_set_indel_ratio(a, b), 6).alias("token_set_indel"))


@query("""WITH t AS (SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+'))) AS x,
        list_sort(list_distinct(regexp_extract_all(lower(reverse(p_name) || ' ' || split_part(p_name, ' ', 1) || ' ' || p_type), '[a-z0-9_]+'))) AS y FROM part),
    s AS (SELECT p_partkey, x, y, list_sort(list_intersect(x, y)) AS i, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS l, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS r FROM t),
    j AS (SELECT p_partkey, array_to_string(i, ' ') AS b, array_to_string(list_concat(i, l), ' ') AS lc, array_to_string(list_concat(i, r), ' ') AS rc FROM s)
    SELECT p_partkey, round(greatest(""" + ", ".join(_LEV.format(p, q) for p, q in (("b", "lc"), ("b", "rc"), ("lc", "rc"))) + "), 6) AS similarity FROM j")
def token_set_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(D.token_set_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""WITH {PAIRS_SQL}, z AS (SELECT *, greatest(length(real_name), length(fraudulent_name)) AS n, least(length(real_name), length(fraudulent_name)) AS m FROM pairs),
    c AS (SELECT *, len(list_filter(range(1, m + 1), lambda i: substr(real_name, i, 1) = substr(fraudulent_name, i, 1))) AS same,
        list_distinct(string_split(real_name, '')) AS x, list_distinct(string_split(fraudulent_name, '')) AS y FROM z)
    SELECT real_name, fraudulent_name, label, round((0.65 * (same / n::DOUBLE) + 0.35 * (m / n::DOUBLE)) * (1 - 0.5 * ((n - m) / n::DOUBLE)), 6) AS score, CAST(n - m AS BIGINT) AS length_delta,
    round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS shared FROM c""")
def positionwise_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("real_name"), F.col("fraudulent_name")
    return pairs(spark, sf_dir).select(a, b, "label", F.round(D.positionwise(a, b), 6).alias("score"), D.length_delta(a, b).cast("long").alias("length_delta"), F.round(D.shared_characters(a, b), 6).alias("shared"))


@query(f"""WITH {PAIRS_SQL}, z AS (SELECT {_LEV.format('real_name', 'fraudulent_name')} AS s, least(length(real_name), length(fraudulent_name)) / greatest(length(real_name), length(fraudulent_name), 1)::DOUBLE AS r, label FROM pairs)
    SELECT CAST(round_even(s * 20, 0) AS BIGINT) AS b1, CAST(round_even(r * 10, 0) AS BIGINT) AS b2, label, count(*) AS n FROM z GROUP BY ALL""")
def match_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("real_name"), F.col("fraudulent_name")
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    bins = pairs(spark, sf_dir).select(X.match_bin(D.levenshtein_similarity(a, b), ratio).alias("m"), "label")
    return bins.groupBy(F.col("m.similarity").cast("long").alias("b1"), F.col("m.length").cast("long").alias("b2"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN length(text) <= 500 THEN 'short' WHEN length(text) <= 2000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(X.length_bucket(F.col("text"), 500, 2000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, (p_size % 100) / 100.0::DOUBLE AS g, p_retailprice / 1000 AS a, upper(CASE WHEN p_type = 'PROMO' THEN 'cyrillic small' WHEN p_type = 'SMALL' THEN 'greek small capital' ELSE p_type END) AS u FROM part)
    SELECT p_partkey, round(g * 100 - abs(a - 1) * 25 + least(greatest(g - 0.2, 0), 1) * 5 + CASE WHEN p_brand = 'Brand#1' THEN 100 WHEN contains(u, 'CYRILLIC') THEN 25 WHEN contains(u, 'GREEK') THEN 20 ELSE 0 END
        - CASE WHEN contains(u, 'SMALL CAPITAL') THEN 35 ELSE 0 END, 6) AS exact_score,
    round(g * 10 + least(p_size, 10) + CASE WHEN p_size > 10 THEN g * 20 WHEN starts_with(p_name, 'small') THEN 35 ELSE 0 END, 6) AS ocr_score,
    CASE WHEN g <= 0.2 THEN 'safe_hard' WHEN g >= 0.35 AND g <= 0.65 THEN 'ambiguous' ELSE 'ocr_easy' END AS bucket FROM r""")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = (F.col("p_size") % 100) / F.lit(100.0)
    name = F.when(F.col("p_type") == "PROMO", "cyrillic small").when(F.col("p_type") == "SMALL", "greek small capital").otherwise(F.col("p_type"))
    source = F.when(F.col("p_name").startswith("small"), "manual_user").otherwise("atlas")
    exact = X.exact_rule_score(g, F.col("p_retailprice") / 1000, g - 0.2, F.col("p_brand") == "Brand#1", name)
    ocr = X.ocr_rule_score(g, F.col("p_size"), F.when(F.col("p_size") > 10, g), source)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(exact, 6).alias("exact_score"), F.round(ocr, 6).alias("ocr_score"), X.difficulty_bucket(g).alias("bucket"))


@query("""WITH e AS (SELECT event_id, event_type, user_id % 3 AS m, ['x' || user_id % 3, '', event_type] AS a, CASE WHEN user_id % 3 > 0 THEN ['y', event_type] END AS b FROM events)
    SELECT event_id, array_to_string(list_filter(list_concat(a, coalesce(b, [])), lambda v: v <> '' AND v <> event_type), ',') AS outputs FROM e""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate outputs of a JSON map of models, in the order of the map, less empty ones and the source itself."""
    of = lambda *v: F.struct(F.array(*v).alias("candidate_outputs"))
    a, b = of(F.concat(F.lit("x"), F.col("user_id") % 3), F.lit(""), F.col("event_type")), of(F.lit("y"), F.col("event_type"))
    models = F.to_json(F.when(F.col("user_id") % 3 > 0, F.create_map(F.lit("a"), a, F.lit("b"), b)).otherwise(F.create_map(F.lit("a"), a)))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.candidate_outputs(models, F.col("event_type")), ",").alias("outputs"))


@query("""WITH h AS (SELECT n_name, sha256(n_name || '|' || n_regionkey) AS h FROM nation), b AS (SELECT n_name, list_reduce(list_transform(range(8, 0, -1), lambda k: substr(h, 2 * k - 1, 2)), lambda x, y: x || y) AS low_first FROM h)
    SELECT n_name, CAST(('0x' || low_first)::UBIGINT % 4294967295 AS BIGINT) AS seed FROM b""")
def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", X.stable_seed(F.col("n_name"), F.col("n_regionkey")).alias("seed"))


@query(f"""WITH {TOKENS_SQL}, i AS (SELECT name, unnest(range(2, length(name) - 1)) AS i FROM tokens WHERE length(name) >= 8)
    SELECT name, CAST(i AS BIGINT) AS swap_i, CAST(i + 1 AS BIGINT) AS swap_j, substr(name, 1, i) || substr(name, i + 2, 1) || substr(name, i + 1, 1) || substr(name, i + 3) AS swapped
    FROM i WHERE substr(name, i + 1, 1) <> substr(name, i + 2, 1)""")
def swap_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacent_swaps(tokens(spark, sf_dir)).select("name", F.col("swap_i").cast("long").alias("swap_i"), F.col("swap_j").cast("long").alias("swap_j"), "swapped")


@query("""WITH a AS (SELECT unnest(['mean', 'max', 'attention']) AS pooling), b AS (SELECT unnest([true, false]) AS trim), c AS (SELECT unnest([4, 8, 16, 32, 48, 64]) AS slice_width), d AS (SELECT unnest([1, 2]) AS stride_div)
    SELECT concat_ws('__', pooling, slice_width, greatest(1, slice_width // stride_div)) || '__' || lower(CAST(trim AS VARCHAR)) AS run, CAST(greatest(1, slice_width // stride_div) AS BIGINT) AS stride_px FROM a, b, c, d
    UNION ALL SELECT unnest(['mean__whole', 'max__whole']), NULL""")
def grid_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = G.design_grid(spark, {"pooling": ["mean", "max", "attention"], "trim": [True, False], "slice_width": [4, 8, 16, 32, 48, 64], "stride_div": [1, 2]})
    run = G.run_name(F.col("pooling"), F.col("slice_width"), F.col("stride_px"), F.col("trim"))
    whole = spark.createDataFrame([("mean__whole",), ("max__whole",)], "run string").withColumn("stride_px", F.lit(None).cast("long"))
    return grid.select(run.alias("run"), F.col("stride_px").cast("long").alias("stride_px")).unionByName(whole)


@query(f"WITH {PAIRS_SQL}, s AS (SELECT fraudulent_name AS name, label FROM pairs UNION ALL SELECT real_name, 0.0::DOUBLE FROM pairs) SELECT label, count(*) AS n, count(DISTINCT name) AS names FROM s GROUP BY label")
def pair_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_samples(pairs(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), w AS (SELECT vec_id, e, unnest(range(0, 49, 8)) AS i FROM e)
    SELECT vec_id, CAST(i AS BIGINT) AS start, round(list_sum(e[i + 1:i + 16]) / 16, 6) AS mean, round(list_max(e[i + 1:i + 16]), 6) AS most FROM w""")
def strip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(X.windows_of(F.col("embedding"), 16, 8)).alias("i", "w"))
    return w.select("vec_id", (F.col("i") * 8).cast("long").alias("start"), F.round(X.masked_mean(F.col("w"), F.lit(16)), 6).alias("mean"), F.round(X.masked_max(F.col("w"), F.lit(16)), 6).alias("most"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda v: v::DOUBLE) AS a, list_transform(embedding[33:42], lambda v: v::DOUBLE) AS l FROM embeddings),
    w AS (SELECT vec_id, a, list_transform(l, lambda v: exp(v - list_max(l))) AS w FROM e)
    SELECT vec_id, round(list_sum(a) / 10, 6) AS mean, round(list_inner_product(a, w) / list_sum(w), 6) AS attention FROM w""")
def masked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    padded = X.pad_to(F.slice(e, 1, 10), 12, 0.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.masked_mean(padded, F.lit(10)), 6).alias("mean"), F.round(X.masked_attention(padded, F.slice(e, 33, 32), F.lit(10)), 6).alias("attention"))


# Fixed rules of the generator queries.
RULES = {
    "multichar_forward": [{"source": "m", "replacement": "rn", "score": 4.0, "operation": "m_to_rn"}, {"source": "w", "replacement": "vv", "score": 3.5, "operation": "w_to_vv"}],
    "ocr": [{"source": "o", "replacement": "0", "score": 4.5, "operation": "o_to_0"}, {"source": "l", "replacement": "1", "score": 4.0, "operation": "l_to_1"}, {"source": "e", "replacement": "3", "score": 2.0, "operation": "e_to_3"}],
    "exact": [{"source": "i", "replacement": "і", "score": 5.0, "operation": "i_to_cyrillic_i"}],
}


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(f, r["source"], r["replacement"], r["score"], {"ocr": 10, "exact": 0}.get(f, 50), r["operation"]) for f, rs in RULES.items() for r in rs]
    return spark.createDataFrame(rows, "family string, source string, replacement string, score double, priority int, operation string")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("row_idx"))


@query()
def edit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.edit_variants(G.candidate_edits(_names(spark, sf_dir), rule_table(spark)))
    return made.select("name", "generated", F.to_json("operations").alias("operations_json"), F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query()
def generate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans, the ordered edit pipeline, fallbacks, capacity variants and the greedy assignment over all document tokens and part rows."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (-F.col("p_partkey")).alias("row_idx"))
    names = token_rows(spark, sf_dir).select("name", "row_idx").unionByName(part)
    params = {"short_max": 6, "medium_max": 10, "short": (1, 2), "medium": (0.1, 0.3), "long": (0.1, 0.3), "skew": "low", "least": 1, "most": 4, "caps": dict.fromkeys(G.FAMILIES, 2), "chances": dict.fromkeys(G.FAMILIES, 0.7), "ocr_share": 0.65, "replaceable": "olei", "seed": 42}
    made = G.generate_unique(names, G.count_plans(names, params), RULES)
    return made.select("row_idx", "name", "generated", F.to_json("operations").alias("operations_json"), F.col("phase").cast("long").alias("phase"))


_RULES_SQL = "rules AS (SELECT unnest(['m', 'w', 'o', 'l', 'e', 'i']) AS source, unnest(['rn', 'vv', '0', '1', '3', 'і']) AS replacement)"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), {_RULES_SQL},
    o AS (SELECT name, source, replacement, unnest(list_filter(range(0, length(name)), lambda i: substr(name, i + 1, 1) = source)) AS start FROM n, rules),
    g AS (SELECT *, substr(name, 1, start) || replacement || substr(name, start + 2) AS generated FROM o),
    s AS (SELECT *, {_LEV.format('name', "replace(generated, 'і', '~')")} AS similarity, sha256('0|' || name || '|' || generated) AS h, row_number() OVER (PARTITION BY name, generated ORDER BY start, source) AS k FROM g),
    r AS (SELECT *, CASE WHEN generated = name THEN 'same' WHEN similarity < 0.55 THEN 'low_similarity' WHEN k > 1 THEN 'duplicate' END AS reason FROM s),
    t AS (SELECT reason, similarity FROM (SELECT reason, similarity FROM r WHERE reason IS NULL ORDER BY h LIMIT 50) UNION ALL SELECT reason, similarity FROM r WHERE reason IS NOT NULL)
    SELECT reason, count(*) AS n, round(avg(similarity), 6) AS similarity FROM t GROUP BY reason""")
def retry_until_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return G.retried(names, rule_table(spark), 50).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("similarity"))


@query(f"""WITH {TOKENS_SQL}, c AS (SELECT name, unnest(range(0, length(name))) AS i FROM tokens), k AS (SELECT name, i, substr(name, i + 1, 1) AS c, row_number() OVER (PARTITION BY name ORDER BY sha256('7|' || name || '|' || i)) AS n FROM c WHERE substr(name, i + 1, 1) IN ('o', 'l', 'e')),
    g AS (SELECT c.name, string_agg(CASE WHEN k.n <= 2 THEN translate(k.c, 'ole', '013') ELSE substr(c.name, c.i + 1, 1) END, '' ORDER BY c.i) AS generated FROM c LEFT JOIN k ON k.name = c.name AND k.i = c.i GROUP BY c.name)
    SELECT name, generated, CAST(levenshtein(name, generated) AS BIGINT) AS distance FROM g WHERE generated <> name""")
def random_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).withColumn("id", F.col("name"))
    made = sampling.substituted_at_random(rows, {"o": "0", "l": "1", "e": "3"}, 2, seed=7)
    return made.select("name", "generated", F.levenshtein("name", "generated").cast("long").alias("distance"))
