import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from simloom.functions import distance as D
from simloom.functions import text as X


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (X.clean_suffix, "Shop.COM.com ", "shop"),
        (X.clean_suffix, "a.common", "a.common"),
        (X.clean_anywhere, "a.common", "amon"),
        (X.clean_anywhere, ".c.comom", ""),
        (X.clean_anywhere, "A b\tc.com", "abc"),
        (X.clean_space_only, " A b\tc.com ", "ab\tc"),
        (X.clean_anywhere, None, ""),
        (X.collapse_spaces, "  A  b\n c ", "a b c"),
        (X.uniqueness_key, "Ｓtraße.com", "strasse"),
        (X.canonical_ocr, "Ünï-Code 1", "unicode1"),
        (X.codepoint_label, "\U0001d5c5", "U+1D5C5"),
    ],
)
def test_cleaners(spark, f, text, want):
    assert one(spark, f(F.col("x")), x=text) == want


def test_suffix_rule_equals_the_loop(spark):
    def loop(s):
        s = "".join(s.lower().split())
        while s.endswith(".com"):
            s = s[:-4].rstrip(".")
        return s

    def anywhere(s):
        s = "".join(s.lower().split())
        while ".com" in s:
            s = s.replace(".com", "")
        return s.strip(".")

    rng = random.Random(1)
    texts = ["".join(rng.choice([".", ".com", "c", "o", "m", "A", " "]) for _ in range(rng.randrange(0, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.clean_suffix(F.col("x")).alias("s"), X.clean_anywhere(F.col("x")).alias("a")).collect()
    assert all(r.s == loop(r.x) and r.a == anywhere(r.x) for r in rows)


def test_starts(spark):
    assert one(spark, X.find_starts(F.col("x"), F.lit("aa")), x="aaa") == [0, 1]
    assert one(spark, X.find_starts_apart(F.col("x"), F.lit("aa")), x="aaaaa") == [0, 2]
    assert one(spark, X.find_starts(F.col("x"), F.lit("")), x="aaa") == []


def test_seed_equals_python(spark):
    want = int.from_bytes(hashlib.sha256(b"fallback|name|3").digest()[:8], "little") % (2**32 - 1)
    assert one(spark, X.stable_seed(F.lit("fallback"), F.col("x"), F.lit(3)), x="name") == want


def test_bins_round_half_to_even(spark):
    got = one(spark, X.match_bin(F.lit(0.625), F.lit(0.25)), x="")
    assert (got.similarity, got.length) == (12, 2)


def test_edits(spark):
    edit = "named_struct('priority', 1, 'negscore', -1.0D, 'position', {}, 'replacement', '{}', 'family', 'ocr', 'source', '{}', 'score', 1.0D, 'operation', 'x')"
    run = lambda *e: one(spark, X.apply_edits(F.col("x"), F.expr(f"array({', '.join(edit.format(*p) for p in e)})").cast(f"array<{X.EDIT}>")), x="warm")
    got = run((3, "rn", "m"), (0, "vv", "w"))
    assert got.generated == "vvarrn" and [(o.before, o.after) for o in got.operations] == [("warm", "vvarm"), ("vvarm", "vvarrn")]
    assert run((0, "x", "wa"), (1, "y", "a")) is None and run((0, "x", "z")) is None


def test_numbers(spark):
    assert one(spark, X.number_or(F.col("x"), F.lit(7.0)), x="nope") == 7 and one(spark, X.number_or(F.col("x"), F.lit(7.0)), x=float("nan")) == 7
    assert one(spark, X.safe_divide(F.col("x"), F.lit(0.0)), x=1.0) == 0 and one(spark, X.ratio_or_null(F.col("x"), F.lit(0.0)), x=1.0) is None
    rows = spark.createDataFrame([("b",), ("10",), ("A",), ("9",)], "x string").orderBy(X.mixed_sort_key(F.col("x"))).collect()
    assert [r.x for r in rows] == ["9", "10", "A", "b"]


def test_unicode_classes(spark):
    rows = spark.createDataFrame([(c,) for c in "aаαA3€"], "x string").select(X.character_class(F.col("x")).alias("c"), X.changed_by_nfkc(F.col("x")).alias("n")).collect()
    assert [r.c for r in rows] == ["latin", "cyrillic", "greek", None, "other", None] and not any(r.n for r in rows)


def test_damerau_variants():
    assert D.restricted_damerau("ca", "abc") == 3 and D.full_damerau("ca", "abc") == 2
    words = ["".join(p) for n in range(4) for p in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        assert D.full_damerau(a, b) <= D.restricted_damerau(a, b) <= max(len(a), len(b))
        assert D.full_damerau(a, b) == D.full_damerau(b, a)


def test_token_sets(spark):
    s = lambda a, b: one(spark, D.token_set_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert s("a b", "a b c") == 1 and s("", "") == 1 and s("b a", "A B") == 1
    assert D.token_set_indel("a b", "a b c") == 100 and D.token_set_indel("", "a") == 0 and D.token_set_indel("fuzzy wuzzy", "wuzzy fuzzy") == 100
    assert abs(D.token_set_indel("ab x", "ab y") - 100 * (1 - 2 / 6)) < 20


def test_position_scores(spark):
    assert D.position_confusion("abc", "abc") == 1 and D.position_confusion("", "") == 1
    assert D.position_confusion("google", "g0ogle") > D.position_confusion("google", "gxogle")
    assert D.position_confusion("xbcdef", "abcdef") < D.position_confusion("abcdex", "abcdef")
    assert D.position_visual("", "", {}) == 1 and D.position_visual("ab", "cb", {("a", "c"): 0.9}) > D.position_visual("ab", "xb", {})
    p = lambda a, b: one(spark, D.positionwise(F.col("a"), F.col("b")), a=a, b=b)
    assert p("", "") == 1 and p("", "a") == 0 and p("abc", "abc") == 1 and abs(p("abcd", "abce") - (0.65 * 0.75 + 0.35)) < 1e-9


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(D.cosine(F.col("a"), F.col("b")).alias("c"), D.cosine_clipped(F.col("a"), F.col("b")).alias("k"), D.shape_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [round(r.c, 9) for r in rows] == [0, 1] and [round(r.k, 9) for r in rows] == [0, 1] and round(rows[1].s, 9) == 1


def test_windows_and_pooling(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>")
    r = df.select(X.windows_of(F.col("v"), 2, 2).alias("w"), X.pad_to(F.col("v"), 7, 0.0).alias("p"), X.masked_mean(F.col("v"), F.lit(2)).alias("m"), X.masked_max(F.col("v"), F.lit(3)).alias("x"), X.masked_attention(F.col("v"), F.array(*[F.lit(0.0)] * 5), F.lit(5)).alias("a")).first()
    assert r.w == [[1, 2], [3, 4]] and r.p[-2:] == [0, 0] and (r.m, r.x, r.a) == (1.5, 3, 3)


def test_score_columns_have_all_names(spark):
    df = spark.createDataFrame([("google", "gogole"), (None, "x")], "a string, b string")
    rows = df.select(*D.score_columns(F.col("a"), F.col("b"))).collect()
    assert set(rows[0].asDict()) == set(D.SCORERS) and all(0 <= v <= 1 for r in rows for v in r)


def test_strips_of_images(spark):
    pure, ink, solid = [0.0, 0.0], [0.0, 0.5], [1.0, 0.0]
    rows = [(1, [pure, ink, solid, ink, pure, pure]), (2, [pure, solid]), (3, [ink])]
    df = spark.createDataFrame(rows, "id long, image array<array<double>>")
    one = {r.id: r.s for r in df.select("id", X.strips(F.col("image"), 2, trim=True).alias("s")).collect()}
    assert one == {1: [[ink, solid]], 2: [[pure, solid]], 3: []}
    two = {r.id: r.s for r in df.select("id", X.strips(F.col("image"), 2, 1, pad_to_width=3).alias("s")).collect()}
    assert two == {1: [[pure, ink], [ink, solid]], 2: [[pure, solid], [solid, pure]], 3: [[ink, [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]}
    flags = spark.createDataFrame([("128",), ("",), ("None",), (None,)], "w string").select(X.whole_image(F.col("w")).alias("f")).collect()
    assert [r.f for r in flags] == [True, False, False, False]
