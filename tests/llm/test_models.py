import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import language_model as M
from simloom.llm import maxscore, quality, toxicity
from simloom.llm.arrow import fold
from simloom.storage import table

DATA = "/root/testdata/sf0.01"


def auc(pos, neg):
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_fold_is_crc32(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.train(docs, labels, fold=fold(F.col("doc_id"), 4) != 2)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter(fold(F.col("doc_id"), 4) == 2).toPandas()
    assert auc(got.toxicity[got.toxic == 1], got.toxicity[got.toxic == 0]) > 0.7
    assert got.toxicity.between(0, 1).all()


def test_long_documents_are_replaced_in_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, prior: seen.append((texts, y.tolist(), prior)))
    docs = spark.createDataFrame([(k, "short" if k % 4 < 2 else "long " * 50) for k in range(80)], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int"), most=15, chars=100)
    texts, y, prior = seen[0]
    assert set(texts) == {b"short"} and sorted(y) == [0] * 15 + [1] * 15 and prior == 0.5


def test_misspellings_share_grams():
    rng = random.Random(4)
    plain = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrt')}{rng.choice('aeiou')}" for _ in range(300)]
    text = lambda extra: " ".join(rng.choice(plain) for _ in range(60)) + " " + extra + " " + " ".join(rng.choice(plain) for _ in range(60))
    texts = [text(rng.choice(["worthless", "disgusting", "pathetic"])).encode() for _ in range(150)] + [text("").encode() for _ in range(300)]
    model = toxicity.fit(texts, np.array([1] * 150 + [0] * 300), 0.2)
    value = dict(zip(["worthles", "disgustin", "pathetick", "balo"], model.words([b"worthles", b"disgustin", b"pathetick", b"balo"]), strict=True))
    assert min(value["worthles"], value["disgustin"], value["pathetick"]) > value["balo"]


def test_windows_cover_all_words():
    for n in range(1, 60):
        a, b = toxicity.windows(n)
        assert set().union(*(range(x, y) for x, y in zip(a, b, strict=True))) == set(range(n)) and b.max() == n


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edge_docs, labels)
    rows = toxicity.score(edge_docs, model, keep=edge_docs.columns)
    assert rows.count() == edge_docs.count() and rows.columns.count("toxicity") == 1
    assert rows.filter("text IS NULL OR text = ''").filter(F.col("toxicity") != model.prior).count() == 0
    none = toxicity.train(edge_docs, labels.limit(0))
    assert toxicity.score(edge_docs, none).filter("toxicity BETWEEN 0 AND 1").count() == edge_docs.count()
    assert toxicity.score(no_docs, none).count() == 0


@pytest.mark.parametrize("known", [200_000, 50])
def test_base_scores_and_counts(spark, monkeypatch, known):
    monkeypatch.setattr(M, "KNOWN", known)
    monkeypatch.setattr(M, "CLASSES", 30)
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice(["The", "the", "É", "x"]) + str(rng.randrange(40) ** 2 // 20) for _ in range(rng.randrange(0, 40)))) for k in range(80)] + [(80, None), (None, "never seen"), (3, "again")]
    learn = lambda i: i is None or i % 5 != 1
    got = M.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1).collect()
    cut = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()] + ["\n"]
    c = Counter(w for i, t in docs if learn(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(t)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_the_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    text = np.tile([0, 1, 2, 3], 2000)
    before, target = M.contexts([text[k : k + 40] for k in range(0, 8000, 40)], 5)
    counts = np.array([2000, 2000, 2000, 2000, 10])
    model = M.initial(counts, 1)
    noise = counts / counts.sum()
    start = (model.score(before, target) - model.normalisers(before)).mean()
    for _ in range(6):
        M.train_noise_contrastive(model, before, target, noise, rng, 0.2)
    logp = model.score(before, target) - model.normalisers(before)
    assert logp.mean() > start + 0.5
    one = before[:3]
    every = np.array([[model.score(c[None], np.array([w]))[0] for w in range(5)] for c in one]) - model.normalisers(one)[:, None]
    assert np.allclose(np.exp(every).sum(axis=1), 1, atol=1e-4)


def test_better_than_unigrams_on_held_out_rows(spark):
    got = M.score_texts(table(spark, DATA, "documents"), fold(F.col("doc_id"), 5) != 1).filter(fold(F.col("doc_id"), 5) == 1)
    better = got.agg(F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()[0]
    assert better > 0.8


def test_all_training_documents_are_trained_on(spark):
    docs = [(k, f"word{k} " * 40) for k in range(36)]
    classes, counts = {f"word{k}".encode(): k for k in range(36)} | {M.END: 36}, np.array([40] * 36 + [36, 0])
    got = M.train(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), classes, counts)
    moved = np.abs(got.left - M.initial(counts, 5).left).max(axis=1)
    assert (moved[:36] > 1e-3).all()


def test_language_model_edges(spark, edge_docs, no_docs):
    assert M.score_texts(edge_docs, F.lit(True)).count() == edge_docs.count()
    assert M.score_texts(edge_docs, F.lit(False)).filter("train_tokens = 0 AND n_known = 0").count() == edge_docs.count()
    assert M.score_texts(no_docs, F.lit(True)).count() == 0


def brute_top(rows, k):
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 10 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return out


@pytest.mark.parametrize("shard", [16_384, 7])
def test_top_k_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    rng = random.Random(7)
    for scale in (0.5, 1e6):  # the second needs integer products
        rows = [(k, [rng.uniform(-scale, scale) if rng.random() < 0.9 else 0.0 for _ in range(12)]) for k in range(120)]
        rows += [(k, list(rows[3][1])) for k in range(200, 230)]  # ties
        rows += [(300, None), (301, [float("nan")] * 12), (302, [1.0, None]), (303, [float("inf")] * 12), (None, rows[0][1]), (310, [0.25] * 5), (304, [])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = maxscore.top_k(df, F.col("vec_id") % 10 == 0, k=10, block=9)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 10)


def test_top_k_edges(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, maxscore.top_k(one, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 1024 * 2048)]
    assert maxscore.top_k(one.limit(0), F.col("vec_id") == 0).count() == 0


def test_quality_finds_junk_and_keeps_the_rest(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.judge(docs, model, F.col("source"), F.col("lang")).drop("quality_").withColumnRenamed("quality", "score").join(labels, "doc_id").filter("doc_id % 2 = 1").toPandas()
    assert auc(got.score[got.quality == 1], got.score[got.quality == 0]) > 0.9
    assert got.keep[got.quality == 1].mean() > 0.97


def test_sparse_sites_shrink(spark):
    good, bad = "plain words in a plain sentence follow here. " * 5, "%%% 99 *** $$ ## @@ 12 !! ~~ ^^ " * 5
    rows = [(k, good, "big", "x") for k in range(60)] + [(100 + k, bad, "worse", "y") for k in range(60)] + [(300, bad, "tiny", "z"), (301, good, "tiny", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[1] == good)) for r in rows if r[2] != "tiny"], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, labels), F.col("source"), F.col("lang")).collect()}
    assert got[0].host_posterior > got[300].host_posterior > got[100].host_posterior
    assert got[0].quality > got[301].quality and got[0].keep and not got[100].keep


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(edge_docs, labels)
    assert quality.judge(edge_docs, model, F.col("source"), F.col("lang")).filter("quality BETWEEN 0 AND 1").count() == edge_docs.count()
    assert quality.judge(no_docs, quality.train(no_docs, labels), F.col("source"), F.col("lang")).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.train(docs, labels)
    a = toxicity.score(docs, model).toPandas().sort_values("doc_id").toxicity.to_numpy()
    b = toxicity.score(docs.repartition(5), toxicity.train(docs.repartition(3), labels)).toPandas().sort_values("doc_id").toxicity.to_numpy()
    assert np.allclose(a, b)


def gains(spark, sf, parts):
    got = M.score_texts(table(spark, sf, "documents").repartition(parts), fold(F.col("doc_id"), 5) != 1)
    held = got.filter(fold(F.col("doc_id"), 5) == 1).agg(F.sum(F.col("score") - F.col("base_score")), F.sum("n_tokens")).first()
    return held[0] / held[1], {r.doc_id: r.score for r in got.select("doc_id", "score").collect()}


def test_scores_are_alike_on_any_partitioning_and_beat_unigrams(spark, monkeypatch):
    """Also with several shards in several rounds, whose models are averaged."""
    for tokens, least in ((M.SHARD_TOKENS, 0.12), (40_000, 0.06)):
        monkeypatch.setattr(M.train, "__defaults__", (5, tokens))
        found = [gains(spark, DATA, parts) for parts in (1, 8, 32)]
        assert min(g for g, _ in found) >= least
        for _, scores in found[1:]:
            assert max(abs(scores[k] - x) / max(1, abs(x)) for k, x in found[0][1].items()) < 1e-6


def test_score_is_the_formula(spark):
    """The model's sums against a plain evaluation of it, token by token."""
    docs = [(k, t) for k, t in enumerate(["a b c a b", "b a never c", "", "c c c a unseen b", "a b a b a b c"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in M.score_texts(df, F.col("doc_id") < 4).collect()}
    train = Counter(w for k, t in docs if k < 4 for w in [*t.encode().split(), M.END])
    names = sorted(train, key=lambda w: (-train[w], w))
    classes = {w: k for k, w in enumerate(names)}
    model = M.train(df.filter("doc_id < 4"), classes, np.array([train[w] for w in names] + [0]))
    rest = len(names)
    for k, text in docs:
        total, before = 0.0, [rest + 1, rest + 1]
        for w in [*text.encode().split(), M.END]:
            c = classes.get(w, rest)
            h = model.left[before[-1]] * model.place[0] + model.left[before[-2]] * model.place[1]
            s = (model.right @ h + model.bias).astype(float)
            total += (s[c] - np.log(np.exp(s).sum())) / np.log(10) + (0 if c < rest else math.log10(0.5) - math.log10(0.5))
            before.append(c)
        assert abs(got[k] - total) < 1e-4


def test_frequent_tokens_by_histogram(spark):
    counts = spark.createDataFrame([(f"t{k}".encode(), c) for k, c in enumerate([9_000_000, 70_000, 5000, 4096, 30, 30, 30, 2] + [1] * 500)], "token binary, c long")
    for most, least in ((4, 4), (7, 7), (8, 8), (300, 200), (1000, 508)):
        n = counts.filter(M.frequent(counts, most)).count()
        assert least <= n <= most + 40


def strength(sites):
    """sites: (n, sum, mean of the level above)."""
    n = sum(a for a, _, _ in sites)
    if len(sites) < 2:
        return 100.0
    between = max(0.0, sum(a * (b / a - m) ** 2 for a, b, m in sites) - sum(m * (1 - m) for _, _, m in sites)) / n
    return min(1e4, max(1.0, sum(a * m * (1 - m) for a, _, m in sites) / n / between - 1 if between > 0 else 1e4))


def test_posteriors_against_plain_sums(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.judge(docs, quality.train(docs, labels), F.col("source"), F.col("lang")).collect()
    hosts, paths = {}, {}
    for r in got:
        for table_, key in ((hosts, r.host), (paths, (r.host, r.path))):
            n, s = table_.get(key, (0, 0.0))
            table_[key] = n + 1, s + r.evidence
    n, s = map(sum, zip(*hosts.values()))
    mean = s / n
    top = strength([(a, b, mean) for a, b in hosts.values()])
    whole = {h: (b + top * mean) / (a + top) for h, (a, b) in hosts.items()}
    low = strength([(a, b, whole[h]) for (h, _), (a, b) in paths.items()])
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        a, b = hosts[r.host]
        host = (b - r.evidence + top * mean) / (a - 1 + top)
        a, b = paths[r.host, r.path]
        path = (b - r.evidence + low * host) / (a - 1 + low)
        odds = logit(r.evidence) + logit(path) - logit(mean)
        assert abs(r.host_posterior - host) < 1e-9 and abs(r.path_posterior - path) < 1e-9
        assert abs(r.quality - 1 / (1 + math.exp(-odds))) < 1e-6


def test_toxicity_forward_pass_against_plain_code(spark):
    """Every gram hashed by itself, every window summed by itself."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.train(docs, labels)
    full = 2**32 - 1

    def bucket(code):
        code ^= code >> 15
        code = code * 0x2C1B3C6D & full
        return (code ^ code >> 13) % toxicity.BUCKETS

    def value(word):
        t, codes = b"<" + word + b">", []
        for size in toxicity.GRAMS:
            for i in range(len(t) - size + 1):
                h = 0
                for c in t[i : i + size]:
                    h = (h * 16777619 & full) ^ c
                codes.append(bucket(h ^ (size * 0x9E3779B1 & full)))
        codes.append(bucket((sum(c * (k + 1) * 2654435761 for k, c in enumerate(t)) & full) ^ 0x85EBCA6B))
        return sum(float(model.weights[c]) for c in codes) / len(codes)

    texts = ["You are worthless trash and nobody wants your pathetic words here", "one", "", None, "É ß plain words " * 7, "a b c d e f g h i"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(rows, model).collect()}
    for k, text in enumerate(texts):
        words = toxicity.words((text or "").lower().encode())
        if not words:
            assert got[k] == model.prior
            continue
        values = [value(w) for w in words]
        starts = {min(a, max(0, len(words) - toxicity.WINDOW)) for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)}
        best = max(sum(values[a : a + toxicity.WINDOW]) / len(values[a : a + toxicity.WINDOW]) for a in starts)
        assert abs(got[k] - 1 / (1 + math.exp(-(model.slope * (best + model.bias) + model.offset)))) < 1e-5


def test_top_k_blocks_leave_nothing_behind(spark):
    """However many blocks, what was broadcast for them is gone, and answers are the same."""
    rows = [(k, [float(k * j % 7) for j in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(None)).withColumn("x", F.lit(1)).withColumn("_q", F.lit(True))
    one, many = (sorted(map(tuple, maxscore.top_k(df, F.col("vec_id") % 3 == 0, k=4, block=b).collect())) for b in (2000, 3))
    assert one == many
