import random
import re

import pytest

from simloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window):
    cut = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, got = cut(t), set(), set()
        for x, ids in wins.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    got |= {str(v) for v in ids if v is not None}
        out.append((i, len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [10_000, 20])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("the of A b c d é".split()) for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)] + [(None, text(30)), (7, text(50)), (41, None), (42, "")]
    items = [(k, text(rng.choice([0, 1, 2, 4, 9]))) for k in range(12)] + [(None, text(5)), (3, text(6)), (13, None)]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_words=block)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()), key=repr)
    assert rows == brute(docs, items, 4)


def brute_near(docs, items, window, slop):
    cut = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in docs:
        w = cut(t)
        out[i] = set()
        for j, u in items:
            v = cut(u)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                x = v[k : k + window]
                if any(set(x) <= set(w[a : a + len(x) + slop]) for a in range(len(w))):
                    out[i].add(str(j))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("block", [10_000, 15])
def test_proximity_against_brute_force(spark, block):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(60)] + [(60, None)]
    items = [(k, text(rng.choice([1, 3, 5, 8]))) for k in range(20)]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string"), window=5, block_words=block, slop=2)
    found = {r.doc_id: (r.near, r["items"]) for r in got.collect()}
    assert {k: v[0] for k, v in found.items()} == brute_near(docs, items, 5, 2)
    assert all(set(exact) <= set(near) for near, exact in found.values()) and any(near != exact for near, exact in found.values())


def test_proximity(spark):
    index = D.build_index(spark.createDataFrame([(1, "x alpha beta y gamma z"), (2, "gamma q r s t u v alpha beta"), (3, "alpha beta gamma")], "doc_id long, text string"))
    got = {tuple(r) for r in D.search_phrases(index, [("p", "alpha beta gamma"), ("none", "...")], slop=1).collect()}
    assert got == {(1, "p", "near", 1, 5), (3, "p", "exact", 0, 3)}


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "word3 word4 word5 word6"), (2, None)], "item_id long, text string")
    rows = D.decontaminate(edge_docs, items).collect()
    assert len(rows) == edge_docs.count()
    assert {r.doc_id for r in rows if r.n_hit} == {5, 6}
    assert D.decontaminate(no_docs, items).count() == 0
    assert D.decontaminate(edge_docs, items.limit(0)).filter("n_hit > 0").count() == 0
    kept = D.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
