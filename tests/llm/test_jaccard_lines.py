import collections
import itertools
import random
import re

from simloom.llm import jaccard_join as J
from simloom.llm import line_dedup as L
from tests.llm.conftest import PASSAGE

WORD = re.compile(r"[0-9a-z]+")


def links(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    found, up = collections.Counter(), {i: i for i in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and n >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            found[a] += 1
            found[b] += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (found[i], root(i)) for i in sets}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(8)]
    out = []
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        out.append((k, " ".join(words)))
    return out


def test_links_and_classes_against_brute_force(spark, monkeypatch):
    texts = near_copies(1)
    for tile in (512, 6):  # with small tiles every group is cut
        monkeypatch.setattr(J, "TILE", tile)
        got = {r.doc_id: (r.n_links, r.class_id) for r in J.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert got == links(texts)


def test_dense_and_set_intersections_agree():
    rng = random.Random(2)
    sets = [J.np.unique(J.np.array([rng.randrange(300) for _ in range(100)], dtype=J.np.uint64)) for _ in range(12)]
    i, j = map(J.np.array, zip(*itertools.combinations(range(12), 2), strict=True))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert J._common(sets, i, j).tolist() == want
    assert [J._common(sets, i[k : k + 1], j[k : k + 1])[0] for k in range(len(i))] == want


def test_pruning_bounds():
    least = J.least_matches()
    assert least == sorted(least) and 0 < least[-1] < 0.8 * J.BANDS * J.ROWS


def test_jaccard_edges(spark, edge_docs, no_docs):
    rows = J.jaccard_join(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[9][0].class_id == 1 and by[1][0].n_links == 1
    assert sorted(r.keep for r in by[6]) == [False, False] and by[6][0].class_id == 5
    assert by[2][0].keep and by[3][0].n_links == 0 and by[None][0].class_id is None
    assert J.jaccard_join(no_docs).count() == 0
    kept = J.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "4", "5", "7", "8"])


def brute_lines(docs, least):
    lines = {i: [x.strip(L.SPACE) for x in (t or "").split("\n") if x.strip(L.SPACE)] for i, t in docs}
    first, later = {}, collections.defaultdict(set)
    for i in sorted(lines):
        ls, spans = lines[i], set()
        n = [len(x.split()) for x in ls]
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(n[a : b + 1]) >= least:
                    spans.add((a, b + 1))
                    break
        for b in range(len(ls)):
            for a in range(b, -1, -1):
                if sum(n[a : b + 1]) >= least:
                    spans.add((a, b + 1))
                    break
        for a, b in sorted(spans):
            f = first.setdefault(tuple(ls[a:b]), (i, a))
            if f != (i, a):
                later[i].update(range(max(a, f[1] + b - a) if f[0] == i else a, b))
    return {i: len(later[i]) for i in lines}


def test_line_runs_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = [" ".join(f"{c}{k}" for k in range(rng.choice([1, 3, 9]))) for c in "abcdefg"]
        docs = [(k, "\n".join(rng.choice([*pool, f"own{k}-{rng.random()}", ""]) for _ in range(rng.randrange(0, 30)))) for k in range(60)]
        got = {r.doc_id: r.n_deleted for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=12).collect()}
        assert got == brute_lines(docs, 12)


def test_what_is_left(spark):
    docs = [(2, f"head\n{PASSAGE}\n\n{PASSAGE} x\ntail"), (1, f"{PASSAGE}\n{PASSAGE} x"), (3, "tail\nhead")]
    got = {r.doc_id: (r.text, r.copy_of) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (docs[1][1], []) and got[2] == ("head\ntail", [1]) and got[3] == ("tail\nhead", [])


def test_repeated_rows_with_runs_of_short_lines(spark):
    run = "\n".join(" ".join(f"v{i}x{k}" for k in range(12)) for i in range(5))
    for x in (1, None):
        got = L.dedup_lines(spark.createDataFrame([(x, "own\n" + run), (x, "own\n" + run), (2, "mine\n" + run)], "doc_id long, text string")).collect()
        left = collections.Counter((r.doc_id, r.text) for r in got)
        # the least doc_id (nulls last) keeps the run, and one of the rows that repeat stays
        want = [(1, "own\n" + run), (1, ""), (2, "mine")] if x else [(None, "own"), (None, ""), (2, "mine\n" + run)]
        assert left == collections.Counter(want)


def test_line_edges(spark, edge_docs, no_docs):
    rows = L.dedup_lines(edge_docs)
    assert [c for c in rows.columns if c not in ("n_lines", "n_deleted", "copy_of")] == [c for c in edge_docs.columns if c != "copy_of"]
    got = collections.defaultdict(list)
    for r in rows.collect():
        got[r.doc_id].append((r.text, r.n_deleted))
    assert sum(map(len, got.values())) == edge_docs.count()
    assert got[2] == [(None, 0)] and got[5] == [(PASSAGE + "\nmore", 0)]
    assert sorted(n for _, n in got[6]) == [1, 2]
    assert L.dedup_lines(no_docs).count() == 0


def test_deleted_lines_are_those_of_maximal_repeated_runs(spark):
    """By comparing all pairs of places and following each common run to its ends; no line repeats within a document."""
    for seed in range(2):
        rng = random.Random(10 + seed)
        runs = [[f"r{k}x{j} " * rng.choice([1, 2, 5]) for j in range(rng.randrange(2, 9))] for k in range(6)]
        docs = []
        for i in range(40):
            lines = []
            for k in rng.sample(range(6), rng.randrange(0, 4)):
                a = rng.randrange(0, 2)
                lines += runs[k][a : len(runs[k]) - rng.randrange(0, 2)] + [f"own{i}-{k}"] * rng.randrange(0, 2)
            docs.append((i, "\n".join(lines)))
        lines = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in docs}
        want = {}
        for i in lines:
            gone = set()
            for j in range(i):
                for a, b in itertools.product(range(len(lines[i])), range(len(lines[j]))):
                    if a and b and lines[i][a - 1] == lines[j][b - 1]:
                        continue  # not where the run begins
                    n = 0
                    while a + n < len(lines[i]) and b + n < len(lines[j]) and lines[i][a + n] == lines[j][b + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[i][a : a + n]) >= 8:
                        gone.update(range(a, a + n))
            want[i] = [x for k, x in enumerate(lines[i]) if k not in gone]
        got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
        assert {r.doc_id: [x.strip() for x in r.text.split("\n") if x.strip()] for r in got} == want
        found = L.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
        for r in found:  # each run is a copy of what it names, and can't be made longer on either side
            x, y = lines[r._d], lines[r._d0]
            n = r.j - r.i
            assert x[r.i : r.j] == y[r.i0 : r.i0 + n]


def test_pairs_go_before_all_values_are_compared(monkeypatch):
    """Incremental comparison: pairs of unlike documents are gone after the first values."""
    rng = J.np.random.default_rng(3)
    sig = rng.integers(0, 2**32, (400, J.BANDS * J.ROWS), dtype=J.np.uint32)
    sig[1] = sig[0]
    sig[1, -8:] += 1
    i, j = J.np.zeros(399, int), J.np.arange(1, 400)

    class Seen(J.np.ndarray):
        looked = 0

        def __getitem__(self, at):
            out = J.np.asarray(super().__getitem__(at))
            Seen.looked += out.size
            return out

    assert J.compare(sig.view(Seen), i, j).tolist() == [0]
    assert Seen.looked < 2 * 399 * J.BANDS * J.ROWS / 4
    band = J.np.full(399, 2)
    assert J.compare(sig, i, j, band).tolist() == []  # the pair meets in band 0 first
    assert J.compare(sig, i, j, J.np.zeros(399, int)).tolist() == [0]
