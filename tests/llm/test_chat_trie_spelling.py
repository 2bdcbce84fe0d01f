import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from simloom.llm import chat, oracle, prefix_trie, queries, spelling

TALK = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<", "a<", "<\\|", "<\\\\|x", "|>", "", "\n", "plain words", "<|im_end|>\n", "\\", "漢字 \U0001d5c5", "  two  words "]


def talks(seed, n=40, most=9):
    """Random conversations with nasty texts, nulls and ties, in random order of rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((rng.choice([c, c, c - c % 20]), rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "system", None, "a\\n\nb<|x"]), rng.choice([*NASTY, None])))
    rng.shuffle(rows)
    return rows


def ordered(rows, tie):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, *tie(*x[1:])))] for c, v in by.items()}


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.parse_marked(chat.marked_turns([(text, text), ("r", text)])) == [(text, text), ("r", text)]


def read(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def expected_chat(turns):
    said = [t for r, t in turns if r == "assistant"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said)), len(chat.marked_turns(turns)), 0)


@pytest.mark.parametrize("seed,turns", [(1, 9), (2, 70)])
def test_chat_round_trip(spark, seed, turns):
    """Conversations of one block and of several; the pieces read in the order that they come in, and in another."""
    rows = talks(seed, 25, turns) + [(None, 1, "assistant", "of nobody"), (None, None, "user", "first")]
    pieces = chat.format_chats(spark.createDataFrame(rows, TALK).repartition(5))
    want = {c: expected_chat(t) for c, t in ordered(rows, lambda r, t: (r, t)).items()}
    assert read(chat.read_back(pieces, ordered=True)) == want
    if turns > 16:
        assert pieces.filter("piece > 0").count()
    stored = spark.createDataFrame(pieces.collect(), pieces.schema).repartition(7)
    assert read(chat.read_back(stored)) == want


def test_spans_say_where_turns_are(spark):
    rows = talks(3, 10, 40)
    whole = defaultdict(str)
    for p in chat.format_chats(spark.createDataFrame(rows, TALK)).orderBy("conv_id", "piece").collect():
        assert p.offset == len(whole[p.conv_id])
        whole[p.conv_id] += p.formatted
        assert p.spans[0].start == 0 and p.spans[-1].end == len(p.formatted)
        assert all(a.end == b.start for a, b in zip(p.spans, p.spans[1:], strict=False))
        for s in p.spans:
            (role, text), = chat.parse_marked(p.formatted[s.start : s.end])
            assert role == s.role and chat.unescape(p.formatted[s.text_start : s.text_end]) == text and s.loss == (role == "assistant")
    assert whole == {c: chat.marked_turns(t) for c, t in ordered(rows, lambda r, t: (r, t)).items()}


def with_prompt(turns):
    return "<s>" + "".join(f"[{r}]{t}[/]" for r, t in turns) + "[assistant]"


def newest_thought(turns):
    """Drops what older assistant turns thought: history is rewritten."""
    last = max([k for k, (r, _) in enumerate(turns) if r == "assistant"], default=-1)
    return "".join(f"[{r}]{t if k == last or r != 'assistant' else re.sub('<think>.*?</think>', '', t)}[/]" for k, (r, t) in enumerate(turns))


def trimmed(turns):
    return "".join(f"[{r}]{t.strip()}[/]" for r, t in turns)


def test_black_boxes(spark):
    assert chat.inspect(chat.marked_turns) == (0, [])
    tail, findings = chat.inspect(with_prompt)
    assert not findings and 0 < tail <= len("[assistant]")
    assert not chat.inspect(newest_thought)[1]  # probes have no thoughts in them
    assert chat.inspect(lambda turns: f"{len(turns)} turns:" + trimmed(turns))[1]
    rows = [(1, k, "assistant" if k % 2 else "user", f"<think>{k}</think> text {k}" if k % 2 else f"text {k}") for k in range(40)]
    df = spark.createDataFrame(rows, TALK)
    turns = [r[2:] for r in rows]
    got = chat.format_chats(df, with_prompt).orderBy("piece").collect()
    assert "".join(p.formatted for p in got) == with_prompt(turns) and len(got) > 1
    assert [p.formatted[s.text_start : s.text_end] for p in got for s in p.spans] == [t for _, t in turns]
    told = [s for p in chat.format_chats(df, newest_thought).collect() for s in p.spans]
    assert [s.turn for s in told if s.rewrites] == list(range(3, 40, 2))
    assert all(not s.loss for s in told if s.text_start is None)
    spans = [(p.formatted[s.text_start : s.text_end]) for p in chat.format_chats(spark.createDataFrame([(1, 0, "user", "  a b "), (1, 1, "assistant", " c ")], TALK), trimmed).collect() for s in p.spans if s.loss]
    assert spans == ["c"]


def test_long_texts_make_blocks_of_their_own(spark):
    long = "x<|" * 600_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", long), (1, 2, "user", None), (1, 3, "assistant", "b")]
    pieces = chat.format_chats(spark.createDataFrame(rows, TALK))
    got = read(chat.read_back(pieces, ordered=True))
    assert got == {1: expected_chat([(r, t or "") for _, _, r, t in rows])} and pieces.count() > 1


def brute_trie(rows):
    turns = ordered([r for r in rows if r[0] is not None], lambda r, t: (r, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,held", [(1, 50_000), (2, 3)])
def test_trie_against_brute_force(spark, monkeypatch, seed, held):
    """Also where a task hands its nodes on long before a family ends."""
    monkeypatch.setattr(prefix_trie, "HELD_NODES", held)
    rng = random.Random(seed)
    rows = []
    for c in range(100):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(["a b", "a  b c", "", None]) if rng.random() < 0.8 else f"{rng.random()}"))
    rows += [(200 + c, t, "user", "the same words") for c in range(30) for t in range(12)] + [(None, 0, "user", "nobody")]
    rng.shuffle(rows)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK).repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_with_ties_and_turnless_conversations(spark):
    one = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 2)  # of a family without a base
    rows = [(one, 0, "user", "only"), (40, None, None, None), (40, None, None, None), (41, 0, "user", "y"), (42, 3, "user", "y")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK).selectExpr("*", "1 AS key", "2 AS n", "3 AS depth2")).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    root = next(r for r in got if r.depth == 0)
    assert root.ends_sha256 != hashlib.sha256(b"").hexdigest()
    below_zero = prefix_trie.prefix_trie(spark.createDataFrame([(-5, 1, "a", "x"), (0, 1, "b", "y")], TALK)).collect()
    assert min(r.conv_id for r in below_zero) == -5
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert chat.format_chats(spark.createDataFrame([], TALK)).count() == 0


LETTERS = "abcdeé"


def brute_spelling(docs):
    counts = Counter()
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                counts[w] += 1
    n = {w: k for w, k in counts.items() if k >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        of = [x for x in n if near(w, x)]
        best = min(of, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = (form[w], n[w], len(of), n[form[w]] if form[w] else None)
    for w, (f, *rest) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (f, root, *rest)
    return out


@pytest.mark.parametrize("seed,words", [(1, 2**22), (2, 40)])
def test_spelling_against_brute_force(spark, monkeypatch, seed, words):
    """Also in several passes over the vocabulary."""
    monkeypatch.setattr(spelling, "PASS_WORDS", words)
    rng = random.Random(seed)
    roots = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 8))) for _ in range(12)]

    def word():
        w = list(rng.choice(roots))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [rng.choice(LETTERS)] * rng.randrange(2)
            w = w or ["a"]
        return "".join(w)

    docs = [(k if k % 9 else None, " ".join(rng.choice([str.upper, str, str])(word()) + rng.choice(["", ".", "7"]) for _ in range(rng.randrange(120)))) for k in range(60)] + [(1, None), (2, ""), (3, "É" * 30_000 + " " + "É" * 30_000 + " " + "É" * 30_000 + " x" + "É" * 29_999 + "é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS near").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    assert got == brute_spelling(docs) and any(v[0] and v[0] != v[1] for v in got.values())


@pytest.mark.parametrize("places", [8192, 3])
def test_each_neighbour_is_made_once(monkeypatch, places):
    monkeypatch.setattr(spelling, "HELD_PLACES", places)
    alphabet = np.array([ord(c) for c in "abz"], np.uint8)
    for word in (b"aabbz", b"a", b"zzzz", b"abab"):
        made = Counter(x for _, x in spelling.neighbours([b"bb", word], alphabet, lambda h: np.ones(len(h), bool)) if _ == 1)
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        want |= {word[:i] + bytes([c]) + word[i + k :] for i in range(len(word) + 1) for c in alphabet for k in (0, 1) if i + k <= len(word)} - {word}
        assert made == Counter(dict.fromkeys(want, 1))
        w = spelling._Words([b"bb", word])
        assert all(spelling._Words([x]).hashes[0] in _hashes(word, alphabet) for x in want) and w.hashes[1] == spelling._Words([word]).hashes[0]


def _hashes(word, alphabet):
    seen = []
    list(spelling.neighbours([word], alphabet, lambda h: seen.extend(h.tolist()) or np.zeros(len(h), bool)))
    return set(seen)


def test_spelling_edges(spark, edge_docs, no_docs):
    rows = spelling.group_variants(edge_docs, least=1).collect()
    assert {r.word for r in rows} >= {"about", "nothing", "token", "abcdefgh"} and all(r.n >= 1 for r in rows)
    assert spelling.group_variants(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_prefix_trie", "op13_spelling_variants"])
def test_queries_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("conversations", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = {"op11_chat_format": oracle.CHAT, "op12_prefix_trie": oracle.TRIE, "op13_spelling_variants": oracle.SPELLING}[name]
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
