"""Toxicity: a linear softmax over averaged subword-bag embeddings, trained jointly in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.llm.arrow import sample_by_hash, small_batches, words
from simloom.storage import materialize

#: Labelled documents of each class that are fitted at most, and the longest text (characters) among them.
TRAIN_DOCS = 3_000
TRAIN_CHARS = 200_000
#: Hashed n-grams, their lengths in bytes, and the size of an embedding.
BUCKETS, GRAMS, DIM = 2**18, (3, 4, 5, 6), 16
#: Words of a window, and words from one window to the next.
WINDOW, STEP = 8, 4
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.25, 11
#: Distinct words whose weights a worker remembers.
CACHE_WORDS = 300_000


def grams(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word between < and >, one after the other, and where each word's begin.

    A word's own string is one of its grams, so that every word has one at least.
    """
    text = np.frombuffer(b"".join([b"<" + w + b">" for w in distinct]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    room = np.repeat(ends, sizes) - np.arange(len(text))  # characters from here to the word's end
    word = np.repeat(np.arange(len(distinct)), sizes)
    found, owner = [], []
    h = np.zeros(len(text), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        step = np.zeros(len(text), np.uint32)
        step[: len(text) - n + 1] = text[n - 1 :]
        h = h * np.uint32(16777619) ^ step
        if n in GRAMS:
            fits = room >= n
            found.append(h[fits] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
            owner.append(word[fits])
    whole = np.add.reduceat(text * (np.arange(len(text), dtype=np.uint32) - np.repeat(starts, sizes).astype(np.uint32) + 1) * np.uint32(2654435761), starts) if len(distinct) else np.zeros(0, np.uint32)
    found.append(whole.astype(np.uint32) ^ np.uint32(0x85EBCA6B))
    owner.append(np.arange(len(distinct)))
    codes, owners = np.concatenate(found), np.concatenate(owner)
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    codes ^= codes >> np.uint32(13)
    order = np.argsort(owners, kind="stable")
    return (codes[order] % np.uint32(BUCKETS)).astype(np.int32), np.searchsorted(owners[order], np.arange(len(distinct)))


def grams_of_many(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """grams(), some words at a time, so that only the result takes memory for all of them."""
    codes, starts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for k in range(0, len(distinct), 10_000):
        c, s = grams(distinct[k : k + 10_000])
        codes.append(c)
        starts.append(s + at)
        at += len(c)
    return np.concatenate(codes), np.concatenate(starts)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words; the last one ends with the text."""
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    starts = np.minimum(starts, max(0, n - WINDOW))
    return starts, np.minimum(starts + WINDOW, n)


@dataclass
class Model:
    """weights: what a gram adds to a word's log odds (its embedding times the softmax rows' difference)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float

    def words(self, distinct: list[bytes]) -> np.ndarray:
        codes, starts = grams(distinct)
        return np.add.reduceat(self.weights[codes], starts) / np.diff(np.append(starts, len(codes))) if distinct else np.zeros(0)

    def score(self, logit: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40)))


def _best_windows(values: np.ndarray) -> tuple[float, int, int]:
    """The highest mean of word values over the windows, and that window."""
    run = np.concatenate([[0.0], np.cumsum(values)])
    a, b = windows(len(values))
    means = (run[b] - run[a]) / (b - a)
    k = int(np.argmax(means))
    return float(means[k]), int(a[k]), int(b[k])


def fit(texts: list[bytes | None], labels: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Train on whole documents of which only some words carry the label.

    A document stands for its most toxic window under the model so far, so negatives are their own
    hardest windows; each also gives a random one. Word vectors (means of their grams' embeddings),
    averaged over a window, go through a linear softmax; embeddings and softmax learn together by
    Adagrad. A fifth of the documents is kept back to calibrate the document's score to the prior.
    """
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32) for t in texts]
    full = np.array([len(d) > 0 for d in docs], bool)
    if not full.any() or len(set(labels[full].tolist())) < 2:
        at = float(np.log(prior / (1 - prior)))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, at, prior)
    codes, starts = grams_of_many(list(number))
    del number
    sizes = np.diff(np.append(starts, len(codes)))
    back = (rng.random(len(docs)) < 0.2) & full
    used = np.flatnonzero(full & ~back)
    if len(set(labels[used].tolist())) < 2:
        used = np.flatnonzero(full)

    # before anything is learned, windows go by how much oftener a gram is in positive documents
    seen = np.full((2, BUCKETS), 0.5)
    total = [1.0, 1.0]
    for d in used:
        own = np.unique(docs[d])
        seen[labels[d]][np.unique(np.concatenate([codes[starts[w] : starts[w] + sizes[w]] for w in own.tolist()]))] += 1
        total[labels[d]] += 1
    start = np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])
    start[seen.sum(axis=0) < 4] = 0
    start = start.astype(np.float32)
    value = np.add.reduceat(start[codes], starts) / sizes

    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    soft[1] = rng.normal(0, 0.1, DIM)
    past_e, past_s, past_b = np.full(BUCKETS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        if epoch:
            value = np.add.reduceat((emb @ (soft[1] - soft[0]))[codes], starts) / sizes
        picked, marks = [], []
        for d in used:
            _, a, b = _best_windows(value[docs[d]])
            picked.append(docs[d][a:b])
            marks.append(labels[d])
            if not labels[d]:
                c = int(rng.integers(0, max(1, len(docs[d]) - WINDOW + 1)))
                picked.append(docs[d][c : c + WINDOW])
                marks.append(0)
        marks_of = np.array(marks)
        order = rng.permutation(len(picked))
        for k in range(0, len(order), BATCH):
            some = [picked[j] for j in order[k : k + BATCH]]
            y = marks_of[order[k : k + BATCH]]
            flat = np.concatenate(some)
            per = sizes[flat]
            at = np.repeat(starts[flat] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
            rows = codes[at]
            share = np.repeat((1 / np.repeat([len(s) for s in some], [len(s) for s in some]) / per).astype(np.float32), per)
            of = np.repeat(np.repeat(np.arange(len(some)), [len(s) for s in some]), per)
            edges = np.searchsorted(of, np.arange(len(some)))
            hidden = np.add.reduceat(emb[rows] * share[:, None], edges)
            out = hidden @ soft.T + bias
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[np.arange(len(y)), y] -= 1
            g_soft, g_bias, g_hidden = out.T @ hidden / len(y), out.sum(axis=0) / len(y), out @ soft
            past_s += g_soft**2
            past_b += g_bias**2
            soft -= RATE * g_soft / np.sqrt(past_s)
            bias -= RATE * g_bias / np.sqrt(past_b)
            # a gram's gradient, summed over its places in the batch
            places = np.argsort(rows, kind="stable")
            distinct, first = np.unique(rows[places], return_index=True)
            g = np.add.reduceat((g_hidden[of] * share[:, None])[places], first)
            past_e[distinct] += (g**2).mean(axis=1)
            emb[distinct] -= RATE * g / np.sqrt(past_e[distinct])[:, None]

    weights = (emb @ (soft[1] - soft[0])).astype(np.float32)
    shift = float(bias[1] - bias[0])
    value = np.add.reduceat(weights[codes], starts) / sizes
    kept = np.flatnonzero(back) if len(set(labels[back].tolist())) == 2 else used
    logits = np.array([_best_windows(value[docs[d]])[0] + shift for d in kept])
    y = labels[kept].astype(float)
    weigh = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    slope, offset = 1.0, 0.0
    scale = float(np.std(logits)) or 1.0
    z = (logits - logits.mean()) / scale
    p = np.array([np.log(prior / (1 - prior)), 1.0])
    for _ in range(50):  # Newton, with a little ridge
        m = 1 / (1 + np.exp(-np.clip(p[0] + p[1] * z, -30, 30)))
        g = np.array([(weigh * (m - y)).sum(), (weigh * (m - y) * z).sum() + 0.01 * p[1]])
        v = weigh * m * (1 - m) + 1e-9
        h = np.array([[v.sum(), (v * z).sum()], [(v * z).sum(), (v * z * z).sum() + 0.01]])
        p = p - np.clip(np.linalg.solve(h, g), -2, 2)
    slope, offset = max(p[1], 0.0) / scale, p[0] - max(p[1], 0.0) * logits.mean() / scale
    return Model(weights, shift, slope, offset, prior)


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on at most `most` labelled documents of each class (of the smallest hash among those of at most `chars` characters).

    labels: doc_id, toxic. Rows with a null label, and those that `fold` doesn't select, aren't used;
    a document labelled both ways counts as toxic. The prior comes from all labels in the fold.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        marked = marked.filter(fold)
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_y"))
    n, ones = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= chars)
    marked = materialize(marked.join(texts.select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    picked = sample_by_hash(marked.filter("_y = 1"), F.col("doc_id"), most).unionByName(sample_by_hash(marked.filter("_y = 0"), F.col("doc_id"), most))
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "_y", F.lower("text").cast("binary").alias("text")).toArrow()
    order = np.argsort(np.asarray(rows.column("doc_id")), kind="stable") if rows.num_rows else []
    y = np.asarray(rows.column("_y"))[order].astype(int) if rows.num_rows else np.zeros(0, int)
    got = rows.column("text").to_pylist()
    del rows
    model = fit([got[i] for i in order], y, (ones + 0.5) / (n + 1.0))
    del got
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the driver is small, and its work goes on
        trim(0)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with toxicity (0 to 1): the calibrated probability of the most toxic window of the whole text.

    Null and empty texts, and texts without words, get the prior, whatever it is. The columns of docs named in keep
    (doc_id unless given) are passed on; a column toxicity of docs is replaced. Rows that repeat are
    scored each. An empty table gives no rows.

    Scale: a map over batches with a model of a fixed size; windows are means of running sums, so a
    text costs the same per word at any length.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "toxicity"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # columns travel in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.lower(F.col("text").cast("string")).cast("binary").alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("toxicity", T.DoubleType())])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known: dict[bytes, float] = {}
        for b in batches:
            tokens = [words(t) for t in b.column(1).to_pylist()]
            new = list({w for d in tokens for w in d if w not in known})
            for k in range(0, len(new), 20_000):
                known.update(zip(new[k : k + 20_000], model.words(new[k : k + 20_000]).tolist(), strict=True))
            out = np.full(len(tokens), model.prior)
            for k, d in enumerate(tokens):
                if d:
                    values = np.fromiter(map(known.__getitem__, d), np.float64, len(d))
                    out[k] = model.score(_best_windows(values)[0] + model.bias)
            if len(known) > CACHE_WORDS:
                known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["_row", "toxicity"])

    return rows.mapInArrow(scored, schema).select(*[F.col(f"_row.`{c}`") for c in keep], "toxicity")
