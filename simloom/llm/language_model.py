"""LM scoring: a log-bilinear model trained with noise-contrastive estimation in numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrow import batch, small_batches, utf8
from simloom.storage import materialize, scratch

#: Not a possible token, as it is whitespace.
END = b"\n"
#: Frequent tokens that the neural model tells apart; all others are one class to it.
CLASSES = 2_000
#: Frequent tokens whose counts every worker holds; the counts of all others are joined.
KNOWN = 200_000
#: Size of a word vector, words of context (fixed by the table of normalisers), noise words of a batch.
DIM, CONTEXT, NOISE = 24, 2, 64
#: Training tokens of a shard, which one copy of the model learns in a fixed order.
SHARD_TOKENS = 2_000_000
#: Each round learns GROWTH times as many shards as all rounds before it, side by side.
GROWTH = 3
#: Tokens that are shuffled before they are learned, those of a step, and the step's size.
CHUNK, BATCH, RATE = 65_536, 384, 0.1
#: Parameters are added up as whole numbers of this grain, so that sums don't depend on the order of adding.
GRAIN = 2.0**-20
#: Distinct tokens that a worker counts before it gives them on.
FLUSH = 250_000


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes.split() cuts at exactly the whitespace \\x20 and \\x09-\\x0D."""
    return text.lower().split() if text else []


def token_counts(docs: DataFrame) -> DataFrame:
    """How often each token (UTF-8), and END once a document, is in docs (text). All of them are counted."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens_of(text))
            seen[END] += b.num_rows
            if len(seen) > FLUSH:
                yield batch(schema, list(seen.keys()), list(seen.values()))
                seen = Counter()
        yield batch(schema, list(seen.keys()), list(seen.values()))

    return docs.select(utf8()).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    """Class k is the k-th most frequent token; the two last are all other tokens, and the begin (context only)."""

    left: np.ndarray  # vectors of context words
    place: np.ndarray  # what a place in the context does to them
    right: np.ndarray  # vectors of predicted classes
    bias: np.ndarray
    past: list[np.ndarray]  # sums of squared gradients of left, right and bias, by class

    def parts(self) -> list[np.ndarray]:
        return [self.left, self.place, self.right, self.bias, *self.past]

    def flat(self) -> np.ndarray:
        """All parameters, with the roots of past, which are of their magnitude."""
        return np.concatenate([*[p.ravel() for p in self.parts()[:4]], *[np.sqrt(p) for p in self.past]]).astype(np.float64)

    def with_flat(self, x: np.ndarray) -> Model:
        ends = np.cumsum([p.size for p in self.parts()])
        got = [v.reshape(p.shape) for v, p in zip(np.split(x, ends[:-1]), self.parts(), strict=True)]
        return Model(*[v.astype(np.float32) for v in got[:4]], [np.square(v).astype(np.float32) for v in got[4:]])

    def predict(self, context: np.ndarray) -> np.ndarray:
        return sum(self.left[context[:, j]] * self.place[j] for j in range(CONTEXT))

    def normaliser_of(self, key: np.ndarray, classes: int) -> np.ndarray:
        """normalisers of contexts by number (first class * classes + second); a worker keeps them from task to task."""
        if not hasattr(self, "known"):
            self.known = np.full(classes**CONTEXT, np.nan, np.float32)
        new = np.unique(key[np.isnan(self.known[key])])
        self.known[new] = self.normalisers(np.stack([new // classes, new % classes], axis=1))
        return self.known[key]

    def normalisers(self, context: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all classes, by products of a bounded size."""
        out = np.empty(len(context), np.float32)
        for k in range(0, len(context), 2048):
            s = self.predict(context[k : k + 2048]) @ self.right.T + self.bias
            top = float(s.max())  # one for the block: scores are log probabilities, nearly, so none underflows
            s -= top
            np.exp(s, out=s)
            out[k : k + 2048] = top + np.log(s.sum(axis=1))
        return out

    def score(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target), np.float32)
        for k in range(0, len(target), 65536):
            s = slice(k, k + 65536)
            out[s] = (self.predict(context[s]) * self.right[target[s]]).sum(axis=1) + self.bias[target[s]]
        return out


def initial(counts: np.ndarray, seed: int) -> Model:
    """counts: of each class, the class of all others last. Scores begin as log unigram probabilities."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    past = [np.full(k, 0.1, np.float32) for k in (n + 1, n, n)]
    return Model(draw(n + 1, DIM), (1 + draw(CONTEXT, DIM)) / CONTEXT, draw(n, DIM), np.log((counts + 0.5) / (counts + 0.5).sum()).astype(np.float32), past)


def contexts(classes: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """For the classes of whole documents, one after the other: the CONTEXT classes before each place, and its class."""
    target = np.concatenate(classes) if classes else np.zeros(0, np.int64)
    before = np.full((len(target), CONTEXT), begin, np.int64)
    starts = np.cumsum([0, *map(len, classes)])[:-1]
    at = np.arange(len(target)) - np.repeat(starts, [len(c) for c in classes])
    for j in range(CONTEXT):
        ok = np.flatnonzero(at > j)
        before[ok, j] = target[ok - 1 - j]
    return before, target


def _adagrad(x: np.ndarray, past: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Add the gradients of each row (ascent), scaled by what that row has seen so far."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    at, g = ordered[first], np.add.reduceat(grads[order], first)
    past[at] += np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim == 2 else g * g
    x[at] += rate * (g.T / np.sqrt(past[at])).T


def train_noise_contrastive(model: Model, before: np.ndarray, target: np.ndarray, noise: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
    """One pass in place. Each step tells its targets from NOISE words drawn from `noise` for the whole step."""
    log_kp = np.log(NOISE * noise).astype(np.float32)
    upto = np.cumsum(noise)
    order = rng.permutation(len(target))
    for k in range(0, len(order), BATCH):
        at = order[k : k + BATCH]
        c, w = before[at], target[at]
        other = np.minimum(np.searchsorted(upto, rng.random(NOISE)), len(noise) - 1)
        left = [model.left[c[:, j]] for j in range(CONTEXT)]
        h = sum(v * model.place[j] for j, v in enumerate(left))
        rw, rn = model.right[w], model.right[other]
        true = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, rw) + model.bias[w] - log_kp[w], -30, 30)))  # 1 - sigmoid
        false = -1 / (1 + np.exp(-np.clip(h @ rn.T + model.bias[other] - log_kp[other], -30, 30)))
        g_h = true[:, None] * rw + false @ rn
        rows = np.concatenate([w, other])
        _adagrad(model.right, model.past[1], rows, np.concatenate([true[:, None] * h, false.T @ h]), rate)
        _adagrad(model.bias, model.past[2], rows, np.concatenate([true, false.sum(axis=0)]), rate)
        _adagrad(model.left, model.past[0], c.T.ravel(), np.concatenate([g_h * model.place[j] for j in range(CONTEXT)]), rate)
        for j in range(CONTEXT):
            model.place[j] += rate * 0.1 * (g_h * left[j]).mean(axis=0)


def _coded(docs: DataFrame, classes: dict[bytes, int], shards: int, seed: int) -> DataFrame:
    """The documents' classes (16 bits each), with the round and shard that learns them and their order there (hash, length)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    rest = len(classes)
    schema = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            ids = [np.fromiter((of.get(w, rest) for w in [*tokens_of(t), END]), "<u2") for t in b.column(2).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), [len(x) for x in ids], [x.tobytes() for x in ids])

    at = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(seed))
    rows = docs.select(at.alias("at"), utf8()).select(F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard"), "at", "text")
    rows = rows.mapInArrow(code, "shard int, at long, n int, ids binary")
    return rows.withColumn("round", _round_of(F.col("shard")))


def _round_of(shard: Column) -> Column:
    """0 for shard 0, r for those from (1 + GROWTH) ** (r - 1) on."""
    return F.when(shard == 0, 0).otherwise(F.floor(F.log(float(1 + GROWTH), shard.cast("double")) + 1e-9) + 1).cast("int")


def train(docs: DataFrame, classes: dict[bytes, int], counts: np.ndarray, seed: int = 5, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Noise-contrastive training over all the documents (doc_id, text), each of them once.

    Documents are dealt by hash to shards of about shard_tokens tokens, as many as the corpus needs,
    and learned in the order of the hash, so the result doesn't depend on how the input is
    partitioned. The first shard is learned alone; each round after it learns three times as many
    shards as were learned so far, every one by its own copy of the model, and averages the copies by
    their tokens. Copies begin alike and each sees millions of tokens, so their average is no worse.

    A task holds one model and one chunk of tokens. Sums are of whole numbers, and so exact.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    model = initial(counts, seed)
    noise = (counts + 0.5) ** 0.75
    noise /= noise.sum()
    rest = len(counts) - 1
    shards = max(1, math.ceil(int(counts.sum()) / shard_tokens))
    coded = materialize(_coded(docs, classes, shards, seed), "lm-coded", by=("round",))
    schema = pa.schema([("tokens", pa.int64()), ("at", pa.int32()), ("values", pa.list_(pa.int64()))])
    piece = 512
    first = 0
    while first < shards:
        last = min(shards, first + max(1, GROWTH * first))
        shared = spark.sparkContext.broadcast((model, noise))

        def learn(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, noise = shared.value
            own, shard, rng, held, size, seen = start, None, None, [], 0, 0
            total, tokens = np.zeros(len(start.flat()), np.int64), 0

            def chunk() -> None:
                if held:
                    train_noise_contrastive(own, *contexts(held, rest + 1), noise, rng)
                held.clear()

            for b in batches:
                for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if s != shard:
                        if shard is not None:
                            chunk()
                            total += np.rint(own.flat() * (seen / shard_tokens / GRAIN)).astype(np.int64)
                        own, shard, rng, size, seen = start.with_flat(start.flat()), s, np.random.default_rng([seed, s]), 0, 0
                    held.append(np.frombuffer(ids, "<u2").astype(np.int64))
                    size += len(held[-1])
                    seen += len(held[-1])
                    tokens += len(held[-1])
                    if size >= CHUNK:
                        chunk()
                        size = 0
            if shard is not None:
                chunk()
                total += np.rint(own.flat() * (seen / shard_tokens / GRAIN)).astype(np.int64)
                pieces = [total[k : k + piece] for k in range(0, len(total), piece)]
                yield batch(schema, [tokens] * len(pieces), list(range(len(pieces))), pieces)

        part = coded.filter((F.col("round") == _round_of(F.lit(first))) & (F.col("shard") >= first)).select("shard", "ids", "at", "n")
        part = part.repartitionById(last - first, (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "at", "n").select("shard", "ids")
        told = part.mapInArrow(learn, "tokens long, at int, values array<long>")
        # sums by position: what tasks tell is added up before anything comes to the driver
        summed = told.select("at", "tokens", F.posexplode("values").alias("i", "v")).groupBy("at", "i").agg(F.sum("v").alias("v"), F.sum("tokens").alias("w"))
        got = summed.toArrow()
        if got.num_rows:
            order = np.lexsort([np.asarray(got.column("i")), np.asarray(got.column("at"))])
            model = model.with_flat((np.asarray(got.column("v")) * GRAIN / (np.asarray(got.column("w")) / shard_tokens))[order])
        shared.destroy()
        first = last
    return model


def _bucket(c: Column) -> Column:
    """Counts in order: each of up to 4,096, then 64 to a doubling. A few thousand at most."""
    return F.when(c <= 4096, c).otherwise(F.floor(F.log2(c.cast("double")) * 64) + 4096 - 12 * 64).cast("long")


def frequent(counts: DataFrame, most: int) -> Column:
    """A condition that selects about the `most` most frequent tokens of counts (token, c), or all if they are fewer.

    It comes from a histogram of counts; of the last bucket a part is taken by hash.
    """
    hist = sorted(((r.b, r.n) for r in counts.groupBy(_bucket(F.col("c")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    above = 0
    for b, n in hist:
        if above + n > most:
            part = int((most - above) / n * 0.99 * 2**20)
            return (_bucket(F.col("c")) > b) | ((_bucket(F.col("c")) == b) & (F.pmod(F.xxhash64("token"), F.lit(2**20)) < part))
        above += n
    return F.lit(True)


def score_texts(docs: DataFrame, learn: Column, seed: int = 5) -> DataFrame:
    """Log10 probabilities of whole texts under smoothed unigrams and under the neural model.

    docs: doc_id, text; other columns are ignored. `learn` selects the rows to learn from. Returns a
    row per row of docs: doc_id, n_tokens (words and one end), n_known (tokens that are in the rows
    learned from), train_tokens, base_score (smoothed unigrams), score.

    score: P(class | two classes before), exactly normalised over the CLASSES most frequent tokens
    and one class of all others; within that class tokens go by smoothed unigrams, where what was
    never seen counts as one more token. So it is a distribution over all tokens, as base_score's.

    Null and empty texts have the end alone. Rows that repeat are scored each. If there is nothing
    to learn from, train_tokens is 0 and both scores are those of the smoothing.

    Scale: counts are grouped over all rows learned from. Workers hold about KNOWN most frequent
    counts and the model, both of a fixed size; all other tokens are joined by token, once for each
    document and token. Texts aren't shuffled; training shuffles two bytes a token.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as block:
        return block.keep(_scored(docs, learn, seed), "lm-scores")


def _scored(docs: DataFrame, learn: Column, seed: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", learn.alias("_learn"))
    counts = materialize(token_counts(rows.filter("_learn")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    is_held = frequent(counts, KNOWN)
    got = counts.filter(is_held).toArrow()
    held = sorted(zip([-c for c in got.column("c").to_pylist()], map(bytes, got.column("token").to_pylist()), strict=True))
    names, known = [w for _, w in held], np.array([-c for c, _ in held], np.int64)
    classes = {w: k for k, w in enumerate(names[:CLASSES])}
    of_class = np.append(known[: len(classes)], max(0, n - known[: len(classes)].sum()))
    rest = len(classes)
    model = train(rows.filter("_learn"), classes, of_class, seed)
    tail_n, tail_v = int(of_class[-1]), v - len(classes)
    base_floor, tail_floor = np.log10(n + 0.5 * (v + 1)), np.log10(tail_n + 0.5 * (tail_v + 1))
    shared = spark.sparkContext.broadcast((model, {w: k for k, w in enumerate(names)}, np.log10(known + 0.5)))
    schema = pa.schema([("doc_id", docs.select("doc_id").limit(0).toArrow().schema.field(0).type), ("_row", pa.int64()), ("n_tokens", pa.int64()), ("_known", pa.int64()), ("_base", pa.float64()), ("_score", pa.float64()), ("_tail", pa.list_(pa.binary())), ("_times", pa.list_(pa.int32()))])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, logs = shared.value
        for b in batches:
            texts = [[*tokens_of(t), END] for t in b.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts])
            ids = np.fromiter((number.get(w, -1) for t in texts for w in t), np.int64, sizes.sum())
            edges = np.cumsum(np.append(0, sizes))
            cls = np.where((ids < 0) | (ids >= rest), rest, ids)
            before, target = contexts([cls[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], rest + 1)
            z = model.normaliser_of(before[:, 0] * (rest + 2) + before[:, 1], rest + 2)
            got = (model.score(before, target) - z).astype(np.float64) / np.log(10)
            is_known = ids >= 0
            log_c = np.where(is_known, logs[np.maximum(ids, 0)], 0.0) if len(logs) else np.zeros(len(ids))
            base = log_c - base_floor
            got += np.where(cls == rest, log_c - tail_floor, 0.0)
            total = lambda x: np.add.reduceat(x, edges[:-1]) if len(texts) else x
            tails = [Counter(texts[k][j - edges[k]] for j in (np.flatnonzero(~is_known[edges[k] : edges[k + 1]]) + edges[k]).tolist()) for k in range(len(texts))]
            yield batch(schema, b.column(0), b.column(2), sizes, total(is_known.astype(np.int64)), total(base), total(got), [list(t.keys()) for t in tails], [list(t.values()) for t in tails])

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _row long, n_tokens long, _known long, _base double, _score double, _tail array<binary>, _times array<int>"
    told = docs.select("doc_id", utf8()).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(read, ddl)
    told = materialize(told, "lm-told")
    # what few documents hold: log10(c + 0.5) joins both scores, with c = 0 for what was never seen
    tail = told.select("_row", F.explode(F.arrays_zip("_tail", "_times")).alias("t")).select("_row", F.col("t._tail").alias("token"), F.col("t._times").alias("times"))
    rare = counts.filter(~is_held)
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = tail.join(rare.hint("merge"), "token", "left").groupBy("_row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("_add"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_more"))
    out = told.drop("_tail", "_times").join(tail, "_row", "left")
    add = F.coalesce(F.col("_add"), F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("_known") + F.coalesce(F.col("_more"), F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("_base") + add).alias("base_score"), (F.col("_score") + add).alias("score"))
