"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrow import batch, small_batches, utf8, words
from simloom.llm.sketch import KEY, Sieve, document_key, maybe_in, packed, repeated_rows, sketch, unpacked
from simloom.storage import materialize, scratch

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values of a document; a pair is a candidate if it agrees on all ROWS of one of BANDS.
#: Of pairs of similarity 0.8 all but three in a million are.
BANDS, ROWS = 24, 4
#: Values that are compared between two tests, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members of a bucket or component that one task compares with each other, or with as many others.
TILE = 512
_PRIMES = np.random.default_rng(20).integers(1, 2**64 - 1, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(tokens: list[bytes], hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE words; a text of fewer words, but not none, is one."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - SHINGLE + 1)
    width = min(SHINGLE, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MIX[0] + h[k : k + n])
    return np.unique(out)


def minhashes(sets: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each of BANDS * ROWS hash functions."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(sets), 4096):
        part = sets[k : k + 4096]
        for j in range(0, BANDS * ROWS, 32):
            x = part[:, None] * _PRIMES[0, j : j + 32] + _PRIMES[1, j : j + 32]
            np.minimum(out[j : j + 32], (x ^ (x >> np.uint64(32))).min(axis=0), out=out[j : j + 32])
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each STEP: how many of the values so far must agree that P(similarity >= threshold) >= tolerance.

    Under a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and its upper
    tail is that of a binomial: P(Bin(n + 1, threshold) <= m).
    """
    found = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        found.append(m)
    return found


def compare(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of rows of sig are left after incremental comparison; with band, only those that meet first there.

    STEP values at a time, and only for the pairs that are left: a pair goes once its posterior is
    below TOLERANCE, or once it agrees on a band before its own, as it is met there.
    """
    left, count, per = np.arange(len(i)), np.zeros(len(i), np.int32), STEP // ROWS
    for n, least in enumerate(least_matches()):
        s = slice(n * STEP, (n + 1) * STEP)
        same = sig[i[left], s] == sig[j[left], s]
        count += same.sum(axis=1, dtype=np.int32)
        ok = count >= least
        if band is not None:
            before = np.arange(n * per, (n + 1) * per) < band[left, None]
            ok &= ~(same.reshape(-1, per, ROWS).all(axis=2) & before).any(axis=1)
        left, count = left[ok], count[ok]
        if not len(left):
            break
    return left


class Union:
    """Least member of each set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first columns, some whole runs at a time (sorted partitions)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first, last = [b.column(k)[0].as_py() for k in range(keys)], [b.column(k)[-1].as_py() for k in range(keys)]
        if held and [held[-1].column(k)[-1].as_py() for k in range(keys)] != first:
            yield pa.Table.from_batches(held)
            held = []
        if first == last:
            held.append(b)
            continue
        # the last run may go on in the next batch
        same = np.ones(b.num_rows, bool)
        for k in range(keys):
            same &= np.asarray(b.column(k)) == last[k]
        cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        held.append(b.slice(0, cut))
        yield pa.Table.from_batches(held)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Rows of large groups (_n members) once for each pair of tiles they belong to: _t1 <= _t2, and _mine (the row's tile)."""
    tiles = F.ceil(F.col("_n") / tile).cast("int")
    rows = rows.withColumn("_tiles", tiles).withColumn("_mine", F.pmod(F.xxhash64(*KEY), F.col("_tiles").cast("long")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda x: F.struct(F.least(x, F.col("_mine")).alias("_t1"), F.greatest(x, F.col("_mine")).alias("_t2")))
    return rows.withColumn("_p", F.explode(pair)).withColumn("_t1", F.col("_p._t1")).withColumn("_t2", F.col("_p._t2")).drop("_p", "_n")


def _pairs(edges: np.ndarray, mine: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each run [edges[k], edges[k+1]), in portions: of two tiles only those between them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        if t1[a] == t2[a]:
            for x in range(a, b - 1, 256):
                i, j = np.triu_indices(b - x, 1)
                some = i < 256
                held.append((i[some] + x, j[some] + x))
                size += len(held[-1][0])
                if size > 200_000:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held, size = [], 0
        else:
            one, two = a + np.flatnonzero(mine[a:b] == t1[a]), a + np.flatnonzero(mine[a:b] == t2[a])
            if len(one) and len(two):
                held.append((np.repeat(one, len(two)), np.tile(two, len(one))))
                size += len(held[-1][0])
        if size > 200_000:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _edges_of(table: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    for k in range(keys):
        x = np.asarray(table.column(k))
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    return np.append(np.flatnonzero(new), table.num_rows)


def _signatures(docs: DataFrame) -> DataFrame:
    """document key, _uid (of the row), _c (which texts have the same shingles) and _sig, for texts with words."""
    schema = pa.schema([("_d", pa.int64()), ("_h", pa.int64()), ("_uid", pa.int64()), ("_c", pa.binary()), ("_sig", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            sets = [shingles(words(t), hashes) for t in b.column(3).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), b.column(2), [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [minhashes(s).tobytes() if len(s) else None for s in sets])
            if len(hashes) > 300_000:
                hashes.clear()

    return document_key(docs.select("doc_id", "text")).select(*KEY, F.monotonically_increasing_id().alias("_uid"), utf8()).mapInArrow(read, "_d long, _h long, _uid long, _c binary, _sig binary")


_EDGE = pa.schema([("_d1", pa.int64()), ("_h1", pa.int64()), ("_d2", pa.int64()), ("_h2", pa.int64())])


def _bucket_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: _key, _t1, _t2, _band, _mine, _d, _h, _sig. Stars of what pruning leaves connected in a bucket."""
    for t in _groups(batches, 3):
        sig = np.frombuffer(b"".join(t.column("_sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        d, h, band = np.asarray(t.column("_d")), np.asarray(t.column("_h")), np.asarray(t.column("_band"))
        sets = Union(t.num_rows)
        for i, j in _pairs(_edges_of(t, 3), np.asarray(t.column("_mine")), np.asarray(t.column("_t1")), np.asarray(t.column("_t2"))):
            for k in compare(sig, i, j, band[i]).tolist():
                sets.join(int(i[k]), int(j[k]))
        up = np.array([sets.find(x) for x in range(t.num_rows)], np.int64)
        on = np.flatnonzero(up != np.arange(t.num_rows))
        if len(on):
            yield batch(_EDGE, d[on], h[on], d[up[on]], h[up[on]])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (_d1, _h1)-(_d2, _h2): _d, _h, and the least member _cd, _ch.

    Every node takes the least label about it, then the label of its label, until nothing changes;
    each round is stored, so that plans stay short.
    """
    one, two = F.struct(F.col("_d1").alias("d"), F.col("_h1").alias("h")), F.struct(F.col("_d2").alias("d"), F.col("_h2").alias("h"))
    both = F.array(F.struct(one.alias("a"), two.alias("b")), F.struct(two.alias("a"), one.alias("b")))
    links = materialize(edges.select(F.explode(both).alias("l")).select("l.a", "l.b").distinct(), "jaccard-links")
    labels = materialize(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "jaccard-labels")
    while True:
        near = links.join(labels.select(F.col("a").alias("b"), F.col("c").alias("_n")).hint("merge"), "b").groupBy("a").agg(F.min("_n").alias("_n"))
        new = labels.join(near.hint("merge"), "a", "left").select("a", F.col("c").alias("_old"), F.least("c", "_n").alias("c"))
        up = labels.select(F.col("a").alias("c"), F.col("c").alias("_up"))
        new = materialize(new.join(up.hint("merge"), "c", "left").select("a", "_old", F.least("c", "_up").alias("c")), "jaccard-labels")
        if not new.filter("c != _old").limit(1).count():
            break
        labels = new.select("a", "c")
    return new.select(F.col("a.d").alias("_d"), F.col("a.h").alias("_h"), F.col("c.d").alias("_cd"), F.col("c.h").alias("_ch"))


_FOUND = pa.schema([("_d", pa.int64()), ("_h", pa.int64()), ("_links", pa.int64()), ("_to_d", pa.int64()), ("_to_h", pa.int64())])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: _cd, _ch, _t1, _t2, _mine, _d, _h, _size, text. Exact links of each document and stars of linked ones.

    MinHash values are made anew from the shingles that verification needs anyway. Intersections of
    a component come from products of its membership matrix, over shingles that two members share.
    """
    hashes = _Hashes()
    for t in _groups(batches, 4):
        d, h, size = np.asarray(t.column("_d")), np.asarray(t.column("_h")), np.asarray(t.column("_size"))
        sets = [shingles(words(x), hashes) for x in t.column("text").to_pylist()]
        if len(hashes) > 300_000:
            hashes.clear()
        sig = np.stack([minhashes(s) for s in sets])
        n = np.array([len(s) for s in sets])
        links, star = np.zeros(t.num_rows, np.int64), Union(t.num_rows)
        edges = _edges_of(t, 4)
        for i, j in _pairs(edges, np.asarray(t.column("_mine")), np.asarray(t.column("_t1")), np.asarray(t.column("_t2"))):
            small = n[i] < THRESHOLD * n[j]
            large = n[j] < THRESHOLD * n[i]
            ok = np.flatnonzero(~small & ~large)
            left = ok[compare(sig, i[ok], j[ok])]
            i, j = i[left], j[left]
            if not len(i):
                continue
            common = _common(sets, i, j)
            linked = np.flatnonzero(common >= THRESHOLD * (n[i] + n[j] - common) - 1e-9)
            np.add.at(links, i[linked], size[j[linked]])
            np.add.at(links, j[linked], size[i[linked]])
            for a, b in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                star.join(a, b)
        up = np.array([star.find(x) for x in range(t.num_rows)], np.int64)
        yield batch(_FOUND, d, h, links, d[up], h[up])


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that the pairs share. Dense products for many pairs of few documents, else set by set."""
    members = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(members):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    every = np.concatenate([sets[m] for m in members.tolist()])
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members.tolist()])
    keep = count[code] > 1
    row, col = row[keep], number[code[keep]]
    at_i, at_j = np.searchsorted(members, i), np.searchsorted(members, j)
    out = np.zeros(len(i), np.int64)
    width = int((count > 1).sum())
    for c in range(0, width, 2048):  # bounded blocks of the membership matrix
        some = (col >= c) & (col < c + 2048)
        m = np.zeros((len(members), min(2048, width - c)), np.float32)
        m[row[some], col[some] - c] = 1
        out += np.rint(m @ m.T).astype(np.int64)[at_i, at_j]
    return out


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Which documents share enough of their word 5-grams: a row per row of docs.

    docs: doc_id (integral), text; other columns are ignored. Two documents are linked if the Jaccard similarity
    of their sets of 5-grams (lower-cased words) is 0.8 or more. Returns doc_id, text_hash, class_id (the least
    doc_id of its connected component), n_links (documents that it is linked with, equal ones
    included) and keep (one row of each class: that of the least doc_id).

    Candidates agree on a band of MinHash values. They are compared STEP values at a time, and dropped
    once the posterior of reaching 0.8 is below TOLERANCE; what is left is verified on the sets
    themselves. Texts with the same set of 5-grams are compared once, for all.

    Texts of fewer than five words, but not none, have one 5-gram: all of them. Null and empty texts
    are linked with nothing and each is a class of its own; a class without doc_id has none. Rows that repeat doc_id
    and text are linked copies, of which one is kept. An empty table gives no rows.

    Scale: texts are read twice; a sketch keeps all but those of candidates where they are. Joins are
    of the same kind at every size. Large buckets and components are cut in tiles, each pair of tiles
    a task's work of a bounded size, and give counts and stars of edges, never pairs. Own tables go
    when the result, a narrow row each, is stored.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as block:
        marks = materialize(_signatures(docs), "jaccard-signatures")
        least = F.min(F.struct("_d", "_h"))
        classes = marks.filter("_c IS NOT NULL").groupBy("_c").agg(least.alias("_r"), F.count(F.lit(1)).alias("_size"), F.first("_sig").alias("_sig"))
        classes = materialize(classes.select("_c", F.col("_r._d").alias("_d"), F.col("_r._h").alias("_h"), "_size", "_sig"), "jaccard-classes")
        several = marks.groupBy(*KEY).agg(F.min("_uid").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        several = materialize(several, "jaccard-repeated")

        members = materialize(_candidates(classes), "jaccard-members")
        told = materialize(_checked(docs, members, several), "jaccard-links")
        counted = told.groupBy(*KEY).agg(F.sum("_links").alias("_links"))
        stars = told.filter((F.col("_d") != F.col("_to_d")) | (F.col("_h") != F.col("_to_h"))).select(F.col("_d").alias("_d1"), F.col("_h").alias("_h1"), F.col("_to_d").alias("_d2"), F.col("_to_h").alias("_h2"))
        groups = components(stars)

        heads = classes.select("_c", *KEY, "_size").join(counted.hint("merge"), KEY, "left").join(groups.hint("merge"), KEY, "left")
        heads = heads.select("_c", (F.coalesce("_links", F.lit(0)) + F.col("_size") - 1).alias("n_links"), F.coalesce("_cd", "_d").alias("_cd"), F.coalesce("_ch", "_h").alias("_ch"))
        found = marks.filter("_c IS NOT NULL").select(*KEY, "_uid", "_c").join(heads.hint("merge"), "_c").join(several.hint("merge"), KEY, "left")
        first = (F.col("_d") == F.col("_cd")) & (F.col("_h") == F.col("_ch")) & (F.col("_least").isNull() | (F.col("_least") == F.col("_uid")))
        # texts without words have no set; they would all meet in one task of that join
        alone = marks.filter("_c IS NULL").select(*KEY, F.col("_d").alias("_cd"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep"))
        out = found.select(*KEY, "_cd", F.col("n_links").cast("long").alias("n_links"), first.alias("keep")).unionByName(alone)
        null_id = lambda c: F.when(c < 2**63 - 1, c)
        return block.keep(out.select(null_id(F.col("_d")).alias("doc_id"), F.col("_h").alias("text_hash"), null_id(F.col("_cd")).alias("class_id"), "n_links", "keep"), "jaccard-join")


def _candidates(classes: DataFrame) -> DataFrame:
    """Members of components of what pruning leaves connected: KEY, _cd, _ch, _size."""
    bands = F.array(*[F.struct(F.lit(k).alias("_band"), F.xxhash64(F.lit(k), F.substring("_sig", 4 * ROWS * k + 1, 4 * ROWS)).alias("_key")) for k in range(BANDS)])
    rows = classes.select(*KEY, F.explode(bands).alias("_b")).select("_b._band", "_b._key", *KEY)
    # buckets are counted by partial sums; a sketch of those of several members spares the others a shuffle
    sizes = materialize(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "jaccard-buckets")
    met = maybe_in(rows, sketch(sizes, ["_key"]), ["_key"]).filter("_maybe").drop("_maybe").join(sizes.hint("merge"), "_key")
    order = ["_key", "_t1", "_t2"]
    tiled = _tiles(met, TILE).join(classes.select(*KEY, "_sig").hint("merge"), KEY)
    tiled = tiled.select(*order, "_band", "_mine", *KEY, "_sig").repartition(*order).sortWithinPartitions(*order, *KEY)
    groups = components(tiled.mapInArrow(_bucket_edges, "_d1 long, _h1 long, _d2 long, _h2 long"))
    return groups.join(classes.select(*KEY, "_size").hint("merge"), KEY)


def _checked(docs: DataFrame, members: DataFrame, several: DataFrame) -> DataFrame:
    """Exact links and stars within the components of members, tile by tile."""
    sizes = materialize(members.groupBy("_cd", "_ch").agg(F.count(F.lit(1)).alias("_n")), "jaccard-groups")
    needed = materialize(members.select(*KEY).join(several.select(*KEY, F.lit(True).alias("_many")).hint("merge"), KEY, "left"), "jaccard-needed")
    found = Sieve(needed).met(document_key(docs.select("doc_id", "text")).select(*KEY, utf8()))
    texts = found.filter("_many IS NULL").select(*KEY, "text").unionByName(found.filter("_many").groupBy(*KEY).agg(F.first("text").alias("text")))
    order = ["_cd", "_ch", "_t1", "_t2"]
    tiled = _tiles(members.join(sizes.hint("merge"), ["_cd", "_ch"]), TILE).join(texts.hint("merge"), KEY)
    tiled = tiled.select(*order, "_mine", *KEY, "_size", "text").repartition(*order).sortWithinPartitions(*order, *KEY)
    return tiled.mapInArrow(_verified, "_d long, _h long, _links long, _to_d long, _to_h long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without all but one of each class of jaccard_join; texts without words stay.

    Of rows that repeat doc_id and text and differ elsewhere, the one that stays is that of the least
    hash of its JSON form. Only documents that go, and rows that repeat, are shuffled.
    """
    with scratch(docs.sparkSession) as block:
        told = jaccard_join(docs).withColumn("_d", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("_h", F.col("text_hash"))
        fate = materialize(told.groupBy(*KEY).agg(F.bool_and("keep").alias("_all"), F.bool_or("keep").alias("_any")).filter("NOT _all"), "jaccard-fate")
        gone = block.keep(fate.select(*KEY), "jaccard-gone")
        one = block.keep(fate.filter("_any").select(*KEY), "jaccard-repeated")
    rows = packed(docs)
    return unpacked(Sieve(gone).without(rows).unionByName(repeated_rows(rows, one).filter("_first").drop("_first")), docs.columns)
