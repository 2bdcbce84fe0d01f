"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from simloom.llm.arrow import small_batches, utf8, words
from simloom.llm.sketch import KEY, Sieve, packed, unpacked
from simloom.storage import materialize, scratch

#: Words of a window.
WINDOW = 13
#: Words of an index segment: a segment is closed once it has so many. A document is never cut.
SEGMENT_WORDS = 400_000
#: Words of test items that are searched, and broadcast, at once. More items go in more blocks.
BLOCK_WORDS = 200_000


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _index_schema(doc_id: T.DataType) -> T.StructType:
    blob = T.BinaryType()
    return T.StructType([T.StructField("segment", T.StringType()), T.StructField("doc_ids", T.ArrayType(doc_id)), *[T.StructField(x, blob) for x in ("starts", "terms", "counts", "positions")]])


def build_index(docs: DataFrame) -> DataFrame:
    """Store the postings of every word of docs (doc_id, text).

    A row is a segment: doc_ids, starts (where each document's words begin, and the end), terms
    (each word once), counts (occurrences of each) and positions (ascending for each term, one after
    the other). Positions count words over the segment. Segments are self-contained, so a search
    needs no shuffle, and a lost task is done again by itself.
    """
    small_batches(docs.sparkSession)
    schema = _index_schema(docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, starts, n = [], [], [0], 0

        def closed() -> pa.RecordBatch:
            number = _Numbers()
            codes = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            order = np.argsort(codes, kind="stable").astype("<i4")
            counts = np.bincount(codes, minlength=len(number)).astype("<i4")
            row = [f"{TaskContext.get().partitionId()}-{n}"], [ids], [np.array(starts, "<i4").tobytes()], [b" ".join(number)], [counts.tobytes()], [order.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, arrow.types, strict=True)], schema=arrow)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens += words(text)
                ids.append(i)
                starts.append(len(tokens))
                if len(tokens) >= SEGMENT_WORDS or len(ids) >= SEGMENT_WORDS:
                    yield closed()
                    ids, tokens, starts, n = [], [], [0], n + 1
        if ids:
            yield closed()

    return materialize(docs.select("doc_id", utf8()).mapInArrow(build, schema), "decontaminate-index")


class Segment:
    """The postings of one row of the index, for the terms in `wanted` alone."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, starts: bytes, wanted: dict[bytes, int]):
        self.starts = np.frombuffer(starts, "<i4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<i4")
        n = np.frombuffer(counts, "<i4")
        ends = np.cumsum(n, dtype=np.int64)
        self.counts, self.lists = np.zeros(len(wanted) + 1, np.int64), {}
        for k, term in enumerate(terms.split(b" ") if terms else []):
            w = wanted.get(term)
            if w is not None:
                self.counts[w] = n[k]
                self.lists[w] = (ends[k] - n[k], ends[k])

    def postings(self, term: int) -> np.ndarray:
        a, b = self.lists.get(term, (0, 0))
        return self.positions[a:b]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def exact(self, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase begins: offset-adjusted postings, intersected from the rarest term on."""
        order = np.argsort(self.counts[phrase], kind="stable")
        found = self.postings(phrase[order[0]]).astype(np.int64) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.postings(phrase[k])
            at = np.searchsorted(other, found + k)
            found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == found + k)] if len(other) else found[:0]
        found = found[found >= 0]
        return found[self.doc_of(found) == self.doc_of(found + len(phrase) - 1)]

    def near_docs(self, phrase: np.ndarray, room: int) -> np.ndarray:
        """Documents with a stretch of at most `room` words that holds every term of the phrase, in any order.

        Postings of the rarest term stay while every other term has one within reach; for what is left,
        every stretch around it is looked at.
        """
        terms = np.unique(phrase)
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        p = self.postings(terms[0]).astype(np.int64)
        for t in terms[1:]:
            if not len(p):
                return p
            x = self.postings(t)
            p = p[np.searchsorted(x, p - room, "right") < np.searchsorted(x, p + room)]
        own = self.doc_of(p)
        ok = np.ones((len(p), room), bool)
        for t in terms[1:] if len(p) else ():
            x = self.postings(t)
            low = np.searchsorted(x, np.maximum(p - room + 1, self.starts[own]))
            n = np.searchsorted(x, np.minimum(p + room, self.starts[own + 1])) - low
            row = np.repeat(np.arange(len(p)), n)
            at = x[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]]
            there = np.zeros((len(p), 2 * room), np.int32)
            there[row, at - p[row] + room] = 1  # column c is the word c - room after p
            upto = there.cumsum(axis=1)
            ok &= upto[:, room : 2 * room] > upto[:, :room]  # stretches that end at p, p + 1, ...
        return np.unique(own[ok.any(axis=1)])

    def near(self, phrase: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """Least stretches of at most len(phrase) + slop words that hold every term of the phrase, in any order."""
        terms = sorted(set(phrase.tolist()), key=lambda t: self.counts[t])
        if not self.counts[terms].all():
            return []
        room, found = len(phrase) + slop, set()
        lists = [self.postings(t) for t in terms]
        for p in lists[0].tolist():
            around = [x[np.searchsorted(x, p - room + 1) : np.searchsorted(x, p + room)].tolist() for x in lists]
            if not all(around):
                continue
            merged = sorted((x, k) for k, xs in enumerate(around) for x in xs)
            last = [-1] * len(terms)
            for x, k in merged:
                last[k] = x
                low = min(last)
                if low >= 0 and x - low < room and low <= p <= x:
                    found.add((low, x + 1))
        spans = np.array(sorted(found), np.int64).reshape(-1, 2)
        inside = self.doc_of(spans[:, 0]) == self.doc_of(spans[:, 1] - 1)
        least = [(a, b) for a, b in spans[inside].tolist() if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans[inside].tolist())]
        return least


def windows_of(items: Iterable[tuple[object, bytes | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """Windows and the items that have them. An item of fewer words, but not none, is one window."""
    found: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(item)
    return found


def _coded(phrases: Iterable[tuple[bytes, ...]]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    number = _Numbers()
    coded = [np.array([number[w] for w in p], np.int64) for p in phrases]
    return dict(number), coded


_ROW = "segment string, _n int, n_words long, items array<string>, spans array<struct<start:long,end:long>>, near array<string>"


def _search(index: DataFrame, windows: dict[tuple[bytes, ...], set], slop: int | None) -> tuple[DataFrame, Broadcast]:
    """Per document of the index: its words, the items found and the merged stretches that windows cover; and what is broadcast for it."""
    spark = index.sparkSession
    wanted, phrases = _coded(windows)
    owners = [sorted({str(i) for i in x if i is not None}) for x in windows.values()]
    width = max(map(len, phrases), default=1)
    table = np.full((len(phrases), width), len(wanted), np.int64)
    for k, p in enumerate(phrases):
        table[k, : len(p)] = p
    shared = spark.sparkContext.broadcast((wanted, phrases, owners, table))
    schema = T.StructType([*T._parse_datatype_string(_ROW).fields[:2], T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType), *T._parse_datatype_string(_ROW).fields[2:]])
    arrow = to_arrow_schema(schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, phrases, owners, table = shared.value
        for b in batches:
            for row in b.to_pylist():
                s = Segment(row["terms"], row["counts"], row["positions"], row["starts"], wanted)
                n = len(row["doc_ids"])
                cover = np.zeros(s.starts[-1] + 1, np.int32)
                items: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                s.counts[-1] = 1  # the filler of short windows
                for k in np.flatnonzero((s.counts[table] > 0).all(axis=1)):
                    begins = s.exact(phrases[k])
                    if len(begins):
                        np.add.at(cover, begins, 1)
                        np.add.at(cover, begins + len(phrases[k]), -1)
                        for d in np.unique(s.doc_of(begins)):
                            items.setdefault(int(d), set()).update(owners[k])
                    for d in () if slop is None else s.near_docs(phrases[k], len(phrases[k]) + slop).tolist():
                        near.setdefault(d, set()).update(owners[k])
                hit = (np.cumsum(cover) > 0).astype(np.int8)
                spans: dict[int, list[dict]] = {}
                if items:
                    for d in items:
                        own = np.diff(np.concatenate([[0], hit[s.starts[d] : s.starts[d + 1]], [0]]))
                        spans[d] = [{"start": x, "end": y} for x, y in zip(np.flatnonzero(own > 0).tolist(), np.flatnonzero(own < 0).tolist(), strict=True)]
                cols = [row["segment"]] * n, list(range(n)), row["doc_ids"], np.diff(s.starts), [sorted(items.get(d, ())) for d in range(n)], [spans.get(d, []) for d in range(n)], [sorted(near.get(d, ())) for d in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return index.mapInArrow(search, schema), shared


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, slop: int | None = None) -> DataFrame:
    """How much of each document is test items.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A document word inside any
    occurrence of a window of an item (`window` consecutive words; an item of fewer is one window)
    is hit. Returns a row per row of docs: doc_id, n_words, n_hit, items (ids as strings, sorted),
    spans (the hit stretches by word, end exclusive), near (with slop, items that have a window all of
    whose words stand, in any order, within a stretch of that many words and slop more; else empty),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and no hits. Rows that repeat are judged each. Items that
    repeat an id count once; null item ids are hit but not listed. Empty tables give no rows, or no hits.

    Scale: documents are indexed in place and searched there; nothing is shuffled. Items are searched
    in blocks of about block_words, one after the other: a block's windows are built on the driver,
    broadcast, and let go once its findings, narrow rows, are stored. With several blocks a
    document's findings are merged by a group. The index goes when the result is stored.
    """
    items = items.select("item_id", utf8())
    rough = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-rough // (6 * block_words)))
    with scratch(docs.sparkSession) as block:
        index = build_index(docs)
        rows = None
        for k in range(blocks):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            found, shared = _search(index, windows_of(((r.item_id, None if r.text is None else bytes(r.text)) for r in part.toLocalIterator()), window), slop)
            if blocks == 1:
                return block.keep(_judged(found), "decontaminated")
            found = materialize(found, "decontaminate-found")
            shared.destroy()
            rows = found if rows is None else rows.unionByName(found)
        rows = rows.groupBy("segment", "_n").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
        return block.keep(_judged(rows), "decontaminated")


def _judged(rows: DataFrame) -> DataFrame:
    """The contract's columns from spans in order, which may overlap."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"],
    )
    rows = rows.withColumn("n_hit", covered)
    return rows.select("doc_id", "n_words", "n_hit", "items", "spans", "near", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def search_phrases(index: DataFrame, phrases: list[tuple[str, str]], slop: int | None = None) -> DataFrame:
    """Exact and, with slop, proximity matches of (phrase_id, phrase): doc_id, phrase_id, kind, start, end (words).

    A proximity match is a least stretch of at most the phrase's words plus slop that holds all of
    its terms, in any order, and isn't an exact match. Phrases of no words match nothing.
    """
    kept = [(i, tuple(words(p.encode()))) for i, p in phrases]
    kept = [x for x in kept if x[1]]
    wanted, coded = _coded(p for _, p in kept)
    shared = index.sparkSession.sparkContext.broadcast((wanted, [(i, p) for (i, _), p in zip(kept, coded, strict=True)]))
    doc = T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType)
    schema = T.StructType([doc, *T._parse_datatype_string("phrase_id string, kind string, start long, end long").fields])
    arrow = to_arrow_schema(schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, phrases = shared.value
        for b in batches:
            for row in b.to_pylist():
                s, out = Segment(row["terms"], row["counts"], row["positions"], row["starts"], wanted), []
                for i, p in phrases:
                    exact = {(x, x + len(p)) for x in s.exact(p).tolist()}
                    near = set(s.near(p, slop)) - exact if slop is not None else set()
                    for kind, spans in (("exact", exact), ("near", near)):
                        for x, y in sorted(spans):
                            d = int(s.doc_of(np.array([x]))[0])
                            out.append((row["doc_ids"][d], i, kind, x - int(s.starts[d]), y - int(s.starts[d])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return index.mapInArrow(search, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that decontaminate doesn't call contaminated. Only those that go are shuffled."""
    with scratch(docs.sparkSession) as block:
        found = decontaminate(packed(docs, "text").select(F.struct(*KEY).alias("doc_id"), "text"), items)
        bad = block.keep(found.filter("contaminated").select("doc_id._d", "doc_id._h").distinct(), "contaminated")
    return unpacked(Sieve(bad).without(packed(docs)), docs.columns)
