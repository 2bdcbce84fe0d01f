"""Spelling variants by full neighbourhood generation: every word one edit away is made, and joined to the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrow import small_batches, utf8
from simloom.storage import materialize, scratch

#: On UTF-8 with A-Z in lower case: runs of a-z and U+00C0 to U+00FF. In Latin-1 each letter is one byte.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: One run in so many loses a letter, by crc32 of document and run.
LOSSES = 97
#: Distinct words that a task counts before they go on.
HELD_WORDS = 100_000
#: Bits of the filter for a pass over the vocabulary (8 MB), words of a pass, and bits of a row of its table.
FILTER_BITS, PASS_WORDS, ROW_BITS = 26, 2**22, 2**15
#: Letter places whose candidates are made together.
HELD_PLACES = 8192
_BASE, _MIX, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def count_words(docs: DataFrame, shortest: int = 5) -> DataFrame:
    """word, n: the letter runs of all texts, with losses applied, of at least `shortest` letters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, n = [w.decode() for w in counts], list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in Counter(RUN.findall(text.lower())).items():
                    if len(w) < shortest:
                        continue
                    h = zlib.crc32(w, seed)
                    if h % LOSSES == 0:
                        letters = w.decode()
                        at = h % len(letters)
                        w = (letters[:at] + letters[at + 1 :]).encode()
                    if len(w) - w.count(b"\xc3") >= shortest:
                        counts[w] += n
                if len(counts) >= HELD_WORDS:
                    yield out()
        if counts:
            yield out()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Words:
    """Words side by side, with what gives the hash of each of their neighbours in a step.

    A word's hash is the sum of letter value * base^place, modulo 2^64, so that changing a place adds
    a term, and deleting or inserting one shifts the rest by a factor.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(self.letters)) - self.starts[self.owner]
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.lengths.max(initial=0)) + 1, _BASE)]).astype(np.uint64))
        self.values = letter_values()
        term = self.values[self.letters] * self.power[self.place]
        running = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        self.before = running[:-1] - running[self.starts[self.owner]]
        self.hashes = running[self.starts + self.lengths] - running[self.starts]
        self.term = term


def letter_values() -> np.ndarray:
    """A 64-bit value for each Latin-1 code."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    return x * _MIX2


def neighbours(words: list[bytes], alphabet: np.ndarray, keep) -> Iterator[tuple[int, bytes]]:
    """Every distinct word one deletion, replacement or insertion away whose hash `keep` lets through: (word number, neighbour).

    words are in Latin-1, alphabet as codes. A letter is deleted where it doesn't repeat the one before
    it, and inserted where it doesn't, so each neighbour is made once; they are made as hashes, in blocks of places, and spelled out if kept.
    """
    w = _Words(words)
    values = w.values[alphabet]

    def spelled(at: np.ndarray, letter: np.ndarray | None, width: int) -> Iterator[tuple[int, bytes]]:
        """Place `at` of all letters side by side, its word by owner, replaced (width 1) or deleted."""
        for k, i in enumerate(at):
            o, p = int(w.owner[i]), int(w.place[i])
            s = words[o]
            yield o, s[:p] + (b"" if letter is None else bytes([letter[k]])) + s[p + width :]

    for a in range(0, len(w.letters), HELD_PLACES):
        b = min(a + HELD_PLACES, len(w.letters))
        own, place, letters, term, before = w.owner[a:b], w.place[a:b], w.letters[a:b], w.term[a:b], w.before[a:b]
        whole = w.hashes[own]
        # deletions
        last = np.where(place > 0, w.letters[np.maximum(np.arange(a, b) - 1, 0)], 0)
        at = np.flatnonzero(letters != last)
        hit = at[keep((before + (whole - before - term) * _BACK)[at])]
        yield from spelled(hit + a, None, 1)
        # replacements, then insertions before each letter: rows are places, columns letters
        power = w.power[place]
        made = (whole - term)[:, None] + values[None, :] * power[:, None]
        hit = np.flatnonzero(keep(made.ravel()) & (letters[:, None] != alphabet[None, :]).ravel())
        yield from spelled(hit // len(alphabet) + a, alphabet[hit % len(alphabet)], 1)
        made = (before + (whole - before) * _BASE)[:, None] + values[None, :] * power[:, None]
        hit = np.flatnonzero(keep(made.ravel()) & (last[:, None] != alphabet[None, :]).ravel())
        yield from spelled(hit // len(alphabet) + a, alphabet[hit % len(alphabet)], 0)
    # insertions after the last letter
    for a in range(0, len(words), HELD_PLACES):
        some = np.arange(a, min(a + HELD_PLACES, len(words)))
        made = w.hashes[some][:, None] + values[None, :] * w.power[w.lengths[some]][:, None]
        last = w.letters[w.starts[some] + w.lengths[some] - 1]
        hit = np.flatnonzero(keep(made.ravel()) & (last[:, None] != alphabet[None, :]).ravel())
        for k in hit:
            o = int(some[k // len(alphabet)])
            yield o, words[o] + bytes([alphabet[k % len(alphabet)]])


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in the filter."""
    shift = np.uint64(64 - FILTER_BITS)
    return (hashes * _MIX) >> shift, ((hashes ^ (hashes >> np.uint64(31))) * _MIX2) >> shift


def _pass_of(hashes: np.ndarray, passes: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(33))) * _BASE >> np.uint64(32)) % np.uint64(passes)


def _filter(vocabulary: DataFrame, number: int, passes: int) -> np.ndarray:
    """The bits that the words of a pass set. A table of at most 2^FILTER_BITS bits comes to the driver, however many words there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _Words([x.encode("latin-1") for x in b.column(0).to_pylist()]).hashes
            h = h[_pass_of(h, passes) == number]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(h)).astype(np.int64))], names=["bit"])

    bits = vocabulary.select("word").mapInArrow(run, "bit long")
    rows = bits.groupBy(F.floor(F.col("bit") / ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("bits")).collect()
    out = np.zeros(2**FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r.row * ROW_BITS // 8 : (r.row + 1) * ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """All pairs of words one edit apart: word, near, near_n (both directions). vocabulary: word, n; materialized, each word once.

    All distinct deletions, replacements and insertions over the letters that occur are made for each
    word. A filter of the vocabulary drops nearly all that aren't words; the rest is joined to it by equality,
    so no distance is computed. A pass covers PASS_WORDS words, so the filter has the same density at every size.
    """
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()  # 90 at most, as RUN has no more
    alphabet = np.array(sorted(ord(r.letter) for r in letters.collect() if r.letter), np.uint8)
    passes = max(1, -(-vocabulary.count() // PASS_WORDS))
    found = None
    for number in range(passes):
        bits = spark.sparkContext.broadcast(_filter(vocabulary, number, passes))

        def run(batches: Iterable[pa.RecordBatch], bits=bits, number=number) -> Iterator[pa.RecordBatch]:
            table = bits.value
            is_set = lambda i: (table[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

            def keep(h: np.ndarray) -> np.ndarray:
                out = np.zeros(len(h), bool)
                at = np.flatnonzero(is_set((h * _MIX) >> np.uint64(64 - FILTER_BITS)))
                at = at[is_set(_bits(h[at])[1])]
                out[at[_pass_of(h[at], passes) == number]] = True
                return out

            for b in batches:
                words = b.column(0).to_pylist()
                owner, near = [], []
                for o, x in neighbours([x.encode("latin-1") for x in words], alphabet, keep):
                    owner.append(words[o])
                    near.append(x.decode("latin-1"))
                    if len(near) >= HELD_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(near)], names=["word", "near"])
                        owner, near = [], []
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

        some = vocabulary.select("word").mapInArrow(run, "word string, near string").join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        some = materialize(some.select("word", "near", "near_n"), "near-words")
        bits.destroy()
        found = some if found is None else found.unionByName(some)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms lead. forms: word, form (null at the end). Counts at least double with each step, so few rounds of jumps do."""
    t = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        jump = t.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("_next"))
        t = materialize(t.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if not t.filter("_moved").limit(1).count():
            return t.select("word", "root")
        t = t.select("word", "root")


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2) -> DataFrame:
    """The words of all texts, each with the more frequent word that it is a variant of.

    docs: doc_id, text; other columns are ignored. Words are runs of a-z and U+00C0 to U+00FF, only A-Z lowered,
    of at least `shortest` letters and `least` occurrences; where crc32 of `doc_id:run` divides by 97
    the run has lost the letter at crc32 % length. Words are near if one inserted, deleted or replaced
    letter lies between them. Returns word, form (its near word of the largest n, ties to the least,
    if that n is at least `factor` times its own, else null), root (where forms lead in the end), n,
    n_near, form_n.

    A null or empty text has no words; a null doc_id counts as ''; rows that repeat count each. An
    empty table gives no rows. Words of any length are handled whole.

    Scale: texts are counted where they are read, and only counts are shuffled. A word's neighbours are
    made in memory as hashes and dropped there by a filter of bounded size; its passes grow with the vocabulary.
    """
    with scratch(docs.sparkSession) as tables:
        words = materialize(count_words(docs, shortest).filter(F.col("n") >= least), "words")
        pairs = near_words(words)
        best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
        near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
        takes = -F.col("_best.n") >= factor * F.col("n")
        told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("_best.word")).alias("form"), F.when(takes, -F.col("_best.n")).alias("form_n"))
        told = materialize(told, "forms")
        return tables.keep(told.join(_roots(told), "word").select("word", "form", "root", "n", "n_near", "form_n"), "spelling-variants")
