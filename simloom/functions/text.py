"""Text expressions: cleaning, keys, spans, rule scores. Column builders, except where Unicode tables are needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATION = "struct<family:string,operation:string,position:int,source:string,replacement:string,score:double,before:string,after:string>"
EDIT = "struct<priority:int,negscore:double,position:int,replacement:string,family:string,source:string,score:double,operation:string>"


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


# Three cleaners with different rules; none replaces another.


def clean_suffix(x: Column) -> Column:
    """Lower case, no whitespace, trailing .com dropped as often as it comes, with the dots before it."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(x)), r"(?U)\s+", ""), r"(\.*\.com)+$", "")


def _without_dot_com(x: Column) -> Column:
    # a round shortens the text by four at least, so that so many rounds reach the fixpoint
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int")))
    return F.btrim(F.when(x.contains(".com"), F.aggregate(rounds, x, lambda a, _: F.replace(a, F.lit(".com"), F.lit("")))).otherwise(x), F.lit("."))


def clean_anywhere(x: Column) -> Column:
    """Lower case, no whitespace, .com dropped wherever it stands until none is left, no dots at the ends."""
    return _without_dot_com(F.regexp_replace(F.lower(_text(x)), r"(?U)\s+", ""))


def clean_space_only(x: Column) -> Column:
    """As clean_anywhere, but of whitespace within the text only U+0020 goes."""
    return _without_dot_com(F.replace(F.lower(F.regexp_replace(_text(x), r"(?U)^\s+|\s+$", "")), F.lit(" "), F.lit("")))


@F.pandas_udf(T.StringType())
def _nfkc_casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def _nfkd_casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).casefold())


_ASCII = r"^[\x00-\x7F]*$"


def uniqueness_key(x: Column, cleaned: Column | None = None) -> Column:
    """NFKC and case folding of the cleaned name. Use uniqueness_key_ascii where texts are known to be ASCII."""
    return _nfkc_casefold(clean_anywhere(x) if cleaned is None else cleaned)


def uniqueness_key_ascii(x: Column) -> Column:
    """The same key on ASCII, in the JVM; null for other texts."""
    clean = clean_anywhere(x)
    return F.when(clean.rlike(_ASCII), F.lower(clean))


def canonical_ocr(x: Column, hyphen: bool = False) -> Column:
    """NFKD and case folding, then ASCII letters and digits (and - with hyphen) only."""
    return F.regexp_replace(_nfkd_casefold(_text(x)), "[^a-z0-9-]" if hyphen else "[^a-z0-9]", "")


def char_normalize(x: Column, source: str, target: str) -> Column:
    """Characters of source become those of target at the same place; whitespace goes. For one-to-one tables."""
    return F.translate(F.regexp_replace(_text(x), r"(?U)\s", ""), source, target)


def merged_table(*tables: dict[str, str]) -> tuple[str, str]:
    """(source, target) for char_normalize; on collision the later table wins."""
    every: dict[str, str] = {}
    for t in tables:
        every |= t
    return "".join(every), "".join(every.values())


def collapse_spaces(x: Column) -> Column:
    return F.regexp_replace(F.btrim(F.lower(_text(x))), r"\s+", " ")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(_text(x), F.lit(r"(?U)(\w+)"), F.lit(1))


def char_ngrams(x: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of <x>, short ones first."""
    marked = F.concat(F.lit("<"), _text(x), F.lit(">"))

    def of(n: int) -> Column:
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def find_starts(x: Column, needle: Column) -> Column:
    """0-based starts of needle, overlapping ones included."""
    last = F.length(x) - F.length(needle) + 1
    starts = F.when((last >= 1) & (F.length(needle) > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, lambda i: F.substring(x, i, F.length(needle)) == needle), lambda i: i - 1)


def find_starts_apart(x: Column, needle: Column) -> Column:
    """0-based starts of needle from left to right, none within another."""
    width = F.length(needle)
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("free"))
    step = lambda a, i: F.when(i >= a["free"], F.struct(F.concat(a["found"], F.array(i)).alias("found"), (i + width).alias("free"))).otherwise(a)
    return F.aggregate(find_starts(x, needle), start, step, lambda a: a["found"])


def replace_span(x: Column, start: Column, width: Column, replacement: Column) -> Column:
    """width characters from the 0-based start become replacement."""
    return F.overlay(x, replacement, start + 1, width)


def apply_edits(x: Column, edits: Column) -> Column:
    """The text after all edits and the operations with what was before and after each; null where edits overlap or don't fit.

    edits: array of EDIT. They are applied from left to right.
    """
    by_place = F.array_sort(edits, lambda a, b: a["position"] - b["position"])
    empty = F.array().cast(f"array<{OPERATION}>")
    start = F.struct(x.alias("text"), F.lit(0).alias("shift"), F.lit(0).alias("free"), F.lit(True).alias("ok"), empty.alias("operations"))

    def step(a: Column, e: Column) -> Column:
        width = F.length(e["source"])
        after = F.overlay(a["text"], e["replacement"], e["position"] + a["shift"] + 1, width)
        done = F.struct(e["family"], e["operation"], e["position"], e["source"], e["replacement"], e["score"], a["text"].alias("before"), after.alias("after")).cast(OPERATION)
        fits = (e["position"] >= a["free"]) & (F.substring(x, e["position"] + 1, width) == e["source"])
        return F.struct(after.alias("text"), (a["shift"] + F.length(e["replacement"]) - width).alias("shift"), (e["position"] + width).alias("free"), (a["ok"] & fits).alias("ok"), F.concat(a["operations"], F.array(done)).alias("operations"))

    return F.aggregate(by_place, start, step, lambda a: F.when(a["ok"] & (F.size(a["operations"]) > 0), F.struct(a["text"].alias("generated"), a["operations"].alias("operations"))))


def codepoint_label(x: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(x))


@F.pandas_udf(T.StringType())
def codepoint_name(x: pd.Series) -> pd.Series:
    """The Unicode name of the first character, as a label; its U+XXXX where it has none."""
    return x.map(lambda s: None if not s else unicodedata.name(s[0], f"U+{ord(s[0]):04X}"))


def number_or(x: Column, default: Column) -> Column:
    """x as a finite-or-infinite double; nulls, NaN and what can't be read become default."""
    v = x.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), default)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def has_dot_com(x: Column) -> Column:
    return F.contains(F.lower(_text(x)), F.lit(".com"))


def stable_seed(*parts: Column) -> Column:
    """First eight bytes of SHA-256 of the parts joined by |, little-endian, modulo 2**32 - 1."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    low_first = [F.substring(h, 15 - 2 * k, 2) for k in range(8)]
    n = F.conv(F.concat(*low_first), 16, 10).cast("decimal(20,0)")
    return (n % F.lit(2**32 - 1)).cast("long")


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A hex string that orders rows at random, the same in every run."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"), 256)


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """A number strictly between 0 and 1 from hash_order."""
    return (F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def replaceable_count(x: Column, characters: str) -> Column:
    return F.length(x) - F.length(F.translate(x, characters, ""))


def match_bin(similarity: Column, length_ratio: Column) -> Column:
    """Similarity in twentieths and length ratio in tenths, halves to even."""
    return F.struct(F.bround(similarity * 20).cast("int").alias("similarity"), F.bround(length_ratio * 10).cast("int").alias("length"))


def bin_distance(a: Column, b: Column) -> Column:
    return F.abs(a["similarity"] - b["similarity"]) * 2 + F.abs(a["length"] - b["length"])


def length_bucket(x: Column, short: int, medium: int) -> Column:
    return F.when(F.length(x) <= short, "short").when(F.length(x) <= medium, "medium").otherwise("long")


def exact_rule_score(glyph: Column, area: Column, margin: Column, preferred: Column, name: Column) -> Column:
    """Score of a look-alike rule: similarity, area and margin, a bonus by script, less for odd alphabets."""
    upper = F.upper(_text(name))
    has = lambda *parts: F.lit(False) if not parts else _any(*[F.contains(upper, F.lit(p)) for p in parts])
    # fixed values: bonus by script and malus
    bonus = F.when(preferred, 100.0).when(has("CYRILLIC"), 25.0).when(has("GREEK"), 20.0).when(has("ARMENIAN", "HEBREW"), 8.0).otherwise(0.0)
    malus = F.when(has("MATHEMATICAL", "ROMAN NUMERAL", "SMALL CAPITAL"), 35.0).otherwise(0.0)
    base = number_or(glyph, F.lit(0.0)) * 100 - F.abs(number_or(area, F.lit(1.0)) - 1) * 25
    return base + F.least(F.greatest(number_or(margin, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 5 + bonus - malus


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def ocr_rule_score(visual: Column, contexts: Column, q25: Column, source: Column) -> Column:
    known = number_or(q25, F.lit(None).cast("double"))
    base = number_or(visual, F.lit(0.0)) * 10 + F.least(number_or(contexts, F.lit(0.0)), F.lit(10.0))
    return base + F.when(known.isNotNull(), known * 20).when(_text(source).startswith("manual_user"), 35.0).otherwise(0.0)


def review_score(q25: Column, visual: Column) -> Column:
    return number_or(q25, number_or(visual, F.lit(None).cast("double")))


def difficulty_bucket(rate: Column) -> Column:
    """safe_hard up to .20, ambiguous from .35 to .65, else ocr_easy (fixed values); null for no rate."""
    return F.when(rate <= 0.20, "safe_hard").when((rate >= 0.35) & (rate <= 0.65), "ambiguous").when(rate.isNotNull(), "ocr_easy")


def candidate_outputs(json: Column, source: Column) -> Column:
    """All candidate outputs of a JSON map of models, without empty ones and the source itself."""
    parsed = F.from_json(json, "map<string,struct<candidate_outputs:array<string>>>")
    every = F.flatten(F.transform(F.map_values(parsed), lambda m: F.coalesce(m["candidate_outputs"], F.array().cast("array<string>"))))
    return F.coalesce(F.filter(every, lambda v: (v != "") & v.isNotNull() & (v != source)), F.array().cast("array<string>"))


def overlap_type(stride: Column, width: Column) -> Column:
    return F.when(stride < width, "overlapping").otherwise("non-overlapping")


def overlap_percent(stride: Column, width: Column) -> Column:
    return F.bround((F.lit(1) - stride / width) * 100).cast("int")


def windows_of(values: Column, width: int, stride: int) -> Column:
    """Sub-arrays of `width` values, `stride` apart; none where values are fewer."""
    last = F.size(values) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(width)))


def whole_image(pad_to_width: Column) -> Column:
    """Whether a run took the padded image as one strip: its width is given, and isn't an empty text or None."""
    return F.coalesce(~F.btrim(pad_to_width.cast("string")).isin("", "None"), F.lit(False))


def without_padding(columns: Column) -> Column:
    """An image, as an array of pixel columns, without those at either end whose pixels are all 0 or 1; all if none is left."""
    inked = F.filter(F.transform(columns, lambda c, i: F.when(F.exists(c, lambda p: (p != 0) & (p != 1)), i)), lambda i: i.isNotNull())
    return F.transform(F.array(inked), lambda k: F.when(F.size(k) == 0, columns).otherwise(F.slice(columns, F.get(k, F.lit(0)) + 1, F.element_at(k, -1) - F.get(k, F.lit(0)) + 1)))[0]


def strips(columns: Column, width: int, stride: int | None = None, trim: bool = False, pad_to_width: int | None = None) -> Column:
    """Strips of `width` pixel columns, `stride` apart (width unless given), after trimming and padding.

    Padding repeats the corner pixel, and cuts wider images.
    """
    out = without_padding(columns) if trim else columns
    if pad_to_width is not None:
        blank = F.transform(F.get(out, F.lit(0)), lambda p: F.get(F.get(out, F.lit(0)), F.lit(0)))
        more = F.array_repeat(blank, F.greatest(F.lit(0), F.lit(pad_to_width) - F.size(out)))
        out = F.slice(F.concat(out, more), 1, pad_to_width)
    return windows_of(out, width, stride or width)


def pad_to(values: Column, width: int, fill: float) -> Column:
    """Exactly `width` values: cut, or filled up at the end."""
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.size(values)))
    return F.slice(F.concat(values.cast("array<double>"), more), 1, width)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def masked_mean(values: Column, length: Column) -> Column:
    own = F.slice(values.cast("array<double>"), 1, length)
    return _sum(own) / F.greatest(F.size(own), F.lit(1))


def masked_max(values: Column, length: Column) -> Column:
    return F.array_max(F.slice(values.cast("array<double>"), 1, length))


def masked_attention(values: Column, logits: Column, length: Column) -> Column:
    """The mean of values weighted by a softmax over the first `length` logits."""
    own, at = F.slice(values.cast("array<double>"), 1, length), F.slice(logits.cast("array<double>"), 1, length)
    w = F.transform(at, lambda v: F.exp(v - F.array_max(at)))
    return _sum(F.zip_with(own, w, lambda a, b: a * b)) / _sum(w)


def mixed_sort_key(x: Column) -> Column:
    """Numbers before words: numbers by value, words in lower case."""
    v = x.try_cast("double")
    return F.struct(v.isNull().alias("word"), v.alias("number"), F.when(v.isNull(), F.lower(x.cast("string"))).alias("text"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def character_class(x: Column) -> Column:
    """Domain-like characters by their script: latin, greek or cyrillic; other, or null if not domain-like."""
    like = x.rlike(r"^(\p{Nd}|\p{Ll}|\p{Lo})$") & (F.lower(x) == x)
    return F.when(~like, F.lit(None)).when(x.rlike(r"\p{IsLatin}"), "latin").when(x.rlike(r"\p{IsGreek}"), "greek").when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("other")


@F.pandas_udf(T.BooleanType())
def changed_by_nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s) != s)


def binary_label(x: Column) -> Column:
    """0.0 or 1.0 where x says so as a number; null for all else."""
    v = F.btrim(x.cast("string")).try_cast("double")
    return F.when(v.isin(0.0, 1.0), v)


#: Fixed value: what normalized names consist of.
NORMAL_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-"


def table_normalizer(exact: dict[str, str], ocr: dict[str, str]):
    """A function of a column: each character by the tables (ocr wins), else by what NFKD and case folding make of it.

    Tables map a character to one of NORMAL_CHARACTERS. Whitespace goes, and so does what neither a
    table nor the fallback knows; a character may give several, as a ligature does. Nulls stay.
    """
    mapping = {c: c for c in NORMAL_CHARACTERS} | {c: v for c, v in exact.items() if v in NORMAL_CHARACTERS} | dict(ocr)

    class Table(dict):
        def __missing__(self, code: int) -> str:
            c = chr(code)
            folded = "" if c.isspace() else unicodedata.normalize("NFKD", c).casefold()
            self[code] = out = "".join(k for k in folded if k in NORMAL_CHARACTERS)
            return out

    start = {ord(c): v for c, v in mapping.items() if not c.isspace()}

    @F.pandas_udf(T.StringType())
    def normalize(x: pd.Series) -> pd.Series:
        table = Table(start)
        return x.map(lambda s: None if s is None else s.translate(table))

    return normalize
