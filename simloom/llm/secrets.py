"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.storage import materialize

# Fixed patterns of the base kinds. hex and access state their least length in the pattern: their
# matches are whole runs, so that is the same as dropping short ones later. assign can't.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
# Weak parts, which count only beside their complement.
IDENT = r"""(?i:access_?key(?:_?id)?|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)"""
OPAQUE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?i:https?|postgres|mysql|redis|amqp|s3)://[^\x00-\x20"'<>\x7f]+"""

#: Kind: pattern, group whose length counts, its least length, part of a credential, reported alone.
KINDS = {
    "assign": (ASSIGN, 1, 6, "secret", True),
    "access": (ACCESS, 0, 20, "id", True),
    "hex": (HEX, 0, 24, "secret", True),
    "ident": (IDENT, 1, 3, "id", False),
    "opaque": (OPAQUE, 0, 32, "secret", False),
    "endpoint": (ENDPOINT, 0, 10, "endpoint", False),
}
#: Characters between two parts that still belong together.
SCOPE = 200


def _found(text: Column, kind: str) -> Column:
    """Array of gap (characters since the last match), len and ok of each match, by position.

    split() gives the text between the matches, so lengths give offsets without any Python.
    """
    pattern, group, least, _, _ = KINDS[kind]
    whole, counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    ok = lambda g: F.length(g) >= least
    if kind == "opaque":  # letters of both cases and a digit: words and paths don't count
        ok = lambda g: (F.length(g) >= least) & g.rlike("[a-z]") & g.rlike("[A-Z]") & g.rlike("[0-9]")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    each = F.zip_with(whole, counted, lambda m, g: F.struct(F.length(m).alias("len"), F.coalesce(ok(g), F.lit(False)).alias("ok")))
    each = F.zip_with(each, F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(0))), lambda m, gap: F.struct(gap.alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")))
    none = F.lit(None).cast("array<struct<gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), each).otherwise(none)


def find_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: _row, doc_id; parts: _row, kind number _k, start, end), both stored without texts."""
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", *[_found(F.col("text"), k).alias(k) for k in KINDS])
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "secret-parts")
    numbered = lambda n: lambda m, i: F.struct(F.lit(n).alias("_k"), i.alias("_i"), m["gap"].alias("gap"), m["len"].alias("len"), m["ok"].alias("ok"))
    each = [F.transform(F.col(kind), numbered(n)) for n, kind in enumerate(KINDS)]
    empty = F.array().cast("array<struct<_k:int,_i:int,gap:int,len:int,ok:boolean>>")
    parts = found.select("_row", F.explode(F.concat(*[F.coalesce(x, empty) for x in each])).alias("m")).select("_row", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_row", "_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("end", end).filter("ok").select("_row", "_k", (F.col("end") - F.col("len")).alias("start"), "end")
    return found.select("_row", "doc_id"), materialize(parts, "secret-offsets")


def _numbers(test) -> list[int]:
    return [n for n, k in enumerate(KINDS) if test(KINDS[k])]


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts to report: an identifier beside a secret, a secret beside an identifier, an endpoint beside both.

    An interval join: parts meet in cells of `scope` characters of their document, then by distance.
    A cell holds few parts, however many the document has. Weak parts that overlap a base one go.
    """
    cell = lambda x: F.floor(x / scope)
    others = parts.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    others = others.select("_row", "_cell", F.col("_k").alias("_k2"), F.col("start").alias("_s2"), F.col("end").alias("_e2"))
    weak = parts.filter(F.col("_k").isin(_numbers(lambda k: not k[4])))
    weak = weak.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")) - 1, cell(F.col("end")) + 1)))
    near = weak.join(others, ["_row", "_cell"]).filter(F.greatest(F.col("_s2") - F.col("end"), F.col("start") - F.col("_e2")) <= scope)
    over = (F.col("_s2") < F.col("end")) & (F.col("start") < F.col("_e2"))
    has = lambda role: F.bool_or(F.col("_k2").isin(_numbers(lambda k: k[3] == role)) & ~over)
    told = near.groupBy("_row", "_k", "start", "end").agg(has("id").alias("_id"), has("secret").alias("_secret"), F.bool_or(F.col("_k2").isin(_numbers(lambda k: k[4])) & over).alias("_taken"))
    is_a = lambda role: F.col("_k").isin(_numbers(lambda k: k[3] == role))
    linked = (is_a("id") & F.col("_secret")) | (is_a("secret") & F.col("_id")) | (is_a("endpoint") & F.col("_id") & F.col("_secret"))
    return told.filter(linked & ~F.col("_taken")).select("_row", "_k", "start", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row per row of docs with the secrets of its whole text.

    docs: doc_id, text; other columns are ignored. Returns doc_id, secrets (array of kind, start, end
    by start, then kind in the order of KINDS; code points, end exclusive) and base, the same for the
    kinds that count alone. A null or empty text has none. Rows that repeat are scanned each; a null
    doc_id stays. An empty table gives no rows.

    Scale: texts are read once, in the JVM. Only offsets are shuffled, by document and kind, and
    linked by document and cell.
    """
    rows, parts = find_parts(docs)
    every = parts.filter(F.col("_k").isin(_numbers(lambda k: k[4]))).unionByName(link_parts(parts, scope))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("_k") + 1)
    span = F.struct("start", F.col("_k"), "end", name.alias("kind"))
    told = every.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_all"))
    out = lambda x: F.transform(x, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.filter(F.col("_all"), lambda s: s["_k"].isin(_numbers(lambda k: k[4])))
    told = told.select("_row", out(F.col("_all")).alias("secrets"), out(base).alias("base"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.join(told, "_row", "left").select("doc_id", *[F.coalesce(F.col(x), empty).alias(x) for x in ("secrets", "base")])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
