"""WARC archives: written in parallel, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.llm.arrow import batch, small_batches
from simloom.llm.sketch import maybe_in, sketch
from simloom.storage import join_small, materialize, new_path

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
#: Equal payloads of so many bytes are written once.
REVISIT_BYTES = 100
#: Bytes of a cell in which a record meets its pieces.
CELL = 65_536


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def _record_id(page: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws(":", page, digest, copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(again: Column, copy: Column, first: Column, date: str) -> Column:
    only = lambda c: F.when(again, c)
    url = F.regexp_replace(F.regexp_replace(F.col("_url"), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("_p"), F.col("_digest"), copy)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        _line("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", only(_record_id(first.cast("string"), F.col("_digest"), F.lit(1)))),
        _line("X-Page-Id", F.col("_page")),
        _line("X-Refers-To-Page-Id", only(first.cast("string"))),
        _line("X-Payload-Length", F.col("_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(again, F.lit("0")).otherwise(F.col("_bytes").cast("string")),
    )
    return F.concat(header, F.lit(BREAK), F.when(again, F.lit("")).otherwise(F.col("_html")))


def write_archive(pages: DataFrame, path: str | None = None, date: str = "2020-01-01T00:00:00Z") -> str:
    """Write a record for each row of pages (page_id, url, html) under path; returns the path.

    Of records with equal payloads of REVISIT_BYTES at least, that with the smallest page_id is a
    response; the others are revisits, without a block, and name its record and page. All others are
    responses. A null html is an empty payload. Of rows that repeat a page_id and its payload one is
    the response. A row without page_id is never referred to, but revisits one that has a page_id.

    Scale: equal payloads are found on digests alone. A sketch of a fixed size tells most payloads
    that occur once; these are written where they are read. The others are shuffled, by digest and
    page_id, so that no digest is a hot key. Files are written by Spark's text writer, with the
    record's end as line separator, to any file system that Spark reaches.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("_page"), F.col("page_id").cast("long").alias("_number"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_p"), F.sha2(html.cast("binary"), 256).alias("_digest"), F.octet_length(html).cast("long").alias("_bytes"), F.col("url").cast("string").alias("_url"), html.alias("_html"))
    ids = rows.groupBy("_digest", "_p").agg(F.first("_number").alias("_number"), F.first("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    ids = materialize(ids, "warc-digests")
    several = materialize(ids.groupBy("_digest").agg(F.min("_number").alias("_first"), F.sum("_n").alias("_of"), F.first("_bytes").alias("_size")).filter("_of > 1"), "warc-repeated")
    repeated = sketch(several, ["_digest"])
    never = F.lit(False)
    alone = maybe_in(rows, repeated, ["_digest"]).filter(~F.col("_maybe"))
    alone.select(_record(never, F.lit(1), F.lit(None), date).alias("value")).write.option("lineSep", BREAK).text(path)
    roles = maybe_in(ids.select("_digest", "_p"), repeated, ["_digest"]).filter("_maybe").drop("_maybe")
    roles = roles.join(several.filter(F.col("_size") >= REVISIT_BYTES).select("_digest", "_first"), "_digest", "left")
    told = maybe_in(rows, repeated, ["_digest"]).filter("_maybe").drop("_maybe").join(roles, ["_digest", "_p"])
    told = told.withColumn("_copy", F.row_number().over(Window.partitionBy("_digest", "_p").orderBy("_url")))
    again = F.col("_first").isNotNull() & ((F.col("_number") != F.col("_first")) | F.col("_number").isNull() | (F.col("_copy") > 1))
    told.select(_record(again, F.col("_copy"), F.col("_first"), date).alias("value")).write.mode("append").option("lineSep", BREAK).text(path)
    return path


_FIELDS = ("warc-type", "x-page-id", "x-refers-to-page-id", "x-payload-length", "warc-payload-digest")
_CANDIDATE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("succ", pa.int64()), ("exit", pa.int64()), ("head", pa.int64()), ("length", pa.int64()), *[(f, pa.string()) for f in ("type", "page", "refers", "claimed_bytes", "claimed_digest", "digest")]])
_DDL = "file string, block long, rel long, size long, succ long, exit long, head long, length long, type string, page string, refers string, claimed_bytes string, claimed_digest string, digest string"


def parse(chunk: bytes) -> tuple | None:
    """Of what follows a magic: header bytes, block bytes and the header's fields; None if it can't be a record."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in chunk[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return None
    return end + 4, int(length), tuple(fields.get(f) for f in _FIELDS)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, in splits of any size: file, block (where its split begins) and value, in order."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk; offsets count from the first chunk of the split.

    rel is where the magic before the chunk would begin, succ where the record there would end. exit
    is where the chain from there leaves the split: in a split the chain is followed at once.
    """
    at, own, rows = 0, None, []

    def closed() -> pa.RecordBatch:
        ends: dict[int, int] = {}
        for r in reversed(rows):
            if r[4] is not None:
                r[5] = ends[r[2]] = ends.get(r[4], r[4])
        return batch(_CANDIDATE, *[list(c) for c in zip(*rows, strict=True)])

    for b in batches:
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (file, block) != own:
                if rows:
                    yield closed()
                at, own, rows = 0, (file, block), []
            found = parse(value) if at or block else None  # before a file's first magic there is no record
            start = at - len(MAGIC)
            if found:
                head, length, fields = found
                whole = len(value) >= head + length
                digest = hashlib.sha256(value[head : head + length]).hexdigest() if whole else None
                rows.append([file, block, start, len(value) + len(MAGIC), start + len(MAGIC) + head + length + len(BREAK), None, head, length, *fields, digest])
            else:
                rows.append([file, block, start, len(value) + len(MAGIC), None, None, None, None, None, None, None, None, None, None])
            at += len(value) + len(MAGIC)
    if rows:
        yield closed()


def _marked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of a split that the chain from its entry meets."""
    succ = dict(zip(pdf["offset"], pdf["succ"], strict=True))
    at, seen = pdf["entry"].iloc[0], set()
    while at in succ and at not in seen:
        seen.add(at)
        at = succ[at]
    return pdf[pdf["offset"].isin(seen)].drop(columns="entry")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records under path: file, offset, type, page, refers, claimed_bytes, claimed_digest, length, digest (SHA-256 of the block).

    Every magic is a candidate record, also one inside a payload. A task gives each candidate's
    successor by its Content-Length. From the start of a file only real records are reached, by
    pointer jumping over the splits of the file; what isn't reached is dropped. A file is read up to
    where its chain breaks. Records whose block has the magic in it are put together from their pieces.

    Scale: splits are read by different tasks, and in a split the chain is followed at once, so that
    jumping takes rounds by the logarithm of a file's splits, over one or two candidates of each.
    """
    small_batches(spark)
    found = materialize(_chunks(spark, path).mapInArrow(_candidates, _DDL), "warc-candidates")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("_size"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("_size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    blocks = materialize(blocks, "warc-blocks")
    records = join_small(found.filter("succ IS NOT NULL"), blocks, ["file", "block"]).withColumn("offset", F.col("rel") + F.col("base")).withColumn("succ", F.col("succ") + F.col("base")).withColumn("exit", F.col("exit") + F.col("base"))
    jump = records.select("file", "offset", "exit", "block")
    most = blocks.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    reached = jump.filter("offset = 0").select("file", "offset", "block")
    if most > 1:
        targets = jump.select("file", F.col("exit").alias("offset")).distinct()
        jump = materialize(jump.join(targets, ["file", "offset"], "left_semi").unionByName(jump.filter("offset = 0")).distinct(), "warc-jumps")
        reached = materialize(reached, "warc-reached")
        for _ in range(math.ceil(math.log2(most)) + 1):
            to = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
            new = jump.select("file", "offset", "block").join(to, ["file", "offset"], "left_semi")
            reached = materialize(reached.unionByName(new).distinct(), "warc-reached")
            on = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("_further"))
            jump = materialize(jump.join(on, ["file", "exit"], "left").select("file", "offset", F.coalesce("_further", "exit").alias("exit"), "block"), "warc-jumps")
    entries = materialize(reached.groupBy("file", "block").agg(F.min("offset").alias("entry")), "warc-entries")
    records = join_small(records.drop("rel", "size", "exit", "base"), entries, ["file", "block"])
    kept = records.groupBy("file", "block").applyInPandas(_marked, records.drop("entry").schema)
    kept = materialize(kept, "warc-records")
    cut = kept.filter("digest IS NULL").select("file", "offset", "succ", "head", "length")
    if cut.limit(1).count():
        spans = cut.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("offset") / CELL), F.floor(F.col("succ") / CELL))))
        pieces = join_small(_chunks(spark, path).mapInArrow(_placed, "file string, block long, rel long, value binary"), blocks, ["file", "block"])
        pieces = pieces.select("file", (F.col("rel") + F.col("base")).alias("_at"), "value").withColumn("_cell", F.floor(F.col("_at") / CELL))
        met = join_small(pieces, materialize(spans, "warc-spans"), ["file", "_cell"]).filter("_at >= offset AND _at < succ")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.hex("value").alias("v")))), lambda x: x["v"]), MAGIC.encode().hex())
        whole = met.groupBy("file", "offset", "head", "length").agg(F.unhex(joined).alias("_all"))
        digest = F.sha2(F.substring(F.col("_all"), F.col("head") + 1, F.col("length")), 256)
        full = F.octet_length("_all") >= F.col("head") + F.col("length")
        kept = kept.join(whole.filter(full).select("file", "offset", digest.alias("_digest")), ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "_digest")).drop("_digest")
    return kept.select("file", "offset", "type", "page", "refers", "claimed_bytes", "claimed_digest", "length", "digest")


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, own = 0, None
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("value", pa.binary())])
    for b in batches:
        rel = []
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (file, block) != own:
                at, own = 0, (file, block)
            rel.append(at - len(MAGIC))
            at += len(value) + len(MAGIC)
        yield batch(schema, b.column(0), b.column(1), rel, b.column(2))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok.

    digest_ok: whether the payload that was read has the digest that its header states (null for
    revisits, whose payload isn't stored again).
    """
    told = read_archive(pages.sparkSession, write_archive(pages))
    again = F.col("type") == "revisit"
    claimed = F.regexp_replace("claimed_digest", "^sha256:", "")
    return told.select(
        F.col("page").cast("long").alias("page_id"),
        F.when(again, F.col("claimed_bytes").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(again, claimed).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast("long").alias("refers_to"),
        F.when(~again, F.col("digest") == claimed).alias("digest_ok"),
    )
