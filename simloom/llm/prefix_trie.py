"""The prefix trie of conversations, family-first: each family's small trie, then a merge of family nodes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.mixing import WORD
from simloom.storage import materialize, scratch

#: Conversations of a family have the same id but for the remainder by FAMILY; of the base they take HEAD - 1 turns at most.
FAMILY, HEAD = 20, 4
#: Conversation ids are joined to texts by ranges of so many.
ID_RANGE = 4096
#: Nodes of a task that are combined before they go on.
HELD_NODES = 50_000
ROOT = b"\0" * 32


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that tell turns apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of each family's trie: key, parent, depth, words, n (members), conv_id (the least), ends (ids of members that end here).

    Turns go to their family as digests and word counts, sorted so that the base's own come first: its
    first turns are kept, and every other conversation is rebuilt as its turns pass by. A task holds
    the nodes of the family at hand; where a conversation is so long that they are too many, they go on earlier,
    which merging evens out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = conversations.filter("conv_id IS NOT NULL").select(base.cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_digest(role, text).alias("digest"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("words"))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "digest").select("base", "conv_id", "digest", "words")
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[bytes, list] = {}
        family = conv = None
        head: list[tuple[bytes, int]] = []
        key, depth, skip = ROOT, 0, 0

        def add(at: bytes, parent: bytes | None, words: int) -> None:
            n = nodes.get(at)
            if n is None:
                nodes[at] = [at, parent, depth, words, 1, conv, []]
            else:
                n[4] += 1
                n[5] = min(n[5], conv)

        def walk(digest: bytes, words: int) -> None:
            nonlocal key, depth
            parent, key, depth = key, hashlib.sha256(key + digest).digest(), depth + 1
            add(key, parent, words)

        def end() -> None:
            if key not in nodes:  # handed on already
                nodes[key] = [key, None, depth, 0, 0, conv, []]
            nodes[key][6].append(conv)

        def out() -> pa.RecordBatch:
            columns = list(zip(*nodes.values(), strict=True))
            nodes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for b in batches:
            for f, c, digest, words in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if c != conv:
                    if conv is not None:
                        end()
                    if f != family:
                        family, head = f, []
                        if len(nodes) >= max(1, HELD_NODES // 10):
                            yield out()
                    conv, key, depth, skip = c, ROOT, 0, 0
                    add(ROOT, None, 0)
                    if c != f:
                        skip = zlib.crc32(str(c).encode()) % HEAD
                        for d, w in head[:skip]:
                            walk(d, w)
                if c == f and len(head) < HEAD - 1:
                    head.append((digest, words))
                if skip:
                    skip -= 1
                else:
                    walk(digest, words)
                if len(nodes) >= HELD_NODES:
                    yield out()
        if conv is not None:
            end()
        if nodes:
            yield out()

    return rows.mapInArrow(run, "key binary, parent binary, depth long, words long, n long, conv_id long, ends array<long>")


def _ends(family: DataFrame) -> DataFrame:
    """key, ends_sha256 of nodes where conversations end. Ids are joined in ranges, and ranges hashed in order, so no task holds them all."""
    ids = family.filter(F.size("ends") > 0).select("key", F.explode("ends").alias("id")).withColumn("_range", F.floor(F.col("id") / ID_RANGE))
    ranges = ids.groupBy("key", "_range").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    ranges = ranges.repartition("key").sortWithinPartitions("key", "_range").select("key", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        keys: list[bytes] = []
        told: list[str] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(told)], names=["key", "ends_sha256"])
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(f",{ids}".encode())
                    continue
                if key is not None:
                    keys.append(key)
                    told.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            if len(keys) >= 10_000:
                yield out()
                keys, told = [], []
        if key is not None:
            keys.append(key)
            told.append(state.hexdigest())
        if keys:
            yield out()

    return ranges.mapInArrow(run, "key binary, ends_sha256 string")


def _subtrees(shared: DataFrame) -> DataFrame:
    """key with leaves and saved summed over its subtree. shared: key, up (parent), leaves, saved.

    By pointer doubling: after round i a node has the sums of all within 2^i levels, and up is its ancestor that far.
    """
    t = materialize(shared, "trie-sums")
    while t.filter("up IS NOT NULL").limit(1).count():
        sums = t.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        above = t.filter("up IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("_next"))
        t = t.join(sums, "key", "left").join(above, "up", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        t = materialize(t.select("key", F.col("_next").alias("up"), plus("leaves", "_l"), plus("saved", "_s")), "trie-sums")
    return t.select("key", "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations' turn prefixes, a row per node.

    conversations: conv_id (integral), turn, role, text; other columns are ignored. Every conversation c is
    rebuilt: the first h turns of its base c - c % 20, then its own after its first h, h = crc32(decimal c) % 4.
    Returns conv_id (least member) and depth, which name a node; parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (of its subtree), ends_sha256 (of the ids of members that end there).

    Turns are in order of turn (nulls first), then role and digest; repeated rows are turns of their own. A
    null role or text is empty; rows without conv_id take no part; an empty table gives no rows, not even the root.

    Scale: no text is shuffled. Rows of a node are combined in each family, then by partial sums. Only
    nodes of several conversations are summed over subtrees, in log2(depth) rounds; all others have
    one leaf and save nothing.
    """
    with scratch(conversations.sparkSession) as tables:
        family = materialize(family_nodes(conversations), "family-nodes")
        nodes = materialize(family.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")), "trie-nodes")
        children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("_lone"))
        nodes = materialize(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-parents")
        leaves = F.coalesce("_lone", F.lit(0)) + (F.col("n_children") == 0).cast("long")
        shared = nodes.filter("n_convs > 1").select("key", F.col("parent").alias("up"), leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
        summed = _subtrees(shared)
        root = F.broadcast(nodes.filter("depth = 0").select(F.col("conv_id").alias("_root")))
        above = nodes.filter("depth > 0 AND n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
        low = nodes.filter("depth <= 1").crossJoin(root).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("_root"))).drop("_root")
        deep = nodes.filter("depth > 1").join(above, "parent").withColumnRenamed("_above", "parent_conv_id")
        told = low.unionByName(deep).join(_ends(family), "key", "left").join(summed, "key", "left")
        told = told.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        return tables.keep(told, "prefix-trie")
