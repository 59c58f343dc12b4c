"""Conversation prefix trie by ROLLUP.

A conversation is cut into blocks of ``BLOCK`` turns, and the turns of a block are positional columns next to the node in
which the prior block ended. One rollup over the columns aggregates the conversations of all prefixes of the block; its
grouping id tells the depth. A second rollup over the nodes sums their subtrees. A node's key is a digest of its prefix.
Keys of block ends are found by doubling: after k rounds a block's digest covers 2^k blocks. Subtrees that go on in further
blocks are summed in the same way, from block roots to the roots above them. So the number of jobs grows with the logarithm
of the longest conversation, and conversations of at most ``BLOCK`` turns need no round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

#: Turns per block, the columns of a rollup.
BLOCK = 8
#: Turns that may come from the conversation whose id is the next lower multiple of 100.
SHARED = 5
ROOT = b"\0" * 16
#: The rollup's columns: the turns of a block, the last one told by the key of the block's end.
_COLUMNS = [*(f"t{j}" for j in range(1, BLOCK)), "full"]


def _digest(*parts):
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 1, t (the turn as digest of role and text, and the code points of its text).

    Turns go by number, null first; equal numbers by role and digest. Null role or text is empty. Rows without a
    conversation id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.struct(_digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("id"), F.length(text).cast("long").alias("n")).alias("t"))
    return rows.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "t")).alias("pos"), "t")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, t of every conversation rebuilt: its first turns are those of conversation ``c - c % 100``.

    Their number is crc32 of the id's decimal digits modulo 6. A conversation left without turns has one row with null
    pos and t. The remainder has the sign of the id, as in SQL.
    """
    own = stash(turns(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    ids = own.select("conv_id").distinct().select("conv_id", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = own.filter((F.col("pos") <= SHARED) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("base"), "pos", "t")
    # a base serves at most 100 conversations with at most five turns
    taken = ids.join(heads, "base", "left").filter(F.col("pos").isNull() | (F.col("pos") <= F.col("h"))).select("conv_id", "pos", "t")
    marks = ids.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast(own.schema["t"].dataType).alias("t"))
    kept = own.filter(F.col("pos") > shared)
    # turns that follow a short head move up; only their number is needed
    have = taken.filter(F.col("pos").isNotNull()).groupBy("conv_id").agg(F.count("*").alias("had"))
    moved = kept.join(have, "conv_id", "left").select("conv_id", (F.col("pos") - shared + F.coalesce("had", F.lit(0))).cast("int").alias("pos"), "t")
    return taken.filter(F.col("pos").isNotNull()).unionByName(moved).unionByName(marks)


def blocks(built: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, q from 0, prior (key of the block's root), t1 to t7, full, n1 to n8, size, total.

    ``full`` is the key of the block's end and null in a block that has free columns; n1 to n8 are the turns' code points.
    """
    j = (F.col("pos") - 1) % BLOCK
    q = F.coalesce(F.floor((F.col("pos") - 1) / BLOCK), F.lit(0)).cast("int")
    slots = range(1, BLOCK + 1)
    packed = built.groupBy("conv_id", q.alias("q")).agg(
        *[F.max(F.when(j == k - 1, F.col("t")["id"])).alias(f"t{k}") for k in slots], *[F.max(F.when(j == k - 1, F.col("t")["n"])).alias(f"n{k}") for k in slots],
        F.count("pos").cast("int").alias("size"))
    total = built.groupBy("conv_id").agg(F.coalesce(F.max("pos"), F.lit(0)).alias("total"))
    content = _digest(F.lit(b"block"), *[F.coalesce(f"t{k}", F.lit(b"")) for k in slots])
    rows = stash(packed.join(total, "conv_id").withColumn("x", content))
    kept = [*_COLUMNS[:-1], *[f"n{k}" for k in slots], "size", "total"]
    longest = rows.agg(F.max("q").alias("q")).first()["q"] or 0
    if not longest:
        return rows.select("conv_id", "q", F.lit(ROOT).alias("prior"), *kept, F.when(F.col("size") == BLOCK, F.col("x")).alias("full"))
    ends, span = rows.filter(F.col("total") > BLOCK).select("conv_id", "q", "x"), 1
    while span <= longest:  # afterwards x covers all blocks up to q; its shape depends on q alone
        before = ends.select("conv_id", (F.col("q") + span).alias("q"), F.col("x").alias("y"))
        ends = stash(ends.join(before, ["conv_id", "q"], "left").select(
            "conv_id", "q", F.when(F.col("y").isNull(), F.col("x")).otherwise(_digest(F.lit(b"pair"), "y", "x")).alias("x")))
        span *= 2
    own, prior = ends.withColumnRenamed("x", "_own"), ends.select("conv_id", (F.col("q") + 1).alias("q"), F.col("x").alias("_prior"))
    joined = rows.join(own, ["conv_id", "q"], "left").join(prior, ["conv_id", "q"], "left")
    return stash(joined.select("conv_id", "q", F.coalesce("_prior", F.lit(ROOT)).alias("prior"), *kept, F.when(F.col("size") == BLOCK, F.coalesce("_own", "x")).alias("full")))


def _rolled(rows: DataFrame, *aggs) -> DataFrame:
    """The rollup of the positional columns within each prior node; ``level`` columns are set, the others null."""
    sets = [["prior", *_COLUMNS[:k]] for k in range(BLOCK + 1)]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "prior", *_COLUMNS).agg(F.bit_count(F.grouping_id()).alias("_free"), *aggs)
    return out.withColumn("level", F.lit(BLOCK) - F.col("_free")).drop("_free")


def _real(root):
    """Whether a group is a node: its last column is set. The root of a further block is the end of the one before."""
    real = F.when(F.col("level") == 0, root)
    for k, c in enumerate(_COLUMNS, 1):
        real = real.when(F.col("level") == k, F.col(c).isNotNull())
    return real


def _key(level):
    """Key of a node: a digest of its block's root and its turns, or the key of the block's end."""
    inner = _digest("prior", *[F.when(level >= k, F.col(c)).otherwise(F.lit(b"")) for k, c in enumerate(_COLUMNS[:-1], 1)])
    return F.when(level == 0, F.col("prior")).when(level == BLOCK, F.col("full")).otherwise(inner)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece) in order: one digest per key over its pieces, joined by commas, in constant memory."""
    now, h, out = None, None, []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out])], ["key", "ends_sha256"])

    for b in batches:
        for key, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist()):
            if key != now:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        if len(out) > 10_000:
            yield batch()
            out = []
    if h is not None:
        out.append((now, h.hexdigest()))
    if out:
        yield batch()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order: runs of at most 4,096 ids of one key, joined by commas."""
    key, ids = None, []

    def one():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "piece"])

    for b in batches:
        rows = []
        for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (k != key or len(ids) == 4096):
                rows.append(one())
                ids = []
            key = k
            ids.append(c)
        yield from (pa.Table.from_batches(rows).combine_chunks().to_batches() if rows else ())
    if ids:
        yield one()


def _ends(rows: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the conversations that end at a node. Ids travel in runs; only the runs of one node meet."""
    last = rows.filter(F.col("q") == F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / BLOCK))
    ends = last.select(_key(F.col("size")).alias("key"), "conv_id")
    runs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, piece string")
    return runs.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(_hashed, "key binary, ends_sha256 string")


def _below(nodes: DataFrame, longest: int) -> DataFrame:
    """key, children, leaves, saved of what hangs below a block's end, over all further blocks."""
    inside = nodes.filter(F.col("prior") != F.lit(ROOT)).groupBy("prior").agg(
        F.count_if(F.col("level") == 1).alias("children"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.filter(F.col("level") == BLOCK).select(F.col("key").alias("prior"), F.when(F.col("prior") != F.lit(ROOT), F.col("prior")).alias("up"))
    now = stash(inside.join(above, "prior", "left"))
    children, now, span = now.select("prior", "children"), now.drop("children"), 1
    while span <= longest:  # afterwards the sums cover 2 * span generations of blocks
        gained = now.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("prior")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = now.select(F.col("prior").alias("up"), F.col("up").alias("next"))
        now = stash(now.join(further, "up", "left").join(gained, "prior", "left").select(
            "prior", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
        span *= 2
    return now.join(children, "prior").select(F.col("prior").alias("key"), "children", "leaves", "saved")


def trie(built: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``built`` has conv_id, pos and t as :func:`rebuilt` gives them. Without any conversation there is no node.
    """
    rows = blocks(built)
    level, steps = F.col("level"), range(BLOCK + 1)
    found = _rolled(
        rows, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("q").alias("q"),
        *[F.count_if(F.col("total") == F.col("q") * BLOCK + k).alias(f"e{k}") for k in steps], *[F.max(f"n{k}").alias(f"n{k}") for k in steps[1:]])
    ending, chars = F.get(F.array(*[F.col(f"e{k}") for k in steps]), level), F.get(F.array(F.lit(0).cast("long"), *[F.col(f"n{k}") for k in steps[1:]]), level)
    nodes = stash(found.filter(_real(F.col("q") == 0)).select(
        "prior", *_COLUMNS, "level", _key(level).alias("key"), F.when(level == 1, F.col("prior")).when(level > 1, _key(level - 1)).alias("parent"), "conv_id",
        (F.col("q") * BLOCK + level).cast("long").alias("depth"), "n_convs", (ending == F.col("n_convs")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * chars).alias("saved")))
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    own = nodes.select("prior", *_COLUMNS, "level", "key", "leaf", "saved", F.lit(0).cast("long").alias("children"))
    if deepest > BLOCK:  # ends of full blocks take in what hangs below them
        below = _below(nodes, deepest // BLOCK).select("key", F.col("children").alias("_c"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        ends = own.filter(level == BLOCK).join(below, "key", "left").select(*own.columns[:-3], plus("leaf", "_l"), plus("saved", "_s"), plus("children", "_c"))
        own = own.filter(level != BLOCK).unionByName(ends)
    # the second rollup: each node counts for itself and for the nodes above it in its block; a block's end has only itself
    sums = _rolled(own.withColumnRenamed("level", "_level"), *[F.count_if(F.col("_level") == k).alias(f"c{k}") for k in steps[1:]],
                   F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("_below"))
    inner = F.get(F.array(*[F.col(f"c{k}") for k in steps[1:]]), level)
    sums = sums.filter(_real(F.col("prior") == F.lit(ROOT))).select(
        _key(level).alias("key"), F.when(level == BLOCK, F.col("_below")).otherwise(inner).alias("n_children"), "n_leaves", "saved_tokens")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    told = nodes.select("key", "parent", "conv_id", "depth", "n_convs").join(sums, "key").join(_ends(rows), "key", "left").join(parents, "parent", "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
