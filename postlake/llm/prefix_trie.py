"""The trie of conversation prefixes: what is shared between conversations, and what a cache of it would save.

Every turn becomes a digest of its role and text; every prefix gets the digest of the one before it and of its last turn, so
equal digests are equal prefixes, and no text is shuffled.  Conversations are exploded into their prefixes, which
grouped by (depth, digest) are the nodes.  Sums over subtrees come from exploding nodes to all their ancestors; the nodes that
a conversation is the smallest member of are the lower end of its own path, so their sums are added up along that
path first, and a conversation sends one row an ancestor, not one a node and ancestor.

A conversation may hold a third of all turns: turns are numbered within range partitions, and chains and sums go by blocks of
``BLOCK`` turns, whose own digests are chained in turn.  The ids that end at a node are joined in pieces of
bounded size before one task hashes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.runtime import Scratch, ship_package

#: Turns of a block and ids of a piece (numbers of bits).
BLOCK, PIECE = 12, 10
ROOT = b"\0" * 32


def ordered_turns(turns: DataFrame, scratch: Scratch, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest, chars (code points of the text) of every turn, by turn, null first.

    Null roles and texts are empty.  Turns of one number go by the digest of role and text.  Rows without a
    conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "digest", "row"]
    ranged = scratch.keep(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ranged")
    # a range partition goes on with at most one conversation that began before it, so these are no more than partitions
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "part", F.sum("n").over(earlier).alias("before")).where("before is not null")
    numbered = ranged.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1)
    pos = F.col("pos") + F.coalesce("before", F.lit(0))
    return numbered.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", pos.cast("long").alias("pos"), "digest", "chars")


def with_shared_beginnings(turns: DataFrame, scratch: Scratch, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations as if the first of each ``every`` ids had been continued by the others.

    Conversation c begins with the first h turns of conversation c - c % ``every`` (all if it has fewer, none where there
    is none), and goes on with its own turns after its first h; h is the CRC-32 of its decimal id modulo ``most``.
    Returns the turns (conv_id, depth from 1, digest, chars, length) and the conversations (conv_id, length), of which
    some may have no turn left.
    """
    turns = scratch.keep(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    # at most ``most`` - 1 turns each
    first = turns.where((F.col("conv_id") == base) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    head = F.expr("slice(first, 1, cast(h as int))")
    taken = F.when(F.col("first").isNull(), 0).otherwise(F.least(F.size("first"), F.col("h"))).cast("long")
    plan = own.join(first, "base", "left").select("conv_id", "h", F.when(taken > 0, head).alias("head"), taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    plan = scratch.keep(plan, "plan")
    heads = plan.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.chars", "length")
    rest = turns.where(F.col("pos") >= h).join(plan.select("conv_id", "h", "taken", "length"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).cast("long").alias("depth"), "digest", "chars", "length")
    return heads.unionByName(rest), plan.select("conv_id", "length")


def _block(depth: Column) -> Column:
    return F.shiftright(depth - 1, BLOCK)


def _blocks_of(batches: Iterator[pa.RecordBatch], close) -> Iterator[pa.RecordBatch]:
    """The end of each chain of turn digests that begins anew with every (conv_id, block)."""
    last, state, rows = None, ROOT, []
    for batch in batches:
        for conv, block, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "digest")), strict=True):
            if (conv, block) != last:
                if last:
                    rows.append((*last, state))
                last, state = (conv, block), ROOT
            state = hashlib.sha256(state + digest).digest()
        yield close(rows)
        rows = []
    yield close([(*last, state)] if last else [])


def _table(names: list[str], kinds: list[pa.DataType]):
    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return made


def chained(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, chars, length, prev, key of every prefix: ``key`` is its digest, ``prev`` that of the prefix before it.

    Within a block each digest is that of the one before and the turn's; the last of a full block is that of the
    block's beginning and the block's own chain instead, so that blocks of one conversation can be worked on side by side once
    their own chains are known.
    """
    ship_package(turns.sparkSession)
    size = 1 << BLOCK
    turns = scratch.keep(turns.withColumn("block", _block(F.col("depth"))), "rebuilt")
    ends = _table(["conv_id", "block", "digest"], [pa.int64(), pa.int64(), pa.binary()])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, ROOT
        for batch in batches:
            rows = []
            for conv, block, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "digest")), strict=True):
                state = hashlib.sha256((state if conv == last else ROOT) + digest + b"block").digest()
                last = conv
                rows.append((conv, block + 1, state))
            yield ends(rows)

    full = turns.where((F.col("length") > size) & (F.col("block") < F.shiftright("length", BLOCK))).select("conv_id", "block", "depth", "digest")
    own = full.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(lambda b: _blocks_of(b, ends), "conv_id long, block long, digest binary")
    seeds = own.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(begin, "conv_id long, block long, digest binary")
    seeds = seeds.select("conv_id", "block", (F.col("block") * size).alias("depth"), "digest", F.lit(None).cast("long").alias("chars"), F.lit(0).cast("long").alias("length"))
    made = _table(["conv_id", "depth", "chars", "length", "prev", "key"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seed, state, own = None, ROOT, ROOT, ROOT
        for batch in batches:
            rows = []
            for conv, block, depth, digest, chars, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "depth", "digest", "chars", "length")), strict=True):
                if (conv, block) != last:
                    last, seed, state, own = (conv, block), ROOT, ROOT, ROOT
                if chars is None:
                    seed = state = digest
                    continue
                prev, own = state, hashlib.sha256(own + digest).digest()
                state = hashlib.sha256(state + digest).digest() if depth % size else hashlib.sha256(seed + own + b"block").digest()
                rows.append((conv, depth, chars, length, prev, state))
            yield made(rows)

    both = turns.select("conv_id", "block", "depth", "digest", "chars", "length").unionByName(seeds)
    return both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(run, "conv_id long, depth long, chars long, length long, prev binary, key binary")


def _ends(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """depth, key, ends_sha256 of the nodes where conversations end."""
    rows = prefixes.where("depth = length").select("depth", "key", "conv_id").unionByName(conversations.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = rows.groupBy("depth", "key", F.shiftright("conv_id", PIECE).alias("piece")).agg(ids.alias("ids"))
    made = _table(["depth", "key", "ends_sha256"], [pa.int64(), pa.binary(), pa.string()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for depth, key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "ids")), strict=True):
                if (depth, key) == last:
                    h.update(b",")
                else:
                    if last:
                        rows.append((*last, h.hexdigest()))
                    last, h = (depth, key), hashlib.sha256()
                h.update(ids.encode())
            yield made(rows)
        yield made([(*last, h.hexdigest())] if last else [])

    return pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "piece").select("depth", "key", "ids").mapInArrow(run, "depth long, key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row a node: conv_id (the smallest that begins with it), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes
    without children in its subtree, itself included), saved_tokens (over its subtree, what a conversation beyond the
    first spares: the code points of each node's last text), ends_sha256 (of the ids that end there, ascending).

    ``turns`` (conv_id, depth, digest, chars, length) and ``conversations`` (conv_id, length) as of
    ``with_shared_beginnings``; a conversation without turns ends at the root, which has depth 0, no text and no parent.
    Repeated conversations share all their nodes.  Without conversations there is no node.
    """
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    prefixes = scratch.keep(chained(turns, scratch), "prefixes")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("prev"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs", "n_ends")
    nodes = prefixes.groupBy("depth", "key", "prev", "chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"))
    nodes = nodes.unionByName(root).withColumns({"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaf": (F.col("n_ends") == F.col("n_convs")).cast("long")})
    nodes = scratch.keep(nodes, "nodes")

    # along its own path a conversation adds up the nodes that it is the smallest member of, from the deepest on
    mine = nodes.where("depth > 0").select("conv_id", "depth", "saved", "leaf")
    path = prefixes.select("conv_id", "depth", "key", "length").join(mine, ["conv_id", "depth"], "left").withColumn("block", _block(F.col("depth")))
    deeper = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = path.select("conv_id", "depth", "block", "key", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(c) for c in ("saved", "leaf")))
    long = nodes.where("depth > 0").select("conv_id", _block(F.col("depth")).alias("block"), "saved", "leaf")
    blocks = long.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in ("saved", "leaf")))
    # of conversations of more than one block, what the later ones hold goes to every earlier one
    reach = prefixes.where(F.col("length") > (1 << BLOCK)).where((F.col("depth") - 1) % (1 << BLOCK) == 0).select("conv_id", _block(F.col("depth")).alias("block"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = reach.join(blocks, ["conv_id", "block"], "left").select("conv_id", "block", *(F.sum(c).over(after).alias(f"{c}_later") for c in ("saved", "leaf")))
    sums = sums.join(later, ["conv_id", "block"], "left")
    given = sums.select("depth", "key", *((F.col(c) + F.coalesce(f"{c}_later", F.lit(0))).alias(c) for c in ("saved", "leaf")), F.lit(0).alias("child")).where("saved > 0 or leaf > 0")
    zero = F.lit(0).cast("long")
    to_root = nodes.select(zero.alias("depth"), F.lit(ROOT).alias("key"), "saved", "leaf", F.lit(0).alias("child"))
    to_parent = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("prev").alias("key"), zero.alias("saved"), zero.alias("leaf"), F.lit(1).alias("child"))
    below = given.unionByName(to_root).unionByName(to_parent).groupBy("depth", "key").agg(F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, ["depth", "key"]).join(_ends(prefixes, conversations), ["depth", "key"], "left").join(parents, ["depth", "prev"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
