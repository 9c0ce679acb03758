"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are written once to the shared folder, bucketed by their sender, and no text that is unique ever leaves it:

1. a sender (the rows of a few partitions, at most ``PARTS`` x ``BLOCK`` of them) sorts its distinct fingerprints and sends
   to each owner of a range of hash values the gaps between those in that range, Golomb-coded.  A fingerprint has
   ``slack`` bits more than the number of rows needs, so a text without a copy is suspected by
   chance once in 2^slack rows;
2. an owner decodes its lists and answers each sender with one bit a fingerprint: whether another sender has it too.  A
   value that a third of all rows have reaches its owner once a sender;
3. a sender turns the answers, and what it holds twice itself, into a bitmap of its rows.  Bucketed by sender, the
   texts meet their bitmap without being shuffled;
4. only suspects are shuffled: they are grouped by their very bytes, combined before the shuffle, so that a large
   group costs a row a task.  Rows find their group by digest; digests that unlike texts share, if any, by text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.runtime import Scratch

U = np.uint64
#: Rows of a block and partitions of a sender (numbers of bits); fingerprints that an owner decodes at once.
BLOCK, PARTS, OWNED = 17, 4, 1 << 20
#: Buckets that Spark allows.
MOST_BUCKETS = 100_000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending unsigned integers as gaps to the one before: quotients by 2^k in unary, remainders in k bits each.  k is
    the whole part of the logarithm of ln 2 times the mean gap, the best a power of two can do for gaps of random values."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=U(0))
    k = max(0, int(0.69 * float(values[-1]) / len(values)).bit_length() - 1)
    ends = np.cumsum((gaps >> U(k)) + U(1)).astype(np.int64) - 1
    unary = np.zeros(ends[-1] + 1, np.uint8)
    unary[ends] = 1
    binary = np.empty((len(values), k), np.uint8)
    for j in range(k):
        binary[:, j] = (gaps >> U(k - 1 - j)) & U(1)
    return k, np.packbits(unary).tobytes(), np.packbits(binary).tobytes()


def golomb_decode(n: int, k: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The ``n`` values of ``golomb_encode``."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(U) - U(1)
    binary = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
    for j in range(k):
        gaps = gaps << U(1) | binary[:, j].astype(U)
    return np.cumsum(gaps, dtype=U)


def _bucketed(df: DataFrame, scratch: Scratch, name: str, buckets: int, column: str) -> DataFrame:
    """A table written to the shared folder in buckets, so that work on each value of a column needs no shuffle.  Its
    name leaves the catalogue again: the frame holds the files."""
    spark, known = df.sparkSession, f"postlake_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch.path(name)).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(known)
    written = spark.table(known)
    spark.sql(f"drop table {known}")
    return written


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: int = 10,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when their bytes are; null counts as empty, and empty texts are a group like others.  Of equal texts the row with
    the largest id stays.  Of rows that repeat that id one stays; a null id is smaller than any, and of a group without
    ids one row stays, with a null ``keep_id``.  Whole texts of any length are compared; extra columns are ignored;
    an empty table gives an empty result.  ``fingerprint`` (a long) and ``digest`` (hexadecimal) needn't be free of
    collisions: they cost work, not results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    turn = F.floor(part / buckets)  # partitions that are equal modulo the buckets share a sender, some at a time
    sender = (F.shiftright(turn, PARTS) * buckets + part % buckets) * (1 << 33 - BLOCK) + F.shiftright(place, BLOCK)
    slot = turn % (1 << PARTS) * (1 << BLOCK) + place % (1 << BLOCK)
    rows = rows.select("*", sender.cast("long").alias("sender"), slot.cast("int").alias("slot"), fingerprint(F.col("text")).cast("long").alias("fp"), F.unhex(digest(F.col("text"))).alias("digest"))
    texts = _bucketed(rows, scratch, "texts", buckets, "sender")

    n = texts.count()
    bits = min(63, max(1, (n - 1).bit_length()) + slack)
    owners = max(buckets, -(-n // OWNED))
    width = -(-(1 << bits) // owners)  # of an owner's range
    cut = U(64 - bits)

    def own(table: pa.Table) -> np.ndarray:
        return table.column("fp").to_numpy().view(U) >> cut

    def send(table: pa.Table) -> pa.Table:
        values = np.unique(own(table))
        owner = (values // U(width)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        found = []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            k, quotients, remainders = golomb_encode(values[a:b] - U(int(owner[a]) * width))
            found.append((int(owner[a]), int(table.column("sender")[0].as_py()), int(b - a), k, quotients, remainders))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["owner", "sender", "n", "k", "quotients", "remainders"])

    def decide(table: pa.Table) -> pa.Table:
        lists = [golomb_decode(r["n"], r["k"], r["quotients"], r["remainders"]) for r in table.select(["n", "k", "quotients", "remainders"]).to_pylist()]
        values, count = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[count > 1]
        found = [np.isin(x, shared, assume_unique=True) for x in lists]
        keep = pa.array([bool(x.any()) for x in found])
        answers = pa.array([np.packbits(x).tobytes() for x in found], pa.binary())
        return pa.Table.from_arrays([table.column("sender").filter(keep), table.column("owner").filter(keep), answers.filter(keep)], names=["sender", "owner", "bits"])

    def receive(mine: pa.Table, answers: pa.Table) -> pa.Table:
        values, at, count = np.unique(own(mine), return_inverse=True, return_counts=True)
        again, owner = count > 1, (values // U(width)).astype(np.int64)
        for r in answers.to_pylist():
            a, b = np.searchsorted(owner, [r["owner"], r["owner"] + 1])
            again[a:b] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
        slots = mine.column("slot").to_numpy()[again[at]]
        names, kinds = ["sender", "words"], [pa.int64(), pa.list_(pa.int64())]
        if not len(slots):
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        words = np.zeros(int(slots.max()) // 64 + 1, U)
        np.bitwise_or.at(words, slots >> 6, U(1) << (slots & 63).astype(U))
        return pa.Table.from_arrays([mine.column("sender").slice(0, 1).combine_chunks(), pa.array([words.view(np.int64)], kinds[1])], names=names)

    lists = texts.select("sender", "fp").groupBy("sender").applyInArrow(send, "owner long, sender long, n int, k int, quotients binary, remainders binary")
    answers = lists.groupBy("owner").applyInArrow(decide, "sender long, owner long, bits binary")
    mine = texts.select("sender", "slot", "fp").groupBy("sender")
    flags = scratch.keep(mine.cogroup(answers.groupBy("sender")).applyInArrow(receive, "sender long, words array<long>"), "flags")

    # the bucketed side isn't shuffled, and of the other one a row a sender is
    marked = texts.join(flags.hint("shuffle_hash"), "sender", "left")
    suspect = F.coalesce(F.bit_get(F.get("words", F.shiftright("slot", 6)), F.col("slot").bitwiseAND(63)) == 1, F.lit(False))
    suspects = marked.where(suspect)
    stays = [F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"), F.count(F.lit(1)).alias("group_size")]
    classes = scratch.keep(suspects.groupBy("digest", "text").agg(*stays), "classes")
    # none where all classes of a digest are one
    one = F.count(F.lit(1)) == 1
    by_digest = scratch.keep(classes.groupBy("digest").agg(one.alias("one"), *(F.max(c).alias(c) for c in ("keep_id", "keep_row", "group_size"))), "digests")
    members = suspects.select("doc_id", "row", "digest").join(by_digest.where("one").drop("one"), "digest")
    unlike = by_digest.where("not one")
    out = [F.col("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    found = members.select(*out)
    if not unlike.isEmpty():
        apart = classes.join(unlike.select("digest"), "digest", "left_semi")
        found = found.unionByName(suspects.select("doc_id", "row", "digest", "text").join(apart, ["digest", "text"]).select(*out))
    alone = marked.where(~suspect).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return found.unionByName(alone)

