"""Arrow helpers for mapInArrow operators: sorted groups, blocks, links."""

from __future__ import annotations

import ctypes
import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.runtime import Scratch


Batches = Iterator[pa.RecordBatch]


class Remembered(dict):
    """What a function gives for the byte strings that a worker meets often, in bounded memory: strings of more than
    ``LONGEST`` bytes are computed each time, and beyond ``LIMIT`` others all are forgotten."""

    LONGEST, LIMIT = 64, 100_000

    def __init__(self, compute: Callable[[bytes], int]):
        self.compute = compute

    def __missing__(self, key: bytes) -> int:
        value = self.compute(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[key] = value
        return value


def release() -> None:
    """Give freed memory back to the system: Python workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on every platform
        pass


def tidy(run: Callable[[Batches], Batches], *caches: str) -> Callable[[Batches], Batches]:
    """``run``, after which the named caches of the worker's modules are emptied and memory is given back."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            for c in caches:
                module, _, name = c.rpartition(".")
                getattr(importlib.import_module(module), name).clear()
            release()

    return wrapped


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and g[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = g[start]
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, work: Callable[[pa.Table], dict | None], schema: str, names: list[str]) -> DataFrame:
    """Apply ``work`` to each group of column ``g`` (a long) and stream out its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        rows = 0
        for group in sorted_groups(batches):
            out = work(group)
            if out is None or not len(out[names[0]]):
                continue
            found.append(out)
            rows += len(out[names[0]])
            if rows >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[n] for x in found])) for n in names], names=names)
                found, rows = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[n] for x in found])) for n in names], names=names)

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), schema)


def block_pairs(df: DataFrame, scratch: Scratch, name: str, key: str, row_id: str, block: int, weight: str | None = None, heaviest: int = 0, settled: str | None = None) -> DataFrame:
    """Cut each group of ``key`` into blocks of about ``block`` rows and give every
    pair of blocks a group ``g`` of its own.

    A row goes to as many pairs as it has blocks to meet, and no task ever holds more than
    two blocks.  ``side`` is 0 or 1 in a pair of two blocks, 0 in a block paired with itself.
    Groups of one row are left out: nothing can be linked there.
    ``weight``/``heaviest`` also bound the sum of a column within a block.

    With ``settled``, a column of components that are known already, rows of a group's largest
    component have blocks of their own that aren't paired with each other: they meet only
    the other rows.  A group that is one component has no pairs at all.
    """
    total, largest = F.col("n"), F.lit(block)
    blocks_of = lambda n, w: F.greatest(F.ceil(n / largest), F.ceil(w / F.lit(heaviest))) if weight else F.ceil(n / largest)
    sums = [F.count(F.lit(1)).alias("n"), (F.sum(weight) if weight else F.lit(0)).alias("w")]
    if settled is None:
        sizes = df.groupBy(key).agg(*sums).where("n > 1").select(F.col(key), F.lit(0).alias("na"), blocks_of(total, F.col("w")).cast("int").alias("nb"), F.lit(None).cast("long").alias("main"))
    else:
        parts = df.groupBy(key, settled).agg(*sums)
        sizes = parts.groupBy(key).agg(F.max(F.struct("n", "w", F.col(settled).alias("main"))).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
        sizes = sizes.where("n > top.n")
        rest_n, rest_w = F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")
        sizes = sizes.select(F.col(key), blocks_of(F.col("top.n"), F.col("top.w")).cast("int").alias("na"), blocks_of(rest_n, rest_w).cast("int").alias("nb"), F.col("top.main").alias("main"))
    sizes = scratch.keep(sizes, name)
    dealt = df.join(sizes, key)
    inside = F.coalesce(F.col(settled) == F.col("main"), F.lit(False)) if settled else F.lit(False)
    h = F.xxhash64(F.col(row_id), F.lit(17))
    dealt = dealt.withColumn("b", F.when(inside, F.pmod(h, F.greatest("na", F.lit(1)))).otherwise(F.col("na") + F.pmod(h, F.col("nb"))).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("b") < F.col("na"), F.sequence(F.col("na"), F.col("na") + F.col("nb") - 1)).otherwise(F.sequence(F.lit(0), F.col("na") + F.col("nb") - 1))))
    i, j = F.least("b", "j"), F.greatest("b", "j")
    return dealt.select("*", F.xxhash64(F.col(key), i, j).alias("g"), (F.col("b") > F.col("j")).cast("int").alias("side")).drop(key, "b", "j", "na", "nb", "main")


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches through the links of this block (symmetric matrix)."""
    label = ids.copy()
    top = np.iinfo(ids.dtype).max
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], top).min(axis=1))
        if np.array_equal(low, label):
            return label
        label = low


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
