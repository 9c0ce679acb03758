"""Connected components of a distributed link table: local forests, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import tidy
from postlake.runtime import Scratch

#: Links that a task contracts at once, and the edges of its forest beyond which that is handed on (no fewer than
#: CHUNK links can have).
CHUNK, FOREST = 1 << 20, 1 << 21


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest node that each node reaches so far) after the links (a, b) are added."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the given links: (node, smallest node it reaches), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merge(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of each task's links (u, v), in bounded memory: a full one is handed on and begun anew."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    def batch_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        rows += batch.num_rows
        if rows >= CHUNK:
            u, v = merged()
            held, rows = [(u, v)], 0
            if len(u) >= FOREST:
                yield batch_of(u, v)
                held = []
    if held:
        yield batch_of(*merged())


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every id of ``links(a, b)``; component is the smallest id reachable.

    Every task first replaces its links by a forest of stars, which has the same components and at most one
    edge a node; then tasks of ``CHUNK`` edges do so again.  Where one such task is enough, its forest is the answer.
    Else stars over all tasks follow while edges remain that aren't settled.  Links stay in the shared folder; only a count and
    one row a round reach the driver.  Minima are aggregated map-side first; the join that follows has plain exchanges, so
    a node with very many links is split by the skew join of adaptive execution.
    """
    schema = "u long, v long"
    start = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = scratch.keep(start.mapInArrow(tidy(_contract), schema), f"{name}-0")
    step = 0
    while True:
        tasks = max(1, -(-edges.count() // CHUNK))
        dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "u")
        forests = scratch.keep(dealt.mapInArrow(tidy(_contract), schema), f"{name}-{step}-f")
        scratch.drop(f"{name}-{step}")
        # settled once every node hangs on exactly one root and no root hangs on anything
        hanging = forests.select("u", "v").unionByName(forests.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        state = hanging.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("root"))
        if tasks == 1 or state.where("low < high or (root and low is not null)").isEmpty():
            stars = forests.distinct() if tasks > 1 else forests
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(forests.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        # large star: every larger neighbour of u hangs on the smallest of u's neighbourhood
        both = forests.unionByName(forests.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{step}-l")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"{name}-{step}-e")
        # small star: u and its smaller neighbours hang on the smallest of them
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-s")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        edges = scratch.keep(small.where("u <> v").mapInArrow(tidy(_contract), schema), f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}-f", f"{name}-{step}-l", f"{name}-{step}-e", f"{name}-{step}-s")
        step += 1
