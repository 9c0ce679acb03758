"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Vectors are compared only within a label.  Copies (equal label and components) are collapsed first onto
one numbered vector.  Each label is cut into cells by spherical k-means on a bounded sample of its
own vectors (one of fewer than ``LEAST`` is one cell); a cell that is still large is cut again, and so on, so neither the number of cells nor that of
levels is fixed.  How many cells a group gets is what costs least on the sample; a group that no cut makes
cheaper (a dense ball) stays whole and is compared in blocks.

At each level a vector has its home in the cell of its nearest centroid.  A pair with a cosine of at least ``c``
is at most d = sqrt(2 - 2c) apart, so a vector y can only be linked with one at home in another cell if it lies
within d of the plane between both centroids: y . (home - other) <= d * |home - other|.  It visits those cells of
smaller number, and a bit for the level says that it is a visitor there.  A linked pair meets, at every
level, in exactly one cell where not both are visitors: the smaller of their homes.  Hence pairs whose bits
don't overlap are those to count, each pair is counted once, and no link is lost.

Within a cell blocks of bounded rows and bytes are multiplied in double precision; what leaves a block is a row per
linked vector (its number of links, the smallest number it reaches), never a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.components import connected_components, merge
from postlake.llm.streams import block_pairs, map_groups, sorted_groups, tidy
from postlake.runtime import Scratch

#: Vectors and bytes that cells of a group are fitted on at most, and the numbers of cells that are tried.
SAMPLE, SAMPLE_BYTES, CELLS = 4_096, 8 << 20, (2, 4, 8, 16, 32, 64)
#: Vectors from which a label is cut into cells, and a cell again; vectors of a group that one task assigns at most.
LEAST, PER_CELL, ASSIGN = 16, 4_096, 65_536
#: Vectors and bytes of a block, rows multiplied at once, levels (one bit each).
BLOCK, BLOCK_BYTES, TILE, LEVELS = 2_048, 4 << 20, 512, 60
#: A cut must leave less than this share of the pairs to compare.
WORTH = 0.9


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """Components as float64 bytes of the vectors that can be linked, null for the others."""
    some = (column.is_valid().to_numpy(zero_copy_only=False)) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0)
    out: list[bytes | None] = [None] * len(column)
    if not some.any():
        return out
    held = column.filter(pa.array(some))
    # nulls become nan; no negative zeros: equal vectors have equal bytes
    values = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    ends = np.cumsum(held.value_lengths().to_numpy())
    starts = ends - held.value_lengths().to_numpy()
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.add.reduceat(values * values, starts)
    good = np.isfinite(squares) & (squares > 0)
    raw = values.tobytes()
    for i, ok, a, b in zip(np.flatnonzero(some).tolist(), good.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if ok:
            out[i] = raw[8 * a : 8 * b]
    return out


def matrix(column, n: int) -> np.ndarray:
    """Unit vectors of equally long binary values."""
    x = np.frombuffer(b"".join(column.to_pylist())).reshape(n, -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cell takes the vector that is worst off."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        s = x @ centroids.T
        home, best = s.argmax(axis=1), s.max(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(best)[: len(empty)]]
        norms = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norms > 0, total / np.where(norms > 0, norms, 1), centroids)
    return centroids


def places(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's home) of every cell that a row is in."""
    s = x @ centroids.T
    home = s.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T)) + 1e-7
    near = s.max(axis=1)[:, None] - s <= reach * gap[home] + 1e-9
    cells = np.arange(len(centroids))
    near &= cells < home[:, None]
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def best_cells(x: np.ndarray, reach: float) -> np.ndarray | None:
    """The centroids with which the fewest pairs are left to compare; None where no cut is worth it."""
    best, least = None, WORTH
    for k in CELLS:
        if 4 * k > len(x):
            break
        centroids = fit_centroids(x, k)
        _, cell, _ = places(x, centroids, reach)
        share = np.bincount(cell, minlength=k) / len(x)
        cost = float((share * share).sum()) + 0.01 * float(share.sum() - 1)
        if cost < least:
            best, least = centroids, cost
    return best


def cut_into_cells(vectors: DataFrame, scratch: Scratch, cosine: float) -> DataFrame:
    """``vectors(id, w, place, lab, vec, size)`` dealt to cells: ``place`` names a cell, ``visits`` says at which
    levels the row is a visitor."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    names = ["id", "w", "place", "lab", "vec", "size", "visits"]
    schema = "id long, w long, place long, lab long, vec binary, size long, visits long, cell int"

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "place"):
            found = best_cells(matrix(group.column("vec"), group.num_rows), reach)
            if found is not None:
                yield pa.RecordBatch.from_arrays([group.column("place").slice(0, 1).combine_chunks(), pa.array([found.tobytes()], pa.binary())], names=["place", "cells"])

    def assign_at(level: int):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = np.empty((0, 0))
            for batch in batches:
                heads = np.flatnonzero(batch.column("id").is_null().to_numpy(zero_copy_only=False))
                cuts = np.unique(np.concatenate([[0], heads, heads + 1, [batch.num_rows]])).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(a, b - a)
                    if not part.column("id")[0].is_valid:  # the centroids of the rows that follow
                        raw = np.frombuffer(part.column("vec")[0].as_py())
                        centroids = raw.reshape(-1, part.column("size")[0].as_py() // 8)
                        continue
                    for at in range(0, part.num_rows, 2048):
                        some = part.slice(at, 2048)
                        row, cell, home = places(matrix(some.column("vec"), some.num_rows), centroids, reach)
                        out = some.take(pa.array(row))
                        visits = out.column("visits").to_numpy() | np.where(home, 0, 1 << level)
                        columns = [pa.array(visits) if n == "visits" else out.column(n) for n in names]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

        return assign

    whole = scratch.keep(vectors.withColumn("visits", F.lit(0).cast("long")).select(*names), "level-0")
    settled = []
    for level in range(LEVELS):
        sizes = whole.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("one"))
        large = scratch.keep(sizes.where(F.col("n") >= (LEAST if level == 0 else PER_CELL)), f"large-{level}")
        if large.isEmpty():
            break
        nth = F.greatest(F.ceil(F.col("n") / SAMPLE), F.ceil(F.col("bytes") / SAMPLE_BYTES))
        sample = whole.join(large, "place").where(F.pmod(F.xxhash64("id", F.lit(level)), nth) == 0).select("place", "vec")
        fitted = sample.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(fit), "place long, cells binary")
        fitted = scratch.keep(fitted, f"cells-{level}").join(large, "place")
        parts = F.ceil(F.col("n") / ASSIGN).cast("int")
        none = F.lit(None).cast("long")
        heads = fitted.select(none.alias("id"), none.alias("w"), "place", none.alias("lab"), F.col("cells").alias("vec"), F.col("one").alias("size"), none.alias("visits"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        moving = whole.join(fitted.select("place", parts.alias("parts")), "place").select(*names, F.pmod(F.xxhash64("id", F.lit(19)), F.col("parts")).cast("int").alias("part"))
        dealt = heads.unionByName(moving).repartition("place", "part").sortWithinPartitions("place", "part", F.col("id").asc_nulls_first())
        cells = dealt.select(*names).mapInArrow(tidy(assign_at(level)), schema)
        settled.append(whole.join(fitted.select("place"), "place", "left_anti").select(*names))
        whole = scratch.keep(cells.withColumn("place", F.xxhash64("place", "cell")).select(*names), f"level-{level + 1}")
    for rows in settled:
        whole = whole.unionByName(rows)
    return whole


def compare_blocks(cosine: float):
    """Links within a block: each row's number of links, and the smallest row that it reaches."""

    def work(group: pa.Table) -> dict | None:
        n = group.num_rows
        if n < 2:
            return None
        ids, w, lab, visits, side = (group.column(c).to_numpy() for c in ("id", "w", "lab", "visits", "side"))
        label, links = np.arange(n), np.zeros(n, np.int64)
        order = np.argsort(ids, kind="stable")  # so that the smallest row of a component has its smallest id
        ids, w, lab, visits, side = (c[order] for c in (ids, w, lab, visits, side))
        x = matrix(group.column("vec").take(pa.array(order)), n)
        for i in range(0, n, TILE):
            own = slice(i, i + TILE)
            linked = (x[own] @ x.T >= cosine) & ((visits[own, None] & visits) == 0) & (lab[own, None] == lab)
            if side.any():
                linked &= side[own, None] != side
            at = np.arange(len(linked))
            linked[at, i + at] = False
            links[own] = linked @ w
            a, b = np.nonzero(linked)
            label = merge(label, a + i, b)
        some = links > 0
        return {"id": ids[some], "links": links[some], "root": ids[label[some]]}

    return work


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a null id or label, that are null, empty or zero, or hold null or non-finite components,
    and vectors of another length, are linked with nothing; alone, a vector is its own component
    (null where the id is) and kept.  Rows that repeat an id each give a row and are vectors of their own, with
    their own links: they are linked with each other only if their vectors are.  Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "embed")
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(unit_rows(batch.column("v")), pa.binary())], names=["vec_id", "label", "vec"])

    rows = source.mapInArrow(tidy(prepare), "vec_id long, label string, vec binary")
    usable = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("copy", F.when(usable, F.sha2(F.concat(F.concat(F.col("label"), F.lit("\n")).cast("binary"), F.col("vec")), 256)))
    rows = scratch.keep(rows, "vectors")
    firsts = rows.where("copy is not null").groupBy("copy").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("w"))
    # numbers are written down, so a task that is run again can't change them
    firsts = scratch.keep(firsts.select("copy", "first_id", "w", F.monotonically_increasing_id().alias("id")), "copies")
    reps = firsts.join(rows.select(F.col("copy").alias("c"), "vec_id", "label", "vec"), (F.col("copy") == F.col("c")) & (F.col("first_id") == F.col("vec_id")))
    size = F.octet_length("vec").cast("long")
    reps = reps.select("id", "w", F.xxhash64("label", size).alias("place"), F.xxhash64("label", size, F.lit(1)).alias("lab"), "vec", size.alias("size")).dropDuplicates(["id"])

    placed = cut_into_cells(reps, scratch, cosine)
    blocks = block_pairs(placed, scratch, "cell-sizes", "place", "id", BLOCK, "size", BLOCK_BYTES)
    found = scratch.keep(map_groups(blocks, compare_blocks(cosine), "id long, links long, root long", ["id", "links", "root"]), "links")
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    linked = scratch.keep(components.join(firsts.select("id", "first_id"), "id"), "linked")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "component").select("id", "component_id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = firsts.join(links, "id", "left").join(linked, "id", "left")
    groups = groups.select("copy", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    groups = scratch.keep(groups, "groups")
    scratch.drop("cell-sizes", "links")

    grouped = rows.where("copy is not null").select("vec_id", "copy").join(groups, "copy").select("vec_id", "n_links", "component_id")
    alone = rows.where("copy is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return grouped.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
