"""A vector index that is exact: cells of unit vectors with bounds on their angles.

Vectors lie in the cell of their nearest centroid (spherical k-means on a bounded sample), sorted by their angle to it and cut
into rings of at most ``RING`` vectors.  If a query is at angle t from a centroid, a vector at angle r from it is at
least |t - r| away, for angles between unit vectors obey the triangle inequality.  So a ring of angles from low to high has
the lower bound max(0, t - high, low - t), and once the k-th best is nearer than that the ring needn't be read.

A search opens cells in the order of their lower bounds until the k-th distance closes the rest; what it reads are
partitions of the cells, and within them row groups of the angles that are left.  A join deals (query, ring) pairs to the rings
in three rounds, each with the bounds that the last one left; queries stay a table, and a block of a ring and of as many
queries as a task may hold is one matrix product.  Every vector is indexed, and nothing is approximate: bounds are widened by
``EPS`` against rounding, distances are those of the plain scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.functions.vector import literal_cosine_distance
from postlake.runtime import given, ship_package

#: Vectors to fit centroids on (those with the smallest hashes of their ids), cells at most, vectors of a ring.
SAMPLE, CELLS, RING = 16_384, 1_024, 4_096
#: Widening of angles, cells opened first, queries of a block, rings of a query in the second round of a join.
EPS, FIRST, QUERIES, SECOND = 1e-6, 2, 1_024, 8

Best = Callable[[DataFrame], DataFrame]


def fit_cells(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows: begun at vectors far from each other, the same for the same rows."""
    k = max(1, min(k, len(x)))
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < k:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 0, total / np.where(size > 0, size, 1), centroids)
    return centroids


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _unit(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors, and which can be: of length d, finite, not zero, without nulls."""
    out, good = np.zeros((len(column), d)), np.zeros(len(column), bool)
    fits = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
    if len(fits) and d:
        values = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        with np.errstate(all="ignore"):
            size = np.sqrt((values * values).sum(axis=1))
            good[fits] = ok = np.isfinite(size) & (size > 0)
            out[fits[ok]] = values[ok] / size[ok, None]
    return out, good


class VectorIndex:
    """An index at a folder: ``vectors`` (by cell), ``rings`` and ``cells``."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "id", vector_col: str = "embedding"):
        self.spark, self.root, self.id_col, self.vector_col = spark, root.rstrip("/"), id_col, vector_col
        cells = spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()  # at most CELLS
        self.centroids = np.array([r["centroid"] for r in cells], np.float64)
        self.d = self.centroids.shape[1] if len(cells) else 0
        self.rings = spark.read.parquet(f"{self.root}/rings")
        bounds = {r["cell"]: r for r in self.rings.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        own = [bounds.get(i) for i in range(len(cells))]
        self.n = np.array([b["n"] if b else 0 for b in own], np.int64)
        self.low, self.high = (np.array([b[c] if b else 0.0 for b in own]) for c in ("low", "high"))

    @classmethod
    def build(cls, vectors: DataFrame, root: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, ring: int = RING) -> VectorIndex:
        """Write an index of all rows of ``vectors``, with their columns.

        Vectors that are null, empty or zero, hold null or non-finite components or have another length than most are at no
        distance from anything and are left out.  Rows that repeat an id each are in it.  ``cells`` is the square root of the number
        of vectors by default, ``CELLS`` at most; centroids are fitted on at most ``sample`` vectors, and all are dealt.
        """
        spark = vectors.sparkSession
        ship_package(spark)
        lengths = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        d, n = (lengths[0]["d"], lengths[0]["n"]) if lengths else (0, 0)
        fitting = vectors.where(F.size(vector_col) == d).orderBy(F.xxhash64(id_col), vector_col).limit(sample).select(F.col(vector_col).cast("array<double>").alias("v"))
        taken = fitting.toArrow().column("v").combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
        x, good = _unit(taken, d)
        x = x[good]
        wanted = max(1, min(cells or round(n**0.5), CELLS, -(-len(x) // 4)))
        centroids = fit_cells(x, wanted) if len(x) else np.zeros((0, d))
        given(spark, [(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, good = _unit(batch.column(vector_col), d)
                if not len(centroids) or not good.any():
                    continue
                s = x[good] @ centroids.T
                home = s.argmax(axis=1)
                rows = batch.filter(pa.array(good))
                radius = _angles(s[np.arange(len(home)), home])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home.astype(np.int32)), pa.array(radius)], names=[*rows.schema.names, "cell", "radius"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rings of rows sorted by cell and angle: numbered within the task, whose rows are of a range of both."""
            last, held, number = None, 0, TaskContext.get().partitionId() << 32
            for batch in batches:
                rings = np.empty(batch.num_rows, np.int64)
                for i, cell in enumerate(batch.column("cell").to_pylist()):
                    if cell != last or held == ring:
                        last, held, number = cell, 0, number + 1
                    held += 1
                    rings[i] = number
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rings)], names=[*batch.schema.names, "ring"])

        schema = type(vectors.schema)(list(vectors.schema.fields)).add("cell", "integer").add("radius", "double")
        dealt = vectors.mapInArrow(assign, schema).repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius")
        kept = type(schema)(list(schema.fields)).add("ring", "long")
        given(spark, [], kept).write.mode("overwrite").parquet(f"{root}/columns")
        dealt.mapInArrow(cut, kept).write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{root}/vectors")
        rings = _written(spark, root).groupBy("cell", "ring").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count(F.lit(1)).alias("n"))
        rings.write.mode("overwrite").parquet(f"{root}/rings")
        return cls(spark, root, id_col, vector_col)

    def table(self) -> DataFrame:
        return _written(self.spark, self.root)

    # -- one query ------------------------------------------------------------------------------

    def _opened(self, cells: list[int], theta: np.ndarray, bound: float) -> DataFrame:
        """Rows of some cells, without those that the bound rules out."""
        rows = self.table()
        if not cells:
            return rows.limit(0)
        low, high = theta[cells] - bound - EPS, theta[cells] + bound + EPS
        rows = rows.where(F.col("cell").isin(cells) & (F.col("radius") >= float(low.min())) & (F.col("radius") <= float(high.max())))
        if len(cells) <= 64:
            each = F.lit(False)
            for c, a, b in zip(cells, low.tolist(), high.tolist(), strict=True):
                each = each | ((F.col("cell") == c) & F.col("radius").between(a, b))
            rows = rows.where(each)
        return rows

    def search(self, query: Sequence[float], k: int, best: Best | None = None, extra: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
        """The hits, and the cells that had to be opened.

        ``best`` takes rows of the table with their ``distance`` and gives at most k hits, nearest first; by default the k
        nearest rows, ties by id.  Whatever it keeps or filters must not depend on rows farther than its last
        hit.  ``extra`` rows, not in the index, are looked at in any case.  A query of another length than the vectors, or zero, has no hits.
        """
        q = np.asarray(query, np.float64)
        distance = literal_cosine_distance(self.vector_col, query)
        best = best or (lambda rows: rows.orderBy("distance", self.id_col).limit(k))

        def hits(cells: list[int], theta: np.ndarray, bound: float) -> DataFrame:
            rows = self._opened(cells, theta, bound).drop("cell", "radius", "ring")
            rows = rows if extra is None else rows.unionByName(extra.select(*rows.columns))
            return best(rows.withColumn("distance", distance).where("distance is not null"))

        size = np.linalg.norm(q)
        if len(q) != self.d or not size or not np.isfinite(size) or k <= 0:
            return hits([], np.zeros(0), 0.0), []
        theta = _angles(self.centroids @ (q / size))
        least = np.maximum(0, np.maximum(theta - self.high, self.low - theta))
        order = [int(c) for c in np.lexsort((theta, least)) if self.n[c]]
        # so many that they may hold k hits; then twice as many each time
        step = max(FIRST, int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1)
        bound, opened = np.pi, 0
        while opened < len(order) and least[order[opened]] <= bound + EPS:
            closed = int(np.searchsorted(least[order], bound + EPS, "right"))
            opened = min(closed, max(step, 2 * opened))
            found = [r[0] for r in hits(order[:opened], theta, bound).select("distance").collect()]
            if len(found) >= k:
                bound = min(bound, float(_angles(np.array([1 - max(found)]))[0]))
        cells = [c for c in order[:opened] if least[c] <= bound + EPS]
        return hits(cells, theta, bound), cells

    def nearest(self, query: Sequence[float], k: int) -> DataFrame:
        """The k rows of smallest cosine distance, ties by id: the same as a scan of all."""
        return self.search(query, k)[0]

    # -- many queries ---------------------------------------------------------------------------

    def join(self, queries: DataFrame, k: int, scratch, name: str = "knn") -> DataFrame:
        """query_id, id, distance, rank: the k nearest of each query (query_id, query_vector), ties by id.

        Queries that are null, zero, not finite or of another length have no rows; those that repeat an id count as one (the first
        by its vector).  ``scratch`` keeps the tables between the rounds.
        """
        d, eps = self.d, EPS
        q_type, id_type = (s.simpleString() for s in (queries.schema["query_id"].dataType, self.table().schema[self.id_col].dataType))
        shared = self.spark.sparkContext.broadcast((self.centroids, self.low, self.high, self.n))  # of at most CELLS cells

        def cells_of(cover: bool):
            """Cells that a query must look into: those that may hold its first k, or those that its bound leaves."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                centroids, low, high, n = shared.value
                for batch in batches:
                    x, good = _unit(batch.column("query_vector"), d)
                    theta = _angles(x @ centroids.T)
                    least = np.maximum(0, np.maximum(theta - high, low - theta))
                    least[:, n == 0] = np.inf
                    if cover:
                        order = np.lexsort((theta, least))
                        before = np.cumsum(n[order], axis=1) - n[order]
                        take = np.zeros(least.shape, bool)
                        np.put_along_axis(take, order, before < k, axis=1)
                    else:
                        take = least <= batch.column("bound").to_numpy()[:, None] + eps
                    row, cell = np.nonzero(take & np.isfinite(least) & good[:, None])
                    for at in range(0, len(row), 65_536):
                        r, c = row[at : at + 65_536], cell[at : at + 65_536]
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(r)), pa.array(c.astype(np.int32)), pa.array(theta[r, c])], names=["query_id", "cell", "theta"])

            return run

        schema = f"query_id {q_type}, cell int, theta double"
        least = F.greatest(F.lit(0.0), F.col("theta") - F.col("high"), F.col("low") - F.col("theta"))
        asked = queries.where("query_id is not null and query_vector is not null").groupBy("query_id").agg(F.min(F.col("query_vector").cast("array<double>")).alias("query_vector"))
        asked = scratch.keep(asked, f"{name}-queries")
        if not self.d:
            return given(self.spark, [], f"query_id {q_type}, id {id_type}, distance double, rank int")

        def pairs_of(cells: DataFrame) -> DataFrame:
            return cells.join(self.rings, "cell").select("query_id", "ring", "n", least.alias("least"))

        nearer = Window.partitionBy("query_id").orderBy("least", "ring")
        first = pairs_of(asked.mapInArrow(cells_of(True), schema))
        first = first.withColumn("before", F.sum("n").over(nearer.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).where(F.col("before") < k)
        done = scratch.keep(first.select("query_id", "ring"), f"{name}-first")
        hits = scratch.keep(self._compared(done, asked.withColumn("bound", F.lit(float(np.pi))), k, q_type, id_type), f"{name}-hits-0")
        bounds = self._bounds(asked, hits, k, scratch, f"{name}-bounds-0")
        left = pairs_of(bounds.mapInArrow(cells_of(False), schema)).join(bounds.select("query_id", "bound"), "query_id").where(F.col("least") <= F.col("bound") + eps)
        left = scratch.keep(left.join(done, ["query_id", "ring"], "left_anti").withColumn("place", F.row_number().over(nearer)).select("query_id", "ring", "least", "place"), f"{name}-left")
        for i, some in enumerate((left.where(F.col("place") <= SECOND), left.where(F.col("place") > SECOND)), 1):
            still = some.join(bounds.select("query_id", "bound"), "query_id").where(F.col("least") <= F.col("bound") + eps).select("query_id", "ring")
            more = self._compared(still, bounds, k, q_type, id_type)
            hits = scratch.keep(_ranked(hits.drop("rank").unionByName(more.drop("rank")), k), f"{name}-hits-{i}")
            if i == 1:
                bounds = self._bounds(asked, hits, k, scratch, f"{name}-bounds-{i}")
        return hits.select("query_id", "id", "distance", "rank")

    def _bounds(self, asked: DataFrame, hits: DataFrame, k: int, scratch, name: str) -> DataFrame:
        """Queries with the angle of their k-th hit so far; without k hits there is no bound."""
        kth = hits.where(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))).alias("bound"))
        return scratch.keep(asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float(np.pi)))), name)

    def _compared(self, pairs: DataFrame, asked: DataFrame, k: int, q_type: str, id_type: str) -> DataFrame:
        """The k best of each query among the rings that it is paired with: blocks of a ring and some of its queries."""
        sizes = pairs.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        left = pairs.join(sizes, "ring").join(asked, "query_id").select("ring", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "query_vector", "bound")
        vectors = self.table().select(F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("v"), "ring", "cell")
        right = vectors.join(self.rings.select("ring", "cell").join(sizes, "ring"), ["ring", "cell"]).select("ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
        names = ["query_id", "id", "distance"]

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            kinds = [a.schema.field("query_id").type, b.schema.field("id").type, pa.float64()]
            if not a.num_rows or not b.num_rows:
                return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
            q, x = (np.asarray(t.column(c).combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t, c in ((a, "query_vector"), (b, "v")))
            nq, nx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
            far = 1 - np.cos(np.minimum(a.column("bound").to_numpy() + EPS, np.pi))
            rows, found = [], []
            for s in range(0, len(q), 256):
                d = 1 - (q[s : s + 256] / nq[s : s + 256, None]) @ (x / nx[:, None]).T
                most = np.minimum(far[s : s + 256], np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.inf)
                qi, xi = np.nonzero(d <= most[:, None] + 1e-9)
                rows.append(qi + s)
                found.append(xi)
            qi, xi = np.concatenate(rows), np.concatenate(found)
            # equal vectors must tie, so distances are added up one component after the other, as the scan does
            exact = np.empty(len(qi))
            size_q, size_x = (np.sqrt(np.add.accumulate(m * m, axis=1)[:, -1]) for m in (q, x))
            for s in range(0, len(qi), 65_536):
                i, j = qi[s : s + 65_536], xi[s : s + 65_536]
                exact[s : s + 65_536] = 1 - np.add.accumulate(q[i] * x[j], axis=1)[:, -1] / (size_q[i] * size_x[j])
            ids = pd.factorize(b.column("id").to_numpy(zero_copy_only=False), sort=True)[0]
            order = np.lexsort((ids[xi], exact, qi))
            qi, xi, exact = qi[order], xi[order], exact[order]
            keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            return pa.Table.from_arrays([a.column("query_id").take(pa.array(qi[keep])).combine_chunks(), b.column("id").take(pa.array(xi[keep])).combine_chunks(), pa.array(exact[keep])], names=names)

        found = left.groupBy("ring", "part").cogroup(right.groupBy("ring", "part")).applyInArrow(block, f"query_id {q_type}, id {id_type}, distance double")
        return _ranked(found, k)


def _written(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{root}/columns").schema).parquet(f"{root}/vectors")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
