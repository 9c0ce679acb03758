"""Near-duplicate documents by min-max hashing (both extremes of every permutation).

A document is the set of its distinct word shingles.  Each permutation of the 64-bit
shingle space yields two values, its minimum and its maximum over the set; for two sets
either agrees with a probability equal to their Jaccard similarity, so a signature of 2K
values costs K hash evaluations a shingle.  Signatures are cut into bands whose values
all come from different permutations.  Band collisions are only candidates:

1. documents with equal sets are collapsed onto one numbered set (map-side combined);
2. candidate clusters: each member of a band bucket is compared with the bucket's pivot by
   signature sketch, and those that are not far from similar (within five standard errors)
   join it; members that this leaves in other clusters than most of their bucket are compared
   with the whole bucket, block by block;
3. exact links: the full shingle set of each member of a cluster is intersected with that of the
   cluster's pivot; members that this leaves apart from the largest component are intersected with
   the whole cluster, block by block;
4. connected components of the exact links give the groups.

So a large group of copies costs a comparison a member, and only what doesn't fit its pivot meets
the others.  No pair table is ever built, no group lands in one task (blocks of bounded rows and
bounded shingles), and nothing but counts reaches the driver.  With the defaults (32 bands
of 6 rows) a pair at a similarity of 0.85 shares no band with probability 2.6e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from postlake.llm.components import connected_components
from postlake.llm.streams import Remembered, block_pairs, map_groups, roots, texts_of, tidy
from postlake.runtime import Scratch

ROWS, BANDS = 6, 32
PERMUTATIONS = ROWS * BANDS // 2
U = np.uint64


_words = Remembered(xxhash.xxh64_intdigest)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _own_words(run):
    """``run`` with the worker's word hashes emptied after it."""
    return tidy(run, "postlake.llm.minhash._words")


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of lower-cased (A-Z) text.

    ``bytes.split`` cuts at exactly the bytes 0x20 and 0x09-0x0D.  A text of fewer words is one
    shingle; one without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, n)
    take = min(size, n)
    total = np.full(n - take + 1, take, U)
    for k in range(take):
        total += h[k : n - take + 1 + k] * _mix(np.array([k + 1], U))
    return np.unique(_mix(total))


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return seeds[:k] | U(1), seeds[k:]


def signature(shingles: np.ndarray, k: int = PERMUTATIONS) -> np.ndarray:
    """The k minima, then the k maxima."""
    a, b = _multipliers(k)
    low, high = np.full(k, np.iinfo(U).max, U), np.zeros(k, U)
    for i in range(0, len(shingles), 2048):
        v = shingles[i : i + 2048, None] * a + b
        np.minimum(low, v.min(axis=0), out=low)
        np.maximum(high, v.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key a band.  Position p of the flattened bands takes permutation p mod k, its
    minimum in the first k positions and its maximum in the next k, rotated so that a band mixes both."""
    k = len(sig) // 2
    p = np.arange(rows * bands)
    perm = p % k
    kind = (p // k + p) % 2
    values = sig[perm + k * kind].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=U)
    for r in range(rows):
        out = _mix(out * U(0x9E3779B97F4A7C15) + values[:, r])
    return out.view(np.int64)


def _sketches(ngram: int, rows: int, bands: int):
    k = rows * bands // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, lo, hi, keys, sketch = [], [], [], [], []
                for text in texts_of(part.column("text")):
                    s = shingle_set(text, ngram)
                    n.append(len(s))
                    one, two = digest_of(s)
                    lo.append(one)
                    hi.append(two)
                    if len(s):
                        sig = signature(s, k)
                        keys.append(band_keys(sig, rows, bands))
                        sketch.append((_mix(sig) & U(255)).astype(np.uint8).tobytes())
                    else:
                        keys.append(np.empty(0, np.int64))
                        sketch.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n_shingles", "lo", "hi", "keys", "sketch"],
                )

    return run


def _near_pivot(percent: int, least: float):
    """Rows (id, n_shingles, sketch and the pivot's) that may be similar to their pivot, as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "p_sketch"))
            n, m = batch.column("n_shingles").to_numpy(), batch.column("p_n").to_numpy()
            near = ((one == two).mean(axis=1) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            keep = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(keep), batch.column("p_id").take(keep)], names=["a", "b"])

    return run


def _linked_to_pivot(percent: int):
    """Rows (id, shingles and the pivot's) that are similar to their pivot, as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, pivot = [], None, np.empty(0, U)
            for i, (mine, theirs) in enumerate(zip(batch.column("shingles").to_pylist(), batch.column("p_shingles").to_pylist(), strict=True)):
                if theirs != last:
                    last, pivot = theirs, np.frombuffer(theirs, U)
                a = np.frombuffer(mine, U)
                small, large = (a, pivot) if len(a) < len(pivot) else (pivot, a)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * shared >= percent * (len(a) + len(pivot) - shared):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("p_id").take(take)], names=["a", "b"])

    return run


def _compare_sketches(percent: int, least: float):
    """Candidate clusters of a block: pairs whose sizes allow the similarity and whose sketches don't exclude it."""

    def work(group: pa.Table) -> dict | None:
        if group.num_rows < 2:
            return None
        ids = group.column("id").to_numpy()
        n = group.column("n_shingles").to_numpy()
        side = group.column("side").to_numpy()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        share = np.empty((len(ids), len(ids)), np.float32)
        for i in range(len(ids)):
            share[i] = (sketch == sketch[i]).mean(axis=1)
        near = (share >= least) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
        if side.any():
            near &= side[:, None] != side
        label = roots(near, ids)
        moved = label != ids
        return {"a": ids[moved], "b": label[moved]}

    return work


def intersections(sets: list[np.ndarray], most: int = 8_000_000) -> np.ndarray:
    """Sizes of all intersections of a block's sets, from products of 0/1 matrices of bounded size."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, most // len(sets))
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(sets), min(width, total - start)), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += m @ m.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def _compare_sets(percent: int):
    def work(group: pa.Table) -> dict | None:
        if group.num_rows < 2:
            return None
        ids = group.column("id").to_numpy()
        side = group.column("side").to_numpy()
        sets = [np.frombuffer(x, U) for x in group.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        shared = intersections(sets)
        linked = 100 * shared >= percent * (n[:, None] + n - shared)
        if side.any():
            linked &= side[:, None] != side
        label = roots(linked, ids)
        moved = label != ids
        return {"a": ids[moved], "b": label[moved]}

    return work


def digest_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set, as two signed longs."""
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (digest & (2**64 - 1)) - 2**63, (digest >> 64) - 2**63


def document_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, ngram: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``near_duplicates`` with ``lo`` and ``hi``, the digest of the row's shingle set.

    Inside, a node is a distinct set, named by a number of its own: an id whose rows differ names several sets, each
    with its own links, and what each of them is linked with counts.
    """
    if percent < 80 or ngram < 5:
        raise ValueError("near duplicates take shingles of five words or more and a similarity of 0.8 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_shingles long, lo long, hi long, keys array<long>, sketch binary"
    seen = scratch.keep(source.mapInArrow(_own_words(_sketches(ngram, rows, bands)), schema), "sketches")

    has = seen.where("n_shingles > 0 and doc_id is not null")
    first = has.groupBy("lo", "hi").agg(F.min("doc_id").alias("first_id"))
    # numbers are written down, so a task that is run again can't change them
    first = scratch.keep(first.select("lo", "hi", "first_id", F.monotonically_increasing_id().alias("id")), "sets")
    # one signature a distinct set: that of its smallest id; rows that repeat it are alike
    reps = first.select("id", "first_id", F.col("lo").alias("rlo"), F.col("hi").alias("rhi")).join(has, (F.col("first_id") == F.col("doc_id")) & (F.col("rlo") == F.col("lo")) & (F.col("rhi") == F.col("hi")))
    reps = scratch.keep(reps.select("id", "n_shingles", "keys", "sketch").dropDuplicates(["id"]), "reps")

    # similarity of which fewer sketch bytes agree than here lies five standard errors below the bound
    bound = percent / 100
    values = rows * bands
    least = bound - 5 * (bound * (1 - bound) / values) ** 0.5
    members = reps.select("id", F.explode("keys").alias("bucket"))
    full = scratch.keep(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "buckets")
    members = members.join(full, "bucket")
    members = members.join(reps.select("id", "n_shingles", "sketch"), "id")
    members = scratch.keep(members, "members")
    pivots = members.groupBy("bucket").agg(F.min(F.struct("id", "n_shingles", "sketch")).alias("p"))
    pivots = scratch.keep(pivots.select("bucket", F.col("p.id").alias("p_id"), F.col("p.n_shingles").alias("p_n"), F.col("p.sketch").alias("p_sketch")), "pivots")
    near = members.join(pivots, "bucket").where("id <> p_id").mapInArrow(tidy(_near_pivot(percent, least)), "a long, b long")
    known = scratch.keep(connected_components(near, scratch, "near-first"), "near-known")
    members = members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    blocks = block_pairs(members, scratch, "bucket-sizes", "bucket", "id", 512, settled="component")
    near = map_groups(blocks, _compare_sketches(percent, least), "a long, b long", ["a", "b"])
    # a known component is one edge a member
    near = near.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    clusters = scratch.keep(connected_components(near, scratch, "near"), "clusters")
    scratch.drop("members", "pivots", "bucket-sizes")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, ngram) for t in texts_of(part.column("text"))]
                digests = [digest_of(s) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in digests], pa.int64()), pa.array([x for _, x in digests], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["first_id", "size", "lo", "hi", "shingles"])

    # texts meet ids alone, a table so short that Spark may broadcast it for long; sets find their numbers by digest,
    # since an id may have rows with other texts
    named = scratch.keep(clusters.join(first, "id").select("id", F.col("component").alias("cluster"), "first_id", "lo", "hi"), "named")
    ids = scratch.keep(named.select(F.col("first_id").alias("member")).distinct().sortWithinPartitions("member"), "member-ids")
    texts = source.join(ids, F.col("doc_id") == F.col("member"), "left_semi")
    sets = texts.mapInArrow(_own_words(to_sets), "first_id long, size long, lo long, hi long, shingles binary")
    sets = scratch.keep(sets.join(named, ["first_id", "lo", "hi"]).select("id", "cluster", "size", "shingles"), "shingles")
    pivots = sets.groupBy("cluster").agg(F.min("id").alias("p_id"))
    pivots = sets.select(F.col("id").alias("p_id"), "shingles").join(pivots, "p_id").select("cluster", "p_id", F.col("shingles").alias("p_shingles"))
    pivots = scratch.keep(pivots.dropDuplicates(["cluster"]), "cluster-pivots")
    first_links = scratch.keep(sets.join(pivots, "cluster").where("id <> p_id").mapInArrow(tidy(_linked_to_pivot(percent)), "a long, b long"), "pivot-links")
    # every link leads to a pivot, so these are stars: a member's component is its pivot
    stars = first_links.select(F.col("a").alias("id"), "b").distinct()
    sets = sets.join(stars, "id", "left").withColumn("component", F.coalesce("b", "id")).drop("b")
    blocks = block_pairs(sets, scratch, "cluster-sizes", "cluster", "id", 256, "size", 1_000_000, settled="component")
    links = map_groups(blocks, _compare_sets(percent), "a long, b long", ["a", "b"])
    linked = scratch.keep(connected_components(links.unionByName(first_links), scratch, "links"), "linked")
    scratch.drop("shingles", "cluster-sizes", "clusters", "named", "member-ids", "buckets", "cluster-pivots", "pivot-links", "near-known")

    # from numbers of sets to the smallest document id of a component
    named = linked.join(first.select("id", "first_id"), "id")
    smallest = scratch.keep(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    ids = linked.join(smallest, "component").select("id", "component_id")
    groups = scratch.keep(first.join(ids, "id", "left").select("lo", "hi", F.coalesce("component_id", "first_id").alias("component_id")), "groups")
    return _grouped(seen, groups)


def _grouped(seen: DataFrame, groups: DataFrame) -> DataFrame:
    one = seen.select("doc_id", "n_shingles", "lo", "hi")
    names = ["doc_id", "n_shingles", "component_id", "lo", "hi"]
    in_group = one.where("n_shingles > 0 and doc_id is not null").join(groups, ["lo", "hi"]).select(names)
    alone = one.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")).select(names)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return in_group.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept, "lo", "hi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, ngram: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B|; ``component_id`` is the
    smallest id reachable over links.  Null and word-free texts have no shingles and are alone.
    Rows that repeat an id each give a row and are documents of their own: with different texts they have
    different links.  A null id is linked with nothing: its component is null and it is kept.  Other columns
    of ``docs`` are ignored, whatever their names; an empty table gives an empty result.
    """
    return document_groups(docs, id_col, text_col, percent, ngram, rows, bands).drop("lo", "hi")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their columns, one of each group: that of the smallest id.

    Where rows repeat an id and a set of shingles the one whose text (then other columns) comes first stays; rows of one id with unlike texts are judged one
    by one.  Rows without an id and texts without words have no duplicates and all stay.  Texts are filtered by ids,
    only rows of repeated ids (few, or none) are compared by contents.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    groups = scratch.keep(document_groups(docs, id_col, text_col, **options), "groups")
    ngram = options.get("ngram", 5)
    own, lo, hi, i, x, y = F.col(id_col).cast("long"), *(_free(docs, n) for n in ("lo", "hi", "id_of_set", "lo_of_set", "hi_of_set"))
    known = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias(i)).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    apart = scratch.keep(known.where("n > 1 or not kept").select(i, "n"), "apart")
    once = docs.join(apart.select(i), own == F.col(i), "left_anti")
    again = docs.join(apart.where("n > 1").select(i), own == F.col(i), "left_semi")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, ngram) for t in texts_of(batch.column(batch.schema.get_field_index(text_col)))]
            found = [digest_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=[*batch.schema.names, lo, hi])

    again = again.mapInArrow(_own_words(digests), type(docs.schema)(list(docs.schema.fields)).add(lo, "long").add(hi, "long"))
    wanted = groups.where("kept and doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias(i), F.col("lo").alias(x), F.col("hi").alias(y)).distinct()
    unlike = again.where(F.col(lo).isNotNull()).join(wanted, (own == F.col(i)) & (F.col(lo) == F.col(x)) & (F.col(hi) == F.col(y)), "left_semi")
    rank = Window.partitionBy(id_col, lo, hi).orderBy(text_col, *(F.col(c) for c in docs.columns if c not in (id_col, text_col) and not isinstance(docs.schema[c].dataType, MapType | VariantType)))
    unlike = unlike.withColumn(x, F.row_number().over(rank)).where(F.col(x) == 1)
    return once.unionByName(unlike.select(*docs.columns)).unionByName(again.where(F.col(lo).isNull()).select(*docs.columns))


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
