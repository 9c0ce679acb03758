"""Vector search: exact cosine top-k, hybrid with metadata filters, duplicates, reranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from postlake.functions.text import rerank_text
from postlake.functions.vector import cosine_distance, literal_cosine_distance, sign_bucket
from postlake.operators.listing import matching, newest
from postlake.operators.maintain import best_per_message
from postlake.operators.vectorindex import VectorIndex
from postlake.params import SETTINGS, Filters, Settings, filtered_widths, retrieval_width, search_limit
from postlake.runtime import Scratch, ship_package

Scorer = Callable[[str, list[str]], Sequence[float]]
Embed = Callable[[list[str]], list[list[float]]]

# Documented short names of embedding models.
MODEL_NAMES = {
    "BGE-base-en-v1.5": "BAAI/bge-base-en-v1.5",
    "BGE-small-en-v1.5": "BAAI/bge-small-en-v1.5",
    "nomic-embed-text-v1": "nomic-ai/nomic-embed-text-v1",
    "all-MiniLM-L6-v2": "sentence-transformers/all-MiniLM-L6-v2",
}


def resolve_model(name: str) -> str:
    """The full name of a documented model; any other name as it is."""
    return MODEL_NAMES.get(name, name)


def load_local_first(name: str, load: Callable[..., object]) -> object:
    """A model from the local cache, else from wherever it comes."""
    try:
        return load(name, local_files_only=True)
    except Exception:
        return load(name)


def hashing_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Deterministic unit vectors from hashed words: an embedder without a model."""
    out = []
    for t in texts:
        v = np.zeros(dims)
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % dims] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embed_column(df: DataFrame, text: str, embed: Embed = hashing_embedder, name: str = "embedding", batch: int = 64) -> DataFrame:
    """Embeds a text column in Arrow batches; an embedder that loads a model does so once a worker.  No more than ``batch`` texts and
    vectors are Python's objects at a time: its floats take eight times as much as the column's."""
    ship_package(df.sparkSession)

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(ArrayType(FloatType()))
        for texts in batches:
            some = [pa.array(list(embed(texts.slice(i, batch).fill_null("").to_pylist())), kind, from_pandas=True) for i in range(0, len(texts), batch)]
            yield pa.concat_arrays([pa.array([], kind), *some])

    return df.withColumn(name, run(F.col(text)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows of smallest cosine distance, ties by id: each task keeps k rows, which are then merged."""
    ranked = vectors.withColumn("distance", literal_cosine_distance(vector_col, query))
    return ranked.where("distance is not null").orderBy("distance", id_col).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """query_id, id, distance, rank: the k nearest of each query (query_id, query_vector), ties by id.

    The vectors are indexed in the shared folder and joined with the queries cell by cell (``VectorIndex.join``); where an
    index is kept, its own ``join`` does the same without building one.  Neither side passes through the driver.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    index = VectorIndex.build(vectors.select(id_col, vector_col), scratch.path("index"), id_col, vector_col)
    return index.join(queries, k, scratch)


@dataclass(frozen=True)
class StoredIndex:
    """An index of the vectors of some version of a store, and what has changed since: rows of buckets that were written anew
    are looked at as they are, and what the index holds of those buckets counts no more."""

    index: VectorIndex
    fresh: list[int]
    changed: DataFrame | None

    def search(self, query: Sequence[float], k: int, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
        known = F.col("bucket").isNull() | F.col("bucket").isin(self.fresh)
        extra = None if self.changed is None else self.changed.withColumn("bucket", F.lit(None).cast("int"))
        return self.index.search(query, k, lambda rows: best(rows.where(known).drop("bucket")), extra)[0]


def with_buckets(vectors: DataFrame, planes: int = 8, dims: int = 64, vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """``bucket`` by random hyperplanes, to partition a vector table by when written."""
    p = np.random.default_rng(seed).standard_normal((planes, dims)).tolist()
    return vectors.withColumn("bucket", sign_bucket(vector_col, p))


def hydrate(hits: DataFrame, emails: DataFrame) -> DataFrame:
    """Hits with their messages.  Where there is a message all its columns win, null ones too, and ``similarity``
    is 1 - distance; a hit without one keeps its own fields and has no similarity.

    Hits are few rows after their top-k; Spark broadcasts them where they are.
    """
    ids = hits.select(F.col("id").alias("_hit"), *(F.col(c).alias(f"_h_{c}") for c in hits.columns if c != "id"))
    own = emails.join(ids.select("_hit"), F.col("file_hash") == F.col("_hit"), "left_semi").withColumn("_found", F.lit(True))
    joined = ids.join(own, F.col("_hit") == F.col("file_hash"), "left")
    pairs = {"subject": "subject", "from_addr": "from", "to_addrs": "to", "message_id": "message_id", "file_path": "file_path", "attachment_count": "attachment_count"}
    columns = [F.col("_hit").alias("vector_id")]
    for c in emails.columns:
        other = pairs.get(c)
        if other and f"_h_{other}" in joined.columns:
            columns.append(F.when(F.col("_found"), F.col(c)).otherwise(F.col(f"_h_{other}")).alias(c))
        else:
            columns.append(F.col(c))
    extra = [F.col(f"_h_{c}").alias(c) for c in ("distance", "document", "rank") if f"_h_{c}" in joined.columns]
    return joined.select(*columns, *extra, F.when(F.col("_found"), 1 - F.col("_h_distance")).alias("similarity"))


def ranked_hits(hits: DataFrame) -> DataFrame:
    """``rank`` of a small set of hits by distance, then id."""
    from pyspark.sql.window import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def nearest_messages(vectors: DataFrame, query: Sequence[float], messages: DataFrame, k: int, known_only: bool = False) -> DataFrame:
    """The nearest vector of each message id, and of these the k nearest: copies of a message, however many, take
    one place.  A vector's message id is that of its message (``messages``), else its own; without one it stands alone.

    The minimum of (distance, id) is combined before the shuffle, so a message with very many copies makes no long task.
    """
    scored = vectors.withColumn("distance", literal_cosine_distance("embedding", query)).where("distance is not null")
    return best_messages(scored, messages, k, known_only)


def best_messages(scored: DataFrame, messages: DataFrame, k: int, known_only: bool = False) -> DataFrame:
    """``nearest_messages`` of vectors that have their ``distance``."""
    own = F.col("message_id") if "message_id" in scored.columns else F.lit(None).cast("string")
    ids = messages.select(F.col("file_hash").alias("id"), F.col("message_id").alias("_mid"), F.lit(True).alias("_found"))
    named = scored.select("id", "distance", own.alias("_own")).join(ids, "id", "inner" if known_only else "left")
    name = F.nullif(F.when(F.col("_found"), F.col("_mid")).otherwise(F.col("_own")), F.lit(""))
    key = F.coalesce(name, F.concat(F.lit("\x00row:"), F.col("id").cast("string")))
    best = named.groupBy(key.alias("_key")).agg(F.min(F.struct("distance", "id")).alias("_best")).select("_best.*")
    return scored.join(best.orderBy("distance", "id").limit(k), ["id", "distance"], "left_semi")


def rerank(results: DataFrame, query: str, score: Scorer, top_k: int, s: Settings = SETTINGS) -> DataFrame:
    """Scores the results' texts, best first, ties by rank; those without text are dropped, unless none has any:
    then the input order stands."""
    ship_package(results.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([float(v) for v in score(query, x.tolist())])

    document = "document" if "document" in results.columns else F.lit(None).cast("string")
    texts = results.withColumn("_text", rerank_text(document, "subject", "body_preview", s))
    some = texts.where("_text <> ''")
    if some.isEmpty():
        return results.withColumn("rerank_score", F.lit(None).cast("double")).orderBy("rank").limit(top_k)
    return some.withColumn("rerank_score", run("_text")).drop("_text").orderBy(F.desc("rerank_score"), "rank").limit(top_k)


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """A scorer without a model: share of the query's words in the text."""
    q = set(re.findall(r"\w+", query.lower()))
    return [len(q & set(re.findall(r"\w+", t.lower()))) / len(q) if q else 0.0 for t in texts]


def hybrid_search(
    emails: DataFrame,
    attachments: DataFrame,
    vectors: DataFrame,
    query_vector: Sequence[float],
    filters: Filters | None = None,
    limit: int | None = None,
    mode: str = "prefilter",
    query: str = "",
    scorer: Scorer | None = None,
    s: Settings = SETTINGS,
    index: StoredIndex | None = None,
) -> DataFrame:
    """Semantic search: filters, nearest vectors, their messages, without duplicates, reranked or cut.

    ``prefilter`` searches exactly the vectors of matching messages, however many, and removes duplicates before it
    cuts.  ``postfilter`` behaves as an index that can't filter: the newest ``filtered_cap`` matches, a global top-k,
    widened once if too few are left; duplicates are removed from what was cut to twice the limit.

    With an ``index`` of the vectors ``prefilter`` reads only the cells that it must, and gives the same.
    """
    filters = filters or Filters()
    top = search_limit(limit, s)
    want = retrieval_width(top, scorer is not None, s)
    if mode == "prefilter":
        wanted = matching(emails, attachments, filters) if filters.any() else emails
        k = want if scorer is not None else top
        if index is None:
            hits = nearest_messages(vectors, query_vector, wanted, k, filters.any())
        else:
            hits = index.search(query_vector, k, lambda rows: best_messages(rows, wanted, k, filters.any()))
    elif not filters.any():
        hits = nearest(vectors, query_vector, want)
    else:
        keys = newest(matching(emails, attachments, filters), s.filtered_cap).select(F.col("file_hash").alias("id"))
        n = keys.count()
        first, wider = filtered_widths(want, n, s)
        hits = nearest(vectors, query_vector, first).join(keys, "id", "left_semi")
        if wider is not None and hits.count() < want:
            hits = nearest(vectors, query_vector, wider).join(keys, "id", "left_semi")
        hits = hits.orderBy("distance", "id").limit(want)
    results = best_per_message(hydrate(ranked_hits(hits), emails))
    if scorer is not None:
        return rerank(results, query, scorer, top, s)
    return results.orderBy("rank").limit(top)


def pairwise(vectors: DataFrame, other: DataFrame, left: str = "embedding", right: str = "query_vector") -> DataFrame:
    """Distances of every vector to one other row (a broadcast of a single row)."""
    one = other.limit(1)
    return vectors.crossJoin(F.broadcast(one)).withColumn("distance", cosine_distance(left, right))
