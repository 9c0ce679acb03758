"""Full text search with BM25 over an inverted index that skips blocks of documents.

Documents are taken in blocks, of at most ``BLOCK`` that one task reads one after the other.  The index has a list for each term and
block (ids, frequencies and lengths of the documents that have the term; made within the task, so no single word is shuffled), the
greatest impact of each term in each block (what the term's frequency is worth in a text of that length), and
the number of documents of each term.  A document's score is the sum of its terms' impacts times their inverse document
frequency, so no document of a block scores more than the sum of the block's greatest impacts.  A search opens the blocks
that promise most, takes the k-th score that it finds there, and then opens only blocks that promise as much: the result is that of scoring
all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postlake.runtime import given, ship_package

#: Usual constants of BM25, documents of a block and words at which one is closed before, files of postings, blocks opened
#: at first.
K1, B, BLOCK, WORDS, FILES, FIRST = 1.2, 0.75, 2_048, 1_000_000, 16, 4


def terms_of(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _file_of(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(FILES)).cast("int")


def _impact(tf: Column, size: Column, length: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / length))


class TextIndex:
    """An index at a folder: ``postings``, ``blocks``, ``terms`` and ``totals``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.documents, self.length = spark.read.parquet(f"{self.root}/totals").select("documents", "length").first()

    @classmethod
    def build(cls, docs: DataFrame, root: str, id_col: str = "id", text_col: str = "text", block: int = BLOCK) -> TextIndex:
        """Index whole texts.  Null texts are empty; empty ones count as documents and match nothing; rows without an id are left
        out.  Ids are strings or whole numbers and must be distinct."""
        spark, root = docs.sparkSession, root.rstrip("/")
        ship_package(spark)
        words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("words"))
        kind = pa.string() if isinstance(words.schema["id"].dataType, StringType) else pa.int64()
        names = ["term", "block", "ids", "tfs", "sizes"]

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            number, n, entries = TaskContext.get().partitionId() << 32, 0, 0

            def closed() -> pa.RecordBatch:
                ids = pa.concat_arrays([b.column("id") for b in held]).cast(kind)
                found = pa.concat_arrays([b.column("words") for b in held])
                sizes = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                coded = found.flatten().dictionary_encode()
                by_name = np.asarray(pc.sort_indices(coded.dictionary))
                rank = np.empty(len(by_name), np.int64)
                rank[by_name] = np.arange(len(by_name))
                pairs = rank[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), sizes)
                each, tfs = np.unique(pairs, return_counts=True)  # by term, then by place in the block
                term, place = each // n, each % n
                # the empty term comes first: how many documents, and words
                ends = np.concatenate([[0, 1], 1 + np.searchsorted(term, np.arange(1, len(by_name) + 1))]).astype(np.int32)
                lists_of = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
                none = pa.array([None], kind)
                columns = [
                    pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(by_name)).cast(pa.string())]),
                    pa.array(np.full(len(by_name) + 1, number)),
                    lists_of(pa.concat_arrays([none, ids.take(pa.array(place))])),
                    lists_of(pa.array(np.concatenate([[n], tfs]).astype(np.int64))),
                    lists_of(pa.array(np.concatenate([[sizes.sum()], sizes[place]]).astype(np.int64))),
                ]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for batch in batches:
                ends = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
                start = 0
                while start < batch.num_rows:
                    before = ends[start - 1] if start else 0
                    # up to the document that fills the block, itself included
                    full = int(np.searchsorted(ends, before + WORDS - entries)) + 1
                    stop = min(batch.num_rows, start + block - n, full)
                    held.append(batch.slice(start, stop - start))
                    n, entries, start = n + stop - start, entries + int(ends[stop - 1] - before), stop
                    if n >= block or entries >= WORDS:
                        yield closed()
                        held, number, n, entries = [], number + 1, 0, 0
            if n:
                yield closed()

        id_type = "string" if kind == pa.string() else "long"
        made = words.mapInArrow(lists, f"term string, block long, ids array<{id_type}>, tfs array<long>, sizes array<long>").withColumn("file", _file_of(F.col("term")))
        # a term of very many documents is split by its blocks; not by range, since sampling would make all lists twice
        dealt = made.repartition("file", "term", F.pmod(F.xxhash64("block"), F.lit(64))).sortWithinPartitions("file", "term", "block")
        given(spark, [], made.schema).write.mode("overwrite").parquet(f"{root}/columns")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("file").parquet(f"{root}/postings")
        kept = spark.read.schema(made.schema).parquet(f"{root}/postings")
        whole = kept.where((F.col("file") == _file_of(F.lit(""))) & (F.col("term") == ""))
        n, size = whole.agg(F.coalesce(F.sum(F.col("tfs")[0]), F.lit(0)), F.coalesce(F.sum(F.col("sizes")[0]), F.lit(0))).first()
        length = size / n if n else 1.0
        given(spark, [(n, float(length or 1.0))], "documents long, length double").coalesce(1).write.mode("overwrite").parquet(f"{root}/totals")
        most = F.array_max(F.zip_with("tfs", "sizes", lambda tf, size: _impact(tf, size, float(length or 1.0))))
        best = kept.where(F.col("term") != "").select("term", "block", most.alias("most"), F.size("tfs").cast("long").alias("n"))
        # lists lie sorted in their files, so they are read in order
        best.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{root}/blocks")
        out = cls(spark, root)
        out.blocks().groupBy("term").agg(F.sum("n").alias("n")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/terms")
        return out

    def postings(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.root}/columns").schema).parquet(f"{self.root}/postings")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/blocks")

    def weights(self, query: str) -> dict[str, float]:
        """The query's distinct terms that some document has, with their inverse document frequency."""
        asked = self.spark.range(1).select(F.array_distinct(terms_of(F.lit(query)))).first()[0]
        rows = self.spark.read.parquet(f"{self.root}/terms").where(F.col("term").isin(asked)) if asked else None
        if rows is None:
            return {}
        return {r["term"]: r["w"] for r in rows.select("term", F.log(1 + (self.documents - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("w")).collect()}

    def search(self, query: str, k: int) -> tuple[DataFrame, int]:
        """id, score of the k best documents, ties by id, and how many blocks were opened."""
        weights = self.weights(query)
        kept = self.postings()
        if not weights or k <= 0:
            return kept.select(F.explode("ids").alias("id"), F.lit(0.0).alias("score")).limit(0), 0
        idf = F.element_at(F.create_map(*(F.lit(x) for t, w in sorted(weights.items()) for x in (t, w))), F.col("term"))
        some = F.col("term").isin(sorted(weights))
        files = [r[0] for r in given(self.spark, [(t,) for t in weights], "term string").select(_file_of(F.col("term"))).distinct().collect()]
        promised = self.blocks().where(some).groupBy("block").agg(F.sum(F.col("most") * idf).alias("most"))

        def scored(opened: DataFrame) -> DataFrame:
            rows = kept.where(F.col("file").isin(files) & some).join(opened.select("block"), "block", "left_semi")
            each = rows.select("term", F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("d"))
            return each.groupBy(F.col("d.ids").alias("id")).agg(F.sum(_impact(F.col("d.tfs"), F.col("d.sizes"), self.length) * idf).alias("score"))

        first = promised.orderBy(F.desc("most"), "block").limit(max(FIRST, -(-2 * k // BLOCK)))
        found = [r[0] for r in scored(first).orderBy(F.desc("score")).limit(k).select("score").collect()]
        # sums in another order may differ in their last digits
        opened = promised.where(F.col("most") >= min(found) * (1 - 1e-9)) if len(found) == k else promised
        return scored(opened).orderBy(F.desc("score"), "id").limit(k), opened.count()
