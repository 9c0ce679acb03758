"""Trigram postings for LIKE: which texts can match is read from an index, which do is decided by the pattern itself.

Every distinct text of a field is lower-cased and cut into its distinct runs of three characters; a posting says that a text (by
its hash) has one.  Senders, recipients and names of files repeat over very many rows, so postings are far fewer than rows have
trigrams.  Postings lie in files by field and by a hash of the trigram, sorted by trigram, so a search reads the row groups of a
few trigrams.  A pattern asks for the trigrams of its literal stretches (wildcards, ``%`` and ``_``, end a stretch).  Of those the
rarest ``PROBED`` by the number of rows that have them, which the index keeps, are intersected by counting; texts that have all are
candidates, and the exact ``ilike`` is applied to the rows whose text hashes to one.  A pattern without a stretch of three
characters, or whose trigrams are all in more than ``COMMON`` of the rows, is answered by the plain scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import contains_like
from postlake.operators.listing import attachment_predicate, email_predicate
from postlake.params import Filters
from postlake.runtime import given

#: Fields of messages, and of attachments, that patterns are asked of.
FIELDS = {"emails": ("from_addr", "to_addrs", "cc_addrs", "bcc_addrs", "subject"), "attachments": ("filename",)}
#: Trigrams of a pattern that are looked up, the share of rows from which a trigram says too little, files of a field.
PROBED, COMMON, FILES = 3, 0.2, 16
#: Candidates that are sent to all tasks.
SENT = 500_000
POSTINGS = "value long, n long, gram string, field string, file int"


def grams_of(text: Column) -> Column:
    """Distinct trigrams of a text, lower-cased."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def grams_of_pattern(lowered: str) -> list[str]:
    """Trigrams that every text matching ``%pattern%`` has, of a lower-cased pattern."""
    return sorted({s[i : i + 3] for s in re.split("[%_]", lowered) for i in range(len(s) - 2)})


def _file_of(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(FILES)).cast("int")


def _value(text: str | Column) -> Column:
    """What stands for a text in the postings; texts that share it are candidates together."""
    return F.xxhash64(F.lower(F.col(text).cast("string") if isinstance(text, str) else text))


class LikeIndex:
    """Postings of the texts of messages and of attachments at a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rows = {r["kind"]: r["n"] for r in spark.read.parquet(f"{self.root}/rows").collect()}

    @classmethod
    def build(cls, emails: DataFrame, attachments: DataFrame, root: str) -> LikeIndex:
        """Index the texts of all rows.  Null fields have no postings.  A trigram that very many texts have is spread over tasks."""
        spark, root = emails.sparkSession, root.rstrip("/")
        sides = (("emails", emails), ("attachments", attachments))
        texts = None
        for kind, rows in sides:
            fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("text")) for f in FIELDS[kind]))
            cut = rows.select(F.explode(fields).alias("f")).where(F.length("f.text") >= 3).groupBy("f.field", "f.text").agg(F.count(F.lit(1)).alias("n"))
            texts = cut if texts is None else texts.unionByName(cut)
        postings = texts.select(_value(F.col("text")).alias("value"), "n", "field", F.explode(grams_of(F.col("text"))).alias("gram")).withColumn("file", _file_of(F.col("gram")))
        # by range, so that a frequent trigram is split by texts; sorted, so that row groups are of few trigrams
        ranged = postings.repartitionByRange("field", "file", "gram", "value").sortWithinPartitions("field", "file", "gram", "value")
        ranged.write.mode("overwrite").option("compression", "zstd").partitionBy("field", "file").parquet(f"{root}/postings")
        kept = spark.read.schema(POSTINGS).parquet(f"{root}/postings")
        kept.groupBy("field", "gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).sortWithinPartitions("field", "gram").write.mode("overwrite").parquet(f"{root}/frequencies")
        counts = [(kind, rows.count()) for kind, rows in sides]
        given(spark, counts, "kind string, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/rows")
        return cls(spark, root)

    def candidates(self, field: str, pattern: str) -> DataFrame | None:
        """Distinct hashes (value) of the texts of a field that may match ``%pattern%``; None where the index doesn't narrow it down."""
        # lower-cased as the texts are, which is not quite as Python does
        grams = grams_of_pattern(self.spark.sql("select lower(:pattern)", {"pattern": pattern}).first()[0])
        if not grams:
            return None
        rows = self.rows["attachments" if field in FIELDS["attachments"] else "emails"]
        known = {r["gram"]: (r["n"], r["texts"]) for r in self.spark.read.parquet(f"{self.root}/frequencies").where((F.col("field") == field) & F.col("gram").isin(grams)).collect()}
        probed = sorted(grams, key=lambda g: (known.get(g, (0, 0)), g))[:PROBED]
        if probed[0] not in known:  # no row has it
            return given(self.spark, [], "value long")
        if known[probed[0]][0] > COMMON * rows:
            return None
        files = [r[0] for r in self.spark.range(1).select(F.explode(F.array_distinct(F.array(*(_file_of(F.lit(g)) for g in probed))))).collect()]
        found = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings")
        found = found.where((F.col("field") == field) & F.col("file").isin(files) & F.col("gram").isin(probed)).select("value", "gram")
        # texts of one hash may have a trigram each
        found = found.groupBy("value").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(probed)).select("value")
        return F.broadcast(found) if min(known.get(g, (0, 0))[1] for g in probed) <= SENT else found

    def narrowed(self, rows: DataFrame, *asked: tuple[tuple[str, ...], str | None]) -> DataFrame:
        """Rows without those that some pattern rules out.  ``asked`` are (fields, pattern): one of the fields must match."""
        for fields, pattern in asked:
            if not pattern:
                continue
            found = [self.candidates(f, pattern) for f in fields]
            if any(x is None for x in found):
                continue
            columns = rows.columns
            if len(fields) == 1:
                rows = rows.withColumn("_value", _value(fields[0])).join(found[0].withColumnRenamed("value", "_value"), "_value", "left_semi").select(*columns)
                continue
            for i, (f, x) in enumerate(zip(fields, found, strict=True)):  # candidates are distinct, so no row is repeated
                rows = rows.withColumn("_value", _value(f)).join(x.select(F.col("value").alias("_value"), F.lit(True).alias(f"_in{i}")), "_value", "left").drop("_value")
            rows = rows.where(F.coalesce(*(F.col(f"_in{i}") for i in range(len(fields))))).select(*columns)
        return rows

    def matching(self, emails: DataFrame, attachments: DataFrame, f: Filters) -> DataFrame:
        """``listing.matching`` by way of the index: the same rows."""
        to = FIELDS["emails"][1:4]
        out = self.narrowed(emails, (("from_addr",), f.from_addr), (to, f.to_addr), (("subject",), f.subject_like)).where(email_predicate(f))
        on_attachment = attachment_predicate(f)
        if on_attachment is None:
            return out
        some = self.narrowed(attachments, (("filename",), f.attachment_name)).where(on_attachment)
        return out.join(some.select(F.col("email_id").alias("id")), "id", "left_semi")


def like_rows(index: LikeIndex, rows: DataFrame, field: str, pattern: str) -> DataFrame:
    """Rows of which a field contains a pattern, by way of the index."""
    return index.narrowed(rows, ((field,), pattern)).where(contains_like(field, pattern))
