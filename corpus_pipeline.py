"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.bpe import encode_documents
from postlake.llm.minhash import without_near_duplicates
from postlake.llm.mixing import mix_documents
from postlake.llm.quality import select_documents
from postlake.llm.queries import CLEANED_TARGETS, labelled_domains
from postlake.llm.secret_scan import redact_documents
from postlake.runtime import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose importance weight, with Gumbel noise, is among the k largest; the others go."""
    return select_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of rows that repeat its id and words one.
    Rows of one id with unlike texts are judged one by one; documents without an id or without words all stay."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by the name of its kind."""
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the rates say that bring clean and toxic tokens to their target weights.  Junk
    went in the first stage, so the classifier isn't asked for it."""
    labelled = labelled_domains(spark, sf_dir).where("domain <> 'junk'")
    return mix_documents(docs, labelled, CLEANED_TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, input_ids of every row."""
    return encode_documents(docs, decoded=False).select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "input_ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: Importance resampling, hashed classifiers and byte-pair encoding can't be said in SQL; the tests hold run()
#: against the stages' brute-force forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
