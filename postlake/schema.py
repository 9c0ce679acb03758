"""The data model: messages, attachments, vectors and state as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from postlake.runtime import given

#: Version of the extraction; rows of a lower one are stale.
EXTRACTION_VERSION = 3

EMAILS = StructType(
    [
        StructField("id", LongType()),
        StructField("message_id", StringType()),
        StructField("file_path", StringType(), False),
        StructField("file_hash", StringType(), False),
        StructField("subject", StringType()),
        StructField("from_addr", StringType()),
        StructField("to_addrs", StringType()),
        StructField("cc_addrs", StringType()),
        StructField("bcc_addrs", StringType()),
        StructField("date", TimestampType()),
        StructField("body_preview", StringType()),
        StructField("has_attachments", BooleanType()),
        StructField("attachment_count", IntegerType()),
        StructField("file_size", LongType()),
        StructField("indexed_at", TimestampType()),
        StructField("file_mtime", DoubleType()),
        StructField("extraction_version", IntegerType()),
        StructField("in_reply_to", StringType()),
        StructField("references_header", StringType()),
        StructField("date_offset", IntegerType()),  # minutes that the sender's clock was ahead of UTC
    ]
)
ATTACHMENTS = StructType(
    [
        StructField("id", LongType()),
        StructField("email_id", LongType()),
        StructField("filename", StringType()),
        StructField("content_type", StringType()),
        StructField("file_extension", StringType()),
        StructField("size", LongType()),
        StructField("content_disposition", StringType()),
    ]
)
VECTORS = StructType(
    [
        StructField("id", StringType(), False),
        StructField("embedding", ArrayType(FloatType())),
        StructField("document", StringType()),
        StructField("subject", StringType()),
        StructField("from", StringType()),
        StructField("to", StringType()),
        StructField("date", StringType()),
        StructField("message_id", StringType()),
        StructField("file_path", StringType()),
        StructField("attachment_count", IntegerType()),
        StructField("attachment_types", StringType()),
    ]
)
STATE = StructType([StructField("key", StringType(), False), StructField("value", StringType()), StructField("updated_at", TimestampType())])
PARSED_ATTACHMENT = StructType(
    [
        StructField("filename", StringType()),
        StructField("content_type", StringType()),
        StructField("content_disposition", StringType()),
        StructField("size", LongType()),
        StructField("extracted_text", StringType()),
    ]
)
PARSED = StructType(
    [
        StructField("file_path", StringType()),
        StructField("subject", StringType()),
        StructField("from", StringType()),
        StructField("to", StringType()),
        StructField("cc", StringType()),
        StructField("bcc", StringType()),
        StructField("date", TimestampType()),
        StructField("date_raw", StringType()),
        StructField("date_offset", IntegerType()),
        StructField("message_id", StringType()),
        StructField("body", StringType()),
        StructField("attachments", ArrayType(PARSED_ATTACHMENT)),
        StructField("in_reply_to", StringType()),
        StructField("references", StringType()),
        StructField("file_mtime", DoubleType()),
        StructField("file_size", LongType()),
        StructField("parse_error", StringType()),
    ]
)
TABLES = {"emails": EMAILS, "attachments": ATTACHMENTS, "vectors": VECTORS, "state": STATE}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return given(spark, [], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema``, missing ones as null; a missing extraction version is 0."""
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    out = df.select(*columns)
    return out.withColumn("extraction_version", F.coalesce("extraction_version", F.lit(0))) if "extraction_version" in out.columns else out
