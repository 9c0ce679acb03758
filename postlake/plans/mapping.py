"""The test tables seen as a mail archive, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import file_extension, file_hash
from postlake.runtime import table
from postlake.schema import EMAILS, conform


def order_emails(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    """orders and customer as messages; with ``counts`` their lineitems as attachment counts."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    key = F.col("o_orderkey").cast("string")
    segment = F.lower("c_mktsegment")
    box = F.when(F.col("o_orderstatus") == "F", "INBOX.mailbox").otherwise("Archive.mailbox")
    path = F.concat(F.lit("/mail/"), segment, F.lit("%40example.com/"), box, F.lit("/Messages/"), key, F.lit(".eml"))
    mid = F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("<m"), (F.col("o_orderkey") % 4001).cast("string"), F.lit("@example.com>")))
    rows = rows.select(
        F.col("o_orderkey").alias("id"),
        mid.alias("message_id"),
        path.alias("file_path"),
        file_hash(path).alias("file_hash"),
        F.col("o_orderpriority").alias("subject"),
        F.col("c_name").alias("from_addr"),
        F.concat(segment, F.lit("@example.com")).alias("to_addrs"),
        F.concat(F.lower("o_orderstatus"), F.lit("-desk@example.com")).alias("cc_addrs"),
        F.lit("").alias("bcc_addrs"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.repeat(F.concat_ws(" ", "o_orderpriority", "c_name", "c_mktsegment"), 8)).alias("body_preview"),
        F.col("o_orderdate").cast("timestamp").alias("indexed_at"),
        F.unix_timestamp("o_orderdate").cast("double").alias("file_mtime"),
        (F.col("o_orderkey") % 5).cast("int").alias("extraction_version"),
    )
    if counts:
        n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("attachment_count"))
        rows = rows.join(n, "id", "left").withColumn("attachment_count", F.coalesce("attachment_count", F.lit(0))).withColumn("has_attachments", F.col("attachment_count") > 0)
    return conform(rows, EMAILS)


def line_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("l_returnflag") == "R", ".PDF").when(F.col("l_returnflag") == "A", ".tar.gz").otherwise("")
    name = F.concat(F.lit("doc-"), F.col("l_linenumber").cast("string"), suffix)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("email_id"),
        name.alias("filename"),
        F.lit("application/octet-stream").alias("content_type"),
        file_extension(name).alias("file_extension"),
        F.col("l_quantity").cast("long").alias("size"),
        F.lit("attachment").alias("content_disposition"),
    )


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages: real duplicate ids, and a vector for some."""
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".eml"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.md5("text").alias("message_id"),
        path.alias("file_path"),
        file_hash(path).alias("file_hash"),
        F.col("lang").alias("subject"),
        F.col("source").alias("from_addr"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("date"),
        F.substring("text", 1, 5000).alias("body_preview"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("indexed_at"),
        F.col("n_chars").cast("double").alias("file_mtime"),
    )
    return conform(rows, EMAILS)


def embedding_vectors(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    path = F.concat(F.lit("/docs/"), (F.col("vec_id") + shift).cast("string"), F.lit(".eml"))
    return table(spark, sf_dir, "embeddings").select(file_hash(path).alias("id"), "embedding", path.alias("file_path"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("message_id"), "vec_id", "label")


#: The same tables in DuckDB's SQL.
EMAILS_SQL = """
order_emails as (
  select o_orderkey as id,
    case when o_orderkey % 50 = 0 then '' else concat('<m', cast(o_orderkey % 4001 as varchar), '@example.com>') end as message_id,
    concat('/mail/', lower(c_mktsegment), '%40example.com/', case when o_orderstatus = 'F' then 'INBOX.mailbox' else 'Archive.mailbox' end, '/Messages/', cast(o_orderkey as varchar), '.eml') as file_path,
    o_orderpriority as subject, c_name as from_addr, concat(lower(c_mktsegment), '@example.com') as to_addrs,
    concat(lower(o_orderstatus), '-desk@example.com') as cc_addrs, '' as bcc_addrs, cast(o_orderdate as timestamp) as date,
    case when o_orderkey % 7 <> 0 then repeat(concat_ws(' ', o_orderpriority, c_name, c_mktsegment), 8) end as body_preview,
    cast(o_orderdate as timestamp) as indexed_at, cast(epoch(o_orderdate) as double) as file_mtime, cast(o_orderkey % 5 as integer) as extraction_version,
    coalesce(n, 0) as attachment_count, coalesce(n, 0) > 0 as has_attachments
  from orders join customer on o_custkey = c_custkey
  left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on l_orderkey = o_orderkey),
line_attachments as (
  select l_orderkey * 10 + l_linenumber as id, l_orderkey as email_id,
    concat('doc-', cast(l_linenumber as varchar), case l_returnflag when 'R' then '.PDF' when 'A' then '.tar.gz' else '' end) as filename,
    case l_returnflag when 'R' then 'pdf' when 'A' then 'gz' else '' end as file_extension, cast(l_quantity as bigint) as size
  from lineitem)
"""
DOCS_SQL = """
document_emails as (
  select doc_id as id, md5(text) as message_id, concat('/docs/', cast(doc_id as varchar), '.eml') as file_path, lang as subject, source as from_addr,
    timestamp '2024-01-01' + to_hours(cast(doc_id as integer)) as date, substr(text, 1, 5000) as body_preview
  from documents),
vectors as (
  select md5(concat('/docs/', cast(vec_id as varchar), '.eml')) as id, embedding::double[] as e, vec_id, label from embeddings),
q as (select embedding::double[] as qe from embeddings where vec_id = 7)
"""
