"""Metadata queries, inbox pages, lookups and statistics, as lazy DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import account_pattern, contains_like, file_hash, link_fields, message_id_of, snippet
from postlake.params import SETTINGS, Filters, Settings, builder_limit, inbox_limit
from postlake.schema import EXTRACTION_VERSION


def email_predicate(f: Filters) -> Column:
    """The conjunction of the filters on the message itself; date bounds are inclusive."""
    parts: list[Column] = []
    if f.from_addr:
        parts.append(contains_like("from_addr", f.from_addr))
    if f.to_addr:
        parts.append(contains_like("to_addrs", f.to_addr) | contains_like("cc_addrs", f.to_addr) | contains_like("bcc_addrs", f.to_addr))
    if f.subject:
        parts.append(F.col("subject") == f.subject)
    if f.subject_like:
        parts.append(contains_like("subject", f.subject_like))
    if f.date_after:
        parts.append(F.col("date") >= F.lit(f.date_after))
    if f.date_before:
        parts.append(F.col("date") <= F.lit(f.date_before))
    if f.has_attachments is not None:
        parts.append(F.col("has_attachments") == F.lit(f.has_attachments))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def attachment_predicate(f: Filters) -> Column | None:
    """What one attachment of the message must satisfy; None where attachments aren't asked for."""
    if f.attachment_type is None and f.attachment_name is None:
        return None
    out = F.lit(True)
    if f.attachment_type:
        out = out & (F.col("file_extension") == f.attachment_type.lower().lstrip("."))
    if f.attachment_name:
        out = out & contains_like("filename", f.attachment_name)
    return out


def matching(emails: DataFrame, attachments: DataFrame, f: Filters) -> DataFrame:
    """Messages that satisfy the filters: a semi-join, so no message appears twice and nothing is deduplicated."""
    out = emails.where(email_predicate(f))
    on_attachment = attachment_predicate(f)
    if on_attachment is None:
        return out
    return out.join(attachments.where(on_attachment).select(F.col("email_id").alias("id")), "id", "left_semi")


def newest(df: DataFrame, limit: int) -> DataFrame:
    """Top-n by date, messages without one last; equal dates by id."""
    return df.orderBy(F.desc_nulls_last("date"), "id").limit(limit)


def metadata_query(emails: DataFrame, attachments: DataFrame, f: Filters, limit: int | None = None, s: Settings = SETTINGS) -> DataFrame:
    return newest(matching(emails, attachments, f), builder_limit(limit, s))


def with_attachments(rows: DataFrame, attachments: DataFrame) -> DataFrame:
    """``attachments``: the messages' attachments in order; an empty array where there are none.

    ``rows`` is a limited result, so its ids cut the attachments down before they are grouped.
    """
    own = attachments.join(rows.select(F.col("id").alias("email_id")), "email_id", "left_semi")
    fields = [c for c in attachments.columns if c != "email_id"]
    nested = own.groupBy(F.col("email_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("attachments"))
    kind = nested.schema["attachments"].dataType.simpleString()
    return rows.join(nested, "id", "left").withColumn("attachments", F.coalesce("attachments", F.expr(f"cast(array() as {kind})")))


def with_links(rows: DataFrame, scheme: str | None = None) -> DataFrame:
    return rows.withColumns(link_fields("message_id", "subject", scheme))


def truncated(emails: DataFrame, attachments: DataFrame, f: Filters, limit: int) -> DataFrame:
    """One row: whether more than ``limit`` messages match, found by looking at limit + 1 of them."""
    return matching(emails, attachments, f).select(F.lit(1)).limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("truncated"))


def inbox(emails: DataFrame, limit: int = 50, account: str | None = None, date_after: datetime | None = None, date_before: datetime | None = None, s: Settings = SETTINGS) -> DataFrame:
    """A page of inbox messages, newest first; the next page begins strictly before this one's oldest date."""
    rows = emails.where(F.col("file_path").ilike("%/INBOX.mailbox/%"))
    if account:
        rows = rows.where(F.col("file_path").ilike(account_pattern(account)))
    if date_after is not None:
        rows = rows.where(F.col("date") > F.lit(date_after))
    if date_before is not None:
        rows = rows.where(F.col("date") < F.lit(date_before))
    page = newest(rows, inbox_limit(limit, s))
    return inbox_rows(page, s)


def inbox_after(emails: DataFrame, date: datetime, last_id: int, limit: int = 50, s: Settings = SETTINGS) -> DataFrame:
    """The page after the message (date, id): also right where many messages have one date."""
    rows = emails.where(F.col("file_path").ilike("%/INBOX.mailbox/%")).where((F.col("date") < F.lit(date)) | ((F.col("date") == F.lit(date)) & (F.col("id") > last_id)))
    return inbox_rows(newest(rows, inbox_limit(limit, s)), s)


def inbox_rows(page: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return page.select("id", "message_id", text("from_addr").alias("from"), text("to_addrs").alias("to"), text("subject").alias("subject"), "date", F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"), snippet("body_preview", s).alias("body_snippet"))


# -- lookups: every one is a filter that Parquet statistics can prune --------------------------------


def by_path(emails: DataFrame, path: str) -> DataFrame:
    return emails.where(F.col("file_path") == path)


def by_id(emails: DataFrame, email_id: int) -> DataFrame:
    return emails.where(F.col("id") == email_id)


def by_hash(emails: DataFrame, hashed: str) -> DataFrame:
    return emails.where(F.col("file_hash") == hashed)


def by_message_id(emails: DataFrame, message_id: str | None) -> DataFrame:
    """The newest message with the id (with or without brackets); none for an empty one."""
    if not message_id:
        return emails.limit(0)
    bare = message_id.strip().removeprefix("<").removesuffix(">")
    found = emails.where(F.col("message_id").isin(message_id, bare, f"<{bare}>"))
    return found.orderBy(F.desc(F.col("message_id") == message_id), F.desc_nulls_last("indexed_at"), F.desc("id")).limit(1)


def by_hashes(emails: DataFrame, hashes: DataFrame) -> DataFrame:
    """Messages whose hash is in ``hashes(file_hash)``: a semi-join instead of lists of 500."""
    return emails.join(hashes.select("file_hash"), "file_hash", "left_semi")


def vector_by_path(vectors: DataFrame, path: str) -> DataFrame:
    return vectors.where(F.col("id") == file_hash(F.lit(path)))


def inspect(emails: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """What both tables hold for a path, whichever has it."""
    left = by_path(emails, path).select(F.col("file_hash").alias("key"), "subject", "from_addr", "date", "body_preview")
    right = vector_by_path(vectors, path).select(F.col("id").alias("key"), "document")
    return left.join(right, "key", "full_outer").withColumn("file_path", F.lit(path))


# -- statistics --------------------------------------------------------------------------------------


def statistics(emails: DataFrame, attachments: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row of counts and the date range: one pass over each table."""
    out = emails.agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if("has_attachments").alias("emails_with_attachments"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.max("file_mtime").alias("max_file_mtime"),
    ).crossJoin(attachments.agg(F.count(F.lit(1)).alias("total_attachments")))
    return out if vectors is None else out.crossJoin(vectors.agg(F.count(F.lit(1)).alias("total_indexed_emails")))


def stale(emails: DataFrame, version: int = EXTRACTION_VERSION) -> DataFrame:
    return emails.where(F.coalesce("extraction_version", F.lit(0)) < version)


def same_message(a: Column, b: Column) -> Column:
    return message_id_of(a) == message_id_of(b)
