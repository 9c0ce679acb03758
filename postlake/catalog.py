"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.functions import text as T
from postlake.functions.embedtext import embedding_text
from postlake.functions.html import html_to_text
from postlake.operators import listing, maintain, search
from postlake.operators.asof import asof_join
from postlake.operators.fulltext import TextIndex
from postlake.operators.intervals import overlap_join
from postlake.operators.likeindex import LikeIndex
from postlake.operators.staging import numbered_names
from postlake.operators.threads import threads
from postlake.operators.vectorindex import VectorIndex
from postlake.params import SETTINGS, Filters
from postlake.plans.mapping import DOCS_SQL, EMAILS_SQL, document_emails, embedding_vectors, line_attachments, order_emails
from postlake.plans.nlq import coerced_columns
from postlake.runtime import Scratch, ship_package, table
from postlake.streaming.ingest import late_candidates
from postlake.streaming.moves import moves_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def mail(select: str) -> str:
    return f"with {EMAILS_SQL} {select}"


def docs(select: str) -> str:
    return f"with {DOCS_SQL} {select}"


def _rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(columns or ("id", "date", "from_addr", "subject")))


# -- metadata queries --------------------------------------------------------------------------------

FROM, TO = datetime(1995, 1, 1), datetime(1995, 12, 31)


def _metadata(spark: SparkSession, sf_dir: str, f: Filters, limit: int | None) -> DataFrame:
    counts = f.has_attachments is not None
    return _rows(listing.metadata_query(order_emails(spark, sf_dir, counts), line_attachments(spark, sf_dir), f, limit))


@query(mail("select id, date, from_addr, subject from order_emails where from_addr ilike '%#00000001%' order by date desc nulls last, id limit 1000"))
def meta_query_from(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(from_addr="#00000001"), None)


@query(mail("select id, date, from_addr, subject from order_emails where from_addr ilike '%CUSTOMER#0000_00%' order by date desc nulls last, id limit 500"))
def meta_query_wildcard(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(from_addr="CUSTOMER#0000_00"), 500)


@query(mail("select id, date, from_addr, subject from order_emails where date >= timestamp '1995-01-01' and date <= timestamp '1995-12-31' order by date desc nulls last, id limit 400"))
def meta_query_dates(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(date_after=FROM, date_before=TO), 400)


@query(mail("select id, date, from_addr, subject from order_emails e where exists (select 1 from line_attachments a where a.email_id = e.id and a.file_extension = 'pdf' and a.filename ilike '%DOC-3%') order by date desc nulls last, id limit 300"))
def meta_query_attachment(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(attachment_type=".PDF", attachment_name="DOC-3"), 300)


@query(mail("select id, date, from_addr, subject from order_emails e where exists (select 1 from line_attachments a where a.email_id = e.id) order by date desc nulls last, id limit 300"))
def meta_query_any_attachment(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(attachment_type=""), 300)


@query(mail("select id, date, from_addr, subject from order_emails where has_attachments order by date desc nulls last, id limit 300"))
def meta_query_has_attachments(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(has_attachments=True), 300)


@query(mail("select id, date, from_addr, subject from order_emails where not has_attachments order by date desc nulls last, id limit 1000"))
def meta_query_no_attachments(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(has_attachments=False), None)


@query(mail("select id, date, from_addr, subject from order_emails where to_addrs ilike '%P-DESK%' or cc_addrs ilike '%P-DESK%' or bcc_addrs ilike '%P-DESK%' order by date desc nulls last, id limit 500"))
def meta_query_any_recipient(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(to_addr="P-DESK"), 500)


@query(mail("select id, date, from_addr, subject from order_emails where subject = '1-URGENT' and from_addr ilike '%7%' order by date desc nulls last, id limit 500"))
def meta_query_subject_exact(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(subject="1-URGENT", from_addr="7"), 500)


@query(mail("select id, date, from_addr, subject from order_emails where subject ilike '%urgent%' order by date desc nulls last, id limit 250"))
def meta_query_subject_like(spark, sf_dir):
    return _metadata(spark, sf_dir, Filters(subject_like="urgent"), 250)


@query(mail("select (select count(*) from order_emails where subject ilike '%HIGH%') > 100 as truncated"))
def meta_query_truncated(spark, sf_dir):
    return listing.truncated(order_emails(spark, sf_dir), line_attachments(spark, sf_dir), Filters(subject_like="HIGH"), 100)


@query(
    mail("""
select 'from' as what, id from order_emails where from_addr ilike '%#00000001%'
union all select 'wildcard', id from order_emails where from_addr ilike '%CUSTOMER#0000_00%' and subject ilike '%LOW%'
union all select 'recipient', id from order_emails where (to_addrs ilike '%f-desk@EXAMPLE%' or cc_addrs ilike '%f-desk@EXAMPLE%' or bcc_addrs ilike '%f-desk@EXAMPLE%') and subject ilike '%urgent%'
union all select 'short', id from order_emails where subject ilike '%5-%' and from_addr ilike '%77%'
union all select 'none', id from order_emails where from_addr ilike '%nobody%'
union all select 'file', id from order_emails e where exists (select 1 from line_attachments a where a.email_id = e.id and a.file_extension = 'pdf' and a.filename ilike '%DOC-37%')""")
)
def indexed_like(spark, sf_dir):
    """LIKE filters by way of trigram postings: selective, with wildcards, of several fields, too short, of attachments."""
    emails, files = order_emails(spark, sf_dir), line_attachments(spark, sf_dir)
    index = LikeIndex.build(emails, files, Scratch(spark, "like").path("index"))
    asked = {"from": Filters(from_addr="#00000001"), "wildcard": Filters(from_addr="CUSTOMER#0000_00", subject_like="LOW"), "recipient": Filters(to_addr="f-desk@EXAMPLE", subject_like="urgent")}
    asked |= {"short": Filters(subject_like="5-", from_addr="77"), "none": Filters(from_addr="nobody"), "file": Filters(attachment_type="pdf", attachment_name="DOC-37")}
    found = [index.matching(emails, files, f).select(F.lit(what).alias("what"), "id") for what, f in asked.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(
    mail("""
select e.id, cast(count(a.id) as bigint) as n, coalesce(string_agg(a.filename, ',' order by a.id, a.filename), '') as names
from (select * from order_emails where subject = '2-HIGH' order by date desc nulls last, id limit 200) e
left join line_attachments a on a.email_id = e.id group by e.id""")
)
def meta_query_nested_attachments(spark, sf_dir):
    att = line_attachments(spark, sf_dir)
    rows = listing.metadata_query(order_emails(spark, sf_dir), att, Filters(subject="2-HIGH"), 200)
    nested = listing.with_attachments(rows, att)
    return nested.select("id", F.size("attachments").cast("long").alias("n"), F.array_join(F.transform("attachments", lambda a: a["filename"]), ",").alias("names"))


# -- inbox -------------------------------------------------------------------------------------------

INBOX_SQL = "select id, message_id, from_addr as \"from\", to_addrs as \"to\", subject, date, has_attachments, substr(coalesce(body_preview, ''), 1, 200) as body_snippet from order_emails where file_path ilike '%/INBOX.mailbox/%'"


@query(mail(INBOX_SQL + " order by date desc nulls last, id limit 50"))
def inbox_page1(spark, sf_dir):
    return listing.inbox(order_emails(spark, sf_dir, True))


@query(mail(INBOX_SQL + " and date < timestamp '1996-03-01' and date > timestamp '1995-06-01' order by date desc nulls last, id limit 500"))
def inbox_page2(spark, sf_dir):
    return listing.inbox(order_emails(spark, sf_dir, True), limit=10_000, date_before=datetime(1996, 3, 1), date_after=datetime(1995, 6, 1))


@query(mail(INBOX_SQL + " and file_path ilike '%building%40example.com%/INBOX.mailbox/%' order by date desc nulls last, id limit 100"))
def inbox_account(spark, sf_dir):
    return listing.inbox(order_emails(spark, sf_dir, True), limit=100, account="building@example.com")


@query(mail(INBOX_SQL + " and (date < timestamp '1996-03-01' or (date = timestamp '1996-03-01' and id > 500)) order by date desc nulls last, id limit 50"))
def inbox_cursor(spark, sf_dir):
    return listing.inbox_after(order_emails(spark, sf_dir, True), datetime(1996, 3, 1), 500)


# -- statistics and lookups --------------------------------------------------------------------------


@query(
    mail("""
select cast((select count(*) from order_emails) as bigint) as total_emails, cast((select count(*) from order_emails where has_attachments) as bigint) as emails_with_attachments,
  (select min(date) from order_emails) as min_date, (select max(date) from order_emails) as max_date, (select max(file_mtime) from order_emails) as max_file_mtime,
  cast((select count(*) from line_attachments) as bigint) as total_attachments, cast((select count(*) from embeddings) as bigint) as total_indexed_emails""")
)
def index_stats(spark, sf_dir):
    return listing.statistics(order_emails(spark, sf_dir, True), line_attachments(spark, sf_dir), embedding_vectors(spark, sf_dir))


@query(mail("select id, subject from order_emails where file_path = '/mail/building%40example.com/INBOX.mailbox/Messages/1.eml' or id = 33 union all select id, subject from order_emails where md5(file_path) = (select md5(file_path) from order_emails where id = 77)"))
def point_lookups(spark, sf_dir):
    e = order_emails(spark, sf_dir)
    one = listing.by_path(e, "/mail/building%40example.com/INBOX.mailbox/Messages/1.eml").unionByName(listing.by_id(e, 33)).dropDuplicates(["id"])
    return one.unionByName(listing.by_hashes(e, listing.by_id(e, 77).select("file_hash"))).select("id", "subject")


@query(mail("select id, message_id from order_emails where message_id = '<m42@example.com>' order by indexed_at desc nulls last, id desc limit 1"))
def lookup_message_id(spark, sf_dir):
    return listing.by_message_id(order_emails(spark, sf_dir), "m42@example.com").select("id", "message_id")


@query(docs("select d.id, v.vec_id from document_emails d join vectors v on v.id = md5(d.file_path) where d.from_addr = 'src3'"))
def indexed_vectors(spark, sf_dir):
    wanted = document_emails(spark, sf_dir).where("from_addr = 'src3'")
    return wanted.select(F.col("id").alias("doc"), F.col("file_hash").alias("id")).join(embedding_vectors(spark, sf_dir).select("id", "vec_id"), "id").select(F.col("doc").alias("id"), "vec_id")


@query(docs("select key, file_path, subject, label from (select coalesce(md5(d.file_path), v.id) as key, '/docs/9.eml' as file_path, d.subject, v.label from (select * from document_emails where file_path = '/docs/9.eml') d full join (select * from vectors where id = md5('/docs/9.eml')) v on v.id = md5(d.file_path))"))
def inspect_path(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir).withColumn("document", F.col("label"))
    return listing.inspect(document_emails(spark, sf_dir), v, "/docs/9.eml").select("key", "file_path", "subject", F.col("document").alias("label"))


@query(mail("select id, extraction_version from order_emails where extraction_version < 3 order by id limit 200"))
def stale_rows(spark, sf_dir):
    return listing.stale(order_emails(spark, sf_dir)).orderBy("id").limit(200).select("id", "extraction_version")


@query(mail("select cast(count(*) as bigint) as stale from order_emails where extraction_version < 3"))
def stale_count(spark, sf_dir):
    return listing.stale(order_emails(spark, sf_dir)).agg(F.count(F.lit(1)).alias("stale"))


# -- vectors -----------------------------------------------------------------------------------------


def _query_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]


DISTANCE = "1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))"


@query(docs(f"select vec_id, round({DISTANCE}, 6) as distance from vectors, q order by {DISTANCE}, id limit 20"))
def knn_topk(spark, sf_dir):
    return search.nearest(embedding_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query(docs(f"select vec_id, label, round({DISTANCE}, 6) as distance from vectors, q order by {DISTANCE}, id limit 25"))
def vector_index_topk(spark, sf_dir):
    """The nearest vectors by an index of cells and rings; cells that the k-th distance closes aren't read."""
    index = VectorIndex.build(embedding_vectors(spark, sf_dir), Scratch(spark, "vector-index").path("index"))
    return index.nearest(_query_vector(spark, sf_dir), 25).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(
    docs(f"""
, h as (select v.id, vec_id, {DISTANCE} as distance, coalesce(nullif(d.message_id, ''), concat('row', v.id)) as m from q, vectors v join document_emails d on md5(d.file_path) = v.id where d.subject = 'en')
select vec_id, round(distance, 6) as distance from (select *, row_number() over (partition by m order by distance, id) as n from h) where n = 1 order by distance, id limit 20""")
)
def vector_index_messages(spark, sf_dir):
    """The index under a filter and without duplicates: the nearest messages, whatever has to be opened for them."""
    v = embedding_vectors(spark, sf_dir)
    index = VectorIndex.build(v, Scratch(spark, "vector-index").path("index"))
    wanted = listing.matching(document_emails(spark, sf_dir), line_attachments(spark, sf_dir), Filters(subject="en"))
    query = _query_vector(spark, sf_dir)
    found, _ = index.search(query, 20, lambda rows: search.best_messages(rows, wanted, 20, True))
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(docs("select vec_id, round(1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))), 6) as distance from vectors, q"))
def vector_distances(spark, sf_dir):
    one = table(spark, sf_dir, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("query_vector"))
    return search.pairwise(embedding_vectors(spark, sf_dir), one).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    docs(f"""
select h.vec_id, d.id as doc_id, d.subject, round(case when d.id is not null then 1 - h.distance end, 6) as similarity
from (select id, vec_id, {DISTANCE} as distance from vectors, q order by distance, id limit 30) h left join document_emails d on md5(d.file_path) = h.id""")
)
def knn_similarity_hydrated(spark, sf_dir):
    hits = search.nearest(embedding_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 30)
    rows = search.hydrate(hits.withColumn("rank", F.col("vec_id")).drop("label"), document_emails(spark, sf_dir))
    return rows.select(F.col("rank").alias("vec_id"), F.col("id").alias("doc_id"), "subject", F.round("similarity", 6).alias("similarity"))


@query(docs(f"select vec_id, round({DISTANCE}, 6) as distance from vectors v, q where exists (select 1 from document_emails d where md5(d.file_path) = v.id and d.subject = 'en') order by {DISTANCE}, id limit 15"))
def knn_prefiltered(spark, sf_dir):
    keys = listing.matching(document_emails(spark, sf_dir), line_attachments(spark, sf_dir), Filters(subject="en")).select(F.col("file_hash").alias("id"))
    return search.nearest(embedding_vectors(spark, sf_dir).join(keys, "id", "left_semi"), _query_vector(spark, sf_dir), 15).select("vec_id", F.round("distance", 6).alias("distance"))


@query(docs(f"select vec_id from (select id, vec_id from vectors, q order by {DISTANCE}, id limit 40) h where exists (select 1 from document_emails d where md5(d.file_path) = h.id and d.subject = 'fr')"))
def knn_postfiltered(spark, sf_dir):
    keys = document_emails(spark, sf_dir).where("subject = 'fr'").select(F.col("file_hash").alias("id"))
    return search.nearest(embedding_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 40).join(keys, "id", "left_semi").select("vec_id")


@query(
    docs("""
select vec_id, label, round(1 - c, 6) + 0.0 as distance, rank from (
  select a.vec_id as label, b.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) as c,
    row_number() over (partition by a.vec_id order by 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), b.id) as rank
  from vectors a, vectors b where a.vec_id % 100 = 0) where rank <= 10""")
)
def knn_many(spark, sf_dir):
    """The batch search: every vector whose id is divisible by 100 against all."""
    v = embedding_vectors(spark, sf_dir)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = search.nearest_many(v, queries, 10)
    return found.join(v.select("id", "vec_id"), "id").select("vec_id", F.col("query_id").alias("label"), (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    docs(f"""
, h as (select id, vec_id, {DISTANCE} as distance from vectors, q order by distance, id limit 60),
m as (select h.*, d.message_id, row_number() over (order by distance, h.id) as rank from h left join document_emails d on md5(d.file_path) = h.id)
select vec_id, rank from (
  select vec_id, min(rank) over (partition by coalesce(nullif(message_id, ''), cast(rank as varchar))) as rank,
    row_number() over (partition by coalesce(nullif(message_id, ''), cast(rank as varchar)) order by distance, rank) as n from m) where n = 1""")
)
def knn_dedup_results(spark, sf_dir):
    hits = search.nearest(embedding_vectors(spark, sf_dir).drop("message_id"), _query_vector(spark, sf_dir), 60)
    ranked = search.ranked_hits(hits).join(document_emails(spark, sf_dir).select(F.col("file_hash").alias("id"), "message_id"), "id", "left")
    return maintain.best_per_message(ranked).select("vec_id", F.col("rank").cast("long").alias("rank"))


@query(
    docs(f"""
select h.vec_id, d.subject, round(case when d.id is not null then 1 - h.distance end, 6) as similarity
from (select md5(concat('/docs/', cast(vec_id + 700 as varchar), '.eml')) as id, vec_id, {DISTANCE} as distance from vectors, q order by distance, id limit 50) h
left join document_emails d on md5(d.file_path) = h.id""")
)
def knn_orphans_kept(spark, sf_dir):
    hits = search.nearest(embedding_vectors(spark, sf_dir, 700), _query_vector(spark, sf_dir), 50)
    rows = search.hydrate(hits.withColumn("rank", F.col("vec_id")).drop("label"), document_emails(spark, sf_dir))
    return rows.select(F.col("rank").alias("vec_id"), "subject", F.round("similarity", 6).alias("similarity"))


@query(
    docs(f"""
, h as (select d.id as doc_id, v.id, {DISTANCE} as distance, coalesce(nullif(d.message_id, ''), concat('row', v.id)) as m from q, vectors v join document_emails d on md5(d.file_path) = v.id where d.subject = 'en' and d.date >= timestamp '2024-01-02')
select doc_id as id, round(distance, 6) as distance, round(1 - distance, 6) as similarity from (
  select *, row_number() over (partition by m order by distance, id) as n from h) t where n = 1 order by t.distance, t.id limit 20""")
)
def hybrid_search(spark, sf_dir):
    f = Filters(subject="en", date_after=datetime(2024, 1, 2))
    found = search.hybrid_search(document_emails(spark, sf_dir), line_attachments(spark, sf_dir), embedding_vectors(spark, sf_dir).drop("vec_id", "label"), _query_vector(spark, sf_dir), f, limit=20)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(
    docs(f"""
, h as (select v.id, {DISTANCE} as distance from vectors v, q),
m as (select h.*, d.id as doc_id, d.subject, d.body_preview, coalesce(nullif(d.message_id, ''), concat('row', h.id)) as m from h left join document_emails d on md5(d.file_path) = h.id),
f as (select * from (select *, row_number() over (partition by m order by distance, id) as n from m) where n = 1 order by distance, id limit 50),
r as (select *, row_number() over (order by distance, id) as place, substr(case when doc_id is null then '' else concat_ws(chr(10), nullif(trim(subject), ''), nullif(trim(body_preview, ' ' || chr(10) || chr(9) || chr(13)), '')) end, 1, 1200) as t from f),
s as (select *, len(list_filter(['the', 'and', 'that', 'with'], lambda w: list_contains(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), w))) / 4.0 as score from r where t <> '')
select doc_id as id, round(distance, 6) as distance, round(score, 6) as rerank_score from s order by score desc, place limit 10""")
)
def hybrid_search_reranked(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir).drop("vec_id", "label")
    found = search.hybrid_search(document_emails(spark, sf_dir), line_attachments(spark, sf_dir), v, _query_vector(spark, sf_dir), limit=10, query="the and that with", scorer=search.word_overlap)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("rerank_score", 6).alias("rerank_score"))


@query(
    docs(f"""
, f as (select md5(file_path) as id from (select * from document_emails where subject = 'de' order by date desc nulls last, id limit 1000)),
s as (select count(*) as n from f),
r as (select v.id, vec_id, {DISTANCE} as distance, row_number() over (order by {DISTANCE}, v.id) as place from vectors v, q),
a as (select r.* from r, s where place <= case when n <= 20 then n else least(40, n, 1000) end and id in (select id from f)),
b as (select r.* from r, s where place <= case when n <= 20 then n when (select count(*) from a) < 20 and least(40, n, 1000) < n then least(n, 1000) else least(40, n, 1000) end and id in (select id from f))
select doc_id as id from (
  select d.id as doc_id, b.distance, b.id, row_number() over (partition by d.message_id order by b.distance, b.id) as n
  from (select * from b order by distance, id limit 20) b join document_emails d on md5(d.file_path) = b.id) where n = 1 order by distance, id limit 10""")
)
def hybrid_search_postfilter(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir).drop("vec_id", "label")
    return search.hybrid_search(document_emails(spark, sf_dir), line_attachments(spark, sf_dir), v, _query_vector(spark, sf_dir), Filters(subject="de"), limit=10, mode="postfilter").select("id")


# -- maintenance -------------------------------------------------------------------------------------


@query(mail("select message_id, cast(count(*) as bigint) as cnt from order_emails where message_id is not null and message_id <> '' group by message_id having count(*) > 1"))
def dup_groups(spark, sf_dir):
    return maintain.duplicate_groups(order_emails(spark, sf_dir))


@query(docs("select cast(count(*) as bigint) as groups, cast(coalesce(sum(c - 1), 0) as bigint) as surplus from (select count(*) as c from document_emails group by message_id having count(*) > 1)"))
def dup_counts(spark, sf_dir):
    return maintain.duplicate_counts(document_emails(spark, sf_dir))


@query(mail("select id from order_emails where message_id = '' or message_id is null union all select id from (select id, row_number() over (partition by message_id order by indexed_at desc nulls last, id desc) as n from order_emails where message_id <> '') where n = 1"))
def dedup_keep_latest(spark, sf_dir):
    return maintain.keep_latest(order_emails(spark, sf_dir)).select("id")


@query(docs("select id from document_emails d where not exists (select 1 from embeddings where vec_id = d.id)"))
def prune_orphans(spark, sf_dir):
    return maintain.orphans(document_emails(spark, sf_dir), embedding_vectors(spark, sf_dir).select("file_path"), "/docs").select("id")


@query(docs("select cast(count(*) filter (where v.id is null) as bigint) as missing, cast(count(*) filter (where v.id is not null) as bigint) as present from document_emails d left join vectors v on v.id = md5(d.file_path)"))
def prune_counts(spark, sf_dir):
    return maintain.orphan_counts(document_emails(spark, sf_dir), embedding_vectors(spark, sf_dir).select("file_path"))


@query(mail("select file_path from order_emails a where id % 3 = 0 or not exists (select 1 from order_emails b where b.file_path = a.file_path and b.file_mtime = a.file_mtime and b.id % 2 = 0)"))
def unchanged_skip(spark, sf_dir):
    from postlake.sources.mailfiles import unchanged_removed

    e = order_emails(spark, sf_dir)
    # every third file has another time than the index
    candidates = e.select("file_path", (F.col("file_mtime") + F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0)).alias("file_mtime"))
    return unchanged_removed(candidates, e.where("id % 2 = 0")).select("file_path")


@query(docs("select id from document_emails a where exists (select 1 from document_emails b where b.message_id = a.message_id and b.file_path <> a.file_path and b.id >= 500)"))
def move_detection(spark, sf_dir):
    e = document_emails(spark, sf_dir)
    return maintain.moved(e, e.where("id >= 500")).select("id")


@query(
    """
with old as (select doc_id as id, concat('/docs/', cast(doc_id as varchar), '.eml') as file_path, lang as subject, source as from_addr from documents where doc_id < 700),
new as (select concat('/docs/', cast(doc_id as varchar), '.eml') as file_path, upper(lang) as subject, case when doc_id % 2 = 0 then source else '' end as from_addr from documents where doc_id >= 400)
select coalesce(old.id, (select max(id) from old) + row_number() over (partition by old.id is null order by coalesce(new.file_path, old.file_path))) as id,
  coalesce(new.file_path, old.file_path) as file_path, case when new.file_path is not null then new.subject else old.subject end as subject,
  case when new.file_path is not null then new.from_addr else old.from_addr end as from_addr
from old full join new on old.file_path = new.file_path"""
)
def upsert_result(spark, sf_dir):
    from postlake.schema import ATTACHMENTS, PARSED, conform, empty
    from postlake.sources.store import upsert_messages

    e = document_emails(spark, sf_dir)
    new = e.where("id >= 400").select("file_path", F.upper("subject").alias("subject"), F.when(F.col("id") % 2 == 0, F.col("from_addr")).alias("from"), "message_id", F.col("body_preview").alias("body"), "file_mtime")
    out, *_ = upsert_messages(e.where("id < 700"), empty(spark, ATTACHMENTS), conform(new, PARSED))
    return out.select("id", "file_path", "subject", "from_addr")


@query(mail("select id, concat('/archive/', substr(file_path, 7)) as file_path, md5(concat('/archive/', substr(file_path, 7))) as file_hash from order_emails"))
def path_migration(spark, sf_dir):
    from postlake.schema import VECTORS, empty

    emails, _ = maintain.migrate_paths(order_emails(spark, sf_dir), empty(spark, VECTORS), "/mail", "/archive/")
    return emails.select("id", "file_path", "file_hash")


@query("select arg_max(value, ts) as value, event_type as key from events group by event_type")
def state_kv_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max_by("value", "ts").alias("value"))


@query("select event_id, ts from events where ts > timestamp '2024-01-20' - interval 86400 second")
def incremental_candidates(spark, sf_dir):
    return late_candidates(table(spark, sf_dir, "events"), "2024-01-20", SETTINGS.overlap_seconds).select("event_id", "ts")


@query(docs("""
select message_id, old_path, file_path as new_path, date as moved_at
from (select *, lag(file_path) over (partition by message_id order by date, file_path) as old_path from document_emails where message_id is not null) where old_path <> file_path"""))
def streamed_moves(spark, sf_dir):
    """Messages that show up under another path, found by a stream of several micro-batches with a path for each id as its state."""
    scratch = Scratch(spark, "moves")
    seen = document_emails(spark, sf_dir).select("message_id", "file_path", F.col("date").alias("seen_at"))
    at = F.unix_timestamp("seen_at")
    first, last = seen.agg(F.min(at), F.max(at)).first()
    step = ((last or 0) - (first or 0)) // 3 + 1
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for i in range(3):  # thirds of the time, one after the other
            seen.where(F.floor((at - (first or 0)) / step) == i).write.mode("append").parquet(scratch.path("sightings"))
            found = moves_stream(spark.readStream.schema(seen.schema).parquet(scratch.path("sightings")), "1 hour", keep_days=100_000)
            found.writeStream.format("parquet").option("checkpointLocation", scratch.path("progress")).outputMode("append").trigger(availableNow=True).start(scratch.path("moves")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(found.schema).parquet(scratch.path("moves"))


@query(r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents where doc_id is not null),
n as (select count(*) as n, avg(len(w)) as l from w),
t as (select doc_id, len(w) as size, x.t as term, len(list_filter(w, lambda y: y = x.t)) as tf from w, (values ('the'), ('that'), ('with'), ('secret')) as x (t)),
f as (select term, count(*) filter (where tf > 0) as df from t group by term)
select doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / n.l))), 6) as score
from t join f using (term), n where tf > 0 group by doc_id order by sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / n.l))) desc, doc_id limit 50""")
def fulltext_bm25(spark, sf_dir):
    """The best texts for some words by BM25, over an index of all documents that skips blocks."""
    index = TextIndex.build(table(spark, sf_dir, "documents"), Scratch(spark, "fulltext").path("index"), "doc_id", block=256)
    found, _ = index.search("The secret, that WITH the", 50)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# -- threads and times -------------------------------------------------------------------------------


@query("""
with recursive e as (select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as prev, lag(event_id, 2) over (partition by user_id order by ts, event_id) as prev2 from events),
p as (select event_id as id, case event_id % 20 when 19 then null when 18 then prev2 else prev end as parent from e),
r as (select id, id as root_id, cast(0 as bigint) as depth from p where parent is null union all select p.id, r.root_id, r.depth + 1 from p join r on p.parent = r.id),
s as (select root_id, count(*) as size from r group by root_id)
select id, root_id, depth, size from r join s using (root_id)""")
def message_threads(spark, sf_dir):
    """Threads of messages made of events, each an answer to its user's event before (named by either header, or to the one before
    that, as the first is unknown), every twentieth a new thread."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.lag("event_id", 2).over(w).alias("prev2"))
    name = lambda c: F.concat(F.lit("<e"), F.col(c).cast("string"), F.lit("@ex.org>"))
    k = F.col("event_id") % 20
    reply = F.when(k < 10, name("prev")).when(k == 18, F.lit("<lost@ex.org>"))
    references = F.when((k >= 10) & (k < 18), F.concat_ws(" ", name("prev2"), name("prev"))).when(k == 18, F.concat_ws(" ", name("prev2"), F.lit("<gone@ex.org>")))
    return threads(e.select(F.col("event_id").alias("id"), name("event_id").alias("message_id"), reply.alias("in_reply_to"), references.alias("references_header")))


@query("""
with o as (select o_orderkey, o_custkey % 150 as user_id, timestamp '2024-01-01' + to_minutes(cast(o_orderkey * 7919 % 43200 as int)) as opened, case when o_orderkey % 50 = 0 then 20000 else o_orderkey % 600 end as minutes from orders)
select o_orderkey, event_id, e.user_id from o join events e on o.user_id = e.user_id and e.ts >= opened and e.ts <= opened + to_minutes(cast(minutes as int))""")
def events_within(spark, sf_dir):
    """Events within the intervals of their user's orders, of which some are long."""
    k = F.col("o_orderkey")
    start = F.lit(1_704_067_200_000_000) + k * 7919 % 43_200 * 60_000_000
    minutes = F.when(k % 50 == 0, 20_000).otherwise(k % 600)
    orders = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 150).alias("user_id"), start.alias("opened"), (start + minutes * 60_000_000).alias("closed"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return overlap_join(orders, events, ("opened", "closed"), ("at", "at"), ("user_id",)).select("o_orderkey", "event_id", "user_id")


@query("""
with p as (select user_id, ts, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_type = 'purchase' group by user_id, ts)
select e.event_id, e.event_type, p.event_id as last_event_id, p.value as last_value from events e asof left join p on e.user_id = p.user_id and e.ts > p.ts""")
def events_asof(spark, sf_dir):
    """Every event with the last purchase of its user before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return asof_join(events, bought, "user_id", "ts", "event_id", strict=True, prefix="last_").select("event_id", "event_type", "last_event_id", "last_value")


# -- text --------------------------------------------------------------------------------------------

ENCODED = "replace(replace(replace(replace(url_encode({}), '%40', '@'), '%2F', '/'), '%7E', '~'), '+', '%20')"


@query(
    f"""
with m as (select doc_id, case when doc_id % 11 = 0 then '  <>  ' else concat(' <', cast(doc_id as varchar), case doc_id % 4 when 0 then '%25' when 1 then '(x)' when 2 then '/y' else ' z' end, '@ex.com> ') end as raw,
  case when doc_id % 5 = 0 then '[List]  Re:' || chr(10) || lang when doc_id % 7 = 0 then null else source end as subject from documents),
n as (select doc_id, subject, nullif(trim(regexp_replace(trim(raw), '^<(.*)>$', '\\1')), '') as mid from m)
select doc_id, 'message:' || {ENCODED.format("'<' || mid || '>'")} as message_url, 'mid:' || mid as mid_url,
  '[' || coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(subject, ''), '[\\[\\]]', '', 'g'), '\\s+', ' ', 'g')), ''), '(no subject)') || '](message:' || {ENCODED.format("'<' || mid || '>'")} || ')' as markdown_link
from n"""
)
def link_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tail = F.element_at(F.array(*map(F.lit, ("%25", "(x)", "/y", " z"))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("doc_id") % 11 == 0, "  <>  ").otherwise(F.concat(F.lit(" <"), F.col("doc_id").cast("string"), tail, F.lit("@ex.com> ")))
    subject = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("[List]  Re:\n"), F.col("lang"))).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source"))
    return d.select("doc_id", *(c.alias(n) for n, c in T.link_fields(raw, subject).items()))


NAMES = "select p_partkey, concat(case p_partkey % 6 when 0 then 'dir.d/.bashrc' when 1 then 'a.tar.GZ' when 2 then 'plain' when 3 then 'Report.PDF' when 4 then 'x/y.z/name' else 'end.' end) as filename from part"


@query(f"select p_partkey, case when regexp_extract(filename, '[^/]*$') like '_%.%' then lower(regexp_extract(regexp_extract(filename, '[^/]*$'), '^.+\\.([^.]+)$', 1)) else '' end as relational, case when filename like '%.%' then lower(split_part(filename, '.', -1)) end as vector from ({NAMES})")
def file_extensions(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("dir.d/.bashrc", "a.tar.GZ", "plain", "Report.PDF", "x/y.z/name", "end."))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.file_extension(names).alias("relational"), T.meta_extension(names).alias("vector"))


@query(
    mail("""
, named as (select email_id, id, case when filename like '%.%' then lower(split_part(filename, '.', -1)) end as ext, row_number() over (partition by email_id order by id, filename) as n from line_attachments),
firsts as (select email_id, ext, min(n) as n from named where n <= 10 and ext is not null and ext <> '' group by email_id, ext)
select a.email_id, coalesce(string_agg(f.ext, ',' order by f.n), '') as attachment_types from (select distinct email_id from line_attachments) a left join firsts f using (email_id) group by a.email_id""")
)
def attachment_types_meta(spark, sf_dir):
    nested = line_attachments(spark, sf_dir).groupBy("email_id").agg(F.sort_array(F.collect_list(F.struct("id", "filename"))).alias("attachments"))
    return nested.select("email_id", T.attachment_types("attachments").alias("attachment_types"))


@query(
    mail("""
select e.id, md5(trim(concat_ws(chr(10), e.subject, e.from_addr, coalesce(e.body_preview, '')) || coalesce(chr(10) || 'Attachments:' || chr(10) || string_agg(a.filename || chr(10) || a.file_extension || 'x', chr(10) order by a.id, a.filename), ''), chr(10))) as digest
from order_emails e left join line_attachments a on a.email_id = e.id group by e.id, e.subject, e.from_addr, e.body_preview""")
)
def embedding_texts(spark, sf_dir):
    att = line_attachments(spark, sf_dir).withColumn("extracted_text", F.concat("file_extension", F.lit("x")))
    nested = att.groupBy(F.col("email_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "filename", "extracted_text"))).alias("attachments"))
    return order_emails(spark, sf_dir).join(nested, "id", "left").select("id", F.md5(embedding_text("subject", "from_addr", "body_preview", "attachments")).alias("digest"))


FOOT = """coalesce(text, '') || case doc_id % 5 when 0 then chr(10) || '| Unsubscribe here' || chr(10) || 'tail' when 1 then chr(10) || 'LAST' || chr(10) || chr(10) || ' > * [UPDATE YOUR preferences](x)'
  when 2 then chr(10) || 'say unsubscribe now' || chr(10) || '-You are receiving this email because' || chr(10) || 'x' when 3 then chr(10) || chr(9) || 'manage your subscription' else chr(10) || 'no footer: unsubscribe' end"""
MARKERS = "\\n[ \\t\\r\\f\\v>|*\\-]*(?:\\[[ \\t\\r\\f\\v>|*\\-\\[]*)?(?:unsubscribe|update your preferences|you are receiving this email because|manage your subscription)"


@query(
    f"""
with w as (select doc_id, {FOOT} as whole from documents),
h as (select doc_id, whole, regexp_matches(substr(whole, 201), '(?is){MARKERS}') as found, regexp_extract(substr(whole, 201), '(?is)^(.*?){MARKERS}', 1) as head from w)
select doc_id, md5(case when found then regexp_replace(substr(whole, 1, 200) || head, '\\s+$', '') else whole end) as digest from h"""
)
def footer_truncate(spark, sf_dir):
    """All documents, with footers of all four kinds and none, on top of those that they have themselves."""
    d = table(spark, sf_dir, "documents")
    tails = ("\n| Unsubscribe here\ntail", "\nLAST\n\n > * [UPDATE YOUR preferences](x)", "\nsay unsubscribe now\n-You are receiving this email because\nx", "\n\tmanage your subscription", "\nno footer: unsubscribe")
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", F.md5(T.before_footer(F.concat(F.coalesce("text", F.lit("")), tail))).alias("digest"))


@query("select doc_id, md5(trim(regexp_replace(replace(text, ' the ', chr(10) || chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) as digest from documents")
def blank_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeeze_blank(F.replace("text", F.lit(" the "), F.lit("\n\n\n\n")))).alias("digest"))


@query("select page_id, 'see ' || url || ' now' as body from pages")
def redundant_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.redundant_links(F.concat(F.lit("see ["), "url", F.lit("]("), "url", F.lit(") now"))).alias("body"))


@query(
    """
with h as (select page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<style\\b.*?</style>|<script\\b.*?</script>|<head\\b.*?</head>|<noscript\\b.*?</noscript>', '', 'g'), '(?s)<[^>]*>', ' ', 'g') as h from pages),
e as (select page_id, regexp_replace(h, '&(?:#[0-9]+|amp|lt|gt|quot|apos|copy|middot|nbsp);?', ' ', 'g') as h from h)
select page_id, md5(array_to_string(regexp_extract_all(h, '[\\p{L}\\p{N}]+'), ' ')) as words from e"""
)
def html_to_text_pages(spark, sf_dir):
    """The words of whole pages, without the targets of their links."""
    ship_package(spark)

    @F.pandas_udf("string")
    def cleaned(s):
        return s.map(html_to_text)

    words = F.regexp_extract_all(F.regexp_replace("body", r"\]\([^)\s]*\)", "]"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", cleaned("html").alias("body")).select("page_id", F.md5(F.array_join(words, " ")).alias("words"))


@query("select doc_id, (text like '%>%' or lower(text) like '%wrote:%' or lower(text) like '%original message%' or text like '%-----%' or lower(text) like '%' || chr(10) || 'from:%') as markers, length(text) <= 50000 and length(text) - length(replace(text, chr(10), '')) + 1 <= 1500 and (text like '%>%' or lower(text) like '%wrote:%' or lower(text) like '%original message%' or text like '%-----%' or lower(text) like '%' || chr(10) || 'from:%') as strip from documents")
def reply_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.reply_markers("text").alias("markers"), T.quotes_to_strip("text").alias("strip"))


@query(mail("select id, substr(case when id % 3 = 0 then trim(subject || ' doc') else concat_ws(chr(10), nullif(trim(subject), ''), nullif(trim(coalesce(body_preview, '')), '')) end, 1, 1200) as body from order_emails"))
def rerank_texts(spark, sf_dir):
    e = order_emails(spark, sf_dir)
    return e.select("id", T.rerank_text(F.when(F.col("id") % 3 == 0, F.concat("subject", F.lit(" doc "))), "subject", "body_preview").alias("body"))


@query("select l_orderkey, l_linenumber, case when n = 1 then s || '.txt' else s || '-' || cast(n as varchar) || '.txt' end as safe_filename from (select l_orderkey, l_linenumber, regexp_replace(l_returnflag || '-' || l_linestatus, '[^A-Za-z0-9._ -]+', '_', 'g') as s, row_number() over (partition by l_orderkey, l_returnflag, l_linestatus order by l_linenumber) as n from lineitem)")
def staged_file_names(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit("-"), "l_linestatus", F.lit(".txt")).alias("filename"))
    return numbered_names(parts, "l_orderkey", "filename", "l_linenumber").select("l_orderkey", "l_linenumber", "safe_filename")


@query("select page_id, '/x/' || regexp_replace(trim(url), '[^A-Za-z0-9._ -]+', '_', 'g') as path, substr(md5(url), 1, 12) as short_hash, regexp_matches(url, '%40') as coded, replace('a@b.c', '@', '%40') as account from pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/x/"), T.safe_name("url")).alias("path"), T.short_hash("url").alias("short_hash"), F.contains("url", F.lit("%40")).alias("coded"), F.replace(F.lit("a@b.c"), F.lit("@"), F.lit("%40")).alias("account"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M') as shown, cast(epoch(date_trunc('second', ts)) as bigint) as seconds from events")
def display_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.display_date("ts").alias("shown"), F.unix_timestamp("ts").alias("seconds"))


@query(
    """
select event_id, case when event_id % 4 = 1 then null else event_type end as subject, case event_id % 3 when 0 then true when 1 then false end as has_attachments, case when event_id % 2 = 0 then 'pdf' else 'docx' end as attachment_type from events"""
)
def nl_filter_parse(spark, sf_dir):
    subject = F.when(F.col("event_id") % 4 == 1, F.lit("12")).otherwise(F.concat(F.lit('" '), "event_type", F.lit(' "')))
    flag = F.element_at(F.array(*map(F.lit, ('"Yes"', "false", '"maybe"'))), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 2 == 0, '"..PDF"').otherwise('"docx"')
    answer = F.concat(F.lit('Sure: {"subject": '), subject, F.lit(', "has_attachments": '), flag, F.lit(', "attachment_type": '), kind, F.lit("} done"))
    c = coerced_columns("answer")
    return table(spark, sf_dir, "events").select("event_id", answer.alias("answer")).select("event_id", *(c[k].alias(k) for k in ("subject", "has_attachments", "attachment_type")))
