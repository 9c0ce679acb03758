"""Steps whose figures must grow no faster than their input."""

import weakref
from email.headerregistry import ContentTypeHeader

from pyspark.sql import functions as F

from postlake.catalog import QUERIES
from postlake.functions.mime import parse_message
from postlake.operators.likeindex import LikeIndex, like_rows
from postlake.runtime import Scratch
from postlake.schema import ATTACHMENTS, EMAILS, PARSED, VECTORS, conform, empty
from postlake.sources.store import Store


def test_rows_of_a_short_table_are_dealt_to_all_cores(spark, sf):
    for name in ("office_texts", "html_cleaned", "html_failures", "quoted_replies", "parsed_questions"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_headers_of_one_wording_are_parsed_once(monkeypatch):
    own, parsed = ContentTypeHeader.parse, []
    monkeypatch.setattr(ContentTypeHeader, "parse", classmethod(lambda cls, value, kwds: (parsed.append(value), own(value, kwds))[1]))
    lines = ["Subject: s", "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="=once"', "", *(["--=once", "Content-Type: text/plain; charset=utf-8; n=once", "", "body"] * 3), "--=once--", ""]
    for _ in range(2):
        assert parse_message("\r\n".join(lines).encode())["body"] == "body\nbody\nbody"
    assert len(parsed) == 2


def test_postings_of_like_are_of_texts_not_of_rows(spark):
    emails = conform(spark.range(2_000).select("id", F.concat(F.lit("Sender "), (F.col("id") % 3).cast("string")).alias("from_addr"), F.lit("Ann@ex.org").alias("to_addrs")), EMAILS)
    index = LikeIndex.build(emails, empty(spark, ATTACHMENTS), Scratch(spark, "like").path("index"))
    assert spark.read.parquet(f"{index.root}/postings").count() == 3 * 6 + 8
    assert index.candidates("from_addr", "sender") is None and like_rows(index, emails, "from_addr", "R 2").count() == 666


def test_a_long_bucket_is_written_by_several_tasks(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    store = Store(spark, Scratch(spark, "long").path("index"), buckets=1)
    rows = spark.range(0, 4_000, 1, 8).select("id", F.concat(F.lit("/m/"), F.col("id").cast("string")).alias("file_path"), F.sha2(F.col("id").cast("string"), 512).alias("subject")).withColumn("file_hash", F.md5("file_path"))
    spark.conf.set(name, "64k")
    try:
        store.commit(emails=conform(rows, EMAILS))
    finally:
        spark.conf.unset(name)
    assert store.table("emails").count() == 4_000 and len(store.table("emails").inputFiles()) > 1


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_rows_that_stay_are_not_shuffled_by_writes(spark):
    scratch = Scratch(spark, "stays")
    store, n = Store(spark, scratch.path("index"), buckets=1), 40_000  # more than a bitmap has places
    long = F.sha2(F.col("id").cast("string"), 512)
    rows = spark.range(n).select("id", F.concat(F.lit("/m/"), F.col("id").cast("string")).alias("file_path"), F.concat(long, long).alias("subject"), long.alias("from_addr")).withColumn("file_hash", F.md5("file_path"))
    files = rows.select("id", F.col("id").alias("email_id"), F.concat("subject", "subject").alias("filename"))
    before = shuffled(spark)
    store.commit(emails=conform(rows, EMAILS), attachments=conform(files, ATTACHMENTS), vectors=conform(rows.select(F.col("file_hash").alias("id"), F.col("subject").alias("document")), VECTORS))
    whole = shuffled(spark) - before
    gone = scratch.keep(rows.where("id % 10 = 3").select("file_path"), "gone")
    again = scratch.keep(conform(rows.where("id % 10 = 4").select("file_path", F.lit("again").alias("subject")), PARSED), "again")
    before = shuffled(spark)
    store.delete(gone)
    store.upsert(again)
    assert shuffled(spark) - before < 0.2 * whole
    left = [i for i in range(n) if i % 10 != 3]
    emails = store.table("emails").select("id", "file_path", "subject").collect()
    assert sorted(r["id"] for r in emails) == left and all(r["file_path"] == f"/m/{r['id']}" and (r["subject"] == "again") == (r["id"] % 10 == 4) for r in emails)
    assert sorted(r["id"] for r in store.table("attachments").select("id").collect()) == [i for i in left if i % 10 != 4]
    assert store.table("vectors").count() == len(left)


def test_bitmaps_too_long_to_broadcast_are_joined_by_a_shuffle(spark, monkeypatch):
    from postlake.sources import store as module

    monkeypatch.setattr(module, "BROADCAST", 0)
    scratch = Scratch(spark, "shuffled")
    store = Store(spark, scratch.path("index"), buckets=2)
    rows = spark.range(1_000).select("id", F.concat(F.lit("/m/"), F.col("id").cast("string")).alias("file_path")).withColumn("file_hash", F.md5("file_path"))
    store.commit(emails=conform(rows, EMAILS), attachments=conform(rows.select("id", F.col("id").alias("email_id")), ATTACHMENTS))
    store.delete(scratch.keep(rows.where("id % 3 = 0").select("file_path"), "gone"))
    for name in ("emails", "attachments"):
        assert sorted(r[0] for r in store.table(name).select("id").collect()) == [i for i in range(1_000) if i % 3]


def test_messages_replaced_as_a_whole_take_their_attachments_along(spark):
    store = Store(spark, Scratch(spark, "whole").path("index"), buckets=2)
    rows = spark.range(6).select("id", F.concat(F.lit("/m/"), F.col("id").cast("string")).alias("file_path")).withColumn("file_hash", F.md5("file_path"))
    store.commit(emails=conform(rows, EMAILS), attachments=conform(rows.select("id", F.col("id").alias("email_id")), ATTACHMENTS))
    store.commit(emails=conform(rows.where("id < 4"), EMAILS))
    assert sorted(r[0] for r in store.table("attachments").select("email_id").collect()) == [0, 1, 2, 3]
    assert store.manifest()["next"] == {"emails": 5, "attachments": 5}


def test_a_flat_folder_is_never_held_as_a_whole(tmp_path, monkeypatch):
    from postlake.sources import places

    for i in range(100):
        (tmp_path / f"{i}.eml").write_text("")
    monkeypatch.setattr(places, "ROWS", 10)
    pieces = places.planned(str(tmp_path), share=1)
    assert len(pieces) == places.SHARES  # each task reads all names, so their number is bounded
    rows = [r for p in pieces for r in places.walked(str(tmp_path), p)]
    assert sum(map(len, rows)) == len({n for r in rows for n, *_ in r}) == 100
    assert max(map(len, places.walked(str(tmp_path), (str(tmp_path), False, 0, 1)))) == 10


def test_files_are_read_and_parsed_by_one_python_worker_a_task(spark, tmp_path):
    from postlake.sources.mailfiles import list_messages, parse_messages, parse_paths, read_paths

    for i in range(3):
        (tmp_path / f"{i}.eml").write_bytes(f"Subject: s{i}\r\n\r\nbody".encode())
    found = Scratch(spark, "read").keep(list_messages(spark, str(tmp_path)).unionByName(spark.createDataFrame([(str(tmp_path / "none.eml"), 0.0, 9)], "file_path string, file_mtime double, file_size long")), "files")
    rows = parse_paths(spark, found)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["subject"] for r in rows.collect()) == ["s0", "s1", "s2"] == sorted(r["subject"] for r in parse_messages(read_paths(spark, found)).collect())


def test_tables_of_the_driver_need_no_python_workers(spark, tmp_path):
    from postlake.sources.mailfiles import list_messages

    (tmp_path / "1.eml").write_text("")
    store = Store(spark, Scratch(spark, "given").path("index"), buckets=1)
    for rows in (store.table("emails"), empty(spark, VECTORS), store.figures(), list_messages(spark, str(tmp_path))):
        assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()


def test_tables_of_the_driver_are_what_lists_make(spark, tmp_path):
    from postlake.runtime import given

    schema = "s string, n long, i int, x double, b binary, v array<double>, t boolean"
    rows = [("a", 1, 2, 2.5, bytearray(b"xy"), [1.0, 2.0], True), (None,) * 7]
    for some in (rows, []):
        ours, listed = given(spark, some, schema), spark.createDataFrame(some, schema)
        assert ours.schema == listed.schema and ours.collect() == listed.collect()
    for kept in (EMAILS, ATTACHMENTS, VECTORS):
        assert empty(spark, kept).schema == kept and empty(spark, kept)._jdf.schema().json() == spark.createDataFrame([], kept)._jdf.schema().json()
    given(spark, [], VECTORS).write.parquet(str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).columns == VECTORS.names


def test_vectors_of_one_call_at_a_time_are_held_as_objects(spark):
    from postlake.operators.search import embed_column

    class Vector(list):
        pass

    made = []

    def embed(texts):
        out = [Vector([float(sum(v() is not None for v in made)), float(len(t))]) for t in texts]
        made.extend(map(weakref.ref, out))
        return out

    rows = embed_column(spark.range(0, 500, 1, 1).select("id", F.when(F.col("id") > 0, F.col("id").cast("string")).alias("t")), "t", embed, batch=16).collect()
    assert [(r["id"], r["embedding"][1]) for r in rows] == [(i, float(len(str(i)) if i else 0)) for i in range(500)]
    assert {r["embedding"][0] for r in rows} == {0.0}
