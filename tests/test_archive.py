"""Messages on disk through parsing, indexing, searching and upkeep."""

import io
import json
import os
import subprocess
import sys
import zipfile
import zlib
from datetime import UTC, datetime, timedelta
from email.message import EmailMessage

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.functions.attachments import attachment_text
from postlake.functions.mime import parse_message
from postlake.operators import listing, maintain, search, staging, vectorindex
from postlake.params import Filters
from postlake.schema import EXTRACTION_VERSION
from postlake.sources.mailfiles import count_messages, inside, list_messages
from postlake.sources.store import LockedError, Store
from postlake.streaming.ingest import Ingest


def mail(subject="Hello", body="Plain body", html=None, mid="<1@x>", sender="ann@ex.org", date="Mon, 06 May 2024 10:00:00 +0200", attachments=()):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = subject, sender, "bob@ex.org", date
    if mid:
        m["Message-ID"] = mid
    if body is not None:
        m.set_content(body)
    if html is not None:
        m.add_alternative(html, subtype="html") if body is not None else m.set_content(html, subtype="html")
    for name, kind, data in attachments:
        main, _, sub = kind.partition("/")
        m.add_attachment(data, maintype=main, subtype=sub, filename=name)
    return m.as_bytes()


@pytest.fixture
def archive(tmp_path):
    box = tmp_path / "mail" / "ann%40ex.org" / "INBOX.mailbox" / "Messages"
    box.mkdir(parents=True)
    (box / "1.eml").write_bytes(mail("Budget plan", "The budget for May", mid="<1@x>", attachments=[("plan.txt", "text/plain", b"quarter numbers"), ("../odd name;.pdf", "application/pdf", b"%PDF"), ("plan.txt", "text/plain", b"again")]))
    (box / "2.eml").write_bytes(mail("Lunch", "Pizza or pasta", mid="<2@x>", sender="carl@ex.org", date="Tue, 07 May 2024 10:00:00 +0000"))
    (box / "3.eml").write_bytes(mail("Empty id", "no id", mid=None, date="not a date"))
    (box / "note.txt").write_text("no message")
    return tmp_path / "mail"


@pytest.fixture
def ingest(spark, tmp_path):
    return Ingest(Store(spark, tmp_path / "index"))


def table(ingest, name):
    return ingest.store.table(name)


def test_listing_reads_no_contents(spark, archive):
    files = list_messages(spark, str(archive))
    assert count_messages(spark, str(archive)) == 3 and "content" not in files.columns
    assert files.where(inside(str(archive))).count() == 3
    assert files.where(inside(str(archive)[:-1])).count() == 0
    old = archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages" / "1.eml"
    os.utime(old, (1, 1))
    assert count_messages(spark, str(archive), datetime(2000, 1, 1)) == 2


def test_index_fields(ingest, archive):
    run = ingest.index(str(archive))
    assert (run.candidates, run.indexed, run.failed) == (3, 3, 0)
    rows = {r["subject"]: r for r in table(ingest, "emails").collect()}
    one = rows["Budget plan"]
    assert one["message_id"] == "<1@x>" and one["date"] == datetime(2024, 5, 6, 8) and one["attachment_count"] == 3 and one["has_attachments"]
    assert rows["Empty id"]["message_id"] is None and rows["Empty id"]["date"] is None
    assert one["extraction_version"] == EXTRACTION_VERSION and sorted(r["id"] for r in rows.values()) == [1, 2, 3]
    att = table(ingest, "attachments").where(F.col("email_id") == one["id"]).orderBy("id").collect()
    assert [a["file_extension"] for a in att] == ["txt", "pdf", "txt"] and att[0]["size"] == 15
    v = table(ingest, "vectors").where(F.col("id") == one["file_hash"]).first()
    assert "quarter numbers" in v["document"] and v["attachment_types"] == "txt,pdf" and len(v["embedding"]) == 64


def test_second_run_reads_nothing_and_changes_keep_ids(ingest, archive):
    ingest.index(str(archive))
    before = {r["file_path"]: r["id"] for r in table(ingest, "emails").collect()}
    assert ingest.index(str(archive)).candidates == 0
    path = next(p for p in before if p.endswith("/2.eml"))
    open(path, "wb").write(mail("Dinner", "Soup", mid=None))
    os.utime(path, (2e9, 2e9))
    run = ingest.index(str(archive))
    assert run.candidates == run.indexed == 1
    row = listing.by_path(table(ingest, "emails"), path).first()
    assert row["id"] == before[path] and row["subject"] == "Dinner" and row["message_id"] is None
    assert table(ingest, "vectors").count() == 3


def test_moved_message_replaces_its_old_path(ingest, archive):
    ingest.index(str(archive))
    box = archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages"
    (archive / "old").mkdir()
    (box / "2.eml").rename(archive / "old" / "2.eml")
    assert ingest.index_file(str(archive / "old" / "2.eml"))["status"] == "moved"
    assert table(ingest, "emails").where("message_id = '<2@x>'").count() == 1
    assert ingest.index_file(str(archive / "old" / "2.eml"))["status"] == "skipped"
    assert ingest.index_file(str(archive / "gone.eml"))["status"] == "not_found"


def test_two_live_copies_of_a_message_both_stay(ingest, archive):
    ingest.index(str(archive))
    box = archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages"
    (archive / "all").mkdir()
    (archive / "all" / "2.eml").write_bytes((box / "2.eml").read_bytes())
    assert ingest.index_file(str(archive / "all" / "2.eml"))["status"] == "indexed"
    assert table(ingest, "emails").where("message_id = '<2@x>'").count() == 2
    (box / "2.eml").unlink()
    (archive / "all" / "2.eml").rename(archive / "2.eml")
    assert ingest.index_file(str(archive / "2.eml"))["status"] == "moved"
    assert [r["file_path"] for r in table(ingest, "emails").where("message_id = '<2@x>'").collect()] == [str(archive / "2.eml")]


def test_prune_and_its_refusals(ingest, archive, tmp_path):
    ingest.index(str(archive))
    (archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages" / "1.eml").unlink()
    assert ingest.prune(str(archive), dry_run=True) == {"missing": 1, "removed": 0}
    assert ingest.prune(str(archive)) == {"missing": 1, "removed": 1}
    assert ingest.prune(str(archive)) == {"missing": 0, "removed": 0}
    assert table(ingest, "attachments").count() == 0 and table(ingest, "vectors").count() == 2
    (tmp_path / "empty").mkdir()
    for bad in (tmp_path / "empty", tmp_path / "missing"):
        with pytest.raises(ValueError):
            ingest.prune(str(bad))
    assert table(ingest, "emails").count() == 2


def test_prune_keeps_files_outside_the_folder(ingest, archive, tmp_path):
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "9.eml").write_bytes(mail("Elsewhere", mid="<9@x>"))
    ingest.index(str(archive))
    assert ingest.index_file(str(tmp_path / "else" / "9.eml"))["status"] == "indexed"
    assert ingest.prune(str(archive)) == {"missing": 0, "removed": 0}
    (tmp_path / "else" / "9.eml").unlink()
    assert ingest.prune(str(archive)) == {"missing": 1, "removed": 1}


def test_one_message_again(ingest, archive):
    ingest.index(str(archive))
    path = listing.by_message_id(table(ingest, "emails"), "2@x").first()["file_path"]
    ingest.store.commit(emails=table(ingest, "emails").withColumn("extraction_version", F.lit(1)))
    open(path, "wb").write(mail("Lunch", "Soup today", mid="<2@x>"))
    out = ingest.reextract_one(message_id="<2@x>")
    assert out["status"] == "ok" and out["version"] == [1, EXTRACTION_VERSION] and "Pizza" in out["before"] and "Soup" in out["after"]
    assert ingest.reextract_one(file_path="/nowhere")["status"] == "not_indexed"
    os.unlink(path)
    assert ingest.reextract_one(message_id="2@x")["status"] == "missing_file"
    with pytest.raises(ValueError):
        ingest.reextract_one()


def test_heartbeat(ingest, archive, tmp_path, spark):
    from postlake.streaming.ingest import Heartbeat

    beat = Heartbeat()
    spark.streams.addListener(beat)
    try:
        ingest.stream(str(archive), str(tmp_path / "cp")).awaitTermination(120)
    finally:
        spark.streams.removeListener(beat)
    assert beat.stalled() == []
    beat._seen("q", 3)
    assert beat.stalled(-1) == [*beat.progress]


def test_dedup_keeps_the_newest(ingest, archive):
    box = archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages"
    (box / "4.eml").write_bytes(mail("Copy", mid="<1@x>"))
    (box / "5.eml").write_bytes(mail("No id either", mid=None))
    ingest.index(str(archive))
    assert maintain.duplicate_counts(table(ingest, "emails")).first().asDict() == {"groups": 1, "surplus": 1}
    assert ingest.dedup() == {"removed": 1, "groups": 1}
    assert ingest.dedup() == {"removed": 0, "groups": 0}
    assert table(ingest, "emails").count() == 4 and table(ingest, "vectors").count() == 4


def test_migration_keeps_embeddings_and_is_idempotent(ingest, archive):
    ingest.index(str(archive))
    old = {r["message_id"]: r["embedding"] for r in table(ingest, "vectors").collect()}
    assert ingest.migrate(str(archive), "/new/mail")["moved"] == 3
    assert ingest.migrate(str(archive), "/new/mail")["moved"] == 0
    rows = table(ingest, "vectors").collect()
    assert all(r["file_path"].startswith("/new/mail/") for r in rows) and {r["message_id"]: r["embedding"] for r in rows} == old
    assert table(ingest, "emails").join(table(ingest, "vectors").select(F.col("id").alias("file_hash")), "file_hash").count() == 3
    assert table(ingest, "attachments").count() == 3


def test_reextract_only_what_is_stale(ingest, archive):
    ingest.index(str(archive))
    ingest.store.commit(emails=table(ingest, "emails").withColumn("extraction_version", F.when(F.col("id") == 1, 1).otherwise(F.col("extraction_version"))))
    assert ingest.reextract()["ok"] == 1
    assert ingest.reextract()["stale"] == 0


def test_stream_indexes_each_file_once(ingest, archive, tmp_path):
    for _ in range(2):
        ingest.stream(str(archive), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert table(ingest, "emails").count() == 3
    (archive / "6.eml").write_bytes(mail("Late", mid="<6@x>"))
    ingest.stream(str(archive), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert table(ingest, "emails").count() == 4


def test_search_end_to_end(ingest, archive):
    ingest.index(str(archive))
    q = search.hashing_embedder(["budget plan quarter numbers"])[0]
    args = (table(ingest, "emails"), table(ingest, "attachments"), table(ingest, "vectors"), q)
    best = search.hybrid_search(*args, limit=2).collect()
    assert best[0]["subject"] == "Budget plan" and len(best) == 2 and best[0]["similarity"] > best[1]["similarity"]
    assert [r["subject"] for r in search.hybrid_search(*args, Filters(from_addr="CARL"), limit=5).collect()] == ["Lunch"]
    assert [r["subject"] for r in search.hybrid_search(*args, Filters(attachment_type=".PDF"), mode="postfilter").collect()] == ["Budget plan"]
    reranked = search.hybrid_search(*args, limit=3, query="pasta pizza", scorer=search.word_overlap).collect()
    assert reranked[0]["subject"] == "Lunch" and reranked[0]["rerank_score"] == 1.0


def test_nearest_equals_brute_force(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("id", F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    rows = v.collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.array(rows[3]["embedding"], np.float64)
    want = np.argsort(1 - x @ (q / np.linalg.norm(q)), kind="stable")[:25]
    assert [r["vec_id"] for r in search.nearest(v, q, 25).collect()] == [rows[i]["vec_id"] for i in want]


def test_many_queries_equal_one_by_one(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("id", F.col("vec_id"))
    queries = v.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in search.nearest_many(v, queries, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for r in queries.collect():
        assert got[r["query_id"]] == [x["vec_id"] for x in search.nearest(v, r["query_vector"], 8).collect()]
    assert search.nearest_many(v, queries.limit(0), 8).collect() == []


def test_embedding_texts_of_all_messages(spark, sf):
    from hashlib import md5

    from postlake.catalog import QUERIES
    from postlake.plans.mapping import line_attachments, order_emails

    parts = {}
    for a in sorted(line_attachments(spark, sf).collect(), key=lambda a: (a["id"], a["filename"])):
        parts.setdefault(a["email_id"], []).extend([a["filename"], a["file_extension"] + "x"])
    want = {}
    for e in order_emails(spark, sf).collect():
        lines = [e["subject"], e["from_addr"], e["body_preview"] or "", *(["Attachments:", *parts[e["id"]]] if e["id"] in parts else [])]
        want[e["id"]] = md5("\n".join(lines).strip().encode()).hexdigest()
    assert min(e["date"].year for e in order_emails(spark, sf).select("date").collect()) < 1998
    got = QUERIES["embedding_texts"](spark, sf).collect()
    assert len(got) == len(want) and {r["id"]: r["digest"] for r in got} == want


def test_footers_in_both_forms(spark):
    from postlake.functions.html import footer_cut
    from postlake.functions.text import before_footer

    body = "a" * 150 + "\n" + "b" * 150
    tails = ["", "\nUnsubscribe\nmore", "\nLAST\n\n > * [manage your SUBSCRIPTION](x)\nz", "\nsay unsubscribe here\nUpdate your preferences now", "\n| You are receiving this email because\n", "\n\n\n-unsubscribed"]
    texts = [body + t for t in tails] + ["Unsubscribe\n" + body, "x\nUnsubscribe\n" + body + "\nUnsubscribe again", "short\nunsubscribe", "c" * 200 + "\nunsubscribe", "c" * 199 + "\nunsubscribe", "é" * 220 + "\nunsubscribe", "", None]
    want = [body, body, body + "\nLAST", body + "\nsay unsubscribe here", body, body, texts[6], "x\nUnsubscribe\n" + body, texts[8], "c" * 200, texts[10], "é" * 220, "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", before_footer("t").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == want and [footer_cut(t) for t in texts[:-1]] == want[:-1]


def test_every_hundredth_vector_is_a_query(spark, sf):
    from postlake.catalog import QUERIES

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.md5(F.concat(F.lit("/docs/"), "vec_id", F.lit(".eml"))).alias("id")).orderBy("id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i, r in enumerate(rows):
        if r["vec_id"] % 100 == 0:
            near = np.argsort(np.round(1 - x @ x[i], 12), kind="stable")[:10]
            want |= {(r["vec_id"], n, rows[j]["vec_id"]) for n, j in enumerate(near, 1)}
    assert {(r["label"], r["rank"], r["vec_id"]) for r in QUERIES["knn_many"](spark, sf).collect()} == want


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(f"{i:03}", rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(f"{i:03}", rows[i % 2][1]) for i in range(60, 90)] + [("zero", [0.0] * 8), ("null", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    queries = v.where("id < '030' or id = 'null'").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in search.nearest_many(v, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    vectors = dict(rows)
    assert len(got) == 30
    for i, found in got.items():
        cosine = lambda y, q=vectors[i]: np.dot(q, y) / np.linalg.norm(q) / np.linalg.norm(y)
        assert found == sorted((n for n, y in rows[:90]), key=lambda n: (round(1 - cosine(vectors[n]), 12), n))[:5]


def test_more_queries_than_10_000(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<double>")
    queries = spark.range(10_050).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("query_vector"))
    found = search.nearest_many(v, queries, 1)
    assert found.count() == 10_050 and found.where("id <> query_id % 2 + 1").isEmpty()


@pytest.mark.parametrize("filters", [None, Filters(subject="s")])
def test_many_copies_of_one_message_leave_room_for_others(spark, filters):
    from postlake.schema import ATTACHMENTS, EMAILS, conform, empty

    # 300 copies lie nearest, then 30 other messages, every fifth without an id
    ids = ["copy"] * 300 + ["" if i % 5 == 0 else f"m{i}" for i in range(30)]
    rows = [(i, m, f"/m/{i:03}", f"{i:03}", "s", "text") for i, m in enumerate(ids)]
    emails = conform(spark.createDataFrame(rows, "id long, message_id string, file_path string, file_hash string, subject string, body_preview string"), EMAILS)
    # and 4 vectors without a message, of which two have one id
    own = [None] * len(ids) + ["x", "x", "", None]
    rows = [(f"{i:03}", [1.0, 0.001 * i], m) for i, m in enumerate(own)]
    args = (emails, empty(spark, ATTACHMENTS), spark.createDataFrame(rows, "id string, embedding array<double>, message_id string"), [1.0, 0.0], filters)
    want = ["000", *(f"{i:03}" for i in range(300, 331)), "332", "333"]
    if filters:
        want = want[:31]
    for limit in (20, 40):
        assert [r["vector_id"] for r in search.hybrid_search(*args, limit=limit).collect()] == want[:limit]
    assert len(search.hybrid_search(*args, limit=20, query="text", scorer=search.word_overlap).collect()) == 20
    assert len(search.hybrid_search(*args, limit=20, mode="postfilter").collect()) == 1


def test_buckets_keep_near_vectors_together(spark, sf):
    v = search.with_buckets(spark.read.parquet(f"{sf}/embeddings.parquet"), planes=4)
    assert 8 < v.select("bucket").distinct().count() <= 16
    twice = v.withColumn("embedding", F.transform("embedding", lambda x: x * 2)).drop("bucket")
    assert search.with_buckets(twice, planes=4).join(v.select("vec_id", F.col("bucket").alias("b")), "vec_id").where("bucket <> b").isEmpty()


def test_stream_drops_repeats_within_the_allowance(spark, sf, tmp_path):
    from postlake.streaming.ingest import dedup_stream

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(200)
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = dedup_stream(stream, ["event_id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_models():
    full = {"BGE-base-en-v1.5": "BAAI/bge-base-en-v1.5", "BGE-small-en-v1.5": "BAAI/bge-small-en-v1.5", "nomic-embed-text-v1": "nomic-ai/nomic-embed-text-v1", "all-MiniLM-L6-v2": "sentence-transformers/all-MiniLM-L6-v2"}
    assert {n: search.resolve_model(n) for n in full} == full and search.resolve_model("my/model") == "my/model"
    calls = []

    def load(name, **options):
        calls.append(options)
        if options:
            raise OSError("not cached")
        return name

    assert search.load_local_first("m", load) == "m" and calls == [{"local_files_only": True}, {}]
    with pytest.raises(ZeroDivisionError):
        search.load_local_first("m", lambda *a, **k: 1 / 0)


def test_best_per_message_keeps_place_and_distance(spark):
    rows = [(1, "a", 0.3), (2, "b", 0.4), (3, "a", 0.2), (4, "", 0.5), (5, None, 0.6), (6, "b", None), (7, "c", None), (8, "c", 1.0)]
    got = maintain.best_per_message(spark.createDataFrame([(*r, r[0]) for r in rows], "rank int, message_id string, distance double, n int")).orderBy("rank").collect()
    assert [(r["rank"], r["n"]) for r in got] == [(1, 3), (2, 2), (4, 4), (5, 5), (7, 7)]


def test_staging(ingest, archive, tmp_path):
    ingest.index(str(archive))
    emails, root = table(ingest, "emails"), tmp_path / "staged"
    out = staging.stage_message(emails, root, message_id="1@x")
    assert out["status"] == "ok" and [a["filename"] for a in out["attachments"]] == ["plan.txt", "../odd name;.pdf", "plan.txt"]
    names = sorted(p.name for p in (root / os.path.basename(out["staged_dir"]) / "attachments").iterdir())
    assert names == [".._odd name_.pdf", "plan-2.txt", "plan.txt"]
    assert staging.stage_message(emails, root, file_path="/nowhere.eml")["status"] == "not_indexed"
    os.unlink(out["file_path"])
    assert staging.stage_message(emails, root, message_id="<1@x>")["status"] == "source_missing"
    for bad in ("../..", ".", "../mail"):
        with pytest.raises(ValueError):
            staging.clear_staged(root, bad)
    assert staging.clear_staged(root, "unknown")["removed"] == 0
    assert staging.clear_staged(root)["removed"] == 1
    with pytest.raises(ValueError):
        staging.stage_message(emails, root)


def test_lock(spark, tmp_path):
    store = Store(spark, tmp_path / "i")
    assert store.acquire("index", pid=os.getppid()) is None and store.acquire("prune")["kind"] == "index"
    with pytest.raises(LockedError), store.locked("prune"):
        pass
    assert not store.release() and store.release(pid=os.getppid()) and store.lock_holder() is None
    gone = subprocess.Popen([sys.executable, "-c", ""])
    gone.wait()
    assert store.acquire("old", pid=gone.pid) is None
    assert store.acquire("new") is None and store.lock_holder()["kind"] == "new"
    (tmp_path / "i" / "writer.lock").write_text("{broken")
    assert store.acquire("again") is None and store.release()


def test_a_process_may_take_its_own_lock_again(spark, tmp_path):
    store = Store(spark, tmp_path / "i")
    assert store.acquire("index") is None and store.acquire("backfill") is None and store.lock_holder()["kind"] == "backfill"
    assert store.release() and not store.release()
    with store.locked("outer"):
        with store.locked("inner"):
            assert store.lock_holder()["kind"] == "outer"
        assert store.lock_holder()["kind"] == "outer"
    assert store.lock_holder() is None


def folders(store):
    return {name: dict(parts) for name, parts in store.manifest()["tables"].items()}


def test_scratch_folders_of_killed_drivers_are_swept(spark):
    from postlake.runtime import Files, Scratch, shared_dir, sweep

    live = Scratch(spark, "live")
    live.keep(spark.range(3), "rows")
    files = Files(spark, shared_dir(spark))
    files.create("keep-me/x", "mine")
    name = live.root.rpartition("/")[2]
    assert sweep(spark) == 0 and name in files.entries()
    old = shared_dir(spark).removeprefix("file://") + "/" + name
    os.utime(old, (1e9, 1e9))
    assert sweep(spark) == 1 and name not in files.entries() and "keep-me" in files.entries()


def test_one_message_rewrites_only_its_bucket(ingest, archive):
    ingest.index(str(archive))
    before = folders(ingest.store)
    assert len(before["emails"]) > 1
    path = str(archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages" / "1.eml")
    open(path, "wb").write(mail("Budget again", "More", mid="<1@x>", attachments=[("new.txt", "text/plain", b"x")]))
    os.utime(path, (2e9, 2e9))
    assert ingest.index_file(path)["status"] == "indexed"
    after = folders(ingest.store)
    changed = {b for name in before for b in before[name].keys() | after[name].keys() if before[name].get(b) != after[name].get(b)}
    assert len(changed) == 1
    rows = {r["subject"]: r["id"] for r in table(ingest, "emails").collect()}
    assert sorted(rows) == ["Budget again", "Empty id", "Lunch"] and len(set(rows.values())) == 3
    assert [(a["email_id"], a["filename"]) for a in table(ingest, "attachments").collect()] == [(rows["Budget again"], "new.txt")]
    assert [r["subject"] for r in ingest.store.table("emails", [path]).where(F.col("file_path") == path).collect()] == ["Budget again"]


def test_vacuum_and_other_buckets(ingest, archive):
    ingest.index(str(archive))
    rows = sorted(table(ingest, "emails").drop("indexed_at").collect(), key=lambda r: r["id"])
    files = sorted(tuple(r) for r in table(ingest, "attachments").collect())
    ingest.store.rebucket(2)
    assert set(folders(ingest.store)["emails"]) <= {"0", "1"}
    assert sorted(table(ingest, "emails").drop("indexed_at").collect(), key=lambda r: r["id"]) == rows
    assert sorted(tuple(r) for r in table(ingest, "attachments").collect()) == files
    assert ingest.vacuum()["removed"] == 0  # too young
    assert ingest.vacuum(hours=-1)["removed"] == 6 and ingest.vacuum(hours=-1)["removed"] == 0
    assert sorted(tuple(r) for r in table(ingest, "attachments").collect()) == files and table(ingest, "vectors").count() == 3


def test_more_than_4096_attachments_of_a_message_have_ids_of_their_own(spark, tmp_path):
    from postlake.schema import ATTACHMENTS, EMAILS, PARSED, conform, empty
    from postlake.sources.store import upsert_messages

    some = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("filename"), F.lit("t").alias("content_type"), F.lit("attachment").alias("content_disposition"), i.cast("long").alias("size"), F.lit(None).cast("string").alias("extracted_text")))
    parsed = conform(spark.createDataFrame([("/a",), ("/b",)], "file_path string").withColumn("attachments", some), PARSED)
    _, attachments, (n, k) = upsert_messages(empty(spark, EMAILS), empty(spark, ATTACHMENTS), parsed)
    rows = attachments.orderBy("id").collect()
    assert (n, k) == (2, 10_000) and [r["id"] for r in rows] == list(range(1, 10_001))
    assert [(r["email_id"], r["size"]) for r in rows] == [(e, i) for e in (1, 2) for i in range(1, 5001)]


def test_batches_are_versions_of_their_own(spark, archive, tmp_path):
    from dataclasses import replace

    from postlake.params import SETTINGS

    box = archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages"
    for i in range(20):
        (box / f"n{i}.eml").write_bytes(mail(f"Note {i}", f"text {i}", mid=f"<n{i}@x>"))
    seen = []
    ingest = Ingest(Store(spark, tmp_path / "index"), s=replace(SETTINGS, batch_messages=6, bucket_messages=1), report=lambda r: seen.append((r.batches, r.indexed)))
    calls = []

    def failing(files):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("a disk is full")
        return Ingest.write(ingest, files)

    ingest.write = failing
    run = ingest.index(str(archive))
    assert (run.candidates, run.batches, run.batch_errors, run.watermark) == (23, 4, 1, None) and 0 < run.indexed < 23 and run.rate > 0
    assert table(ingest, "emails").count() == run.indexed and [b for b, _ in seen] == [1, 2, 3, 4]
    del ingest.write
    again = ingest.index(str(archive))
    assert again.candidates == 23 - run.indexed and again.batch_errors == 0 and again.watermark
    ids = sorted(r["id"] for r in table(ingest, "emails").select("id").collect())
    assert ids == list(range(1, 24)) and ingest.store.manifest()["buckets"] == 64


def test_reextraction_goes_on_where_it_was_stopped(spark, archive, tmp_path):
    from dataclasses import replace

    from postlake.params import SETTINGS

    for i in range(12):
        (archive / f"n{i}.eml").write_bytes(mail(f"Note {i}", mid=f"<n{i}@x>"))
    ingest = Ingest(Store(spark, tmp_path / "index"))
    ingest.index(str(archive))
    ingest.store.commit(emails=table(ingest, "emails").withColumn("extraction_version", F.lit(1)))
    ingest.s = replace(SETTINGS, batch_messages=5)
    done = []

    def stopping(files):
        if done:
            raise KeyboardInterrupt
        run = Ingest.write(ingest, files)
        done.extend([1] * run.indexed)
        return run

    ingest.write = stopping
    with pytest.raises(KeyboardInterrupt):
        ingest.reextract()
    del ingest.write
    assert ingest.store.lock_holder() is None
    (archive / "ann%40ex.org" / "INBOX.mailbox" / "Messages" / "3.eml").unlink()
    out = ingest.reextract()
    assert out["stale"] == 15 - len(done) < 15 and out["ok"] + out["missing"] == out["stale"] and out["batch_errors"] == 0
    assert listing.stale(table(ingest, "emails")).count() == out["missing"]


def test_a_run_without_progress_says_where_it_is(spark):
    import time

    from postlake.streaming.ingest import StallWatch

    out = io.StringIO()
    with StallWatch(spark, 0.2, out) as watch:
        watch.mark("writing batch 7")
        time.sleep(1.0)
    assert watch.dumps >= 1 and "writing batch 7" in out.getvalue() and "test_a_run_without_progress" in out.getvalue()


def test_listing_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    from postlake.sources import mailfiles, places

    want = set()
    for i in range(5):
        for j in range(3):
            folder = tmp_path / "m" / f"a{i}" / f"b {j}" / "deep"
            folder.mkdir(parents=True)
            for p in (folder / "x.eml", folder.parent / f"{j}.eml"):
                p.write_text("x" * j)
                want.add((str(p), p.stat().st_size, p.stat().st_mtime_ns // 10**6 / 1000))
    (tmp_path / "m" / ".hidden").mkdir()
    (tmp_path / "m" / ".hidden" / "no.eml").write_text("")
    planned = places.planned
    for spread, share in ((1, 1), (4, 1), (256, 1), (256, 5_000)):
        monkeypatch.setattr(mailfiles, "planned", lambda d, spread=spread, share=share: planned(d, spread, share))
        assert {(r["file_path"], r["file_size"], r["file_mtime"]) for r in list_messages(spark, str(tmp_path / "m")).collect()} == want
    assert list_messages(spark, f"file://{tmp_path}/m").count() == len(want) and list_messages(spark, str(tmp_path / "none")).isEmpty()


def test_state_and_watermark(spark, tmp_path):
    store = Store(spark, tmp_path / "i")
    assert store.watermark() is None
    now = datetime(2024, 5, 1, tzinfo=UTC)
    store.set_state("scan_watermark", now.isoformat())
    assert store.watermark() == now
    (tmp_path / "i" / "state.json").write_text("broken")
    assert store.state() == {}


def test_a_failed_write_leaves_the_index_as_it_was(ingest, archive):
    ingest.index(str(archive))
    before = ingest.store.files.text("manifest.json")
    bad = table(ingest, "emails").withColumn("subject", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        ingest.store.commit(attachments=table(ingest, "attachments").limit(0), emails=bad)
    assert ingest.store.files.text("manifest.json") == before and table(ingest, "attachments").count() == 3


def test_body_choice():
    body = lambda **k: parse_message(mail(**k))["body"]
    assert body(body="plain") .strip() == "plain"
    assert "Total due 12.50 by May 30 please" in body(body="see html", html="<p>Total due <b>12.50</b> by May 30 please</p>")
    assert body(body="the plain one", html="<p>tiny</p>").strip() == "the plain one"
    assert body(body=None, html="<p>tiny</p>") == "tiny"
    assert body(body="the plain one", html="<style>x</style>").strip() == "the plain one"


def test_odd_messages():
    assert parse_message(b"")["parse_error"] is None
    r = parse_message(b"Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nContent-Type: text/plain; charset=nope\r\n\r\nhi \xff")
    assert r["subject"] == "Grüße" and r["body"].startswith("hi")
    assert parse_message(b"Date: x\r\n\r\n")["date"] is None
    for raw, ahead in (("+0200", 120), ("-0330", -210), ("GMT", 0), ("-0000", None), ("", None)):
        d = parse_message(f"Date: Mon, 06 May 2024 10:00:00 {raw}\r\n\r\n".encode())
        assert d["date_offset"] == ahead and d["date"] == datetime(2024, 5, 6, 10, tzinfo=UTC) - timedelta(minutes=ahead or 0)


def ooxml(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_rels_", "_rels/"), text)
    return out.getvalue()


def test_attachment_kinds():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{p('One')}{p(' ')}{p('Two')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    assert attachment_text(out.getvalue(), "", "x.DOCX") == "One\nTwo\na | b"
    s, r, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{s}' xmlns:r='{r}'><sheets><sheet name='Sums' r:id='r1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships xmlns='{rel}'><Relationship Id='r1' Type='{r}/worksheet' Target='worksheets/s1.xml'/></Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{s}'><si><t>Item</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet xmlns='{s}'><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>5</v></c></row></sheetData></worksheet>")
    assert attachment_text(out.getvalue(), "", "x.xlsx") == "Sheet: Sums\nItem |  | 5"
    a, pm = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = lambda t, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = f"xmlns:p='{pm}' xmlns:a='{a}' xmlns:r='{r}'"
        z.writestr("ppt/presentation.xml", f"<p:presentation {ns}><p:sldIdLst><p:sldId r:id='r1'/></p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", f"<Relationships xmlns='{rel}'><Relationship Id='r1' Type='{r}/slide' Target='slides/slide1.xml'/></Relationships>")
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {ns}>{shape('Title')}</p:sld>")
        z.writestr("ppt/slides/_rels/slide1.xml.rels", f"<Relationships xmlns='{rel}'><Relationship Id='n' Type='{r}/notesSlide' Target='../notesSlides/n1.xml'/></Relationships>")
        z.writestr("ppt/notesSlides/n1.xml", f"<p:notes {ns}>{shape('Say it', '<p:ph type=' + chr(39) + 'body' + chr(39) + '/>')}</p:notes>")
    assert attachment_text(out.getvalue(), "", "x.pptx") == "Slide 1:\nTitle\nNotes: Say it"
    assert attachment_text("ü".encode("latin-1"), "text/plain", "") == "ü" and attachment_text(b"a,b", "", "x.csv") == "a,b"
    assert attachment_text(b"not zip", "", "x.docx") is None and attachment_text(b"PKbroken", "", "x.docx") is None
    assert attachment_text(b"", "text/plain", "") is None and attachment_text(b"x", "image/png", "x.png") is None
    assert attachment_text(b"x" * 20, "text/plain", "", largest=10) is None


def pdf_file(pages, fonts=b"<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >>", extra=b"", packed=False):
    """A file of the given content streams; ``packed`` puts pages into an object stream."""
    out, kids = [b"%PDF-1.5"], b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /Resources << /Font " % len(pages) + fonts + b" >> >>"}
    for i, content in enumerate(pages):
        plain[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        body = zlib.compress(content)
        out.append(b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % (11 + 2 * i, len(body)) + body + b"\nendstream\nendobj")
    if packed:
        places, body = [], b""
        for n, text in plain.items():
            places.append(b"%d %d" % (n, len(body)))
            body += text + b" "
        head = b" ".join(places) + b" "
        body = zlib.compress(head + body)
        out.append(b"90 0 obj << /Type /ObjStm /N %d /First %d /Length %d /Filter [/FlateDecode] >>\nstream\r\n" % (len(plain), len(head), len(body)) + body + b"\r\nendstream endobj")
    else:
        out += [b"%d 0 obj\n" % n + text + b"\nendobj" for n, text in plain.items()]
    return b"\n".join([*out, extra, b"%%EOF"])


def test_pdf_text():
    one = rb"BT /F1 12 Tf 72 720 Td (Total \(due\): 12\05650 \200) Tj 0 -14 Td [(pay) -250 (by) 20 ( M) (ay)] TJ T* (third) ' ET"
    two = b"BT 1 0 0 1 72 700 Tm <506167652074776f> Tj 1 0 0 1 72 680 Tm (next) Tj ET q 10 0 0 10 0 0 cm BI /W 1 ID abc(\n EI Q BT (last) Tj ET"
    for packed in (False, True):
        assert attachment_text(pdf_file([one, two], packed=packed), "application/pdf", "") == "Total (due): 12.50 €\npay by May\nthird\nPage two\nnext\nlast"
    cmap = b"1 beginbfchar <0001> <0048> endbfchar 2 beginbfrange <0002> <0004> <00e9> <0005> <0006> [<0066006c> <D83DDE00>] endbfrange"
    fonts = b"<< /F1 << /Type /Font /Subtype /Type0 /ToUnicode 80 0 R >> >>"
    extra = b"80 0 obj << /Length %d >> stream\n" % len(cmap) + cmap + b"\nendstream endobj"
    assert attachment_text(pdf_file([b"BT /F1 9 Tf <000100020003000400050006> Tj ET"], fonts, extra), "", "x.PDF") == "Héêëfl😀"
    assert attachment_text(pdf_file([b"q Q"]), "application/pdf", "") is None
    assert attachment_text(pdf_file([one]) + b" trailer << /Encrypt 5 0 R >>", "application/pdf", "") is None
    rng = np.random.default_rng(3)
    whole = pdf_file([one, two])
    for _ in range(300):  # broken files give a text or none
        raw = bytearray(whole)
        for at in rng.integers(0, len(raw), 4):
            raw[at] = rng.integers(0, 256)
        attachment_text(bytes(raw), "application/pdf", "")


def test_kinds_of_attachments():
    from postlake.functions.attachments import kind_of

    cases = [("application/pdf", "", "pdf"), ("", "a.PDF", "pdf"), ("application/msword", "x", "docx"), ("application/msword2", "x", None), ("", "x.docm", "docx"), ("application/vnd.ms-excel", "", "xlsx"), ("", "x.ppsm", "pptx"), ("text/plain; charset=x", "", "text"), ("text/csv", "a.xlsx", "xlsx"), ("text/plain", "a.pdf", "pdf"), ("image/png", "png", None), (None, None, None), ("", "pdf", None)]
    assert [kind_of(t, n) for t, n, _ in cases] == [k for _, _, k in cases]


def test_hidden_elements():
    from postlake.functions.html import hidden

    yes = ["display:none", "DISPLAY : None !important; color:red", "color:red;visibility:hidden", "display:block;display:none"]
    no = ["", "display:block", "color:none", "display:none;display:block", "x-display:none"]
    assert all(hidden({"style": s}) for s in yes) and not any(hidden({"style": s}) for s in no) and not hidden({"style": None})
    assert hidden({"class": "Big PREHEADER"}) and not hidden({"class": "head"})


def test_prompt_names_every_field():
    from datetime import date

    from postlake.plans.nlq import FIELDS, coerce, prompt_for

    text = prompt_for("mails from Ann", date(2024, 5, 6))
    assert all(f'"{k}"' in text for k in FIELDS) and "mails from Ann" in text and "2024-05-06, a Monday" in text
    assert set(coerce({}, "q")) == set(FIELDS)


def test_a_parser_behind_an_endpoint():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from postlake.plans.nlq import http_parser

    asked = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"response": 'Here: {"from_addr": "ann", "semantic_query": "budget", "has_attachments": "yes"}'}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        parse = http_parser(f"http://127.0.0.1:{server.server_port}/api", "small")
        found = parse("budget files from ann")
        assert found["from_addr"] == "ann" and found["has_attachments"] and found["semantic_query"] == "budget"
        assert asked[0]["model"] == "small" and "budget files from ann" in asked[0]["prompt"] and asked[0]["stream"] is False
    finally:
        server.shutdown()
        server.server_close()
    assert parse("anything") is None


def test_questions():
    from postlake.plans.nlq import coerce, json_object, rule_parser

    p = rule_parser('budget from:ann type:.PDF has:attachment after:2024-05-01 subject:"may plan"')
    assert p["semantic_query"] == "budget" and p["attachment_type"] == "pdf" and p["has_attachments"] and p["subject_like"] == "may plan" and p["date_after"] == datetime(2024, 5, 1)
    assert rule_parser("just words") is None
    assert json_object('x {"a": 1} y') == {"a": 1} and json_object("[1]") is None and json_object("{bad}") is None and json_object(None) is None
    c = coerce({"subject": 5, "from_addr": "  ", "has_attachments": "No", "date_after": "soon", "attachment_type": " .Doc "}, "q")
    assert c["subject"] is None and c["from_addr"] is None and c["has_attachments"] is False and c["date_after"] is None and c["attachment_type"] == "doc" and c["semantic_query"] == "q"
    assert json.dumps(c, default=str)


def test_status_reads_figures_not_rows(ingest, archive):
    assert ingest.store.statistics().first()["total_emails"] == 0
    ingest.index(str(archive))
    store = ingest.store
    figures = store.statistics()
    plan = figures._jdf.queryExecution().optimizedPlan().toString()
    assert "from_addr" not in plan and "embedding" not in plan
    want = store.table("emails").count(), store.table("attachments").count(), store.table("vectors").count()
    r = figures.first()
    assert (r["total_emails"], r["total_attachments"], r["total_indexed_emails"], r["senders"]) == (*want, 2)
    # an index of an older writer has none: its rows are counted
    m = store.manifest()
    del m["figures"]
    store.files.replace("manifest.json", json.dumps(m))
    assert store.figures() is None and store.statistics().first() == r
    ingest.index(str(archive), incremental=False, skip_unchanged=False)
    assert store.figures() is not None and store.statistics().first() == r
    assert store.vacuum(hours=0) > 0 and store.statistics().first() == r


def rows_scanned(df):
    """Rows that come out of the scans of a plan that has run."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan

    def walk(node):
        if "Scan" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(out)


def test_lookups_read_no_row_groups_that_bloom_filters_rule_out(spark, tmp_path):
    from postlake.operators import listing
    from postlake.schema import EMAILS, conform

    rows = [(i, f"<m{i}@x>", f"/m/{i}.eml", f"{i:032x}") for i in range(3_000)]
    store = Store(spark, tmp_path / "index", buckets=6)
    emails = conform(spark.createDataFrame(rows, "id long, message_id string, file_path string, file_hash string"), EMAILS)
    store.commit(emails=emails.withColumn("file_hash", F.md5("file_path")))
    emails = store.table("emails")
    assert rows_scanned(listing.by_message_id(emails, "nobody@x")) == 0
    assert rows_scanned(listing.by_hash(emails, "f" * 32)) == 0
    assert listing.by_message_id(emails, "m7@x").first()["id"] == 7
    # a bucket has 500 rows or so, in one row group; five of six are left out (bloom filters err rarely)
    assert 0 < rows_scanned(listing.by_message_id(emails, "m7@x")) <= 1_200
    assert 0 < rows_scanned(listing.by_id(emails, 7)) <= 1_200
