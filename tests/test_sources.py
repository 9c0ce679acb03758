"""Message files by path and by URI, through the listing, the data source and ingest."""

import os

import pytest
from pyspark.sql import functions as F

from postlake.sources import eml, places
from postlake.sources.mailfiles import inside, list_messages, parse_messages
from postlake.sources.store import Store
from postlake.streaming.ingest import Ingest
from tests.test_archive import mail


@pytest.fixture
def box(tmp_path):
    folder = tmp_path / "mail" / "ann%40ex.org" / "INBOX.mailbox"
    folder.mkdir(parents=True)
    for i in range(1, 8):
        (folder / f"{i}.eml").write_bytes(mail(f"Subject {i}", "x" * i, mid=f"<{i}@x>"))
        os.utime(folder / f"{i}.eml", (1_700_000_000 + i, 1_700_000_000 + i))
    (folder / "note.txt").write_text("no message")
    return tmp_path / "mail"


@pytest.mark.parametrize("given", ["{}", "{}/", "file:{}", "file://{}", "file://{}/"])
def test_a_folder_has_one_name(box, given):
    assert places.plain_name(given.format(box)) == str(box)
    assert places.plain_name("s3://bucket/mail/") == "s3://bucket/mail" and places.plain_name("/a/../b") == "/b"


def test_ingest_by_path_and_by_uri_is_the_same(spark, box, tmp_path):
    seen = []
    for i, root in enumerate((str(box), f"file://{box}", f"file:{box}/")):
        ingest = Ingest(Store(spark, tmp_path / f"index-{i}", buckets=4))
        run = ingest.index(root)
        one = f"{root.rstrip('/')}/ann%40ex.org/INBOX.mailbox/1.eml"
        again = ingest.index_file(one)["status"], ingest.index_file(one + "x")["status"], ingest.index(root).candidates
        out = ingest.reextract_one(file_path=one)["status"]
        with pytest.raises(ValueError, match="is no directory"):
            ingest.prune(root.rstrip("/") + "/none")
        box.joinpath("ann%40ex.org", "INBOX.mailbox", "7.eml").rename(tmp_path / "away.eml")
        pruned = ingest.prune(root)
        (tmp_path / "away.eml").rename(box / "ann%40ex.org" / "INBOX.mailbox" / "7.eml")
        rows = sorted((r["file_path"], r["file_hash"], r["subject"]) for r in ingest.store.table("emails").collect())
        seen.append((run.candidates, run.indexed, again, out, pruned, rows))
    assert seen[0] == seen[1] == seen[2]
    assert seen[0][:4] == (7, 7, ("skipped", "not_found", 0), "ok") and seen[0][4] == {"missing": 1, "removed": 1} and len(seen[0][5]) == 6


def test_source_reads_what_the_listing_lists(spark, box):
    eml.register(spark)
    for root in (str(box), f"file://{box}"):
        files = spark.read.format("eml").load(root)
        assert sorted(map(tuple, files.drop("content").collect())) == sorted(map(tuple, list_messages(spark, root).collect()))
        assert sorted(r["subject"] for r in parse_messages(files).collect()) == [f"Subject {i}" for i in range(1, 8)]
        assert files.where(inside(root)).count() == 7
    assert spark.read.format("eml").option("content", "false").load(str(box)).columns == ["file_path", "file_mtime", "file_size"]
    assert spark.read.format("eml").load(f"{box}/none").count() == 0
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format("eml").load().count()


def test_filters_reach_the_walk(spark, box, monkeypatch):
    eml.register(spark)
    files = spark.read.format("eml").load(str(box))
    late = files.where((F.col("file_mtime") > 1_700_000_003) & (F.col("file_mtime") <= 1_700_000_006) & F.startswith(F.col("file_path"), F.lit(str(box))))
    assert sorted(os.path.basename(r["file_path"]) for r in late.collect()) == ["4.eml", "5.eml", "6.eml"]
    assert "Filter (" not in late._jdf.queryExecution().executedPlan().toString()
    # what the filters exclude isn't opened
    reader = eml.EmlReader({"path": str(box)}, True)
    left = list(reader.pushFilters([eml.GreaterThan(("file_mtime",), 1_700_000_005.0), eml.LessThan(("content",), b"")]))
    opened = []
    monkeypatch.setattr(eml, "folder_of", lambda path, own=eml.folder_of: opened.append(path) or own(path))
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(left) == 1 and len(rows) == len(opened) == 2


def test_flat_folders_are_dealt_out(box):
    pieces = places.planned(str(box), share=2)
    assert sum(p[3] == 4 for p in pieces) == 4
    names = [r[0] for p in pieces for rows in places.walked(str(box), p) for r in rows]
    assert len(names) == len(set(names)) == 7
    assert sorted(r[0] for p in places.planned(str(box), spread=1) for rows in places.walked(str(box), p) for r in rows) == sorted(names)


def test_stream_goes_on_where_it_ended(spark, box, tmp_path):
    eml.register(spark)
    got = []

    def run():
        files = spark.readStream.format("eml").option("overlapSeconds", "0").load(f"file://{box}")
        q = files.writeStream.foreachBatch(lambda df, _: got.append(sorted(os.path.basename(r["file_path"]) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    (box / "new.eml").write_bytes(mail("New", mid="<new@x>"))
    run()
    assert [x for x in got if x] == [[f"{i}.eml" for i in range(1, 8)], ["new.eml"]]


def test_late_files_are_found_by_looking_back(box):
    stream = eml.EmlStream({"path": str(box), "overlapSeconds": "3"}, False)
    count = lambda a, b: sum(batch.num_rows for p in stream.partitions({"until": a}, {"until": b}) for batch in stream.read(p))
    assert count(1_700_000_004.0, 1_700_000_005.0) == 4 and stream.initialOffset() == {"until": 0.0}
    stream.overlap = 0
    assert count(1_700_000_004.0, 1_700_000_005.0) == 1
