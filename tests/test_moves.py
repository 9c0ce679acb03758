"""Moves in a stream equal moves in a table."""

from datetime import datetime, timedelta

import pytest

from postlake.streaming.moves import moves, moves_stream

SEEN = "message_id string, file_path string, seen_at timestamp"


@pytest.fixture
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def run(spark, folder, tmp_path, schema, **options):
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(folder))
    q = moves_stream(files, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.schema("message_id string, old_path string, new_path string, moved_at timestamp").parquet(str(tmp_path / "out")).collect()))


def test_stream_equals_table(spark, tmp_path, provider):
    at = lambda h: datetime(2024, 5, 1) + timedelta(hours=h)
    batches = [
        [("a", "/1", at(0)), ("a", "/1", at(0)), ("b", "/b", at(1)), (None, "/n", at(1)), ("", "/e", at(1)), ("c", None, at(1))],
        [("a", "/2", at(2)), ("a", "/3", at(3)), ("b", "/b", at(4)), ("d", "/d2", at(4)), ("d", "/d1", at(4))],
        [("a", "/1", at(6)), ("b", "/x", at(5)), ("b", "/y", at(7)), ("e", "/e", None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, moves(spark.createDataFrame(sum(batches, []), SEEN)).collect()))
    assert run(spark, tmp_path / "in", tmp_path, SEEN, lateness="2 days") == want
    assert [r[:3] for r in want] == [("a", "/1", "/2"), ("a", "/2", "/3"), ("a", "/3", "/1"), ("b", "/b", "/x"), ("b", "/x", "/y"), ("d", "/d1", "/d2")]


def test_ids_that_are_not_seen_are_forgotten(spark, tmp_path, provider):
    day = lambda d: datetime(2024, 5, 1) + timedelta(days=d)
    for rows in ([("a", "/1", day(0))], [("z", "/z", day(30))], [("z", "/z", day(31))], [("a", "/2", day(32)), ("z", "/y", day(32))]):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path / "in", tmp_path, SEEN, lateness="1 hour", keep_days=10)
    assert [r[:3] for r in got] == [("z", "/z", "/y")]


def test_an_empty_table(spark):
    assert moves(spark.createDataFrame([], SEEN)).collect() == []
