"""Message files as tables: listing without reading, pruning by time, parsing on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlake.functions.mime import parse_message
from postlake.params import SETTINGS, Settings
from postlake.runtime import given, ship_package
from postlake.schema import PARSED
from postlake.sources.places import folder_of, look_up, plain_name, planned, walked

LONGEST_PATH = 4_096


def _reader(spark, directory: str, modified_after: datetime | str | None, stream: bool = False):
    r = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
    if modified_after is not None and not stream:
        r = r.option("modifiedAfter", modified_after if isinstance(modified_after, str) else modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    if stream:
        r = r.schema("path string, modificationTime timestamp, length long, content binary")
    return r.load(plain_name(directory))


def plain_path(column="path"):
    """The path without the ``file:`` scheme."""
    return F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^file:/+", "/")


def mtime(column="modificationTime"):
    return F.col(column).cast("double")


def list_messages(spark: SparkSession, directory: str, modified_after: datetime | str | None = None) -> DataFrame:
    """file_path, file_mtime, file_size of every ``.eml`` below a directory, given by path or URI.  The contents aren't read.

    The driver lists no more than the topmost folders; executors walk what is below them, so nothing holds the
    names of a whole archive, and a flat folder of many files is walked by several tasks.
    """
    ship_package(spark)
    if isinstance(modified_after, str):
        modified_after = datetime.fromisoformat(modified_after)
    after = None if modified_after is None else (modified_after if modified_after.tzinfo else modified_after.replace(tzinfo=UTC)).timestamp()
    names = ["file_path", "file_mtime", "file_size"]
    pieces = planned(directory)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for rows in walked(directory, piece, None if after is None else lambda _, changed, size: changed > after):
                    if rows:
                        some = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.string()), pa.array(some[1], pa.float64()), pa.array(some[2], pa.int64())], names=names)

    folders = given(spark, pieces, "folder string, deep boolean, share int, shares int").repartition(max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism)))
    return folders.mapInArrow(walk, "file_path string, file_mtime double, file_size long")


def count_messages(spark: SparkSession, directory: str, modified_after: datetime | str | None = None) -> int:
    return list_messages(spark, directory, modified_after).count()


def read_messages(spark: SparkSession, directory: str, modified_after: datetime | str | None = None, stream: bool = False, s: Settings = SETTINGS) -> DataFrame:
    """Files with their content, but those larger than the cap (skipped before they are read)."""
    df = _reader(spark, directory, modified_after, stream).where(F.col("length") <= s.largest_message)
    return df.select(F.col("path"), plain_path().alias("file_path"), mtime().alias("file_mtime"), F.col("length").alias("file_size"), "content")


def inside(directory: str, column="file_path"):
    """Whether a path lies in a directory (not in one whose name merely begins alike) and isn't too long."""
    return F.startswith(F.col(column), F.lit(plain_name(directory).rstrip("/") + "/")) & (F.length(column) <= LONGEST_PATH) & ~F.col(column).rlike(r"(^|/)\.\.(/|$)")


def unchanged_removed(candidates: DataFrame, emails: DataFrame) -> DataFrame:
    """Candidates that the index does not hold with the same modification time."""
    known = emails.select("file_path", "file_mtime").where("file_mtime is not null")
    return candidates.join(known, ["file_path", "file_mtime"], "left_anti")


def read_paths(spark: SparkSession, wanted: DataFrame, bytes_per_task: int = 64 << 20) -> DataFrame:
    """file_path, file_mtime, file_size and content of the listed files, read where their rows are.

    ``wanted`` (file_path, file_mtime, file_size) is a short table of long files, so it is dealt anew: tasks of
    about ``bytes_per_task``, at least one a core.  Each task opens its own files, so that only those chosen are read.
    """
    return _chosen(spark, wanted, bytes_per_task).mapInArrow(_contents, "file_path string, file_mtime double, file_size long, content binary")


def parse_paths(spark: SparkSession, wanted: DataFrame, s: Settings = SETTINGS, bytes_per_task: int = 64 << 20) -> DataFrame:
    """``parse_messages`` of ``read_paths``, as one step: a task needs one Python worker, and contents stay within it."""
    return _chosen(spark, wanted, bytes_per_task).mapInArrow(lambda batches: _records(_contents(batches), s), PARSED)


def _chosen(spark: SparkSession, wanted: DataFrame, bytes_per_task: int) -> DataFrame:
    ship_package(spark)
    n, size = wanted.agg(F.count(F.lit(1)), F.sum("file_size")).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // bytes_per_task))))
    return wanted.select("file_path", "file_mtime", "file_size").repartition(tasks)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of listed files with their content, but those that can't be read."""
    for batch in batches:
        held: list[bytes | None] = []
        start = size = 0
        for i, path in enumerate(batch.column("file_path").to_pylist()):
            store, name, _ = folder_of(path)
            try:
                with store.open_input_stream(name, compression=None) as f:
                    held.append(f.read())
                size += len(held[-1])
            except OSError:
                held.append(None)
            if len(held) == 64 or size > 4 << 20 or i + 1 == batch.num_rows:
                found = pa.RecordBatch.from_arrays([*(c.slice(start, len(held)) for c in batch.columns), pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                yield found.filter(found.column("content").is_valid())
                start, held, size = i + 1, [], 0


def confirmed_missing(rows: DataFrame) -> DataFrame:
    """Of rows whose ``file_path`` no scan found, those whose file isn't there: guards files outside the
    scanned folder.  The executors look, so their view of the file system must be the driver's."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            gone = []
            for path in batch.column("file_path").to_pylist():
                gone.append(look_up(path).type == fs.FileType.NotFound)
            yield pa.RecordBatch.from_arrays([batch.column("file_path").filter(pa.array(gone))], names=["file_path"])

    return rows.select("file_path").mapInArrow(run, "file_path string")


def parse_messages(files: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """One record a file (schema ``PARSED``); what can't be parsed has a ``parse_error`` instead of fields."""
    ship_package(files.sparkSession)
    return files.select("file_path", "file_mtime", "file_size", "content").mapInArrow(lambda batches: _records(batches, s), PARSED)


def _records(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    arrow = _arrow(PARSED)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [parse_message(c, s) for c in part.column("content").to_pylist()]
            columns = []
            for f in arrow:
                if f.name in ("file_path", "file_mtime", "file_size"):
                    columns.append(part.column(f.name).cast(f.type))
                else:
                    columns.append(pa.array([r.get(f.name) for r in rows], f.type))
            yield pa.RecordBatch.from_arrays(columns, names=PARSED.names)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
