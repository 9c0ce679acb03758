"""A Spark data source for message files, for batches and streams alike.

    register(spark)
    spark.read.format("eml").load("/mail")
    spark.readStream.format("eml").option("from", "0").load("file:///mail")

Rows are file_path, file_mtime, file_size and content; with the option ``content`` ``false`` files are listed and not
opened.  Any folder that pyarrow has a file system for will do, by path or URI; names are those of ``places.plain_name``.

Batch: the planner lists the topmost folders and deals out the rest.  Comparisons of file_mtime, file_size and file_path
are pushed into the walk, so files that they exclude aren't opened.

Stream: an offset is a moment; a batch holds the files changed after its first and up to its last one.  ``overlapSeconds`` looks
back behind the first for files that show up late with an older time; whoever reads must then drop what it knows (ingest
does).  ``settleSeconds`` keeps that much distance from the present for files still being written.

Other options: ``maxBytes`` (larger files are left out), ``from`` (the moment before a stream's first, in seconds).
"""

from __future__ import annotations

import operator
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from postlake.runtime import ship_package
from postlake.sources.places import folder_of, planned, walked

LISTED = ["file_path", "file_mtime", "file_size"]
KINDS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, many: x in many, IsNotNull: lambda x, _: x is not None, StringStartsWith: lambda x, head: x.startswith(head)}
#: Files and bytes of a batch of rows.
FILES, BYTES = 64, 4 << 20


def register(spark: SparkSession) -> None:
    """Make ``eml`` known to a session, with its filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EmlSource)


@dataclass
class Piece(InputPartition):
    """A piece of a walk, and the moments that its files must lie between."""

    piece: tuple[str, bool, int, int]
    after: float | None = None
    until: float | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


class EmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eml"

    def _content(self) -> bool:
        return self.options.get("content", "true").lower() != "false"

    def schema(self) -> str:
        return "file_path string, file_mtime double, file_size long" + (", content binary" if self._content() else "")

    def reader(self, schema) -> DataSourceReader:
        return EmlReader(self.options, self._content())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EmlStream(self.options, self._content())


class _Files:
    def __init__(self, options: dict[str, str], content: bool):
        if not options.get("path"):
            raise ValueError("the eml source needs a folder to load")
        self.root, self.content = options["path"], content
        self.most = int(options["maxBytes"]) if options.get("maxBytes") else None
        self.tests: list[tuple[int, Any, Any]] = []

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where nothing is planned
            return
        after, until = partition.after, partition.until

        def wanted(*row) -> bool:
            if (self.most is not None and row[2] > self.most) or (after is not None and row[1] <= after) or (until is not None and row[1] > until):
                return False
            return all(KINDS[kind](row[at], value) for at, kind, value in self.tests)

        for rows in walked(self.root, partition.piece, wanted):
            if not self.content:
                for at in range(0, len(rows), 10_000):
                    yield self._batch(rows[at : at + 10_000])
                continue
            held: list[tuple] = []
            size = 0
            for row in rows:
                store, path, _ = folder_of(row[0])
                try:
                    with store.open_input_stream(path, compression=None) as f:
                        held.append((*row, f.read()))
                except OSError:  # gone meanwhile, or not readable
                    continue
                size += len(held[-1][3])
                if len(held) >= FILES or size >= BYTES:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [*LISTED, "content"] if self.content else LISTED
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)


class EmlReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in KINDS and len(f.attribute) == 1 and f.attribute[0] in LISTED:
                self.tests.append((LISTED.index(f.attribute[0]), type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        return [Piece(p) for p in planned(self.root)]


class EmlStream(_Files, DataSourceStreamReader):
    def __init__(self, options: dict[str, str], content: bool):
        super().__init__(options, content)
        self.first = float(options.get("from", "0"))
        self.settle, self.overlap = float(options.get("settleSeconds", "0")), float(options.get("overlapSeconds", "0"))

    def initialOffset(self) -> dict:
        return {"until": self.first}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1000) / 1000}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(p, start["until"] - self.overlap, end["until"]) for p in planned(self.root)]

    def commit(self, end: dict) -> None:
        pass
