"""Session helpers shared by all operators: where shared scratch tables live,
how lineage is cut, and how the package reaches Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterable
from contextlib import closing
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of the session."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:  # else a batch has 10,000 rows, however long
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="postlake-ship-")
    target = os.path.join(folder, "postlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("postlake") / p.relative_to(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and runs in one process (``local[...]``,
    as in tests) is a temporary folder made.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="postlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives lost executors, and a join with one is planned
    with plain exchanges on both sides, so that Spark can split skewed keys.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/postlake-{name}-{uuid.uuid4().hex}"
        self._kept = False
        ship_package(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self._kept:  # what isn't dropped before goes with the driver
            root, store = self._store(self.root)
            store.deleteOnExit(root)
            self._kept = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path, store = self._store(self.path(name))
            store.delete(path, True)

    def clear(self) -> None:
        """Delete all tables, where no later plan reads any."""
        path, store = self._store(self.root)
        store.delete(path, True)

    def _store(self, path: str):
        """A path and the file system it lies in, as Spark sees them."""
        sc = self.spark.sparkContext
        found = sc._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(sc._jsc.hadoopConfiguration())


class Files:
    """Small files and folders below a root, on whatever file system Spark reaches it by."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.root = spark.sparkContext, root.rstrip("/")

    def _open(self, name: str):
        path = self.sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.sc._jsc.hadoopConfiguration())

    def make(self, name: str = "") -> None:
        path, store = self._open(name)
        store.mkdirs(path)

    def text(self, name: str) -> str | None:
        """The file's text; none where there is none, or it can't be read."""
        path, store = self._open(name)
        try:
            with closing(store.open(path)) as f:
                return self.sc._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        except Py4JJavaError:
            return None

    def create(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Write a file; false where there is one already."""
        path, store = self._open(name)
        try:
            with closing(store.create(path, overwrite)) as f:
                f.write(bytearray(text.encode()))
            return True
        except Py4JJavaError:
            if store.exists(path):
                return False
            raise

    def replace(self, name: str, text: str) -> None:
        """Write a file in one step: readers see the old text or the new one."""
        temporary = f".{name}.{uuid.uuid4().hex}"
        self.create(temporary, text)
        self.move(temporary, name)

    def move(self, name: str, to: str) -> None:
        hadoop = self.sc._jvm.org.apache.hadoop.fs
        (old, _), (new, store) = self._open(name), self._open(to)
        how = self.sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(store.makeQualified(new).toUri(), self.sc._jsc.hadoopConfiguration()).rename(store.makeQualified(old), store.makeQualified(new), how)

    def delete(self, name: str) -> bool:
        path, store = self._open(name)
        return store.delete(path, True)

    def entries(self, name: str = "") -> dict[str, float]:
        """Names in a folder, and when each was changed (seconds)."""
        path, store = self._open(name)
        if not store.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in store.listStatus(path)}


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Remove scratch folders that drivers which were killed have left in the shared folder; those of running jobs are
    younger than ``hours``."""
    files = Files(spark, shared_dir(spark))
    old = [n for n, changed in files.entries().items() if re.fullmatch(r"postlake-[a-z-]+-[0-9a-f]{32}", n) and changed < time.time() - 3600 * hours]
    return sum(files.delete(n) for n in old)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str) -> DataFrame:
    """A table of a few rows that the driver has, by way of Arrow.  From a list Spark would make it in Python workers, and with an
    environment of their own: executors would hold a second set of them beside the one that reads and parses."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), schema)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores, some tasks each, for steps that take long over a row: a short table may be one partition."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
