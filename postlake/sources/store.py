"""The index as buckets of Parquet files and one manifest that names the current ones.

Messages, their attachments and vectors lie in the bucket that a hash of the message's path says.  A write reads and
replaces only the buckets of the paths that it is about, in new folders, then flips the manifest; buckets that it
doesn't touch are named again as they are.  Rows that stay go from the old folder to the new one without a shuffle: only keys
are joined, and what they hit is left out by its place in its file.  With every bucket the write keeps what it holds in figures (counts, extremes,
a sketch of its senders), which can be merged, so the status of an archive scans none of its rows; and Parquet bloom filters
on what single messages are looked up by, so a lookup reads no row group that can't have them.  The files of the current version are never changed, so readers and failed
writers are safe, and all tables of a version become visible together.  ``vacuum`` removes folders that no
manifest names any more.  All of it goes through the file system that Spark reaches the root by.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.functions.embedtext import fallback_document
from postlake.functions.text import attachment_types, cut, file_extension, file_hash
from postlake.operators.listing import statistics
from postlake.operators.search import StoredIndex
from postlake.operators.vectorindex import VectorIndex
from postlake.params import SETTINGS, Settings
from postlake.runtime import Files, Scratch, given
from postlake.schema import ATTACHMENTS, EMAILS, EXTRACTION_VERSION, TABLES, VECTORS, conform, empty

#: Within a bucket messages are sorted by date, so that date filters skip row groups.
ORDERED_BY = {"emails": ["date"], "attachments": ["email_id"], "vectors": ["id"]}
#: Columns with a bloom filter.
LOOKED_UP = {"emails": ["message_id", "file_hash", "id"], "attachments": ["email_id"], "vectors": ["id"]}
#: What is kept of a bucket of a table.
FIGURES = "name string, bucket int, version string, n long, with_attachments long, min_date timestamp, max_date timestamp, max_file_mtime double, min_id long, max_id long, senders binary"
#: Rows of a file that one bitmap of places is about (``bitmap_construct_agg`` says so), and bytes of bitmaps that a write
#: broadcasts: half a billion rows, at a bit each.  More are joined by a shuffle.
PLACES, BROADCAST = 32_768, 64 << 20
#: Bits of the sketch of senders: its error is about 1.04 / sqrt(2 ** SKETCH) of their number.
SKETCH = 11


class LockedError(RuntimeError):
    """Another live process is writing."""


def bucket_of(hashed: str | Column, buckets: int) -> Column:
    """The bucket of a message by its ``file_hash`` (which is the id of its vector, too)."""
    return (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % buckets).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str | os.PathLike, buckets: int = SETTINGS.buckets):
        """``buckets`` counts for a new index; ``rebucket`` gives another number to one that exists."""
        self.spark, self.root, self._new = spark, str(root).rstrip("/"), buckets
        self.files = Files(spark, self.root)
        self.files.make()

    # -- versions -------------------------------------------------------------------------------

    def manifest(self) -> dict[str, Any]:
        """buckets, next (the last ids given), tables: the folder of each bucket."""
        try:
            return json.loads(self.files.text("manifest.json") or "")
        except ValueError:
            return {"buckets": self._new, "next": {"emails": 0, "attachments": 0}, "tables": {}}

    def _paths(self, m: dict[str, Any], name: str, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        return [f"{self.root}/{p}" for b, p in sorted(m["tables"].get(name, {}).items()) if wanted is None or int(b) in wanted]

    def _read(self, m: dict[str, Any], name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        paths = self._paths(m, name, buckets)
        if not paths:
            return empty(self.spark, TABLES[name])
        return conform(self.spark.read.schema(TABLES[name]).parquet(*paths), TABLES[name])

    def table(self, name: str, paths: Iterable[str] | None = None) -> DataFrame:
        """A table; with ``paths`` only the buckets that these message files are in."""
        m = self.manifest()
        return self._read(m, name, None if paths is None else {int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % m["buckets"] for p in paths})

    def _placed(self, m: dict[str, Any], name: str, buckets: Iterable[int]) -> DataFrame:
        """Rows of a table with their bucket and their place: the file and their number within it."""
        paths, path = self._paths(m, name, buckets), F.col("_metadata.file_path")
        if not paths:
            return self._nothing(name).select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row"))
        # files of one task have the same name in each bucket
        place = F.regexp_extract(path, r"/bucket=(\d+)/[^/]+$", 1).cast("int").alias("bucket"), F.regexp_extract(path, r"/bucket=(\d+/[^/]+)$", 1).alias("_file"), F.col("_metadata.row_index").alias("_row")
        return self.spark.read.schema(TABLES[name]).parquet(*paths).select("*", *place)

    def _put(self, name: str, rows: DataFrame, kept: DataFrame | None = None) -> str:
        """Write rows of a table (with ``bucket``) to a new folder, with their figures.  ``kept`` are rows that lie in the files of
        their bucket already, so they are dealt as those are."""
        folder = f"{name}/v-{uuid.uuid4().hex}"
        columns = [*(F.col(f.name) for f in TABLES[name]), "bucket"]
        # a bucket is as many tasks and files as it is long
        rows = rows.select(*columns).hint("rebalance", "bucket")
        if kept is not None:
            rows = kept.select(*columns).unionByName(rows)
        out = rows.sortWithinPartitions("bucket", *ORDERED_BY.get(name, [])).write.option("compression", "zstd")
        for column in LOOKED_UP.get(name, []):  # as large as a bucket grows, smaller where fewer will do
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(SETTINGS.bucket_messages))
        out.option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        self._figures(name, f"{self.root}/{folder}").coalesce(1).write.parquet(f"{self.root}/figures/{folder}")
        return folder

    def _write(self, m: dict[str, Any], tables: dict[str, tuple[DataFrame, DataFrame | None]], touched: Iterable[int]) -> None:
        """Replace buckets of tables (new rows and kept ones, as ``_put`` has them) and make the new version current."""
        with ThreadPoolExecutor(len(TABLES)) as side_by_side:
            folders = dict(zip(tables, side_by_side.map(lambda name: self._put(name, *tables[name]), tables), strict=True))
        self._publish(m, folders, touched)

    def _publish(self, m: dict[str, Any], folders: dict[str, str], touched: Iterable[int]) -> None:
        touched = {str(b) for b in touched}
        for name, folder in folders.items():
            parts = {b: p for b, p in m["tables"].get(name, {}).items() if b not in touched}
            written = {n.removeprefix("bucket=") for n in self.files.entries(folder) if n.startswith("bucket=")}
            m["tables"][name] = parts | {b: f"{folder}/bucket={b}" for b in written}
            kept = {b: v for b, v in m.setdefault("figures", {}).get(name, {}).items() if b in m["tables"][name]}
            m["figures"][name] = kept | {b: f"figures/{folder}" for b in written}
        self.files.replace("manifest.json", json.dumps(m))

    def _figures(self, name: str, folder: str) -> DataFrame:
        """What the buckets of a written folder hold."""
        rows = self.spark.read.schema(type(TABLES[name])(list(TABLES[name].fields)).add("bucket", "integer")).parquet(folder)
        none = lambda kind: F.lit(None).cast(kind)
        emails = name == "emails"
        own = {
            "n": F.count(F.lit(1)),
            "with_attachments": F.count_if("has_attachments") if emails else none("long"),
            "min_date": F.min("date") if emails else none("timestamp"),
            "max_date": F.max("date") if emails else none("timestamp"),
            "max_file_mtime": F.max("file_mtime") if emails else none("double"),
            "min_id": F.min("id") if name != "vectors" else none("long"),
            "max_id": F.max("id") if name != "vectors" else none("long"),
            "senders": F.hll_sketch_agg("from_addr", SKETCH) if emails else none("binary"),
        }
        return rows.groupBy("bucket").agg(*(c.alias(n) for n, c in own.items())).select(F.lit(name).alias("name"), "bucket", *own)

    def figures(self) -> DataFrame | None:
        """name, bucket and what each current bucket holds; None where an older writer has kept none of some bucket."""
        m = self.manifest()
        current = [(n, int(b), m.get("figures", {}).get(n, {}).get(b)) for n, parts in m["tables"].items() for b in parts]
        if any(v is None for *_, v in current):
            return None
        if not current:
            return given(self.spark, [], FIGURES).drop("version")
        # of as many writes as some bucket is left of
        rows = self.spark.read.parquet(*(f"{self.root}/{v}" for v in sorted({v for *_, v in current})))
        rows = rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"(figures/[^/]+/v-[0-9a-f]+)/[^/]+$", 1))
        known = given(self.spark, current, "name string, bucket int, version string")
        return rows.join(F.broadcast(known), ["name", "bucket", "version"], "left_semi").drop("version")

    def statistics(self) -> DataFrame:
        """One row: ``listing.statistics`` of the current version and an estimate of its distinct senders, from the buckets'
        figures alone; where they aren't known, from the rows."""
        found = self.figures()
        if found is None:
            emails = self.table("emails")
            senders = emails.agg(F.hll_sketch_estimate(F.hll_sketch_agg("from_addr", SKETCH)).alias("senders"))
            return statistics(emails, self.table("attachments"), self.table("vectors")).crossJoin(senders)
        of = lambda name, column="n": F.coalesce(F.sum(F.when(F.col("name") == name, F.col(column))), F.lit(0).cast("long"))
        return found.agg(
            of("emails").alias("total_emails"),
            of("emails", "with_attachments").alias("emails_with_attachments"),
            F.min("min_date").alias("min_date"),
            F.max("max_date").alias("max_date"),
            F.max("max_file_mtime").alias("max_file_mtime"),
            of("attachments").alias("total_attachments"),
            of("vectors").alias("total_indexed_emails"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("senders")), F.lit(0).cast("long")).alias("senders"),
        )

    def _bucketed(self, name: str, rows: DataFrame, buckets: int) -> DataFrame:
        """Messages or vectors with their bucket."""
        return conform(rows, TABLES[name]).withColumn("bucket", bucket_of("file_hash" if name == "emails" else "id", buckets))

    def _replaced(self, m: dict[str, Any], tables: dict[str, DataFrame]) -> None:
        """Write whole tables, and publish them.  An attachment lies in the bucket of its message: messages are written first, and
        the attachments joined with what was written."""
        folders = {}
        if "emails" in tables:
            folders["emails"] = self._put("emails", self._bucketed("emails", tables["emails"], m["buckets"]))
            emails = self.spark.read.schema(type(EMAILS)(list(EMAILS.fields)).add("bucket", "integer")).parquet(f"{self.root}/{folders['emails']}")
        else:
            emails = self._bucketed("emails", self._read(m, "emails"), m["buckets"])
        rows = {n: self._bucketed(n, df, m["buckets"]) for n, df in tables.items() if n == "vectors"}
        if "attachments" in tables:
            rows["attachments"] = conform(tables["attachments"], ATTACHMENTS).join(emails.select(F.col("id").alias("email_id"), "bucket"), "email_id")
        with ThreadPoolExecutor(len(TABLES)) as side_by_side:
            folders |= dict(zip(rows, side_by_side.map(lambda n: self._put(n, rows[n]), rows), strict=True))
        for n in ("emails", "attachments"):
            if n in folders:
                top = self.spark.read.schema(FIGURES).parquet(f"{self.root}/figures/{folders[n]}").agg(F.max("max_id")).first()[0]
                m["next"][n] = max(m["next"].get(n, 0), top or 0)
        self._publish(m, folders, range(m["buckets"]))

    def commit(self, **tables: DataFrame) -> None:
        """Replace whole tables.  Attachments of messages that aren't there are left out, those that the index holds too."""
        m = self.manifest()
        if "emails" in tables and "attachments" not in tables and m["tables"].get("attachments"):
            tables["attachments"] = self._read(m, "attachments")
        self._replaced(m, tables)

    def rebucket(self, buckets: int) -> None:
        """Another number of buckets: every table is written anew."""
        m = self.manifest()
        old = {n: self._read(m, n) for n in m["tables"]}
        self._replaced(m | {"buckets": buckets, "tables": {}}, old)

    def vacuum(self, hours: float = 24) -> int:
        """Remove folders that the manifest doesn't name and that are older than readers of old versions run."""
        m = self.manifest()
        named = {p.rsplit("/", 1)[0] for parts in m["tables"].values() for p in parts.values()} | {m.get("vector_index", {}).get("folder")}
        gone = 0
        named |= {v for parts in m.get("figures", {}).values() for v in parts.values()}
        for name in [*TABLES, "vector-index", *(f"figures/{n}" for n in TABLES)]:
            for folder, changed in self.files.entries(name).items():
                if f"{name}/{folder}" not in named and changed < time.time() - 3600 * hours:
                    gone += self.files.delete(f"{name}/{folder}")
        return gone

    # -- the vector index -----------------------------------------------------------------------

    def build_vector_index(self, **how: Any) -> VectorIndex:
        """Index the vectors of the current version; the manifest remembers which buckets it is of."""
        m = self.manifest()
        folder = f"vector-index/v-{uuid.uuid4().hex}"
        rows = self._read(m, "vectors").withColumn("bucket", bucket_of("id", m["buckets"]))
        built = VectorIndex.build(rows, f"{self.root}/{folder}", **how)
        self.files.replace("manifest.json", json.dumps(self.manifest() | {"vector_index": {"folder": folder, "of": m["tables"].get("vectors", {})}}))
        return built

    def vector_index(self) -> StoredIndex | None:
        """The index as it counts for the current version; none where none was built."""
        m = self.manifest()
        known = m.get("vector_index")
        if known is None:
            return None
        now = m["tables"].get("vectors", {})
        fresh = [int(b) for b, p in now.items() if known["of"].get(b) == p]
        changed = [int(b) for b in now if int(b) not in set(fresh)]
        return StoredIndex(VectorIndex(self.spark, f"{self.root}/{known['folder']}"), fresh, self._read(m, "vectors", changed) if changed else None)

    # -- writes ---------------------------------------------------------------------------------

    def upsert(self, parsed: DataFrame, embedded: DataFrame | None = None, s: Settings = SETTINGS, gone: DataFrame | None = None) -> None:
        """Insert or replace messages by path, with their attachments and vectors, and delete those of ``gone``
        (file_path), in one version.  Both are read several times, so they should be written tables."""
        scratch = Scratch(self.spark, "upsert")
        m = self.manifest()
        about = parsed.select("file_path") if gone is None else parsed.select("file_path").unionByName(gone.select("file_path"))
        touched = self._buckets_of(m, about)
        new = scratch.keep(new_emails(parsed, s), "new")
        replaced = new.select("file_path") if gone is None else new.select("file_path").unionByName(gone.select("file_path"))
        kept, hit = self._without(m, touched, replaced, scratch)
        known = hit if gone is None else hit.join(gone.select("file_path").distinct(), "file_path", "left_anti")
        emails, attachments, more = numbered_messages(new, known, scratch, m["next"]["emails"], m["next"]["attachments"])
        tables = {"emails": (self._bucketed("emails", emails, m["buckets"]), kept["emails"])}
        if embedded is not None or gone is not None:
            ids = [] if gone is None else [gone.select(file_hash("file_path").alias("id"))]
            rows = empty(self.spark, VECTORS)
            if embedded is not None:
                rows = to_vector_rows(latest_per_path(embedded), s)
                ids.append(embedded.select(file_hash("file_path").alias("id")))
            stored = self._placed(m, "vectors", touched)
            left = self._left(stored, self._hit(stored, ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1]), "id"), scratch, "vectors")
            tables["vectors"] = self._bucketed("vectors", rows, m["buckets"]), left
        # attachments of new messages get the bucket of their message
        tables["attachments"] = attachments.withColumn("bucket", bucket_of("file_hash", m["buckets"])), kept["attachments"]
        for n, k in zip(("emails", "attachments"), more, strict=True):
            m["next"][n] += k
        self._write(m, tables, touched)
        scratch.clear()

    def delete(self, paths: DataFrame) -> None:
        """Delete messages by path (a written table with file_path), with their attachments and vectors."""
        scratch = Scratch(self.spark, "delete")
        m = self.manifest()
        touched = self._buckets_of(m, paths)
        kept, _ = self._without(m, touched, paths.select("file_path"), scratch)
        stored = self._placed(m, "vectors", touched)
        kept["vectors"] = self._left(stored, self._hit(stored, paths.select(file_hash("file_path").alias("id")), "id"), scratch, "vectors")
        self._write(m, {n: (self._nothing(n), rows) for n, rows in kept.items()}, touched)
        scratch.clear()

    def _nothing(self, name: str) -> DataFrame:
        return empty(self.spark, TABLES[name]).withColumn("bucket", F.lit(0))

    def _buckets_of(self, m: dict[str, Any], paths: DataFrame) -> list[int]:
        return [r[0] for r in paths.select(bucket_of(file_hash("file_path"), m["buckets"])).distinct().collect()]  # at most all buckets

    def _without(self, m: dict[str, Any], touched: list[int], paths: DataFrame, scratch: Scratch) -> tuple[dict[str, DataFrame], DataFrame]:
        """The messages of buckets but those of ``paths``, and their attachments; also the messages that go (id, file_path)."""
        emails, attachments = self._placed(m, "emails", touched), self._placed(m, "attachments", touched)
        hit = scratch.keep(self._hit(emails, paths, "file_path", "id"), "hit")
        gone = self._hit(attachments, hit.select(F.col("id").alias("email_id")), "email_id")
        return {"emails": self._left(emails, hit, scratch, "emails"), "attachments": self._left(attachments, gone, scratch, "attachments")}, hit

    def _hit(self, stored: DataFrame, keys: DataFrame, key: str, *more: str) -> DataFrame:
        """Key and place of the rows with one of the keys; no other column is shuffled."""
        return stored.select(key, *more, "_file", "_row").join(keys.select(key).distinct(), key, "left_semi")

    def _left(self, stored: DataFrame, hit: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Stored rows but those hit, read where they lie: a bit a row says which go."""
        block = F.floor(F.col("_row") / PLACES).alias("_block")
        bits = hit.groupBy("_file", block).agg(F.bitmap_construct_agg(F.col("_row") % PLACES).alias("_bits"))
        bits = scratch.keep(bits, f"bits-{name}")
        size = bits.agg(F.sum(F.length("_bits"))).first()[0] or 0
        if not size:
            return stored
        at = F.col("_row") % PLACES
        byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        stays = F.col("_bits").isNull() | (F.getbit(byte, (at % 8).cast("int")) == 0)
        return stored.withColumn("_block", block).join(F.broadcast(bits) if size <= BROADCAST else bits, ["_file", "_block"], "left").where(stays)

    # -- state ----------------------------------------------------------------------------------

    def state(self) -> dict[str, Any]:
        try:
            return json.loads(self.files.text("state.json") or "{}")
        except ValueError:
            return {}

    def set_state(self, key: str, value: Any) -> None:
        self.files.replace("state.json", json.dumps(self.state() | {key: {"value": value, "updated_at": datetime.now(UTC).isoformat()}}))

    def watermark(self) -> datetime | None:
        """The scan watermark; without one the latest modification time in the index."""
        found = self.state().get("scan_watermark")
        if found:
            try:
                return datetime.fromisoformat(found["value"])
            except (ValueError, TypeError, KeyError):
                pass
        latest = self.table("emails").agg(F.max("file_mtime")).first()[0]
        return None if latest is None else datetime.fromtimestamp(latest, UTC)

    # -- writer lock ----------------------------------------------------------------------------

    def lock_holder(self) -> dict[str, Any] | None:
        """Who writes just now; none for a file that can't be read or a process that is gone."""
        try:
            held = json.loads(self.files.text("writer.lock") or "")
            pid = int(held["pid"])
        except (ValueError, KeyError, TypeError):
            return None
        if held.get("host", socket.gethostname()) == socket.gethostname() and not _alive(pid):
            return None
        return held

    def _own(self, holder: dict[str, Any] | None, pid: int | None = None) -> bool:
        return holder is not None and holder["pid"] == (pid or os.getpid()) and holder.get("host", socket.gethostname()) == socket.gethostname()

    def acquire(self, kind: str, pid: int | None = None) -> dict[str, Any] | None:
        """Take the lock; None on success, else its live holder.  The lock of a dead process is taken over, and
        a process may take its own again."""
        payload = json.dumps({"pid": pid or os.getpid(), "host": socket.gethostname(), "started_at": datetime.now(UTC).isoformat(), "kind": kind})
        for _ in range(3):
            if self.files.create("writer.lock", payload):
                return None
            holder = self.lock_holder()
            if self._own(holder, pid):
                self.files.replace("writer.lock", payload)
                return None
            if holder:
                return holder
            stale = f".stale.{uuid.uuid4().hex}"
            try:
                self.files.move("writer.lock", stale)
                self.files.delete(stale)
            except Exception:  # another process has taken it over
                continue
        return self.lock_holder() or {"pid": None, "kind": "unknown"}

    def release(self, pid: int | None = None) -> bool:
        """Give the lock back, where it is this process's own."""
        return self._own(self.lock_holder(), pid) and self.files.delete("writer.lock")

    @contextmanager
    def locked(self, kind: str):
        """Holds the lock; within another ``locked`` of this process that one keeps it."""
        within = self._own(self.lock_holder())
        if holder := None if within else self.acquire(kind):
            raise LockedError(f"a {holder.get('kind')} job (pid {holder.get('pid')}) is writing since {holder.get('started_at')}")
        try:
            yield self
        finally:
            if not within:
                self.release()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except (PermissionError, OverflowError):
        return True
    return True


# -- table algebra: all of it lazy DataFrames --------------------------------------------------------


def latest_per_path(parsed: DataFrame) -> DataFrame:
    """One row a path: the one with the latest modification time."""
    w = Window.partitionBy("file_path").orderBy(F.desc_nulls_last("file_mtime"), F.desc_nulls_last("message_id"))
    return parsed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def to_email_rows(parsed: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Parsed records as rows of ``emails``, without ids."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = F.coalesce(F.when(F.col("attachments").isNotNull(), F.size("attachments")), F.lit(0))
    return parsed.select(
        blank("message_id").alias("message_id"),
        "file_path",
        file_hash("file_path").alias("file_hash"),
        text("subject").alias("subject"),
        text("from").alias("from_addr"),
        text("to").alias("to_addrs"),
        text("cc").alias("cc_addrs"),
        text("bcc").alias("bcc_addrs"),
        "date",
        cut(text("body"), s.body_preview_chars).alias("body_preview"),
        (n > 0).alias("has_attachments"),
        n.cast("int").alias("attachment_count"),
        F.col("file_size").cast("long").alias("file_size"),
        F.current_timestamp().alias("indexed_at"),
        F.col("file_mtime").cast("double").alias("file_mtime"),
        F.lit(EXTRACTION_VERSION).alias("extraction_version"),
        blank("in_reply_to").alias("in_reply_to"),
        blank("references").alias("references_header"),
        (F.col("date_offset") if "date_offset" in parsed.columns else F.lit(None)).cast("int").alias("date_offset"),
        "attachments",
    )


def numbered(df: DataFrame, start: int, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows with ids from ``start`` + 1 on, and how many: counted within range partitions, whose few sizes are summed up
    on the driver, so that no task has to see all rows.  The partitions are written down first: made a second time
    they could be others."""
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), f"ranges-{order[0]}")
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, start
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return df.withColumn("id", F.lit(None).cast("long")), 0
    base = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_p"))
    w = Window.partitionBy("_p").orderBy(*order)
    return ranged.withColumn("id", (base + F.row_number().over(w)).cast("long")).drop("_p"), total - start


def upsert_messages(
    emails: DataFrame, attachments: DataFrame, parsed: DataFrame, s: Settings = SETTINGS, scratch: Scratch | None = None, last_email: int | None = None, last_attachment: int | None = None
) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Emails and attachments after replacing by path: ids stay, new paths get the next ids, every other column
    is the new row's (null ones too), and attachments are replaced as a whole.  ``emails`` may be those of the buckets
    that the paths are in; the last ids given then come with them.  Also how many ids were given."""
    new = new_emails(parsed, s)
    known = emails.select("id", "file_path")
    last = (emails.agg(F.max("id")).first()[0] or 0) if last_email is None else last_email
    last_file = (attachments.agg(F.max("id")).first()[0] or 0) if last_attachment is None else last_attachment
    written, rows, more = numbered_messages(new, known, scratch or Scratch(emails.sparkSession, "upsert"), last, last_file)
    kept = emails.join(new.select("file_path"), "file_path", "left_anti")
    left = attachments.join(written.select(F.col("id").alias("email_id")), "email_id", "left_anti")
    return conform(kept, EMAILS).unionByName(conform(written, EMAILS)), conform(left, ATTACHMENTS).unionByName(conform(rows, ATTACHMENTS)), more


def new_emails(parsed: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The rows of ``emails`` that parsed records make, without ids and with their attachments."""
    rows = to_email_rows(latest_per_path(parsed.where("parse_error is null") if "parse_error" in parsed.columns else parsed), s)
    return rows.withColumn("attachments", F.transform("attachments", lambda a: F.struct(*(a[n].alias(n) for n in ("filename", "content_type", "size", "content_disposition")))))


def numbered_messages(new: DataFrame, known: DataFrame, scratch: Scratch, last_email: int, last_attachment: int) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """New rows with the ids of those known (id, file_path) or the next ones, their attachments (with ``file_hash`` of their
    message), and how many ids were given."""
    joined = new.join(known.select(F.col("id").alias("old_id"), "file_path"), "file_path", "left")
    fresh, n_emails = numbered(joined.where("old_id is null").drop("old_id"), last_email, ["file_path"], scratch)
    again = joined.where("old_id is not null").withColumnRenamed("old_id", "id")
    written = again.unionByName(fresh)
    rows = written.select(F.col("id").alias("email_id"), "file_hash", F.posexplode("attachments").alias("pos", "a"))
    rows = rows.select(
        F.col("email_id"),
        "file_hash",
        "pos",
        F.col("a.filename").alias("filename"),
        F.col("a.content_type").alias("content_type"),
        file_extension("a.filename").alias("file_extension"),
        F.col("a.size").alias("size"),
        F.col("a.content_disposition").alias("content_disposition"),
    )
    # increasing with the message and its position
    rows, n_attachments = numbered(rows, last_attachment, ["email_id", "pos"], scratch)
    return written, rows, (n_emails, n_attachments)


def to_vector_rows(embedded: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Parsed records with ``embedding`` (and ``document``, else a fallback) as rows of ``vectors``."""
    short = lambda c: cut(F.coalesce(F.col(c), F.lit("")), s.metadata_chars)
    fallback = fallback_document("subject", "body", "attachments")
    types = attachment_types("attachments", s)
    n = F.coalesce(F.when(F.col("attachments").isNotNull(), F.size("attachments")), F.lit(0))
    return embedded.select(
        file_hash("file_path").alias("id"),
        "embedding",
        (F.coalesce(F.col("document"), fallback) if "document" in embedded.columns else fallback).alias("document"),
        short("subject").alias("subject"),
        short("from").alias("from"),
        short("to").alias("to"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        short("message_id").alias("message_id"),
        "file_path",
        n.cast("int").alias("attachment_count"),
        F.nullif(types, F.lit("")).alias("attachment_types"),
    )


def upsert_vectors(vectors: DataFrame, embedded: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    new = to_vector_rows(latest_per_path(embedded), s)
    return conform(vectors.join(new.select("id"), "id", "left_anti"), VECTORS).unionByName(conform(new, VECTORS))


def delete_paths(emails: DataFrame, attachments: DataFrame, vectors: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the messages of ``paths(file_path)``."""
    gone = paths.select("file_path").distinct()
    kept = emails.join(gone, "file_path", "left_anti")
    ids = emails.join(gone, "file_path", "left_semi").select(F.col("id").alias("email_id"))
    return kept, attachments.join(ids, "email_id", "left_anti"), vectors.join(gone.select(file_hash("file_path").alias("id")), "id", "left_anti")


Embedder = Callable[[list[str]], list[list[float]]]
