"""Ingest: batch, incremental and streaming, all through one write path."""

from __future__ import annotations

import logging
import sys
import threading
import time
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import IO, Any

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from postlake.functions.embedtext import embedding_text
from postlake.functions.text import file_hash
from postlake.operators.listing import by_message_id, by_path, stale
from postlake.operators.maintain import migrate_paths, moved, orphans, surplus_rows
from postlake.operators.search import Embed, embed_column, hashing_embedder
from postlake.params import SETTINGS, Settings
from postlake.runtime import Scratch, given, sweep
from postlake.schema import EXTRACTION_VERSION
from postlake.sources import eml
from postlake.sources.mailfiles import confirmed_missing, inside, list_messages, parse_paths, unchanged_removed
from postlake.sources.places import ENDING, look_up, plain_name
from postlake.sources.store import Store, bucket_of


log = logging.getLogger(__name__)


@dataclass
class Run:
    """What a run did: files found, messages written, old paths replaced, files that couldn't be parsed, batches, those
    that failed, seconds and messages a second."""

    candidates: int = 0
    indexed: int = 0
    moved: int = 0
    failed: int = 0
    batches: int = 0
    batch_errors: int = 0
    seconds: float = 0.0
    rate: float = 0.0
    watermark: str | None = None

    def add(self, other: Run) -> None:
        for name in ("indexed", "moved", "failed"):
            setattr(self, name, getattr(self, name) + getattr(other, name))


class StallWatch:
    """Says where a batch run stands once it has made no progress for a while: its phase, the stages that Spark is
    working on, and the driver's Python stacks."""

    def __init__(self, spark: SparkSession, seconds: float, out: IO[str] | None = None):
        self.spark, self.seconds, self.out = spark, seconds, out
        self.phase, self.at, self.dumps = "starting", time.monotonic(), 0
        self._done = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def mark(self, phase: str) -> None:
        self.phase, self.at = phase, time.monotonic()

    def dump(self) -> str:
        tracker = self.spark.sparkContext.statusTracker()
        stages = [f"stage {i}: {info.numCompletedTasks} of {info.numTasks} tasks" for i in tracker.getActiveStageIds() if (info := tracker.getStageInfo(i))]
        names = {t.ident: t.name for t in threading.enumerate()}
        stacks = ["".join([f"thread {names.get(i, i)}\n", *traceback.format_stack(f)]) for i, f in sys._current_frames().items()]
        return "\n".join([f"no progress for {time.monotonic() - self.at:.0f} s while {self.phase}", *stages, *stacks])

    def _watch(self) -> None:
        while not self._done.wait(min(self.seconds, 5)):
            if time.monotonic() - self.at > self.seconds:
                text = self.dump()
                log.warning("%s", text)
                if self.out is not None:
                    print(text, file=self.out, flush=True)
                self.dumps += 1
                self.at = time.monotonic()

    def __enter__(self) -> StallWatch:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._done.set()
        self._thread.join()


class Ingest:
    def __init__(self, store: Store, embed: Embed = hashing_embedder, s: Settings = SETTINGS, report: Callable[[Run], None] | None = None):
        """``report`` is called after every batch."""
        self.store, self.embed, self.s, self.report = store, embed, s, report
        self.spark: SparkSession = store.spark

    def embedded(self, parsed: DataFrame) -> DataFrame:
        text = parsed.withColumn("document", embedding_text("subject", "from", "body", "attachments", self.s))
        return embed_column(text, "document", self.embed)

    def write(self, files: DataFrame) -> Run:
        """Read and parse files (file_path, file_mtime, file_size) and write them in one version.  Parsed and embedded rows are written to the shared folder
        first: several plans read them, and none should parse again.  A message has moved only where its old file isn't
        there."""
        scratch = Scratch(self.spark, "ingest")
        run, _ = self._write_parsed(scratch.keep(parse_paths(self.spark, files, self.s), "parsed"), scratch)
        scratch.drop("parsed", "moved", "embedded")
        return run

    def _write_parsed(self, parsed: DataFrame, scratch: Scratch) -> tuple[Run, DataFrame]:
        """Write a written table of parsed files; also the old paths (file_path) that others replace."""
        good = parsed.where("parse_error is null")
        failed, n = parsed.agg(F.count_if(F.col("parse_error").isNotNull()), F.count_if(F.col("parse_error").isNull())).first()
        run = Run(failed=failed, indexed=n)
        gone = scratch.keep(confirmed_missing(moved(self.store.table("emails"), good)), "moved")
        run.moved = gone.count()
        if run.indexed:
            self.store.upsert(good, scratch.keep(self.embedded(good), "embedded"), self.s, gone if run.moved else None)
        return run, gone

    def write_batches(self, found: DataFrame, phase: str = "indexing") -> Run:
        """Read, parse and write the files of a written table (file_path, file_mtime, file_size) in batches, each a version of
        its own: one that fails is logged and counted, the others stay.  A batch is a range of buckets, so a bucket
        is rewritten by one batch, or few."""
        began, n = time.monotonic(), found.count()
        run = Run(candidates=n)
        buckets = self.store.manifest()["buckets"]
        batches = max(1, -(-n // self.s.batch_messages))
        place = bucket_of(file_hash("file_path"), buckets) + F.pmod(F.xxhash64("file_path"), F.lit(1 << 20)) / float(1 << 20)
        dealt = found.withColumn("_batch", F.floor(place * (batches / buckets)).cast("int"))
        with StallWatch(self.spark, self.s.stall_seconds) as watch:
            for i in range(batches if n else 0):
                watch.mark(f"{phase} batch {i + 1} of {batches}")
                try:
                    run.add(self.write(dealt.where(F.col("_batch") == i).drop("_batch")))
                except Exception:
                    log.warning("%s: batch %d of %d failed; the others stay", phase, i + 1, batches, exc_info=True)
                    run.batch_errors += 1
                run.batches, run.seconds = i + 1, time.monotonic() - began
                run.rate = run.indexed / run.seconds if run.seconds else 0.0
                log.info("%s: batch %d of %d, %d written, %d failed, %.1f/s, %.0f s left", phase, i + 1, batches, run.indexed, run.failed, run.rate, run.seconds / (i + 1) * (batches - i - 1))
                if self.report:
                    self.report(run)
        return run

    def index(self, directory: str, incremental: bool = True, skip_unchanged: bool = True, limit: int | None = None) -> Run:
        """Index a directory.  Incrementally, only files since the watermark less an overlap for late ones are
        listed; files that the index holds with their modification time are dropped before they are read.  The
        watermark advances once everything is written, so what a failed batch left out is found again."""
        began = datetime.now(UTC)
        with self.store.locked("index"):
            mark = self.store.watermark() if incremental else None
            after = mark - timedelta(seconds=self.s.overlap_seconds) if mark else None
            found = list_messages(self.spark, directory, after).where(F.col("file_size") <= self.s.largest_message).where(inside(directory))
            if skip_unchanged:
                found = unchanged_removed(found, self.store.table("emails"))
            if limit is not None:
                found = found.orderBy("file_path").limit(limit)
            scratch = Scratch(self.spark, "candidates")
            found = scratch.keep(found, "files")
            self._room_for(found.count())
            run = self.write_batches(found)
            if limit is None and not run.batch_errors:
                self.store.set_state("scan_watermark", began.isoformat())
                run.watermark = began.isoformat()
            scratch.drop("files")
            return run

    def _room_for(self, more: int) -> None:
        """As many buckets as keep each to some number of messages; they double, so that the index is seldom rewritten."""
        m = self.store.manifest()
        buckets = m["buckets"]
        while (m["next"]["emails"] + more) / buckets > self.s.bucket_messages:
            buckets *= 2
        if buckets != m["buckets"]:
            self.store.rebucket(buckets)

    def _file_row(self, path: str, seen) -> DataFrame | None:
        """A message file that was looked up, as a row of a listing; none for what is no message file."""
        if seen.type != FileType.File or not path.endswith(ENDING):
            return None
        return given(self.spark, [(path, seen.mtime_ns // 1_000_000 / 1000, seen.size)], "file_path string, file_mtime double, file_size long")

    def index_file(self, path: str) -> dict[str, Any]:
        """One file: indexed, moved, skipped, not_found or failed."""
        p = plain_name(path)
        seen = look_up(p)
        if seen.type == FileType.NotFound:
            return {"status": "not_found", "file_path": p, "message": "There is no such file."}
        row = self._file_row(p, seen)
        if row is None or seen.size > self.s.largest_message:
            return {"status": "failed", "file_path": p, "message": "The file is no message, or too large."}
        known = by_path(self.store.table("emails", [p]), p).select("file_mtime").first()
        if known is not None and known[0] == row.first()["file_mtime"]:
            return {"status": "skipped", "file_path": p, "message": "The index holds it as it is."}
        with self.store.locked("index-file"):
            run = self.write(row)
        status = "failed" if run.failed or not run.indexed else "moved" if run.moved else "indexed"
        return {"status": status, "file_path": p, "message": f"{run.indexed} indexed, {run.moved} moved, {run.failed} failed"}

    def index_files(self, paths: DataFrame) -> DataFrame:
        """file_path, status of any number of files by name (file_path, as path or URI), written in one version: ``not_found``,
        ``failed`` (no message file, too large, or not to be parsed), ``skipped`` (the index holds it as it is), ``moved`` (it
        replaces another path that is gone) or ``indexed``.  The executors look the files up; names that repeat count once."""
        scratch = Scratch(self.spark, "named-files")
        most = self.s.largest_message

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = [plain_name(p) for p in batch.column("file_path").to_pylist()]
                seen = [look_up(p) for p in names]
                files = [i.type == FileType.File and n.endswith(ENDING) and i.size <= most for n, i in zip(names, seen, strict=True)]
                state = ["not_found" if i.type == FileType.NotFound else "found" if ok else "failed" for i, ok in zip(seen, files, strict=True)]
                columns = [names, state, [i.mtime_ns // 1_000_000 / 1000 if ok else None for i, ok in zip(seen, files, strict=True)], [i.size if ok else None for i, ok in zip(seen, files, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["file_path", "state", "file_mtime", "file_size"])

        asked = paths.select("file_path").where("file_path is not null").distinct().mapInArrow(look, "file_path string, state string, file_mtime double, file_size long")
        with self.store.locked("index-files"):
            emails = self.store.table("emails")
            known = emails.select("file_path", F.col("file_mtime").alias("known"))
            state = F.when((F.col("state") == "found") & (F.col("file_mtime") == F.col("known")), "skipped").otherwise(F.col("state"))
            found = scratch.keep(asked.dropDuplicates(["file_path"]).join(known, "file_path", "left").withColumn("state", state).drop("known"), "found")
            parsed = scratch.keep(parse_paths(self.spark, found.where("state = 'found'"), self.s), "parsed")
            _, gone = self._write_parsed(parsed, scratch)
            old = emails.join(gone, "file_path", "left_semi").select("message_id").distinct().withColumn("moved", F.lit(True))
            read = parsed.select("file_path", F.col("parse_error").isNotNull().alias("bad"), "message_id").join(old, "message_id", "left")
            status = F.when(F.col("state") != "found", F.col("state")).when(F.col("bad").isNull(), "not_found").when(F.col("bad"), "failed").when(F.col("moved"), "moved").otherwise("indexed")
            out = scratch.keep(found.join(read, "file_path", "left").select("file_path", status.alias("status")), "statuses")
        scratch.drop("found", "parsed", "moved", "embedded")
        return out

    def reextract(self, limit: int | None = None) -> dict[str, int]:
        """Parse again what an older version extracted (with a limit, those of the smallest ids), in batches;
        resumable, since each batch is written with its version."""
        with self.store.locked("reextract"):
            rows = stale(self.store.table("emails"), EXTRACTION_VERSION)
            rows = rows.orderBy("id").limit(limit) if limit is not None else rows
            scratch = Scratch(self.spark, "reextract")
            wanted = scratch.keep(rows.select("file_path", "file_mtime", "file_size"), "files")
            run = self.write_batches(wanted, "reextracting")
            n = run.candidates
            missing = confirmed_missing(wanted).count() if run.indexed + run.failed < n else 0
            scratch.drop("files")
            return {"stale": n, "ok": run.indexed, "parse_failed": run.failed, "missing": missing, "batch_errors": run.batch_errors, "seconds": round(run.seconds, 3), "rate": round(run.rate, 3)}

    def reextract_one(self, file_path: str | None = None, message_id: str | None = None) -> dict[str, Any]:
        """Parse one indexed message again; what its version and the beginning of its body were, and are."""
        if not file_path and not message_id:
            raise ValueError("a file_path or a message_id is needed")
        emails = self.store.table("emails")
        row = (by_path(emails, plain_name(file_path)) if file_path else by_message_id(emails, message_id)).first()
        if row is None:
            return {"status": "not_indexed", "file_path": file_path or ""}
        found = self._file_row(row["file_path"], look_up(row["file_path"]))
        if found is None:
            return {"status": "missing_file", "file_path": row["file_path"]}
        with self.store.locked("reextract"):
            run = self.write(found)
        if not run.indexed:
            return {"status": "parse_failed", "file_path": row["file_path"]}
        new = by_path(self.store.table("emails", [row["file_path"]]), row["file_path"]).first()
        n = self.s.snippet_chars
        return {"status": "ok", "file_path": row["file_path"], "version": [row["extraction_version"], new["extraction_version"]], "before": (row["body_preview"] or "")[:n], "after": (new["body_preview"] or "")[:n]}

    def dedup(self) -> dict[str, int]:
        """Delete all but the newest row of each message id."""
        with self.store.locked("dedup"):
            scratch = Scratch(self.spark, "dedup")
            gone = scratch.keep(surplus_rows(self.store.table("emails")).select("file_path", "message_id"), "gone")
            n, groups = gone.count(), gone.select("message_id").distinct().count()
            if n:
                self.store.delete(gone)
            scratch.drop("gone")
            return {"removed": n, "groups": groups}

    def prune(self, directory: str, dry_run: bool = False) -> dict[str, int]:
        """Delete rows whose file is gone: it is neither found by a scan of the directory nor there when looked
        for.  A directory that is missing or holds no message is refused: it is more likely not mounted than empty."""
        if look_up(directory).type != FileType.Directory:
            raise ValueError(f"{directory} is no directory")
        scratch = Scratch(self.spark, "prune")
        present = scratch.keep(list_messages(self.spark, directory).select("file_path"), "present")
        if present.isEmpty():
            raise ValueError(f"{directory} holds no messages; nothing is pruned")
        with self.store.locked("prune"):
            gone = scratch.keep(confirmed_missing(orphans(self.store.table("emails"), present)), "gone")
            n = gone.count()
            if n and not dry_run:
                self.store.delete(gone)
            return {"missing": n, "removed": 0 if dry_run else n}

    def migrate(self, old: str, new: str) -> dict[str, int]:
        """Move indexed paths to another prefix; embeddings are kept, a second run changes nothing."""
        with self.store.locked("migrate-paths"):
            emails, vectors = self.store.table("emails"), self.store.table("vectors")
            old, new = plain_name(old), plain_name(new)
            n = emails.where(F.startswith(F.col("file_path"), F.lit(old.rstrip("/") + "/"))).count()
            if n:
                e, v = migrate_paths(emails, vectors, old, new)
                self.store.commit(emails=e, attachments=self.store.table("attachments"), vectors=v)
            return {"moved": n}

    def index_vectors(self) -> dict[str, int]:
        """Build the vector index anew.  Searches use it from then on; what is written later is looked at beside it."""
        with self.store.locked("index-vectors"):
            built = self.store.build_vector_index()
            return {"vectors": int(built.n.sum()), "cells": len(built.n)}

    def vacuum(self, hours: float = 24) -> dict[str, int]:
        """Remove what old versions alone hold, and scratch tables of drivers that were killed."""
        with self.store.locked("vacuum"):
            return {"removed": self.store.vacuum(hours), "scratch": sweep(self.spark, max(hours, 48))}

    def stream(self, directory: str, checkpoint: str, available_now: bool = True):
        """The same ingest as a streaming query: the source goes on from the moment of its last batch, looking back for late
        files, of which those that the index holds are dropped.  Each micro-batch is one version, and one that
        fails is tried again as a whole."""
        eml.register(self.spark)
        files = self.spark.readStream.format("eml").option("content", "false").option("maxBytes", str(self.s.largest_message)).option("overlapSeconds", str(self.s.overlap_seconds)).load(plain_name(directory))

        def write(batch: DataFrame, _: int) -> None:
            with self.store.locked("stream"):
                scratch = Scratch(self.spark, "streamed")
                found = scratch.keep(unchanged_removed(batch.where(inside(directory)), self.store.table("emails")), "files")
                if not found.isEmpty():
                    self.write(found)
                scratch.drop("files")

        w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of each streaming query, and says which have been silent for long."""

    def __init__(self) -> None:
        self.progress: dict[str, dict[str, Any]] = {}

    def onQueryStarted(self, event) -> None:
        self._seen(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._seen(str(p.id), p.numInputRows, p.batchId, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._seen(str(event.id), 0)

    def onQueryTerminated(self, event) -> None:
        self.progress.pop(str(event.id), None)

    def _seen(self, query: str, rows: int, batch: int = -1, rate: float | None = None) -> None:
        old = self.progress.get(query, {"rows": 0, "batch": -1, "rate": None})
        self.progress[query] = {"at": datetime.now(UTC), "rows": old["rows"] + rows, "batch": max(old["batch"], batch), "rate": rate}

    def stalled(self, seconds: float = 300) -> list[str]:
        now = datetime.now(UTC)
        return [q for q, p in self.progress.items() if (now - p["at"]).total_seconds() > seconds]


def late_candidates(events: DataFrame, watermark, overlap_seconds: int, time: str = "ts") -> DataFrame:
    """Rows since a watermark less the allowance for late ones."""
    return events.where(F.col(time) > F.lit(watermark).cast("timestamp") - F.make_dt_interval(secs=F.lit(overlap_seconds)))


def dedup_stream(events: DataFrame, key: list[str], time: str = "ts", lateness: str = "24 hours") -> DataFrame:
    """Streaming counterpart of the overlap: each key once within the allowance."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)
