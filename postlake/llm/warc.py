"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: payload digests (SHA-256) are grouped, map-side combined, and only payloads that more than one page has
are kept, with the smallest page id of each: that record is a response, the others revisit it.  Responses are
written first; revisits then name the record that they refer to.  Every task writes its records, each a gzip
member of its own, to a new file in the shared folder and emits one index row per record: file, offset, length,
URL, digest, kind.  A record's id comes of its file's name and its offset, so rows that repeat each other have ids
of their own.  A task that is run again writes another file; only the rows of the attempt that succeeded
reach the index, so left-over files are never read.

Reading: index rows are chosen (any DataFrame filter), dealt by stretches of a file to tasks in proportion to
the bytes to read, sorted by offset, and neighbouring ranges are joined into one read each before records are parsed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import texts_of, tidy
from postlake.runtime import Scratch, ship_package

INDEX = "file string, offset long, length long, url string, digest string, kind string, page_id long, payload_bytes long, refers_to long, record_id string, refers_to_record string, payload_sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, record_id string, refers_to_record string"
#: Stretch of a file that goes to one reading task, largest gap within one read, most bytes of one read, records from
#: which a core has work, size at which a file is closed.
STRETCH, GAP, READ, LEAST, FILE_BYTES = 16 << 20, 64 << 10, 8 << 20, 1_000, 1 << 30
# Date of all records, profile of revisits.
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def uri_of(scratch: Scratch, name: str) -> str:
    """The URI of a folder in the shared folder, as every executor can open it."""
    jvm, jsc = scratch.spark.sparkContext._jvm, scratch.spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(scratch.path(name))
    found = path.getFileSystem(jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, page_id, url: str | None, size: int, digest: str, payload: bytes = b"", refers_to=None, refers_to_record=None, refers_to_url=None) -> bytes:
    """One record: header, HTTP block (with the payload, but in a revisit), two empty lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    uri = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + uri(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:uuid:{refers_to_record}>", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
        if refers_to_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + uri(refers_to_url))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str):
    """Rows (page_id, url, sha, and html or what a revisit says instead) to records in new files, as index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        try:
            for batch in batches:
                rows = []
                response = "html" in batch.schema.names
                payloads = texts_of(batch.column("html")) if response else [b""] * batch.num_rows
                for r, payload in zip(batch.drop_columns(["html"] if response else []).to_pylist(), payloads, strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    own, kind = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{at}")), "response" if response else "revisit"
                    size = len(payload) if response else r["size"]
                    digest = digest_of(payload) if response else base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    to, to_record = r.get("refers_to"), r.get("refers_to_record")
                    member = gzip_member(record(kind, own, r["page_id"], r["url"], size, digest, payload, to, to_record, r.get("refers_to_url")))
                    out.write(member)
                    rows.append((name, at, len(member), r["url"], digest, kind, r["page_id"], size, to, own, to_record, r["sha"]))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return tidy(run)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in ``folder`` (a URI that executors share); returns the index, written tables.

    A null html is an empty payload, a null url gives a record without target.  A null id is always a
    response, as is every row of the smallest id where rows repeat an id and payload (revisits refer to one of
    these records).  Payloads of fewer than ``min_bytes`` bytes are never revisits.  An empty table writes nothing and
    has an empty index.  Payloads meet only those that more than one page has, and Spark broadcasts these while they
    are few.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    source = source.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    repeated = source.select("page_id", "sha", "size").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("size").alias("s"))
    repeated = scratch.keep(repeated.where((F.col("n") > 1) & (F.col("s") >= min_bytes) & F.col("first").isNotNull()).select("sha", "first"), "repeated")
    again = F.coalesce(F.col("first") < F.col("page_id"), F.lit(False))
    dealt = source.join(repeated, "sha", "left")
    responses = scratch.keep(dealt.where(~again).select("page_id", "url", "sha", "html").mapInArrow(_writer(folder), INDEX), "index-responses")
    heads = responses.join(repeated, (F.col("page_id") == F.col("first")) & (F.col("payload_sha256") == F.col("sha")))
    heads = scratch.keep(heads.groupBy("payload_sha256").agg(F.min(F.struct("record_id", "url")).alias("h")).select(F.col("payload_sha256").alias("sha"), F.col("h.record_id").alias("refers_to_record"), F.col("h.url").alias("refers_to_url")), "heads")
    revisits = dealt.where(again).select("page_id", "url", "sha", "size", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.col("first").alias("refers_to")).join(heads, "sha")
    revisits = scratch.keep(revisits.mapInArrow(_writer(folder), INDEX), "index-revisits")
    scratch.drop("repeated", "heads")
    return responses.unionByName(revisits)


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (file, offset, length), sorted, that are near enough to be read at once."""
    run: list[tuple[str, int, int]] = []
    for r in rows:
        if run and (r[0] != run[0][0] or r[1] > run[-1][1] + run[-1][2] + GAP or r[1] + r[2] - run[0][1] > READ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the chosen index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null in a revisit, and without ``payloads``), record_id, refers_to_record.  A payload that doesn't match
    its digest raises an error, whether it is returned or not."""
    spark = index.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        uuid_of = lambda x: None if x is None else x.removeprefix("<urn:uuid:").removesuffix(">")
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for group in ranges(rows):
                if group[0][0] != name:
                    if source is not None:
                        source.close()
                    name = group[0][0]
                    source = store.open_input_file(f"{root}/{name}")
                start = group[0][1]
                data = memoryview(source.read_at(group[-1][1] + group[-1][2] - start, start))
                out = []
                for _, offset, length in group:
                    fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                        raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                    number = lambda key, f=fields: int(f[key]) if key in f else None
                    text = payload.decode() if payloads and kind == "response" else None
                    out.append((number("x-page-id"), fields.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page"), text, uuid_of(fields["warc-record-id"]), uuid_of(fields.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    total, n = index.agg(F.sum("length"), F.count(F.lit(1))).first()
    # a number of its own: index rows are short, and adaptive execution would put them all into one task
    tasks = max(1, -(-(total or 0) // STRETCH), min(spark.sparkContext.defaultParallelism, n // LEAST))
    stretch = F.floor(F.col("offset") / F.lit(STRETCH))
    chosen = index.select("file", "offset", "length").withColumn("stretch", stretch).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(tidy(run), RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """The records with the payloads of revisits, which are those of the responses that WARC-Refers-To names (null
    where that isn't among ``records``)."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    revisits = records.where("record_type <> 'response'").join(responses, F.col("refers_to_record") == F.col("_id"), "left")
    return records.where("record_type = 'response'").unionByName(revisits.withColumn("payload", F.col("_payload")).drop("_id", "_payload"))
