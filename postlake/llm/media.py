"""Media columns: lossless payloads in ISO base media files, and a reader of their boxes.

The writer stores a payload as raw 8-bit grey video: frames of 16 x 12 samples (192 bytes),
one sample-table entry a frame, every 16th frame marked as a keyframe.  The reader walks the nested boxes of
any ISO file and decodes its sample tables: sizes (stsz, stz2), chunks (stsc, stco, co64), times (stts, ctts), sync
samples (stss) and edits (elst), or, in fragmented files, the runs of samples (trex, tfhd, trun).  It yields codec,
duration (that of the samples' times) and the byte ranges and times of the keyframes; it decodes no payload.  Tables of
foreign files are read no further than the file reaches, whatever counts they state, and a track whose tables
contradict each other is left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import texts_of, tidy
from postlake.runtime import ship_package

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
TIMESCALE, TICKS = 25_000, 1_000
KEY_EVERY, CHUNK_FRAMES = 16, 64

# The identity matrix of track and movie headers.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Boxes that hold boxes, by the bytes before their first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"udta": 0, b"mfra": 0}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 2**32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """The payload with blanks appended up to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b" ")


def write_media(payload: bytes) -> bytes:
    """An ISO base media file with ``payload``, a multiple of 192 bytes, as raw grey frames."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    rest = n - (chunks - 1) * CHUNK_FRAMES
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, CHUNK_FRAMES, 1)] if chunks > 1 else []
    if chunks == 1 or rest != CHUNK_FRAMES:
        runs.append((chunks, rest, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHHIII H32sHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, bytes(32), 8, -1))
    duration = n * TICKS
    wide = duration >= 2**32
    times = ">QQIQ" if wide else ">IIII"

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.uint64) * (CHUNK_FRAMES * FRAME)
        big = first + len(payload) >= 2**32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if big else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if big else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(times, 0, 0, TIMESCALE, duration), struct.pack(">HH", 0x55C4, 0), version=int(wide)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=int(wide), flags=3)
        mvhd = full(b"mvhd", struct.pack(times, 0, 0, TIMESCALE, duration), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=int(wide))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    front = 16 if len(payload) + 8 >= 2**32 else 8
    size = len(moov(0))
    if len(moov(len(head) + size + front)) != size:  # offsets became 64-bit
        size = len(moov(len(head) + size + front))
    return head + moov(len(head) + size + front) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of the boxes in a range; stops at a broken size."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def _table(data: memoryview, at: int, end: int, width: int, columns: int = 1, head: int = 4) -> np.ndarray:
    """A counted table of big-endian numbers ``head`` bytes into a box; at most what the box holds."""
    n = min(struct.unpack_from(">I", data, at + head)[0], max(0, end - at - head - 4) // (width * columns))
    return np.frombuffer(data, f">u{width}", n * columns, at + head + 4).astype(np.int64).reshape(-1, columns)


def _sizes(data: memoryview, kind: bytes, a: int, b: int) -> np.ndarray:
    """Sample sizes; of equal ones no more than the file can hold."""
    if kind == b"stz2":
        field, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        raw = np.frombuffer(data, np.uint8, b - a - 12, a + 12)
        if field == 4:
            raw = np.stack([raw >> 4, raw & 15], axis=1).ravel()
        elif field == 16:
            raw = raw[: len(raw) // 2 * 2].view(">u2")
        return raw[:n].astype(np.int64)
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if fixed:
        return np.full(min(n, len(data) // fixed), fixed, np.int64)
    return np.frombuffer(data, ">u4", min(n, (b - a - 12) // 4), a + 12).astype(np.int64)


def _repeated(counts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Run lengths expanded to at most ``n`` values, whatever counts are stated."""
    counts = np.minimum(counts, n)
    need = int(np.searchsorted(np.cumsum(counts), n)) + 1
    return np.repeat(values[:need], counts[:need])[:n]


def _from_tables(t: dict) -> dict | None:
    """Offsets, sizes, times and sync samples of a track's sample tables."""
    sizes, runs, chunks = t["sizes"], t["runs"], t["chunks"]
    firsts = np.append(runs[:, 0] - 1, len(chunks))
    if len(runs) and (firsts[0] != 0 or (np.diff(firsts) < 0).any()):
        return None  # runs of chunks out of order
    per_chunk = np.repeat(runs[:, 1], np.diff(firsts)) if len(runs) else np.zeros(0, np.int64)
    chunk_of = _repeated(per_chunk, np.arange(len(per_chunk)), len(sizes)) if len(per_chunk) else np.zeros(0, np.int64)
    sizes = sizes[: len(chunk_of)]
    before = np.cumsum(sizes) - sizes
    new = np.concatenate([[True], chunk_of[1:] != chunk_of[:-1]]) if len(sizes) else np.zeros(0, bool)
    start = before[np.maximum.accumulate(np.where(new, np.arange(len(sizes)), 0))] if len(sizes) else before
    deltas = _repeated(t["times"][:, 0], t["times"][:, 1], len(sizes)) if len(t.get("times", ())) else np.zeros(0, np.int64)
    deltas = np.pad(deltas, (0, len(sizes) - len(deltas)))
    shifts = _repeated(t["shifts"][:, 0], t["shifts"][:, 1].astype(np.int32), len(sizes)) if len(t.get("shifts", ())) else np.zeros(0, np.int64)
    sync = t["sync"] if "sync" in t else np.arange(len(sizes))
    return {"offsets": chunks[chunk_of] + before - start, "sizes": sizes, "deltas": deltas, "shifts": np.pad(shifts, (0, len(sizes) - len(shifts))).astype(np.int64), "sync": sync[(sync >= 0) & (sync < len(sizes))]}


def _fragment_run(data: memoryview, a: int, b: int, frag: dict, trex: dict, track: dict) -> None:
    """Adds the samples of one trun box to its track."""
    flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    at = a + 8
    if flags & 1:
        frag["next"] = frag["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 4:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    n = min(n, (b - at) // (4 * len(fields)) if fields else len(data) // max(1, frag.get("size", trex.get("size", 0))))
    rows = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, -1)
    column = lambda f, other: rows[:, fields.index(f)] if f in fields else np.full(n, other, np.int64)
    sizes = column(0x200, frag.get("size", trex.get("size", 0)))
    marks = column(0x400, frag.get("flags", trex.get("flags", 0)))
    if first is not None and n:
        marks = marks.copy()
        marks[0] = first
    have = sum(len(x) for x in track["parts"]["sizes"])
    parts = track["parts"]
    parts["offsets"].append(frag["next"] + np.cumsum(sizes) - sizes)
    parts["sizes"].append(sizes)
    parts["deltas"].append(column(0x100, frag.get("delta", trex.get("delta", 0))))
    parts["shifts"].append(column(0x800, 0).astype(np.int32).astype(np.int64))
    parts["sync"].append(have + np.flatnonzero((marks & 0x10000) == 0))  # not marked as dependent
    frag["next"] += int(sizes.sum())


def read_tracks(media: bytes) -> list[dict]:
    """Codec, times, sample and keyframe byte ranges of each track; [] for what is no such file."""
    data = memoryview(media)
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}

    def walk(start: int, end: int, frag: dict, depth: int = 0) -> None:
        for kind, a, b in boxes(data, start, end):
            try:
                read(kind, a, b, frag, depth)
            except (struct.error, ValueError, IndexError, KeyError, OverflowError):
                if tracks and kind not in CONTAINERS:
                    tracks[-1]["broken"] = True

    def read(kind: bytes, a: int, b: int, frag: dict, depth: int) -> None:
        if kind in CONTAINERS:
            if kind == b"trak":
                tracks.append({"parts": {k: [] for k in ("offsets", "sizes", "deltas", "shifts", "sync")}})
            elif kind == b"moof":
                frag = {"moof": a - 8}
            elif kind == b"traf":
                frag = {"moof": frag.get("moof", 0)}
            if depth < 16:
                walk(a + CONTAINERS[kind], b, frag, depth + 1)
        elif kind == b"trex":
            _, number, _, delta, size, flags = struct.unpack_from(">IIIIII", data, a)
            defaults[number] = {"delta": delta, "size": size, "flags": flags}
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
            frag |= {"track": number, "base": frag["moof"]}
            at = a + 8
            for bit, name, form in ((0x1, "base", ">Q"), (0x2, "", ">I"), (0x8, "delta", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
                if flags & bit:
                    value = struct.unpack_from(form, data, at)[0]
                    at += struct.calcsize(form)
                    if name:
                        frag[name] = value
            frag["next"] = frag["base"]
        elif kind == b"trun":
            own = next((t for t in tracks if t.get("number") == frag["track"]), None)
            if own is not None:
                _fragment_run(data, a, b, frag, defaults.get(frag["track"], {}), own)
        elif tracks:
            t = tracks[-1]
            if kind == b"tkhd":
                t["number"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                t["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, b)), "")
            elif kind in (b"stsz", b"stz2"):
                t["sizes"] = _sizes(data, kind, a, b)
            elif kind == b"stss":
                t["sync"] = _table(data, a, b, 4)[:, 0] - 1
            elif kind == b"stsc":
                t["runs"] = _table(data, a, b, 4, 3)
            elif kind == b"stts":
                t["times"] = _table(data, a, b, 4, 2)
            elif kind == b"ctts":
                t["shifts"] = _table(data, a, b, 4, 2)
            elif kind == b"elst":
                wide = data[a] == 1
                n = min(struct.unpack_from(">I", data, a + 4)[0], (b - a - 8) // (20 if wide else 12))
                t["edits"] = [struct.unpack_from(">Qq" if wide else ">Ii", data, a + 8 + i * (20 if wide else 12)) for i in range(n)]
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _table(data, a, b, 4 if kind == b"stco" else 8)[:, 0]

    walk(0, len(data), {})
    out = []
    for t in tracks:
        if t.get("broken") or not {"sizes", "runs", "chunks", "timescale"} <= t.keys():
            continue
        own = _from_tables(t)
        if own is None:
            continue
        n = len(own["sizes"])
        parts = {k: np.concatenate([own[k], *(x + n if k == "sync" else x for x in t["parts"][k])]).astype(np.int64) for k in own}
        inside = (parts["offsets"] >= 0) & (parts["offsets"] + parts["sizes"] <= len(data))
        if not inside.all():
            continue  # samples that the file doesn't hold
        decoded = np.cumsum(parts["deltas"]) - parts["deltas"]
        sync = parts["sync"]
        out.append(
            {
                "handler": t.get("handler", ""),
                "codec": t.get("codec", ""),
                "timescale": t["timescale"],
                "duration": int(parts["deltas"].sum()) or t["duration"],
                "edits": t.get("edits", []),
                "offsets": parts["offsets"],
                "sizes": parts["sizes"],
                "times": decoded + parts["shifts"],
                "keys": np.stack([parts["offsets"][sync], parts["sizes"][sync]], axis=1),
                "key_times": (decoded + parts["shifts"])[sync],
            }
        )
    return out


def read_payload(media: bytes, track: dict) -> bytes:
    """The stored bytes of all samples, in order; samples that follow each other are read as one range."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cut = np.concatenate([[0], np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1, [len(offsets)]])
    return b"".join(media[offsets[a] : offsets[b - 1] + sizes[b - 1]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media binary: each whole text (null: empty) as padded UTF-8 in a media file.

    Equal texts give equal files.  Rows are independent: repeated rows, null ids and extra columns need no
    care, an empty table gives an empty result, and no row is shuffled.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = texts_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_media(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


PROBE = "handler:string,codec:string,duration_s:double,n_samples:long,keyframes:array<struct<offset:long,size:long,time_s:double>>"


def probe_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with ``tracks``: handler, codec, duration, and byte ranges and times of the keyframes of each track.
    A null, empty or foreign file has no tracks."""
    ship_package(df.sparkSession)
    key = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time_s", pa.float64())])
    kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(key))]))

    def described(t: dict) -> dict:
        seconds = lambda x: x / t["timescale"] if t["timescale"] else None
        keys = [{"offset": o, "size": s, "time_s": seconds(at)} for (o, s), at in zip(t["keys"].tolist(), t["key_times"].tolist(), strict=True)]
        return {"handler": t["handler"], "codec": t["codec"], "duration_s": seconds(t["duration"]), "n_samples": len(t["sizes"]), "keyframes": keys}

    own = [f for f in df.schema if f.name != "tracks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[described(t) for t in read_tracks(media or b"")] for media in batch.column(media_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(found, kind)], names=[*(f.name for f in own), "tracks"])

    return df.select(*(F.col(f"`{f.name}`") for f in own)).mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", tracks array<struct<{PROBE}>>")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes string"


def media_features(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests of the payload read back and of the stored form, with a feature string (codec,
    seconds, samples, keyframes and the CRC-32 of the keyframe ranges, 64-bit little-endian) and the ranges
    themselves (``offset+size``, comma-joined).  Of what holds no track payload and features are null."""
    ship_package(stored.sparkSession)
    names = ["doc_id", *(x.split()[0] for x in FEATURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                media = media or b""
                tracks = read_tracks(media)
                about = (len(media), hashlib.sha256(media).hexdigest())
                if not tracks:
                    rows.append((None, None, None, *about, None, None))
                    continue
                t = tracks[0]
                payload = read_payload(media, t)
                seconds = t["duration"] / t["timescale"] if t["timescale"] else 0.0
                feature = f"{t['codec']}|{seconds:.3f}|{len(t['sizes'])}|{len(t['keys'])}|{zlib.crc32(t['keys'].astype('<i8').tobytes()):08x}"
                ranges = ",".join(f"{o}+{s}" for o, s in t["keys"].tolist())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *about, feature, ranges))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {FEATURES}")
