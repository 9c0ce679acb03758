"""Secret scanning: keyword automaton first, anchored expressions at its hits, checksums last.

An Aho-Corasick automaton over the keywords of all kinds reads each text once.  Only where it
reports a keyword is the kind's expression tried, anchored there; walking the hits from left to
right and skipping those inside the last match gives exactly the leftmost non-overlapping
matches, since every match starts with a keyword.  Runs of hexadecimal digits have no keyword:
a run of 16 or more holds a whole aligned window of 8, so only windows of hexadecimal digits
(found with a table lookup over all bytes) are looked at.

Kinds with a checksum inside (classic code-host tokens end in the CRC-32 of what precedes,
card numbers in a Luhn digit) are kept only when it is right.  Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import texts_of, tidy
from postlake.runtime import ship_package

# The alphabet of base-62 checksums, from digit 0 to digit 61.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(found: re.Match) -> bool:
    """The last six characters are the base-62 CRC-32 of the characters between prefix and checksum."""
    body = found.group(1).decode()
    n, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits == body[-6:]


def luhn(found: re.Match) -> bool:
    digits = [int(chr(c)) for c in found.group() if 48 <= c <= 57]
    odd = digits[-1::-2]
    even = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0


@dataclass(frozen=True)
class Kind:
    """keywords: lower case, found in either case; every match of ``pattern`` starts with one of them."""

    name: str
    keywords: tuple[str, ...]
    pattern: bytes
    flags: int = 0
    accept: Callable[[re.Match], bool] = lambda m: True


#: The base kinds, in the order in which spans of one start are listed, then those with a checksum.
BASE = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I, lambda m: len(m.group(2)) >= 12),
    Kind("access", ("akia",), rb"AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 18),
    Kind("hex", (), rb"[0-9a-f]+", 0, lambda m: len(m.group()) >= 16),
)
CHECKED = (
    Kind("code_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])", 0, crc_token),
    Kind("card", ("card",), rb"card(?: number| no)?[.:]?\x20*((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I, luhn),
)

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


class Scanner:
    def __init__(self, kinds: tuple[Kind, ...] = BASE + CHECKED):
        import ahocorasick

        self.kinds = kinds
        self.patterns = [re.compile(k.pattern, k.flags) for k in kinds]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for i, k in enumerate(kinds):
            for word in k.keywords:
                owners.setdefault(word, []).append(i)
        for word, who in owners.items():
            self.automaton.add_word(word, (len(word), who))
        self.automaton.make_automaton()
        self.free = [i for i, k in enumerate(kinds) if not k.keywords]

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, kind index) in bytes, by start, then kind."""
        hits: dict[int, set[int]] = {}
        # one character per byte, so that offsets stay byte offsets
        for end, (size, who) in self.automaton.iter(text.lower().decode("latin-1")):
            for i in who:
                hits.setdefault(i, set()).add(end - size + 1)
        found: list[tuple[int, int, int]] = []
        for i, starts in hits.items():
            self._walk(text, i, sorted(starts), found)
        for i in self.free:
            self._walk(text, i, self._hex_runs(text), found)
        found.sort(key=lambda x: (x[0], x[2]))
        return found

    def _walk(self, text: bytes, i: int, starts: list[int], found: list) -> None:
        at = 0
        match, accept = self.patterns[i].match, self.kinds[i].accept
        for start in starts:
            if start >= at and (m := match(text, start)):
                at = m.end()
                if accept(m):
                    found.append((start, at, i))

    @staticmethod
    def _hex_runs(text: bytes) -> list[int]:
        """Starts of the runs that hold an aligned window of eight hexadecimal digits."""
        usable = len(text) // 8 * 8
        if usable < 8:
            return []
        windows = np.flatnonzero(_HEX[np.frombuffer(text, np.uint8, usable)].reshape(-1, 8).all(axis=1))
        starts, end = [], 0
        for w in windows.tolist():
            at = 8 * w
            if at < end:
                continue
            while at > 0 and _HEX[text[at - 1]]:
                at -= 1
            starts.append(at)
            end = 8 * w + 8
            while end < len(text) and _HEX[text[end]]:
                end += 1
        return starts


@lru_cache(maxsize=4)
def scanner(kinds: tuple[Kind, ...] = BASE + CHECKED) -> Scanner:
    return Scanner(kinds)


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with offsets in code points (every byte but continuation bytes begins one)."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), int(before[e]), k) for s, e, k in spans]


SPAN = "struct<kind:string,start:int,end:int>"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, secrets array<struct<kind, start, end>>: all spans of each whole text, by start, then kind.

    A null text is empty and has none.  Rows are independent: repeated rows, null ids and extra columns
    need no care, an empty table gives an empty result, and no row is shuffled.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        names = [k.name for k in s.kinds]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for t in texts_of(batch.column("text")):
                rows.append([{"kind": names[k], "start": a, "end": b} for a, b, k in code_points(t, s.scan(t))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "secrets"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, secrets array<{SPAN}>")


def span_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    names = [k.name for k in BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*names))
    of = lambda name: F.filter("secrets", lambda s: s["kind"] == name)
    counts = [F.size(of(n)).cast("long").alias(f"n_{n}") for n in names]
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by ``<kind>`` (overlapping spans by that of the first);
    n_chars, where there is such a column of a whole-number type, becomes the new length.  Texts without secrets, and null
    ones, stay as they are."""
    ship_package(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out, sizes = [], []
            for t in batch.column(at).cast(pa.large_binary()).to_pylist():
                spans = s.scan(t) if t else []
                parts, end = [], 0
                for a, b, k in spans:
                    if a >= end:
                        parts += [t[end:a], b"<" + s.kinds[k].name.encode() + b">"]
                    end = max(end, b)
                new = b"".join([*parts, t[end:]]) if spans else t
                out.append(None if new is None else new.decode())
                sizes.append(None if new is None else len(out[-1]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.column(at).type)
            if "n_chars" in batch.schema.names and pa.types.is_integer(batch.schema.field("n_chars").type):
                n = batch.schema.get_field_index("n_chars")
                old = batch.column(n).to_pylist()
                columns[n] = pa.array([size if size is not None else o for size, o in zip(sizes, old, strict=True)], batch.column(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), schema)
