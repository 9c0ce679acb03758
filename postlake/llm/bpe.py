"""BPE encoding and decoding with a public byte-level vocabulary.

A text is encoded as a tree: it is cut into halves down to leaves of ``LEAF`` characters, wherever these end, leaves
are encoded on their own, side by side, by the ranked-merge encoder of the vocabulary file,
and halves are joined.  At a join the tokens around it are encoded again, in a window that grows on
either side until it reaches a place where both sides agree with the whole:

* an edge: a place between characters of two kinds that the vocabulary's pattern never puts into one pre-token (a letter and
  what is none, a digit and what is none, a symbol other than an apostrophe and a letter or digit, any of them and white space
  after it), whatever stands around it.  Pre-tokens on either side depend on nothing beyond it; hence the half's tokens up to
  there (or from there on) are those of the whole.  The ends of the halves are such places too.  A character that
  this Python's tables don't know, and others might, makes no edge.
* within one pre-token that is longer than a leaf (one long word, one long run of symbols or blanks) tokens are
  compared instead: the window grows until its first and last tokens are the very tokens that both sides already had
  there.  For a byte-level BPE whose tokens each encode to themselves, a token sequence is the encoding of
  its bytes exactly when every adjacent pair is the encoding of that pair; where the window agrees with both
  sides, all pairs are ones that an exact encoding held already, so the joined sequence is exact.

Special tokens cut a text before anything else.  Decoding concatenates the bytes of the tokens and reads them as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import texts_of, tidy
from postlake.runtime import ship_package

#: Characters of a leaf.
LEAF = 1_024


class ByteBPE:
    """Encoder and decoder over a rank file ("base64 rank" lines) and its special tokens."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int], threads: int = 2):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special
        self.core = tiktoken.Encoding("postlake", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=special)
        self.pieces = regex.compile(pattern)
        # where no pre-token goes over: after these characters
        self.edge = regex.compile(r"[^\s\x1c-\x1f](?=[ \t\r\n])|\p{L}(?=[^\p{L}\s\x1c-\x1f])|\p{N}(?=[^\p{N}\s\x1c-\x1f])|[^'\p{L}\p{N}\s\x1c-\x1f](?=[\p{L}\p{N}])")
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.threads = ThreadPoolExecutor(threads)
        top = max([*self.ranks.values(), *special.values()]) + 1
        table: list[bytes] = [b""] * top
        for b, r in self.ranks.items():
            table[r] = b
        for s, r in special.items():
            table[r] = s.encode()
        self.bytes_of = table

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it get their own ids."""
        parts = self.split.split(text) if self.split else [text]
        out = [np.array([self.special[p]], np.uint32) if p in self.special else self.encode_tree(p) for p in parts if p]
        return (out[0] if len(out) == 1 else np.concatenate(out)) if out else np.empty(0, np.uint32)

    def _leaf(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, disallowed_special=())

    def encode_tree(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens, by tree concatenation."""
        if len(text) <= LEAF:
            return self._leaf(text)
        level = [text[i : i + LEAF] for i in range(0, len(text), LEAF)]
        nodes = list(zip(level, self.threads.map(self._leaf, level), strict=True))
        while len(nodes) > 1:
            pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = list(self.threads.map(lambda p: self.join_texts(*p), pairs)) + nodes[2 * len(pairs) :]
        return nodes[0][1]

    def _places(self, text: str, start: int = 0) -> Iterator[int]:
        """Places of ``text`` that no pre-token goes over, of those from ``start`` on."""
        for m in self.edge.finditer(text, start):
            if unicodedata.category(text[m.start()]) != "Cn" != unicodedata.category(text[m.end()]):
                yield m.end()

    def _edges(self, left: str, right: str) -> tuple[int, int]:
        """The last place in ``left`` and the first in ``right`` that no pre-token goes over."""
        if next(self._places(left[-1:] + right[:1]), None):
            return len(left), 0
        size = 32
        while True:
            found = list(self._places(left, max(0, len(left) - size)))
            if found or size >= len(left):
                a = found[-1] if found else 0
                break
            size *= 2
        return a, next(self._places(right), len(right))

    def _count(self, ids: np.ndarray, size: int, step: int) -> int:
        """How many ids of one end (step -1: the last ones) make up ``size`` bytes."""
        table, n = self.bytes_of, 0
        for start in range(0, len(ids), 64):
            some = ids[start : start + 64] if step > 0 else ids[::-1][start : start + 64]
            for t in some.tolist():
                if not size:
                    return n
                size -= len(table[t])
                n += 1
        return n

    def join_texts(self, one: tuple[str, np.ndarray], two: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """Two neighbouring texts with their ids as one."""
        (left, a), (right, b) = one, two
        i, j = self._edges(left, right)
        tail, head = left[i:], right[:j]
        if not tail and not head:
            return left + right, np.concatenate([a, b])
        m, n = self._count(a, len(tail.encode()), -1), self._count(b, len(head.encode()), 1)
        a_tail, b_head = a[len(a) - m :], b[:n]
        if len(tail) + len(head) <= LEAF:
            window = self._leaf(tail + head)
        else:
            window = self._long_window(tail, a_tail, head, b_head)
        return left + right, np.concatenate([a[: len(a) - m], window, b[n:]])

    def _long_window(self, tail: str, a: np.ndarray, head: str, b: np.ndarray) -> np.ndarray:
        """Ids of a window without an edge.  Where one pre-token goes over the join and both sides have cut it just
        there, its halves are joined by tokens; else the window is encoded anew."""
        spans = lambda text: [m.span() for m in self.pieces.finditer(text)]
        cut, whole = len(tail), spans(tail + head)
        mine, theirs = spans(tail), [(s + cut, e + cut) for s, e in spans(head)]
        over = next(((s, e) for s, e in whole if s < cut < e), None)
        if over is None or mine[-1] != (over[0], cut) or theirs[0] != (cut, over[1]) or [*mine[:-1], over, *theirs[1:]] != whole:
            return self._leaf(tail + head)
        m, n = self._count(a, len(tail[over[0] :].encode()), -1), self._count(b, len(head[: over[1] - cut].encode()), 1)
        middle = self.join(a[len(a) - m :].tolist(), b[:n].tolist())
        return np.concatenate([a[: len(a) - m], np.array(middle, np.uint32), b[n:]])

    def _bytes(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.core._encode_single_piece(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring stretches as one: windows of 4, 8, 16 ... tokens a side."""
        size = 4
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            window = self._bytes(b"".join(self.bytes_of[t] for t in left[len(left) - a :] + right[:b]))
            left_agrees = a == len(left) or window[0] == left[-a]
            right_agrees = b == len(right) or window[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - a] + window + right[b:]
            size *= 2

    def decode(self, ids) -> str:
        table = self.bytes_of
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> ByteBPE:
    return ByteBPE(ranks_path, pattern, dict(special))


def public_vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Path, pattern and special tokens of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)


def encode_documents(docs: DataFrame, vocabulary=None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, input_ids array<int>, decoded string (the ids decoded again; not without ``decoded``): whole texts.
    With ``digests`` also ids_sha256, of the ids as little-endian 32-bit integers.

    A null text is empty, an empty text has no ids.  Rows are independent: repeated rows, null ids
    and extra columns need no care, and an empty table gives an empty result.  No row is shuffled.
    """
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or public_vocabulary()
    names = ["doc_id", "input_ids", *(["decoded"] if decoded else []), *(["ids_sha256"] if digests else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = load(*vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [bpe.encode(t.decode()) for t in texts_of(part.column("text"))]
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                if digests:
                    columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"doc_id": docs.schema[id_col].dataType.simpleString(), "input_ids": "array<int>", "decoded": "string", "ids_sha256": "string"}
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), ", ".join(f"{n} {kinds[n]}" for n in names))


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts encoded with ``digests``."""
    return encoded.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
