"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 characters
within words, with a blank at either end), in order of frequency; a document's profile is
made alike from its whole text.  The out-of-place distance adds, over the document's
n-grams, how far each stands from its place in the language's profile (the profile's length
where it is missing).  The language with the smallest distance wins.

An n-gram is a number, 21 bits a character, so that n-grams are counted by sorting arrays.
Fitting counts the n-grams of a language within each partition first, so that what is shuffled
are counts, not text; profiles (at most ``languages x size`` n-grams) are the only thing that
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.llm.streams import tidy
from postlake.runtime import ship_package

#: n-grams of a language's profile and of a document's.
SIZE = 400
BLANK = 32
#: Steepness with which distances become likelihoods in the score.
SHARP = 40.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Every code point's own number where it is a letter, else a blank's."""
    table = np.full(0x110000, BLANK, np.uint64)
    found = [c for c in range(0x110000) if chr(c).isalpha()]
    table[found] = found
    return table


def ngram_codes(text: str) -> np.ndarray:
    """Sorted codes of all 1- to 3-grams of the lower-cased words of a text."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = c == BLANK
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = (two[:-1] << np.uint64(21) | c[2:])[c[1:-1] != BLANK]
    return np.sort(np.concatenate([c[c != BLANK], two, three]))


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    if weights is not None:
        return codes[starts], np.add.reduceat(weights, starts) if len(starts) else weights
    return codes[starts], np.diff(np.append(starts, len(codes)))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; equally frequent ones by code."""
    distinct, n = counted(codes)
    if len(distinct) > size:
        keep = n >= np.partition(n, len(n) - size)[len(n) - size]
        distinct, n = distinct[keep], n[keep]
    return distinct[np.argsort(-n, kind="stable")][:size]


def ngram_text(code: int) -> str:
    out = ""
    while code:
        code, c = divmod(code, 1 << 21)
        out = chr(c) + out
    return out


class Profiles:
    """Places of n-grams in the profiles of all languages."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.places = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            p = np.array(profiles[lang], np.uint64)
            self.places[k, np.searchsorted(self.codes, p)] = np.arange(len(p))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, 0 (same order) to 1 (no n-gram in common)."""
        at = np.searchsorted(self.codes, profile)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != profile)] = len(self.codes)
        place = self.places[:, at]
        apart = np.minimum(np.abs(place - np.arange(len(profile))), self.size)
        return np.where(place < 0, self.size, apart).sum(axis=1) / (self.size * len(profile))


def fit_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SIZE) -> dict[str, list[int]]:
    """Profiles of the languages named in ``labelled``: n-gram codes by frequency over all whole texts.
    Null languages and null texts are left out; a language without letters gets no profile."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def merge() -> None:
            nonlocal rows
            rows = 0
            for lang, parts in held.items():
                codes = np.concatenate([p[0] for p in parts])
                order = np.argsort(codes, kind="stable")
                held[lang] = [counted(codes[order], np.concatenate([p[1] for p in parts])[order])]
                rows += len(held[lang][0][0])

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, [(codes, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, found in texts.items():
                    new = counted(ngram_codes(" ".join(found)))
                    held.setdefault(lang, []).append(new)
                    rows += len(new[0])
                if rows > 1_000_000:
                    merge()
                if rows > 500_000:
                    yield from flush()
                    rows = 0
        yield from flush()

    ship_package(labelled.sparkSession)
    texts = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    total = texts.mapInArrow(tidy(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the rank's bound is applied before the shuffle, so a language sends ``size`` rows a task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    profiles: dict[str, list[int]] = {}
    for r in total.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred, score: the nearest language of each whole text, and how sure that is.

    ``score`` is the language's share once distances are turned into likelihoods (0 to 1).  A null text, or
    one without letters, is ``und`` with score 0, as is every text when there is no profile.  Ties go to the
    language first in the alphabet.  Rows are independent: repeated rows, null ids and extra columns need no
    care, an empty table gives an empty result, and no row is shuffled.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, size)
        for batch in batches:
            best, score = [], []
            for text in batch.column("text").to_pylist():
                codes = ngram_codes(text) if text and known.langs else ()
                if not len(codes):
                    best.append("und")
                    score.append(0.0)
                    continue
                d = known.distances(ranked(codes, size))
                k = int(d.argmin())
                best.append(known.langs[k])
                score.append(1 / sum(math.exp(-SHARP * (x - d[k])) for x in d.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
