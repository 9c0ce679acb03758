"""Quality selection by importance resampling over hashed n-grams.

Two generative models over hashed features are counted: the target's from a bounded sample of
labelled good documents (``FIT``), the raw one from every document; each document counts alike,
whatever its length (its counts are scaled to ``LENGTH`` features).  Features are byte trigrams and word
bigrams, each in 2**16 buckets; bigrams of a word with itself share a bucket, so that a text that says one word again
and again is unlike the target whatever the word.  A document's log importance weight is the sum of its features'
log ratios; documents are drawn without replacement by Gumbel top-k: the k largest of weight plus Gumbel noise, the
noise being a hash of the document's id, so that a run that is repeated draws the same.

k is given, or is the number of documents whose weight is above a cut.  The cut is placed on a second
bounded sample of labelled good documents and one of labelled bad ones (``CALIBRATE`` each): where the
share of good ones lost, weighed ``WEIGHT`` times, and that of bad ones kept are smallest together,
less ``MARGIN``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import Remembered, texts_of, tidy
from postlake.runtime import Scratch, ship_package

BITS = 16
BUCKETS = 2 << BITS
#: The first bucket of word bigrams: that of equal words.
SAME = 1 << BITS
#: Labelled good documents to fit the target on, and labelled ones to place the cut by (smallest hashes of ids first).
FIT, CALIBRATE = 16_384, 4_096
#: Pseudo-counts of a bucket in either model, cost of a good document lost to a bad one kept, nats below the best cut.
SMOOTH, WEIGHT, MARGIN = 10.0, 30.0, 2.0
LENGTH = 1_000.0
#: Counts are whole multiples of 1 / UNIT, so that their sums are the same in any order; texts counted at once, bins.
UNIT, TEXTS, BINS = 1 << 16, 200, 4_096


_words = Remembered(xxhash.xxh32_intdigest)


def features(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text (with a blank at either end) and of its word bigrams."""
    x = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    three = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    words = text.split()
    if len(words) < 2:
        return three
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    two = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
    two = np.where(w[:-1] == w[1:], 0, two).astype(np.uint32) + np.uint32(SAME)
    return np.concatenate([three, two])


def scale_of(n: int) -> int:
    """What a feature of a text with ``n`` of them counts, in units."""
    return max(1, round(LENGTH * UNIT / n))


def fit_log_ratios(docs: DataFrame, target_ids: list[int], id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket.  The raw counts cover all documents; only sums by bucket are shuffled."""
    ship_package(docs.sparkSession)
    wanted = np.array(sorted(target_ids), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.isin(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), wanted) & ~np.asarray(batch.column("doc_id").is_null())
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [features(t) for t in texts_of(part.column("text"))]
                for counts, which in ((raw, np.arange(len(found))), (target, np.flatnonzero(good[at : at + TEXTS]))):
                    some = [found[i] for i in which.tolist() if len(found[i])]
                    if some:
                        sizes = [len(f) for f in some]
                        # whole numbers well below 2 ** 53: exact
                        counts += np.bincount(np.concatenate(some), np.repeat([scale_of(n) for n in sizes], sizes), BUCKETS).astype(np.int64)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(count, "postlake.llm.quality._words"), "bucket int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"] / UNIT, r["target"] / UNIT
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTH) / (expected + SMOOTH))


def with_weights(docs: DataFrame, ratios: np.ndarray, text_col: str, name: str) -> DataFrame:
    """All columns, and the log importance weight of each whole text as column ``name``."""
    ship_package(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for text in texts_of(batch.column(batch.schema.get_field_index(text_col))):
                weights.append(float(ratios[features(text)].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run, "postlake.llm.quality._words"), type(schema)(list(schema.fields)).add(name, "double"))


def gumbel_key(weight: str, id_col, temperature: float = 1.0, seed: int = 5):
    """Weight plus Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col(weight) - F.lit(temperature) * F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int]:
    """(key, id) of the k-th row of ``keys(key, id)`` by key descending, then id.

    Histograms of BINS bins narrow the range until few rows are left; only those and the bins
    reach the driver.
    """
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return float("inf"), 0
    if k >= n:
        return float("-inf"), 0
    above = 0
    while True:
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / BINS
        if n <= BINS or width <= 0 or lo + width == lo:
            rows = inside.orderBy(F.desc("key"), "id").limit(k - above).collect()
            return rows[-1]["key"], rows[-1]["id"]
        bin_of = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        found = inside.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in found:
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]


@dataclass(frozen=True)
class Selection:
    """What decides: log ratios, and the last (key, id) that is kept."""

    ratios: np.ndarray
    key: float
    last: int


def _labelled_ids(labels: DataFrame, quality: int, most: int) -> list[int]:
    """Ids with a quality (of several the lowest), by hash; at most ``most``."""
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.min("quality").alias("q")).where(F.col("q") == quality)
    return [r[0] for r in rows.orderBy(F.xxhash64("i"), "i").select("i").limit(most).collect()]


def split_good(labels: DataFrame) -> tuple[list[int], list[int]]:
    """Good documents to fit on, and others to calibrate with."""
    ids = _labelled_ids(labels, 1, FIT + CALIBRATE)
    cut = len(ids) * FIT // (FIT + CALIBRATE)
    return ids[:cut], ids[cut:]


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which documents are kept (the lowest of equally good ones)."""
    if not len(good):
        return float("-inf")
    cuts = np.sort(good)
    lost = np.searchsorted(cuts, cuts, "left") / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cuts, "left") / len(bad) if len(bad) else np.zeros(len(cuts))
    return float(cuts[np.argmin(WEIGHT * lost + kept)]) - MARGIN


def fit_selection(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Selection, DataFrame]:
    """The selection, and a written table of doc_id and log_weight.  Without good labels all weights are 0."""
    scratch = Scratch(docs.sparkSession, "quality")
    fit, calibrate = split_good(labels)
    ratios = fit_log_ratios(docs, fit, id_col, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_weights(source, ratios, "text", "log_weight").select("doc_id", "log_weight")
    scored = scratch.keep(scored, "weights")
    if k is None:
        bad = _labelled_ids(labels, 0, CALIBRATE)
        ids = docs.sparkSession.createDataFrame([(i, True) for i in calibrate] + [(i, False) for i in bad], "doc_id long, good boolean")
        held = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("good"), F.min("log_weight")).collect()  # at most 2 * CALIBRATE rows
        held = [r[1:] for r in held]
        cut = best_cut(np.array([r[1] for r in held if r[0]]), np.array([r[1] for r in held if not r[0]]))
        k = scored.where(F.col("log_weight") >= cut).count()
    keys = scored.select(gumbel_key("log_weight", "doc_id").alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    key, last = kth_largest(keys, k)
    return Selection(ratios, key, last), scored


def _chosen(chosen: Selection, weight: str, doc_id):
    key, i = gumbel_key(weight, doc_id), F.coalesce(doc_id, F.lit(-(2**63)))
    return (key > F.lit(chosen.key)) | ((key == F.lit(chosen.key)) & (i <= F.lit(chosen.last)))


def quality_scores(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, kept for every document.

    Null and empty texts have weight 0.  Rows that repeat an id and text share their noise, so both are kept
    or neither (k may be passed by such ties).  An empty table gives an empty result; without good labels all
    weights are 0 and, unless k is given, all documents are kept.  Extra columns are ignored.
    """
    chosen, scored = fit_selection(docs, labels, k, id_col, text_col)
    return scored.select("doc_id", "log_weight", _chosen(chosen, "log_weight", F.col("doc_id")).alias("kept"))


def select_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their columns.  Texts are scored again rather than shuffled."""
    chosen, _ = fit_selection(docs, labels, k, id_col, text_col)
    name = "log_weight"
    while name in docs.columns:
        name += "_"
    return with_weights(docs, chosen.ratios, text_col, name).where(_chosen(chosen, name, F.col(id_col).cast("long"))).drop(name)
