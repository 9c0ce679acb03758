"""Mixing documents to target weights with soft domain membership.

A classifier is trained on a bounded sample of a table that labels some documents with a domain
(``FIT`` documents, those with the smallest hashes): softmax regression over the ``CHOSEN`` hashed words, runs of
punctuation and rates of repeated words and capitals that say most about a domain (by the G statistic, if ``OFTEN``
documents or more have them).  Words of few documents would be learnt by heart and tell nothing about others.  It
predicts for every document p(domain | text).  Document rates r >= 0 are then fitted so that the
expected tokens of each domain, sum over documents of r * tokens * p(domain), match target weights:

    minimise  sum_k (A_k(r) - T_k)^2 / S_k      A_k(r) = sum_d r_d t_d p_dk,  S_k = A_k(1)

by projected gradient steps from r = 1, in the metric that weighs a document with its tokens:
r_d <- max(0, r_d - sum_k p_dk g_k).  The plain gradient is g_k = (A_k - T_k) / S_k: the matrix of this problem is
stochastic, its largest eigenvalue is 1, so the step 1 descends.  Where posteriors overlap that is slow, so the gradient
is scaled by the inverse of C + damping * S, C being the K x K curvature over the documents that have a rate: little
damping meets the targets at once unless rates become 0.  A scaled step that wins next to nothing is taken back and damped
more; where none wins any more, as at targets that no rates meet, plain steps follow, with momentum that begins anew
whenever it leads upwards.  They end at the least squares optimum: where a step no longer moves the rates (the projected
gradient is the step itself, so that is the optimality condition).  Each step is
one distributed pass over (tokens, posteriors), which returns K totals and K x K curvatures; a document's rate
depends only on its posteriors and the K + 1 numbers of each step so far, so those few numbers are all the state
there is: a lost executor recomputes rates from them.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from postlake.llm.streams import Remembered, texts_of, tidy
from postlake.runtime import Scratch, ship_package

#: Labelled documents to train on, hashed features, passes over the sample.
FIT, WIDTH, EPOCHS = 16_384, 1 << 16, 20
#: Features that are used, documents that each is in at least, pull of the weights towards 0.
CHOSEN, OFTEN, DECAY = 2_048, 4, 0.01
#: The largest relative miss of a target at which steps end, the share of the objective that a scaled step
#: must still win, and the least damping.
TOLERANCE, STILL, LEAST = 1e-4, 1e-2, 1e-9
#: The mean move of a rate (root of the mean square over tokens) in a plain step at which steps end, their greatest number,
#: and after how many scaled ones are tried again.
MOVE, MOST, EVERY = 2e-5, 300, 10
log = logging.getLogger(__name__)


_buckets = Remembered(lambda word: xxhash.xxh32_intdigest(word) % WIDTH)


PUNCTUATION = b".,;:!?\"'()#$%&*-=_+~/\\|<>@^"
_TAIL = frozenset(PUNCTUATION)
_CAPITALS = bytes(range(65, 91))


def word_features(text: bytes) -> tuple[np.ndarray, int]:
    """Buckets of a text's distinct lower-cased words (without punctuation at either end), of the runs of punctuation
    that end them, and of its rates of repeated words and of capitals; and the number of words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64), 0
    whole = set(words)
    found = {w.strip(PUNCTUATION) for w in whole}
    found |= {b"\1" + w[len(w.rstrip(PUNCTUATION)) :] for w in whole if w[-1] in _TAIL}
    found.add(b"\2%d" % (10 * sum(map(eq, words, words[1:])) // len(words)))
    found.add(b"\3%d" % (10 * (len(text) - len(text.translate(None, _CAPITALS))) // len(text)))
    return np.unique(np.fromiter(map(_buckets.__getitem__, found), np.int64, len(found))), len(words)


@dataclass(frozen=True)
class Classifier:
    """Domains, weights (WIDTH x K, zero for features that aren't used) and biases."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, words: np.ndarray) -> np.ndarray:
        if not self.domains:
            return np.empty(0)
        s = self.bias + self.weights[words].sum(axis=0, dtype=np.float64)
        e = np.exp(s - s.max())
        return e / e.sum()


def chosen_features(samples: list[np.ndarray], y: np.ndarray, k: int) -> np.ndarray:
    """The features that tell some domain best from the others, equally good ones by number."""
    n, sizes = len(y), np.bincount(y, minlength=k)
    counts = np.zeros((WIDTH, k))
    for words, label in zip(samples, y.tolist(), strict=True):
        counts[words, label] += 1
    total = counts.sum(axis=1)
    term = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    best = np.zeros(WIDTH)
    for c in range(k):
        with_, without = counts[:, c], sizes[c] - counts[:, c]
        g = term(with_, total * sizes[c] / n) + term(total - with_, total * (n - sizes[c]) / n) + term(without, (n - total) * sizes[c] / n) + term(n - total - without, (n - total) * (n - sizes[c]) / n)
        best = np.maximum(best, g)
    best[total < OFTEN] = 0
    order = np.argsort(-best, kind="stable")[:CHOSEN]
    return order[best[order] > 3]


def train(samples: list[np.ndarray], labels: list[str]) -> Classifier:
    """Softmax regression by AdaGrad over the chosen features; the same samples in one order give the same weights."""
    domains = tuple(sorted(set(labels)))
    k, n = len(domains), len(labels)
    weights, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k)
    if k < 2:
        return Classifier(domains, weights, bias)
    y = np.array([domains.index(x) for x in labels])
    used = chosen_features(samples, y, k)
    at = np.full(WIDTH, -1)
    at[used] = np.arange(len(used))
    held = [found[found >= 0] for found in (at[words] for words in samples)]
    w, bias = np.zeros((len(used), k)), np.log(np.bincount(y, minlength=k) / n)
    seen, seen_bias, draw = np.full((len(used), 1), 1e-3), 1e-3, np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in draw.permutation(n).tolist():
            words = held[i]
            s = bias + w[words].sum(axis=0)
            e = np.exp(s - s.max())
            g = e / e.sum()
            g[y[i]] -= 1
            size = float(g @ g)
            if size < 1e-6:
                continue
            seen[words] += size
            w[words] -= 0.3 * (g + DECAY * w[words]) / np.sqrt(seen[words])
            seen_bias += size
            bias = bias - 0.03 * g / np.sqrt(seen_bias)
    weights[used] = w
    return Classifier(domains, weights, bias)


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """From ``labelled(doc_id, domain)``: at most FIT documents, their hashed words gathered on the driver.
    Null ids and domains are left out; a document with several domains takes the first in the alphabet."""
    ship_package(docs.sparkSession)
    table = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.min("domain").alias("domain"))
    table = table.orderBy(F.xxhash64("i"), "i").limit(FIT)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_features(t)[0].astype(np.int32).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("domain"), pa.array(found, pa.binary())], names=["i", "domain", "words"])

    # the sample is at most FIT rows of two columns, whatever the size of the tables
    sample = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).join(F.broadcast(table), "i").select("i", "domain", "text")
    found = sample.mapInArrow(tidy(words, "postlake.llm.mixing._buckets"), "i long, domain string, words binary")
    rows = found.groupBy("i").agg(F.min("domain").alias("domain"), F.min("words").alias("words")).collect()  # of an id's rows always the same
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["i"])), r["words"]))
    return train([np.frombuffer(r["words"], np.int32) for r in rows], [r["domain"] for r in rows])




def with_membership(docs: DataFrame, classifier: Classifier, text_col: str = "text", tokens: str = "tokens", posteriors: str = "posteriors") -> DataFrame:
    """All columns, with the number of words and the domain posteriors (in the order of ``classifier.domains``)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # WIDTH x K floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, p = [], []
            for text in texts_of(batch.column(batch.schema.get_field_index(text_col))):
                words, size = word_features(text)
                n.append(size)
                p.append(known.posteriors(words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([x.tolist() for x in p], pa.list_(pa.float64()))], names=[*batch.schema.names, tokens, posteriors])

    return docs.mapInArrow(tidy(run, "postlake.llm.mixing._buckets"), type(docs.schema)(list(docs.schema.fields)).add(tokens, "long").add(posteriors, ArrayType(DoubleType())))


Step = tuple[np.ndarray, float]


def rates_before_last(p: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors ``p`` (n x K) after the given steps (gradient, momentum), and where the last
    step was taken from."""
    r = last = start = np.ones(len(p))
    for g, momentum in steps:
        start = r + momentum * (r - last) if momentum else r
        last, r = r, np.maximum(0.0, start - p @ g)
    return r, start


def rates_of(p: np.ndarray, steps: list[Step]) -> np.ndarray:
    return rates_before_last(p, steps)[0]


def _matrix(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(-1, k)


@dataclass(frozen=True)
class Fit:
    """Gradient steps, domain totals before, those that the rates give, and those that they should give."""

    steps: list[Step]
    natural: np.ndarray
    reached: np.ndarray
    target: np.ndarray

    @property
    def residual(self) -> float:
        """The largest miss of a target, as a share of all tokens that the targets share out."""
        total = self.target.sum()
        return float(np.abs(self.reached - self.target).max() / total) if total else 0.0

    @property
    def met(self) -> bool:
        return self.residual <= TOLERANCE


def fit_steps(members: DataFrame, k: int, weights: np.ndarray, total: float | None = None) -> Fit:
    """Steps until every target is met, or, where no rates meet them, until they are as near as any rates come; such
    a miss is logged and is the fit's ``residual``.  Documents whose posteriors overlap much take many steps.

    ``weights`` are the targets' shares.  ``total`` is how many tokens they share out; by default as many as let
    the domain of the largest share keep what it has, so that its documents are neither dropped nor repeated much.
    """

    ship_package(members.sparkSession)
    n = k + k * k + 2

    def totals(steps: list[Step]) -> tuple[np.ndarray, np.ndarray, float]:
        """Domain totals, the curvature over documents with a rate, and how far the last step moved the rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, curves, moved, tokens = np.zeros(k), np.zeros((k, k)), 0.0, 0.0
            for batch in batches:
                p, t = _matrix(batch, "posteriors", k), batch.column("tokens").to_numpy()
                r, start = rates_before_last(p, steps)
                sums += (r * t) @ p
                curves += (p * (t * (r > 0))[:, None]).T @ p
                moved += float(t @ (r - start) ** 2)
                tokens += float(t.sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(np.concatenate([sums, curves.ravel(), [moved, tokens]]))], names=["k", "s"])

        rows = members.select("tokens", "posteriors").mapInArrow(tidy(run), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(n)
        for r in rows:
            out[r["k"]] = r["s"]
        return out[:k], out[k:-2].reshape(k, k), float(np.sqrt(out[-2] / out[-1])) if out[-1] else 0.0

    natural, curves, _ = totals([])
    now = natural
    used = np.where(natural > 0, weights, 0)
    if used.sum() <= 0:
        return Fit([], natural, natural, np.zeros(k))
    used = used / used.sum()
    if total is None:
        main = int(used.argmax())
        total = float(natural[main] / used[main])
    target = used * total
    scale = np.where(natural > 0, natural, 1.0)
    objective = lambda x: float(((x - target) ** 2 / scale).sum())
    missed = lambda: np.abs(now - target).max() > TOLERANCE * total
    steps: list[Step] = []
    damping, last, t, moved = LEAST, natural, 1.0, np.inf
    while missed() and moved > MOVE and len(steps) < MOST:
        if damping <= 1 or len(steps) % EVERY == 0:
            step = (np.linalg.solve(curves + min(damping, 1.0) * np.diag(scale), now - target), 0.0)
            found, curved, _ = totals([*steps, step])
            if objective(now) - objective(found) > STILL * objective(now):
                steps, last, now, curves, t = [*steps, step], found, found, curved, 1.0
                damping = max(LEAST, damping / 10)
                continue
            damping *= 30
            if damping <= 1:
                continue
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / further
        # totals depend on rates in a line, so those of the point that momentum leads to needn't be counted
        at = now + momentum * (now - last)
        step = ((at - target) / scale, momentum)
        found, curved, shift = totals([*steps, step])
        if momentum and objective(found) > objective(now):
            last, t = now, 1.0
            continue
        steps, last, now, curves, t, moved = [*steps, step], now, found, curved, further, shift
        if len(steps) % EVERY == 0:
            damping = min(damping, 1e-3)
    if missed():
        log.warning("mixing: after %d steps the targets are missed by up to %.3g of all tokens: %s instead of %s", len(steps), np.abs(now - target).max() / total, now.tolist(), target.tolist())
    return Fit(steps, natural, now, target)


def copies_of(rate, id_col, *instead):
    """The rate rounded up or down at random by a hash of the id (of ``instead`` where it is null): its expectation
    is the rate."""
    seed = F.when(id_col.isNull(), F.xxhash64(*instead, F.lit(13))).otherwise(F.xxhash64(id_col, F.lit(11)))
    u = (F.shiftrightunsigned(seed, 11).cast("double") + 0.5) / float(1 << 53)
    return F.floor(rate + u).cast("int")


def fit_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, domain, posteriors map<string, double>, rate, copies for every document.

    Null and blank texts have no tokens and the prior as posteriors.  Rows without an id are drawn by their tokens
    and posteriors, so that only rows alike share a draw.  Domains of
    ``targets`` that the labels don't know are ignored, known ones that ``targets`` lacks have weight 0.  Rows that repeat
    an id each give a row.  Without labels every rate is 1.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classifier = fit_classifier(source, labelled)
    k = len(classifier.domains)
    members = scratch.keep(with_membership(source, classifier).drop("text"), "members")
    steps = fit_steps(members, k, np.array([targets.get(d, 0.0) for d in classifier.domains]), total).steps if k else []
    rated = with_rates(members, classifier, steps)
    return rated.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"), F.col("tokens"), F.col("rate")))


def with_rates(members: DataFrame, classifier: Classifier, steps: list[np.ndarray]) -> DataFrame:
    k = len(classifier.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates_of(_matrix(batch, "posteriors", k), steps) if k else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    rated = members.mapInArrow(tidy(run), type(members.schema)(list(members.schema.fields)).add("rate", "double"))
    names = F.array(*(F.lit(d) for d in classifier.domains)) if k else F.expr("cast(array() as array<string>)")
    best = F.element_at(names, F.array_position(F.col("posteriors"), F.array_max("posteriors")).cast("int")) if k else F.lit(None).cast("string")
    return rated.select("doc_id", "tokens", best.alias("domain"), F.map_from_arrays(names, "posteriors").alias("posteriors"), "rate")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each as often as its rate says (0 times and more), with their columns.

    Texts are classified again rather than shuffled: a first pass fits the rates, a second applies them.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    classifier = fit_classifier(docs, labelled, id_col, text_col)
    k = len(classifier.domains)
    if not k:
        return docs
    members = scratch.keep(with_membership(docs.select(F.col(text_col).alias("text")), classifier).drop("text"), "members")
    steps = fit_steps(members, k, np.array([targets.get(d, 0.0) for d in classifier.domains]), total).steps
    scratch.drop("members")
    names = {x: x for x in ("tokens", "posteriors", "rate", "copies")}
    for x in names:
        while names[x] in docs.columns:
            names[x] += "_"
    rated = with_membership(docs, classifier, text_col, names["tokens"], names["posteriors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch, names["posteriors"], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_of(p, steps))], names=[*batch.schema.names, names["rate"]])

    rated = rated.mapInArrow(tidy(run), type(rated.schema)(list(rated.schema.fields)).add(names["rate"], "double"))
    copies = copies_of(F.col(names["rate"]), F.col(id_col).cast("long"), F.col(names["tokens"]), F.col(names["rate"]))
    return rated.withColumn(names["copies"], F.explode(F.sequence(F.lit(0), copies))).where(F.col(names["copies"]) > 0).select(*docs.columns)
