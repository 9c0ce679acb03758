import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postlake.llm.spelling import near_words, spelling_groups, word_counts
from postlake.runtime import Scratch
from tests.llm.helpers import DOCS, LOWER, ODD

WORDS = "word string, n long"


def brute_counts(docs, spoil=199, shortest=6, rarest=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % spoil == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= rarest}


def brute_near(words):
    """Through all words with one character left out or masked."""
    where, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            where[w[:i], w[i + 1 :]].add(w)
    for w in words:
        for i in range(len(w)):
            near[w] |= where[w[:i], w[i + 1 :]] - {w}
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    return near


def brute(words, ratio=5):
    near = brute_near(words)
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f is not None and words[f] >= ratio * words[w] else None for w, f in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out)


def found(spark, words, **how):
    return sorted(map(tuple, spelling_groups(spark.createDataFrame(list(words.items()), WORDS).repartition(3), **how).collect()))


def test_words_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_counts([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert {r["word"]: r["n"] for r in word_counts(docs, spoil=199).collect()} == want
    assert found(spark, want) == brute(want)


def test_odd_rows(spark):
    rows = [(*r, 1, "x") for r in ODD] + [(20, "Über×Größe÷größe ÉTÉÉTÉ étéété naïve_naïve'naïveté " * 6, "de", "a", 1, 1, "x"), (21, "y" * 200_000 + " " + "ab" * 50_000, "en", "a", 1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS + ", word int, n string")
    for spoil in (2, 199):
        assert {r["word"]: r["n"] for r in word_counts(df, spoil=spoil).collect()} == brute_counts([r[:2] for r in rows], spoil)
    assert word_counts(spark.createDataFrame([], DOCS), spoil=199).count() == 0
    assert word_counts(df.where("doc_id < 0"), spoil=None).count() == 0


def dense_words(seed, n, alphabet, lengths):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        out[w] = 5 ** rng.randrange(1, 9)
    return out


@pytest.mark.parametrize("largest", [2, 8, 48])
def test_skewed_blocks_are_subdivided(spark, largest):
    """Few letters, so that words share long beginnings and ends; of every length from the shortest on."""
    words = dense_words(1, 900, "abé", (6, 7, 8, 9)) | {"prefixprefix" + w: 7 for w in dense_words(2, 300, "xyz", (4, 5, 6))} | {w + "suffixsuffix": 9 for w in dense_words(3, 300, "xyz", (4, 5, 6))}
    assert found(spark, words, largest=largest) == brute(words)


def test_all_edits_of_one_word(spark):
    base = "straßenbahn"
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    words = {base[:i] + c + base[i + k :] for i in range(len(base) + 1) for c in ["", *letters] for k in (0, 1)}
    words = {w: 5 + len(w) for w in words} | {base: 10_000}
    got = found(spark, words)
    assert got == brute(words)
    assert all(r[1] == base for r in got if r[0] != base)


def test_chains_of_forms_end_at_the_last(spark):
    words = {"aaaaaaaaaa"[:i] + "bbbbbbbbbb"[i:]: 5**i for i in range(1, 11)}
    got = {r[0]: r for r in found(spark, words)}
    assert {r[2] for r in got.values()} == {"aaaaaaaaaa"}
    assert found(spark, {}) == [] and found(spark, {"lonely": 5}) == [("lonely", None, "lonely", 5, 0, None)]


def test_pairs_come_both_ways_and_once(spark):
    words = dense_words(4, 300, "ab", (6, 7, 8))
    df = spark.createDataFrame(list(words.items()), WORDS)
    got = near_words(df, Scratch(spark, "near"), 4).groupBy("word", "other").agg(F.count(F.lit(1)).alias("c")).collect()
    want = brute_near(words)
    assert {(r["word"], r["other"], r["c"]) for r in got} == {(w, x, 1) for w in want for x in want[w]}
