"""Full text search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from postlake.operators.fulltext import B, K1, TextIndex
from postlake.runtime import Scratch


def brute(rows, query, k):
    words = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in rows if i is not None}
    mean = sum(c.total() for c in words.values()) / max(1, len(words))
    scores = {}
    for t in set(re.findall(r"\w+", query.lower())):
        df = sum(t in c for c in words.values())
        idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
        for i, c in words.items():
            if t in c:
                scores[i] = scores.get(i, 0) + idf * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * c.total() / mean))
    best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
    return [(i, pytest.approx(scores[i], abs=1e-9)) for i in best]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "é", "報告"]
    out = [(i, " ".join(rng.choice(common) if rng.random() < 0.9 else f"rare{rng.randrange(300)}" for _ in range(rng.randrange(60)))) for i in range(900)]
    return out + [(2_000, None), (2_001, ""), (2_002, "Alpha ALPHA, alpha!"), (None, "alpha"), (2_003, "needle " * 400), (2_004, "needle alpha")]


@pytest.fixture(scope="module")
def index(spark, rows):
    return TextIndex.build(spark.createDataFrame(rows, "id long, text string").repartition(4), Scratch(spark, "text").path("index"), block=30)


@pytest.mark.parametrize("query, k", [("alpha", 10), ("needle", 5), ("rare7 ALPHA alpha", 20), ("é 報告", 15), ("rare1 rare2 rare3 rare4", 1_000), ("nothing", 5), ("", 5), ("alpha", 0)])
def test_search_equals_scoring_all(index, rows, query, k):
    found, _ = index.search(query, k)
    assert [tuple(r) for r in found.collect()] == brute(rows, query, k)


def test_blocks_that_promise_too_little_stay_closed(index):
    blocks = index.blocks().select("block").distinct().count()
    found, opened = index.search("needle alpha", 1)
    assert blocks >= 25 and opened <= blocks // 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "file" in plan.partition("PartitionFilters: [")[2]


def test_an_empty_index(spark):
    empty = TextIndex.build(spark.createDataFrame([], "id long, text string"), Scratch(spark, "text").path("index"))
    assert empty.search("alpha", 3)[0].collect() == []
