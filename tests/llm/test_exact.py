import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode
from tests.llm.helpers import DOCS, ODD


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1), (1, 1 << 62), (2, 3), (500, 500), (4_000, 1 << 20), (3_000, 1 << 60)])
def test_golomb_codes_come_back(n, top):
    values = np.unique(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
    k, quotients, remainders = golomb_encode(values)
    assert np.array_equal(golomb_decode(len(values), k, quotients, remainders), values)
    if n >= 1_000:  # within a bit and a half of the information in a gap
        assert 8 * (len(quotients) + len(remainders)) / len(values) < np.log2(top / n) + 2


def test_golomb_codes_of_clustered_values():
    values = np.array([0, 1, 2, 3, 1 << 50, (1 << 50) + 1], np.uint64)
    assert np.array_equal(golomb_decode(6, *golomb_encode(values)), values)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        kept = i == top and (t or "") not in seen
        if kept:
            seen.add(t or "")
        out.append((i, top, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **how):
    return sorted(map(tuple, exact_duplicates(df, **how).collect()), key=str)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in ODD], DOCS + ", keep_id int, kept string, row int").repartition(3)
    assert found(df) == brute([(r[0], r[1]) for r in ODD])


def test_an_empty_table_and_one_row(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(spark.createDataFrame([(3, None)], "doc_id long, text string")) == brute([(3, None)])
    assert found(spark.createDataFrame([(None, "x")], "doc_id long, text string"))[0][1:4] == (None, 1, True)


def hot_rows(n=3_000):
    """A third are one text, others come in small groups or alone; a few are nearly alike."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(n)}" if i % 3 == 1 else f"only {i}" + " " * (i % 2)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_large_groups_over_many_partitions(spark):
    rows = hot_rows()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(23)) == brute(rows)


@pytest.mark.parametrize("how", [{"fingerprint": lambda t: F.length(t)}, {"digest": lambda t: F.substring(F.sha2(t, 256), 1, 2)}, {"slack": 0}])
def test_colliding_hashes_cost_no_result(spark, how):
    rows = hot_rows(900)
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(11), **how)
    assert [r[:4] for r in got] == [r[:4] for r in brute(rows)]


def test_unique_texts_are_not_shuffled(spark):
    df = exact_duplicates(spark.createDataFrame(hot_rows(300), "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and ",text#" not in plan
