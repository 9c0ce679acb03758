"""Threads and as-of joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from postlake.operators.asof import asof_join
from postlake.operators.threads import ids_in, threads

MAIL = "id long, message_id string, in_reply_to string, references_header string"


def brute(rows):
    import re

    ids = lambda h: re.findall(r"<\s*([^<>]*[^<>\s])\s*>", h or "") or re.findall(r"[^\s<>]+", h or "")
    bare = lambda m: (re.sub(r"^<(.*)>$", r"\1", (m or "").strip(), flags=re.S).strip()) or None
    node, head = {}, {}
    for i, m, *_ in sorted(rows):
        if bare(m):
            node.setdefault(bare(m), i)
    for i, m, reply, refs in rows:
        n = node[bare(m)] if bare(m) else i
        if n == i:
            named = [node[x] for x in [*ids(reply), *reversed(ids(refs))] if x in node and node[x] != i]
            head[i] = named[0] if named else None
    roots = {}
    for i in head:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = head[at]
        if at is not None:  # cut the cycle above its smallest
            head[min(seen[seen.index(at) :])] = None
    for i in head:
        d, at = 0, i
        while head[at] is not None:
            at, d = head[at], d + 1
        roots[i] = (at, d)
    out = [(i, *roots[node[bare(m)] if bare(m) else i]) for i, m, *_ in rows]
    sizes = {}
    for _, r, _ in out:
        sizes[r] = sizes.get(r, 0) + 1
    return sorted((i, r, d, sizes[r]) for i, r, d in out)


def found(spark, rows):
    return sorted(map(tuple, threads(spark.createDataFrame(rows, MAIL).repartition(3)).collect()))


def test_headers_name_ids(spark):
    texts = ["<a@x> <b@y>", " <a b>\n\t< c >", "a@x b@y", "", None, "no <> id", "(comment) <d@z>"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, h string").select("i", ids_in(F.col("h")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [["a@x", "b@y"], ["a b", "c"], ["a@x", "b@y"], [], [], ["no", "id"], ["d@z"]]


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_and_cycles(spark, seed):
    rng = random.Random(seed)
    n = 300
    rows = []
    for i in range(n):
        mid = rng.choice([f"<m{i}>", f"m{i}", f"<m{rng.randrange(n)}>", None, "", f" <m{i}> "])
        name = lambda: rng.choice([f"<m{rng.randrange(n)}>", f"m{rng.randrange(n)}", "<unknown>", None, ""])
        rows.append((i, mid, name() if rng.random() < 0.7 else None, " ".join(filter(None, (name() for _ in range(rng.randrange(4))))) or None))
    assert found(spark, rows) == brute(rows)


def test_cycles_are_cut_above_their_smallest_message(spark):
    rows = [(5, "<a>", "<b>", None), (3, "<b>", "<c>", None), (4, "<c>", "<a>", None), (9, "<d>", "<a>", None), (1, "<e>", "<d>", None), (7, "<f>", "<f>", None), (8, "<g>", "<h>", None), (2, "<h>", "<g>", None)]
    got = {r[0]: r[1:3] for r in found(spark, rows)}
    assert got == {3: (3, 0), 5: (3, 1), 4: (3, 2), 9: (3, 2), 1: (3, 3), 7: (7, 0), 2: (2, 0), 8: (2, 1)}
    assert found(spark, rows) == brute(rows) and found(spark, []) == []


def test_a_chain_of_10_000(spark):
    rows = [(i, f"<m{i}>", f"<m{i - 1}>" if i else None, None) for i in range(10_000)]
    r = threads(spark.createDataFrame(rows, MAIL)).agg(F.count(F.lit(1)), F.max("root_id"), F.max("depth"), F.min("size"), F.sum(F.col("depth") - F.col("id"))).first()
    assert tuple(r) == (10_000, 0, 9_999, 10_000, 0)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, strict):
    """One key has a third of all rows, times repeat, rows repeat, keys and times are missing."""
    rng = random.Random(5)
    key = lambda: rng.choice(["hot", "hot", *"abcdef", None]) if rng.random() < 0.8 else f"k{rng.randrange(50)}"
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(500)]
    right = [(key(), rng.choice([None, *range(60)]), i % 97, f"v{i % 97}") for i in range(400)]
    left += left[:5]
    got = asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, n int, v string"), "k", "t", "n", strict).collect()
    want = []
    for i, k, t in left:
        some = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(some, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((i, k, t, *best))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_asof_of_empty_sides_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 5, "l")], "k int, t int, r string")
    none = left.limit(0)
    assert [tuple(r) for r in asof_join(left, none, "k", "t").collect()] == [(1, 5, "l", None, None, None)]
    assert asof_join(none, left, "k", "t").collect() == []
    assert [tuple(r) for r in asof_join(left, left.withColumn("l", F.lit(1)), "k", "t").collect()] == [(1, 5, "l", 1, 5, "l", 1)]
