import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm.components import connected_components
from postlake.llm.embed_dedup import near_duplicate_vectors
from postlake.llm.minhash import band_keys, intersections, near_duplicates, shingle_set, signature, without_near_duplicates
from postlake.runtime import Scratch
from tests.llm.helpers import DOCS, ODD, components, near_pairs, shingles


def test_matches_brute_force_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, links = near_pairs(rows)
    roots = components(sets, links)
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), roots[i], roots[i] == i) for i, s in sets.items()}
    assert any(i != r for i, r in roots.items())


def test_chains_of_edits_near_the_bound(spark):
    """Groups whose copies differ from each other by more than they may: only links through others hold them together."""
    rng = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice([40, 90, 200]))]
        rows.append(words)
        for _ in range(40):
            base = list(rng.choice([words, rows[-1]]))
            for _ in range(rng.randrange(1, 4)):
                base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
            rows.append(base)
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets, links = near_pairs(docs)
    roots = components(sets, links)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots
    assert 6 < len(set(roots.values())) < len(docs)


def test_one_large_group_is_cut_into_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base, f"tail{i}"])) for i in range(1500)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).agg(F.countDistinct("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1, 1)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 7, "x", 1.5) for r in ODD], DOCS + ", component_id int, kept string, id double")
    got = near_duplicates(df).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and all(r["component_id"] == 1 for r in by[1] + by[2] + by[3])
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    for i in (4, 5, 6, 7):
        assert (by[i][0]["n_shingles"], by[i][0]["component_id"], by[i][0]["kept"]) == (0, i, True)
    assert by[8][0]["component_id"] == by[9][0]["component_id"] == 8 and by[8][0]["n_shingles"] == 1
    assert by[11][0]["n_shingles"] == 1 and by[10][0]["n_shingles"] == 1


def by_rows(rows):
    """Brute force where rows repeat ids: every row is a document; its component is the smallest id it reaches."""
    _, links = near_pairs([(n, t) for n, (_, t) in enumerate(rows)])
    roots = components(range(len(rows)), links)
    low = {}
    for n, (i, _) in enumerate(rows):
        low[roots[n]] = min(i, low.get(roots[n], i))
    return [low[roots[n]] for n in range(len(rows))]


def unlike_rows():
    text = lambda n, tail="": " ".join(f"t{n}w{i}" for i in range(40)) + tail
    a, b, c = text("a"), text("b"), text("c")
    return [(1, a), (1, b), (5, b + " tail"), (6, a + " tail"), (0, a + " x"), (7, c), (7, c), (8, c), (9, text("d")), (9, text("e")), (9, "the end"), (3, "the end"), (10, ""), (10, ""), (10, text("e"))]


def test_rows_of_one_id_with_unlike_texts_keep_their_links(spark):
    rows = unlike_rows()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = by_rows(rows)
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted((i, c, c == i) for (i, _), c in zip(rows, want, strict=True))


def test_only_duplicates_are_dropped(spark):
    rows = [*unlike_rows(), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, n) for n, r in enumerate(rows)], "doc_id long, text string, lo int, id_of_set int").repartition(3)
    out = without_near_duplicates(df)
    assert out.columns == df.columns
    kept = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None)
    want = {(i, t) for (i, t), c in zip(rows, by_rows(rows[:-1]), strict=False) if i == c and t}
    assert kept == sorted([*want, (10, ""), (10, "")]) and out.where("doc_id is null").count() == 1


def test_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_full_forests_are_handed_on(spark, monkeypatch):
    from postlake.llm import components as c

    monkeypatch.setattr(c, "CHUNK", 8)
    monkeypatch.setattr(c, "FOREST", 4)
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in links[i : i + 5]]), pa.array([b for _, b in links[i : i + 5]])], names=["u", "v"]) for i in range(0, 50, 5)]
    out = [(u, v) for b in c._contract(iter(batches)) for u, v in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    assert components(range(60), out) == components(range(60), links) and len(out) < 60


def test_weak_settings_are_refused(spark):
    for bad in ({"percent": 70}, {"ngram": 3}):
        with pytest.raises(ValueError):
            near_duplicates(spark.createDataFrame([], DOCS), **bad)


def test_shingles_signatures_and_intersections():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 3, 5, 6, 50, 400)]
    sets = [shingle_set(t.encode()) for t in texts]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    want = [[len(shingles(a) & shingles(b)) for b in texts] for a in texts]
    for most in (8, 1000):
        assert intersections(sets, most).tolist() == want
    a = signature(sets[-1], 12)
    assert (a == signature(sets[-1][::-1], 12)).all() and len(band_keys(a, 6, 4)) == 4
    # both extremes estimate the similarity without bias
    every = np.random.default_rng(3).integers(0, 2**64, 2500, dtype=np.uint64)
    x, y = every[:2000], every[500:]
    agree = (signature(x, 400) == signature(y, 400)).mean()
    assert abs(agree - 1500 / 2500) < 0.06


@pytest.mark.parametrize("seed,chunk", [(0, 1 << 20), (1, 40), (2, 7)])
def test_components(spark, seed, chunk, monkeypatch):
    from postlake.llm import components as c

    monkeypatch.setattr(c, "CHUNK", chunk)
    rng = random.Random(seed)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, i) for i in range(2000, 2200)]
    links = path + star + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(links)
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    want = components({i for e in links for i in e}, links)
    linked = {i for a, b in links if a != b for i in (a, b)}
    rows = got.collect()
    assert len(rows) == len(linked) and {r["id"]: r["component"] for r in rows} == {i: want[i] for i in linked}


def brute(rows, bound=0.98):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        a = np.array([np.nan if x is None else x for x in v or []], np.float64)
        if i is not None and label is not None and len(a) and np.isfinite(a).all() and (a != 0).any():
            ok[n] = a / np.sqrt((a * a).sum())
    same = {}
    for n in ok:
        same.setdefault((rows[n][2], len(ok[n])), []).append(n)
    links = [(m, n) for group in same.values() for k, n in enumerate(group) for m in group[:k] if float(ok[m] @ ok[n]) >= bound]
    return ok, links


def check_vectors(spark, rows):
    """Every row is a vector of its own, whatever its id; a component is named by its smallest id."""
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    _, links = brute(rows)
    roots = components(range(len(rows)), links)
    low, degree = {}, [0] * len(rows)
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            low[roots[n]] = min(i, low.get(roots[n], i))
    for m, n in links:
        degree[m] += 1
        degree[n] += 1
    want = sorted((i, degree[n], low[roots[n]], low[roots[n]] == i) for n, (i, _, _) in enumerate(rows) if i is not None)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None) == want
    return got


@pytest.fixture
def cells(monkeypatch):
    """Notes the tables of cells as they are dealt."""
    from postlake.llm import embed_dedup

    seen = []
    own = embed_dedup.cut_into_cells

    def noted(vectors, scratch, cosine):
        placed = scratch.keep(own(vectors, scratch, cosine), "placed")
        seen.append((vectors, placed))
        return placed

    monkeypatch.setattr(embed_dedup, "cut_into_cells", noted)
    return seen


def test_vectors_match_brute_force(spark, sf, cells):
    """On the table that the SQL is checked on, every label has been cut into several cells."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_vectors(spark, rows)
    ((vectors, placed),) = cells
    per_label = placed.groupBy("lab").agg(F.countDistinct("place").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per_label) == len({r[2] for r in rows}) and min(r["k"] for r in per_label) > 1
    assert placed.count() < 3 * vectors.count()


def test_vectors_over_many_cells_lose_no_link(spark, monkeypatch, cells):
    from postlake.llm import embed_dedup

    for name, value in (("PER_CELL", 40), ("BLOCK", 16), ("TILE", 7), ("ASSIGN", 100), ("SAMPLE", 100)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 6))
    x = np.repeat(base, 12, axis=0) + 0.12 * rng.standard_normal((720, 6))
    ball = rng.standard_normal(6) + 0.05 * rng.standard_normal((150, 6))  # all linked with nearly all: no cut is worth it
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(np.concatenate([x, ball]))]
    got = check_vectors(spark, rows)
    assert sum(r["n_links"] for r in got) > 500
    ((_, placed),) = cells
    assert placed.select("place").distinct().count() > 20 and placed.agg(F.max("visits")).first()[0] > 1  # cut twice and more


def test_rows_of_one_id_with_unlike_vectors_keep_their_links(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    near = lambda v: [x + 0.02 for x in v]
    check_vectors(spark, [(1, a, 1), (1, b, 1), (5, near(b), 1), (6, near(a), 1), (0, a, 1), (0, a, 1), (7, a, 2), (1, a, 1)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, None, 1), (9, [], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1e-30, 0.0], 1)]
    check_vectors(spark, rows)
    alone = near_duplicate_vectors(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in alone] == [(0, None, True)] * 2
