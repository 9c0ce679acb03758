"""The vector index against scans of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.operators import search, vectorindex
from postlake.operators.vectorindex import VectorIndex
from postlake.runtime import Scratch


def clustered(n=3_000, groups=30, d=16, seed=1):
    """Vectors in tight groups of unlike sizes, some repeated, and rows that are no vectors."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, d))
    home = (rng.random(n) ** 2 * groups).astype(int)
    x = centers[home] + 0.05 * rng.standard_normal((n, d)) * rng.random((n, 1))
    rows = [(i, x[i].tolist(), f"p{i}") for i in range(n)]
    rows += [(n + i, x[7].tolist(), "copy") for i in range(300)]
    return rows + [(-1, None, "null"), (-2, [0.0] * d, "zero"), (-3, [1.0] * (d - 1), "short"), (-4, [float("nan")] * d, "nan"), (-5, [], "empty"), (-6, [None] * d, "nulls")]


SCHEMA = "id long, embedding array<double>, payload string"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def index(spark, vectors):
    return VectorIndex.build(vectors, Scratch(spark, "index").path("index"), ring=100)


def scan(vectors, q, k):
    return [(r["id"], r["distance"]) for r in search.nearest(vectors.where("id >= 0"), q, k).collect()]


def test_every_vector_is_in_the_index_once(index, vectors):
    got = sorted(r[0] for r in index.table().select("id").collect())
    assert got == sorted(r[0] for r in vectors.where("id >= 0").select("id").collect())
    assert index.rings.agg(F.max("n")).first()[0] <= 100 and index.table().columns[:3] == ["id", "embedding", "payload"]
    sizes = index.table().groupBy("ring").agg(F.countDistinct("cell").alias("c")).where("c > 1")
    assert sizes.isEmpty()


@pytest.mark.parametrize("k", [1, 20, 350, 5_000])
def test_search_equals_the_scan(index, vectors, k):
    rows = {r["id"]: r["embedding"] for r in vectors.where("id in (0, 7, 44, 2999)").collect()}
    for q in (*rows.values(), [1.0] + [0.0] * 15, (-np.array(rows[0])).tolist()):
        found, _ = index.search(q, k)
        assert [(r["id"], r["distance"]) for r in found.collect()] == scan(vectors, q, k)


def test_most_cells_stay_unread(index, vectors):
    q = vectors.where("id = 44").first()["embedding"]
    found, cells = index.search(q, 10)
    assert len(cells) <= len(index.n) // 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan.partition("FileScan")[2]
    assert "cell" in scan.partition("PartitionFilters: [")[2] and "radius" in scan.partition("PushedFilters: [")[2]
    # and of what is opened, rings are left out
    read = index.table().where(F.col("cell").isin(cells)).select("ring").distinct().count()
    assert read < 0.5 * index.rings.count()


def test_odd_queries_and_an_empty_index(spark, index):
    for q in ([0.0] * 16, [1.0] * 15, [float("nan")] * 16):
        assert index.nearest(q, 3).collect() == []
    assert index.nearest([1.0] * 16, 0).collect() == []
    for rows in ([], [(1, None, "x"), (2, [0.0, 0.0], "y")]):
        empty = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "index").path("index"))
        assert empty.nearest([1.0, 0.0], 3).collect() == []
        queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
        assert empty.join(queries, 3, Scratch(spark, "j")).collect() == []
    one = VectorIndex.build(spark.createDataFrame([(5, [2.0, 0.0], "x"), (5, [2.0, 0.0], "x")], SCHEMA), Scratch(spark, "index").path("index"))
    assert [(r["id"], r["distance"]) for r in one.nearest([1.0, 0.0], 3).collect()] == [(5, 0.0), (5, 0.0)]


def test_filters_and_rows_beside_the_index(spark, index, vectors):
    q = vectors.where("id = 44").first()["embedding"]
    keep = vectors.where("id % 50 = 0").select("id")
    found, _ = index.search(q, 30, lambda rows: rows.join(keep, "id", "left_semi").orderBy("distance", "id").limit(30))
    assert [(r["id"], r["distance"]) for r in found.collect()] == scan(vectors.join(keep, "id", "left_semi"), q, 30)
    extra = spark.createDataFrame([(9_000, q, "new")], SCHEMA)
    assert [r["id"] for r in index.search(q, 2, extra=extra)[0].collect()] == [44, 9_000]


@pytest.mark.parametrize("k, block", [(1, 1_024), (7, 5), (400, 1_024)])
def test_join_equals_one_search_a_query(spark, index, vectors, monkeypatch, k, block):
    monkeypatch.setattr(vectorindex, "QUERIES", block)
    asked = vectors.where("id % 397 = 0 or id < 0 or id = 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in index.join(asked, k, Scratch(spark, "join")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    rows = {r["query_id"]: r["query_vector"] for r in asked.where("query_id >= 0").collect()}
    assert sorted(got) == sorted(rows)
    for i, q in rows.items():
        want = scan(vectors, q, k)
        assert [x for x, _ in got[i]] == [x for x, _ in want]
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want], abs=1e-12)


def test_join_leaves_most_rings_out_and_nothing_passes_the_driver(spark, index, vectors, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def fail(*_):
        raise AssertionError("through the driver")

    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, fail)
    scratch, seen = Scratch(spark, "join"), []
    compared = VectorIndex._compared
    monkeypatch.setattr(VectorIndex, "_compared", lambda self, pairs, *a: seen.append(pairs.count()) or compared(self, pairs, *a))
    asked = vectors.where("id % 100 = 0 and id >= 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert index.join(asked, 10, scratch).count() == 10 * asked.count()
    assert sum(seen) < 0.3 * asked.count() * index.rings.count()


def test_a_store_searches_its_index_and_what_changed_since(spark, tmp_path):
    from postlake.sources.store import Store
    from postlake.streaming.ingest import Ingest
    from tests.test_archive import mail

    for i in range(12):
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / f"{i}.eml").write_bytes(mail(f"Subject {i}", f"word{i} " * 5, mid=f"<{i % 10}@x>"))
    ingest = Ingest(Store(spark, tmp_path / "index", buckets=4))
    ingest.index(str(tmp_path / "m"))
    store = ingest.store
    assert store.vector_index() is None
    assert ingest.index_vectors()["vectors"] == 12 and store.vector_index().changed is None
    q = search.hashing_embedder(["word3 subject 3"])[0]

    def both(limit):
        args = (store.table("emails"), store.table("attachments"), store.table("vectors"), q)
        return [[(r["vector_id"], round(r["distance"], 9)) for r in search.hybrid_search(*args, limit=limit, index=i).collect()] for i in (None, store.vector_index())]

    (tmp_path / "m" / "3.eml").write_bytes(mail("Other", "nothing alike", mid="<3@x>"))
    (tmp_path / "m" / "new.eml").write_bytes(mail("Subject 3", "word3 " * 5, mid="<new@x>"))
    (tmp_path / "m" / "5.eml").unlink()
    ingest.index(str(tmp_path / "m"))
    ingest.prune(str(tmp_path / "m"))
    index = store.vector_index()
    assert index.fresh and index.changed is not None
    for limit in (1, 5, 50):
        plain, indexed = both(limit)
        assert plain == indexed
    store.vacuum(hours=0)
    assert both(5)[0] == both(5)[1]
