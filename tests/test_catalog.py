"""Every registered query of the mail archive against its SQL, on the smallest tables."""

import duckdb
import pytest

from postlake import catalog, catalog_files  # noqa: F401
from postlake.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    found = got.collect()
    if name not in ORACLE_SQL:
        assert found
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_texts_that_look_like_quotes_stay_whole(spark, tmp_path):
    texts = [None, "", " ", "\n", "> quoted", "\t>> a", ">", "On Mon, Ann wrote:", "Le 3 mai Anne a écrit :", "-----Original Message-----", "From: Ann\nSent: x", "\u00a0x\u3000", "x \u00a0 ", "\u00a0", "\u2003> q", "\x1cx\x85", "\u2028", "body: x", "plain"]
    ids = [None, *range(-4, 8)]
    spark.createDataFrame([(i, t) for t in texts for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["quoted_replies"](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL["quoted_replies"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in QUERIES


def test_plans_keep_filters_in_the_scan_and_read_few_columns(spark, sf, capsys):
    plan = QUERIES["meta_query_from"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["meta_query_any_attachment"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "l_comment" not in plan


def test_dedup_has_no_window(spark, sf):
    plan = QUERIES["dedup_keep_latest"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
