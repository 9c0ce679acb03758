"""LIKE by way of trigram postings against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from postlake.functions.text import contains_like
from postlake.operators import likeindex, listing
from postlake.operators.likeindex import LikeIndex, grams_of_pattern, like_rows
from postlake.params import Filters
from postlake.runtime import Scratch
from postlake.schema import ATTACHMENTS, EMAILS, conform


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    words = ["Ann", "BOB", "Straße", "ÉCLAIR", "50%_off", "a\\b", "ΟΔΟΣ", "İzmir", "x", "", "報告書", "plan", "plane", "planet"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i, say(4), say(3), say(3), None if i % 3 else say(2), None if i % 11 == 0 else say(6)) for i in range(400)] + [(9_000, None, None, None, None, None)]
    emails = conform(spark.createDataFrame(rows, "id long, from_addr string, to_addrs string, cc_addrs string, bcc_addrs string, subject string"), EMAILS)
    files = [(i, i % 300, f"{say(3)}.{'pdf' if i % 2 else 'txt'}", "pdf" if i % 2 else "txt") for i in range(500)]
    attachments = conform(spark.createDataFrame(files, "id long, email_id long, filename string, file_extension string"), ATTACHMENTS)
    return emails.cache(), attachments.cache()


@pytest.fixture(scope="module")
def index(spark, tables):
    return LikeIndex.build(*tables, Scratch(spark, "like").path("index"))


def test_patterns_ask_for_their_literal_stretches():
    assert grams_of_pattern("plan%et_abc") == ["abc", "lan", "pla"] and grams_of_pattern("ab%cd_e") == [] and grams_of_pattern("") == []


PATTERNS = ["plan", "PLANET", "pla_et", "plan%straße", "éclair", "ΟΔΟΣ", "οδο", "İzm", "izmir", "50%_off", "a\\b", "報告書", "ab", "zzz", "x%", "_____", "plan plan"]


@pytest.mark.parametrize("common", [0.2, 1.0, 0.0])
def test_the_same_rows_as_the_scan(index, tables, monkeypatch, common):
    monkeypatch.setattr(likeindex, "COMMON", common)
    emails, _ = tables
    for p in PATTERNS if common == 1.0 else PATTERNS[:6]:
        for field in ("subject", "bcc_addrs"):
            want = sorted(r[0] for r in emails.where(contains_like(field, p)).select("id").collect())
            assert sorted(r[0] for r in like_rows(index, emails, field, p).select("id").collect()) == want, (p, field)


def test_filters_of_messages_and_attachments(index, tables):
    for f in (Filters(from_addr="planet", to_addr="éclair"), Filters(attachment_name="planet", attachment_type="pdf"), Filters(subject_like="straße", attachment_name="ann"), Filters()):
        want = sorted(r[0] for r in listing.matching(*tables, f).select("id").collect())
        assert sorted(r[0] for r in index.matching(*tables, f).select("id").collect()) == want


def test_postings_are_read_pruned(index):
    found = index.candidates("subject", "報告書")
    scan = found._jdf.queryExecution().executedPlan().toString().partition("FileScan")[2]
    partitions, pushed = scan.partition("PartitionFilters: [")[2], scan.partition("PushedFilters: [")[2]
    assert "field" in partitions and "file" in partitions and "gram" in pushed
    assert index.candidates("subject", "ab") is None and index.candidates("subject", "qqq").count() == 0


def test_an_empty_index(spark, tables):
    emails, attachments = (t.limit(0) for t in tables)
    empty = LikeIndex.build(emails, attachments, Scratch(spark, "like").path("index"))
    assert empty.matching(emails, attachments, Filters(from_addr="plan", attachment_name="plan")).count() == 0
    assert like_rows(empty, emails.select("id", F.lit("plan").alias("subject")), "subject", "plan").count() == 0
