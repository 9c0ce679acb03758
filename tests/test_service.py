import json
from datetime import datetime

import pytest

from postlake import cli
from postlake.params import Filters, InboxRequest, QueryRequest, SearchRequest, Settings
from postlake.plans.service import NO_MATCH, NOTHING_INDEXED, MailService, payload
from postlake.sources.store import Store
from postlake.streaming.ingest import Ingest
from tests.test_archive import archive  # noqa: F401


@pytest.fixture
def filled(spark, tmp_path, archive):  # noqa: F811
    Ingest(Store(spark, tmp_path / "index")).index(str(archive))
    return MailService.open(spark, tmp_path / "index", directory=str(archive))


def test_search_response(filled, spark, tmp_path):
    r = filled.search(SearchRequest("budget plan", limit=2))
    assert r.results[0]["subject"] == "Budget plan" and r.results[0]["message_url"] == "message:%3C1@x%3E" and len(r.results[0]["attachments"]) == 3
    assert (r.indexed_emails, r.parser_applied, r.rerank_applied, r.message) == (3, False, False, None)
    r = filled.search(SearchRequest("pasta from:carl", use_parser=True, use_reranker=True))
    assert r.parser_applied and r.effective_query == "pasta" and r.filters["from_addr"] == "carl" and [x["subject"] for x in r.results] == ["Lunch"] and r.rerank_applied
    assert filled.search(SearchRequest("x", filters=Filters(subject="nothing like it"))).message == NO_MATCH
    assert MailService.open(spark, tmp_path / "new").search(SearchRequest("x")).message == NOTHING_INDEXED
    assert json.loads(payload(r))["results"][0]["rerank_score"] is not None


def test_query_caps_and_truncation(filled):
    filled.s = Settings(query_cap=2)
    r = filled.query(QueryRequest())
    assert (r.limit, r.truncated, len(r.results)) == (2, True, 2) and r.results[0]["subject"] == "Lunch"
    r = filled.query(QueryRequest(Filters(subject_like="budget"), 0))
    assert (r.limit, r.truncated) == (1, False) and r.results[0]["markdown_link"] == "[Budget plan](message:%3C1@x%3E)"


def test_inbox_pages_meet_without_overlap(filled):
    first = filled.inbox(InboxRequest(limit=1))
    assert [r["subject"] for r in first.results] == ["Lunch"] and first.filters["limit"] == 1
    second = filled.inbox(InboxRequest(limit=1, date_before=datetime.fromisoformat(first.results[0]["date"])))
    assert [r["subject"] for r in second.results] == ["Budget plan"]
    assert {"id", "message_id", "from", "to", "subject", "date", "has_attachments", "body_snippet", "message_url"} <= set(second.results[0])
    assert filled.inbox(InboxRequest(account="zoe@ex.org")).results == [] and len(filled.inbox(InboxRequest(account="ann@ex.org")).results) == 3


def test_status_and_inspect(filled, archive):  # noqa: F811
    s = filled.status()
    assert (s.total_emails, s.total_attachments, s.emails_with_attachments, s.total_indexed_emails) == (3, 3, 1, 3)
    assert s.date_range == {"min": "2024-05-06T08:00:00", "max": "2024-05-07T10:00:00"}
    path = filled.query(QueryRequest(Filters(subject="Lunch"))).results[0]["file_path"]
    assert filled.inspect(path)["document"].startswith("Lunch") and filled.inspect("/nowhere") is None


@pytest.mark.parametrize(
    ("line", "key"),
    [("status", "total_emails"), ("query --subject-like lunch", "results"), ("search budget --limit 1", "results"), ("inbox --limit 2", "results"), ("dedup --dry-run", "surplus"), ("dedup", "removed"), ("reextract", "stale"), ("migrate-paths /a /b", "moved"), ("inspect /x", "status")],
)
def test_commands(filled, spark, line, key, capsys):
    args = cli.parser().parse_args(["--index", str(filled.store.root), "--json", *line.split()])
    out = json.loads(payload(cli.run(args, spark)))
    assert key in out


def test_tools(filled, tmp_path):
    import io

    from postlake.plans.tools import Tools

    tools = Tools(filled, tmp_path / "staged")
    asked = [{"tool": "list"}, {"tool": "query_emails", "arguments": {"has_attachments": True}}, {"tool": "query_emails", "arguments": {"has_attachments": True, "no_attachments": True}}, {"tool": "list_inbox_emails", "arguments": {"date_after": "soon"}}, {"tool": "stage_email_attachments"}, {"tool": "stage_email_attachments", "arguments": {"message_id": "1@x"}}, {"tool": "clear_staged_emails"}, {"tool": "drop"}, {"tool": "get_status", "arguments": {"x": 1}}]
    out = io.StringIO()
    tools.serve(io.StringIO("\n".join(map(json.dumps, asked)) + "\n{bad\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 10 and [x["name"] for x in got[0]["result"]] == list(Tools.NAMES)
    assert [r["subject"] for r in got[1]["result"]["results"]] == ["Budget plan"]
    assert all("error" in got[i] for i in (2, 3, 7, 8, 9)) and got[4]["result"]["status"] == "failed"
    assert got[5]["result"]["status"] == "ok" and got[6]["result"]["removed"] == 1


def test_bad_dates_are_refused(capsys):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--index", "x", "query", "--after", "soon"])
