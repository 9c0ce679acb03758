from datetime import datetime

import pytest

from postlake.params import (
    Filters,
    SearchRequest,
    Settings,
    attachment_flag,
    builder_limit,
    display_date,
    filtered_widths,
    inbox_limit,
    merge_parsed,
    parse_date,
    parse_date_or_none,
    query_limit,
    retrieval_width,
    search_limit,
)


@pytest.mark.parametrize(("asked", "got"), [(None, 5), (10_000, 5), (2, 2), (0, 1), (-3, 1), (5, 5)])
def test_query_limits_are_clamped(asked, got):
    assert query_limit(asked, Settings(query_cap=5)) == got


@pytest.mark.parametrize(("asked", "got"), [(None, 1000), (0, 1000), (-1, 1000), (7, 7)])
def test_builder_limits_are_never_unbounded(asked, got):
    assert builder_limit(asked) == got


def test_inbox_and_search_limits():
    assert [inbox_limit(x) for x in (0, 1, 500, 9999)] == [1, 1, 500, 500]
    assert [search_limit(x) for x in (None, 0, 3)] == [10, 10, 3]
    assert retrieval_width(10, False) == 20 and retrieval_width(10, True) == 50 and retrieval_width(80, True) == 80


def test_filtered_widths():
    assert filtered_widths(20, 7) == (7, None)
    assert filtered_widths(20, 30) == (30, None)
    assert filtered_widths(20, 500) == (40, 500)
    assert filtered_widths(20, 5000) == (40, 1000)


def test_filters_present():
    assert not Filters().any() and not Filters(from_addr="").any()
    assert Filters(has_attachments=False).any() and Filters(subject="x").any()


def test_flags():
    assert attachment_flag(True, False, True) is True and attachment_flag(False, True, True) is False
    assert attachment_flag(False, False, True) is None and attachment_flag(True, True, False) is True
    with pytest.raises(ValueError):
        attachment_flag(True, True, True)


def test_explicit_filters_win_over_parsed_ones():
    r = SearchRequest("mail from ann", filters=Filters(from_addr="bob"))
    merged, applied = merge_parsed(r, {"from_addr": "ann", "subject_like": "x", "semantic_query": "budget"})
    assert applied and merged.query == "budget" and merged.filters.from_addr == "bob" and merged.filters.subject_like == "x"
    assert merge_parsed(r, None) == (r, False)


def test_dates():
    assert parse_date("2024-05-01") == datetime(2024, 5, 1)
    with pytest.raises(ValueError):
        parse_date("soon")
    assert parse_date_or_none("soon") is None
    assert display_date("2024-05-01T10:20:30Z") == "2024-05-01 10:20" and display_date("x") == "x" and display_date(None) == "Unknown date"
