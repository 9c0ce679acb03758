"""Settings, request records and the small arithmetic on them; all of it runs on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any


@dataclass(frozen=True)
class Settings:
    search_default: int = 10
    query_cap: int = 1_000
    filtered_cap: int = 1_000
    rerank_width: int = 50
    inbox_default: int = 50
    inbox_cap: int = 500
    metadata_chars: int = 500
    meta_attachments: int = 10
    meta_extensions: int = 5
    body_preview_chars: int = 5_000
    embed_chars: int = 5_000
    embed_attachment_chars: int = 2_000
    rerank_chars: int = 1_200
    snippet_chars: int = 200
    largest_message: int = 50 * 1024 * 1024
    largest_attachment: int = 10 * 1024 * 1024
    overlap_seconds: int = 86_400
    buckets: int = 64
    bucket_messages: int = 250_000
    batch_messages: int = 50_000
    stall_seconds: float = 300.0
    quotes: bool = True
    quote_chars: int = 50_000
    quote_lines: int = 1_500
    link_scheme: str = "message"
    parser_default: bool = False
    rerank_default: bool = False


SETTINGS = Settings()


@dataclass(frozen=True)
class Filters:
    """All optional and conjunctive.  An empty string filters nothing, but an empty (not None) attachment
    filter asks for at least one attachment."""

    from_addr: str | None = None
    to_addr: str | None = None
    subject: str | None = None
    subject_like: str | None = None
    date_after: datetime | None = None
    date_before: datetime | None = None
    has_attachments: bool | None = None
    attachment_type: str | None = None
    attachment_name: str | None = None

    def any(self) -> bool:
        texts = (self.from_addr, self.to_addr, self.subject, self.subject_like, self.date_after, self.date_before, self.attachment_type, self.attachment_name)
        return any(texts) or self.has_attachments is not None

    def echo(self) -> dict[str, Any]:
        return {k: v.isoformat() if isinstance(v, datetime) else v for k, v in self.__dict__.items()}


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int | None = None
    filters: Filters = field(default_factory=Filters)
    use_parser: bool | None = None
    use_reranker: bool | None = None
    mode: str = "prefilter"  # exact; "postfilter" cuts before filtering, as an approximate index would


@dataclass(frozen=True)
class QueryRequest:
    filters: Filters = field(default_factory=Filters)
    limit: int | None = None


@dataclass(frozen=True)
class InboxRequest:
    limit: int = 50
    account: str | None = None
    date_after: datetime | None = None
    date_before: datetime | None = None


def query_limit(limit: int | None, s: Settings = SETTINGS) -> int:
    """None is the cap, everything else lies between 1 and the cap."""
    return s.query_cap if limit is None else max(1, min(limit, s.query_cap))


def builder_limit(limit: int | None, s: Settings = SETTINGS) -> int:
    """Unset, zero and negative limits are the cap, never none."""
    return limit if limit and limit > 0 else s.filtered_cap


def inbox_limit(limit: int, s: Settings = SETTINGS) -> int:
    return max(1, min(limit, s.inbox_cap))


def search_limit(limit: int | None, s: Settings = SETTINGS) -> int:
    return limit or s.search_default


def retrieval_width(limit: int, rerank: bool, s: Settings = SETTINGS) -> int:
    """Candidates to fetch, so that removing duplicates leaves enough."""
    return max(limit, s.rerank_width) if rerank else 2 * limit


def filtered_widths(want: int, matching: int, s: Settings = SETTINGS) -> tuple[int, int | None]:
    """First width of a search that filters afterwards, and the one to widen to if too few are left."""
    if matching <= want:
        return matching, None
    first = min(2 * want, matching, s.filtered_cap)
    return first, min(matching, s.filtered_cap) if first < matching else None


def enabled(flag: bool | None, default: bool) -> bool:
    return default if flag is None else flag


def attachment_flag(has: bool, without: bool, strict: bool) -> bool | None:
    """Both flags at once: an error where strict, else ``has`` wins."""
    if has and without and strict:
        raise ValueError("has_attachments and no_attachments exclude each other")
    return True if has else False if without else None


def merge_parsed(request: SearchRequest, parsed: dict[str, Any] | None) -> tuple[SearchRequest, bool]:
    """Explicit filters (not None) win over parsed ones; the parsed text replaces the query's."""
    if not parsed:
        return request, False
    own = request.filters
    merged = replace(own, **{k: parsed[k] for k in own.__dict__ if getattr(own, k) is None and parsed.get(k) is not None})
    return replace(request, query=parsed.get("semantic_query") or request.query, filters=merged), True


def parse_date(text: str | None) -> datetime | None:
    """ISO date or time; raises ValueError for anything else."""
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


def parse_date_or_none(text: str | None) -> datetime | None:
    try:
        return parse_date(text)
    except (ValueError, AttributeError, TypeError):
        return None


def display_date(value: datetime | str | None) -> str:
    """``2024-05-01 13:30``; text that is no date as it is, nothing as ``Unknown date``."""
    if not value:
        return "Unknown date"
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M")
    found = parse_date_or_none(value)
    return found.strftime("%Y-%m-%d %H:%M") if found else value
