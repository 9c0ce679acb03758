"""Requests to responses: what the command line and tool servers call."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from postlake.operators import listing, search, staging
from postlake.params import (
    SETTINGS,
    Filters,
    InboxRequest,
    QueryRequest,
    SearchRequest,
    Settings,
    enabled,
    merge_parsed,
    query_limit,
    search_limit,
)
from postlake.plans.nlq import Parser, rule_parser
from postlake.sources.store import Store

NOTHING_INDEXED = "No messages are indexed yet; run the index command first."
NO_MATCH = "No messages match the filters."


@dataclass
class SearchResponse:
    query: str
    effective_query: str
    parser_applied: bool
    rerank_applied: bool
    indexed_emails: int
    filters: dict[str, Any]
    results: list[dict[str, Any]] = field(default_factory=list)
    message: str | None = None


@dataclass
class QueryResponse:
    filters: dict[str, Any]
    results: list[dict[str, Any]]
    limit: int
    truncated: bool


@dataclass
class InboxResponse:
    filters: dict[str, Any]
    results: list[dict[str, Any]]


@dataclass
class StatusResponse:
    embedding_model: str
    email_directory: str
    vector_path: str
    database_path: str
    total_indexed_emails: int
    total_emails: int
    total_attachments: int
    emails_with_attachments: int
    date_range: dict[str, str | None]
    batch_size: int
    search_results: int


def plain(value: Any) -> Any:
    """Rows, dates and arrays as JSON values."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def records(df: DataFrame) -> list[dict[str, Any]]:
    """A limited result as dictionaries."""
    return [plain(r) for r in df.collect()]


def payload(response: Any) -> str:
    return json.dumps(asdict(response) if hasattr(response, "__dataclass_fields__") else response, ensure_ascii=False, default=str)


class MailService:
    """Queries over a store, with pluggable embedder, question parser and reranker."""

    def __init__(self, store: Store, embed: search.Embed = search.hashing_embedder, parser: Parser = rule_parser, scorer: search.Scorer = search.word_overlap, s: Settings = SETTINGS, directory: str = "", model: str = "hashing"):
        self.store, self.embed, self.parser, self.scorer, self.s = store, embed, parser, scorer, s
        self.directory, self.model = directory, search.resolve_model(model)

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path, **options) -> MailService:
        return cls(Store(spark, root), **options)

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.store.table("emails"), self.store.table("attachments"), self.store.table("vectors")

    def search(self, request: SearchRequest) -> SearchResponse:
        resolved, applied = request, False
        if enabled(request.use_parser, self.s.parser_default):
            resolved, applied = merge_parsed(request, self.parser(request.query))
        emails, attachments, vectors = self._tables()
        rerank = enabled(resolved.use_reranker, self.s.rerank_default)
        n = vectors.count()
        out = SearchResponse(request.query, resolved.query, applied, False, n, resolved.filters.echo())
        if not n and emails.isEmpty():
            out.message = NOTHING_INDEXED
            return out
        if resolved.filters.any() and listing.matching(emails, attachments, resolved.filters).isEmpty():
            out.message = NO_MATCH
            return out
        vector = self.embed([resolved.query])[0]
        found = search.hybrid_search(emails, attachments, vectors, vector, resolved.filters, search_limit(resolved.limit, self.s), resolved.mode, resolved.query, self.scorer if rerank else None, self.s, self.store.vector_index())
        rows = records(listing.with_links(found))
        nested = self._attachments([r["id"] for r in rows if r["id"] is not None])
        for r in rows:
            r["attachments"] = nested.get(r["id"], [])
        out.rerank_applied = rerank and bool(rows)
        out.results = rows
        return out

    def _attachments(self, ids: list[int]) -> dict[int, list[dict[str, Any]]]:
        """Attachments of the few messages of a result."""
        out: dict[int, list[dict[str, Any]]] = {}
        if ids:
            for r in self.store.table("attachments").where(listing.F.col("email_id").isin(ids)).orderBy("email_id", "id").collect():
                out.setdefault(r["email_id"], []).append(plain(r))
        return out

    def query(self, request: QueryRequest) -> QueryResponse:
        """Messages by metadata; one row more than the limit says whether there are more."""
        limit = query_limit(request.limit, self.s)
        emails, attachments, _ = self._tables()
        rows = records(listing.with_links(listing.metadata_query(emails, attachments, request.filters, limit + 1, self.s)))
        nested = self._attachments([r["id"] for r in rows[:limit]])
        for r in rows[:limit]:
            r["attachments"] = nested.get(r["id"], [])
        return QueryResponse(request.filters.echo(), rows[:limit], limit, len(rows) > limit)

    def inbox(self, request: InboxRequest) -> InboxResponse:
        page = listing.inbox(self.store.table("emails"), request.limit, request.account, request.date_after, request.date_before, self.s)
        return InboxResponse({k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(request).items()}, records(listing.with_links(page).orderBy(listing.F.desc_nulls_last("date"), "id")))

    def status(self) -> StatusResponse:
        r = self.store.statistics().first()
        dates = {"min": r["min_date"] and r["min_date"].isoformat(), "max": r["max_date"] and r["max_date"].isoformat()}
        root = str(self.store.root)
        return StatusResponse(self.model, self.directory, f"{root}/vectors", root, r["total_indexed_emails"], r["total_emails"], r["total_attachments"], r["emails_with_attachments"], dates, 64, self.s.search_default)

    def inspect(self, path: str) -> dict[str, Any] | None:
        emails, _, vectors = self._tables()
        found = records(listing.inspect(emails, vectors, path))
        return found[0] if found else None

    def stage(self, root: str | Path, file_path: str | None = None, message_id: str | None = None, include_eml: bool = True) -> dict[str, Any]:
        return staging.stage_message(self.store.table("emails"), root, file_path, message_id, include_eml)


def shown(results: list[dict[str, Any]]) -> str:
    """A result list for a terminal."""
    from postlake.params import display_date

    lines = []
    for i, r in enumerate(results, 1):
        lines.append(f"{i}. {r.get('subject') or '(no subject)'}")
        lines.append(f"   {r.get('from_addr') or r.get('from') or ''}  {display_date(r.get('date'))}" + (f"  similarity {r['similarity']:.3f}" if r.get("similarity") is not None else ""))
        if names := [a["filename"] for a in r.get("attachments") or [] if a.get("filename")]:
            lines.append("   Attachments: " + ", ".join(names))
        if r.get("message_url"):
            lines.append(f"   {r['message_url']}")
    return "\n".join(lines) or "No results."


def filters_from(**values: Any) -> Filters:
    return Filters(**{k: v for k, v in values.items() if k in Filters.__dataclass_fields__})
