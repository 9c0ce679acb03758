"""The service as named tools with JSON arguments, for assistants and scripts.

``serve`` speaks JSON lines: ``{"tool": name, "arguments": {...}}`` in, ``{"result": ...}`` or ``{"error": ...}`` out.
"""

from __future__ import annotations

import inspect
import json
from dataclasses import asdict
from pathlib import Path
from typing import IO, Any

from postlake.operators.staging import clear_staged
from postlake.params import Filters, InboxRequest, QueryRequest, SearchRequest, attachment_flag, parse_date
from postlake.plans.service import MailService


class Tools:
    NAMES = ("search_emails", "query_emails", "get_status", "list_inbox_emails", "stage_email_attachments", "clear_staged_emails")

    def __init__(self, service: MailService, staging_root: str | Path):
        self.service, self.staging_root = service, staging_root

    @staticmethod
    def _filters(from_addr, to_addr, subject, subject_like, date_after, date_before, has_attachments, no_attachments, attachment_type, attachment_name) -> Filters:
        """Dates that aren't ISO, and both attachment flags at once, are errors here."""
        has = attachment_flag(bool(has_attachments), bool(no_attachments), strict=True)
        return Filters(from_addr, to_addr, subject, subject_like, parse_date(date_after), parse_date(date_before), has, attachment_type, attachment_name)

    def search_emails(self, query: str, from_addr=None, to_addr=None, subject=None, subject_like=None, date_after=None, date_before=None, has_attachments=None, no_attachments=None, attachment_type=None, attachment_name=None, limit=None, auto_filters=None, rerank=None) -> dict[str, Any]:
        f = self._filters(from_addr, to_addr, subject, subject_like, date_after, date_before, has_attachments, no_attachments, attachment_type, attachment_name)
        return asdict(self.service.search(SearchRequest(query, limit, f, auto_filters, rerank)))

    def query_emails(self, from_addr=None, to_addr=None, subject=None, subject_like=None, date_after=None, date_before=None, has_attachments=None, no_attachments=None, attachment_type=None, attachment_name=None, limit=None) -> dict[str, Any]:
        f = self._filters(from_addr, to_addr, subject, subject_like, date_after, date_before, has_attachments, no_attachments, attachment_type, attachment_name)
        return asdict(self.service.query(QueryRequest(f, limit)))

    def get_status(self) -> dict[str, Any]:
        return asdict(self.service.status())

    def list_inbox_emails(self, limit: int = 50, account=None, date_after=None, date_before=None) -> dict[str, Any]:
        return asdict(self.service.inbox(InboxRequest(limit, account, parse_date(date_after), parse_date(date_before))))

    def stage_email_attachments(self, message_id=None, file_path=None, include_eml: bool = True) -> dict[str, Any]:
        if not message_id and not file_path:
            return {"status": "failed", "message": "a message_id or a file_path is needed"}
        return self.service.stage(self.staging_root, file_path, message_id, include_eml)

    def clear_staged_emails(self, short_hash=None) -> dict[str, Any]:
        return clear_staged(self.staging_root, short_hash)

    def describe(self) -> list[dict[str, Any]]:
        return [{"name": n, "arguments": list(inspect.signature(getattr(self, n)).parameters)} for n in self.NAMES]

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> dict[str, Any]:
        if name not in self.NAMES:
            raise ValueError(f"there is no tool {name!r}")
        return getattr(self, name)(**(arguments or {}))

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                answer = {"result": self.describe() if request.get("tool") == "list" else self.call(request["tool"], request.get("arguments"))}
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                answer = {"error": str(e)}
            print(json.dumps(answer, ensure_ascii=False, default=str), file=out, flush=True)
