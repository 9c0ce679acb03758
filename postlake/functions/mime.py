"""Messages in RFC 5322 form to records, on the standard library; used inside Arrow UDFs."""

from __future__ import annotations

import email
import email.header
import email.policy
from datetime import UTC, datetime
from email.headerregistry import HeaderRegistry
from email.message import Message
from email.utils import parsedate_to_datetime
from functools import lru_cache
from typing import Any

from postlake.functions.attachments import attachment_text
from postlake.functions.html import html_to_text
from postlake.functions.quotes import without_quotes
from postlake.params import SETTINGS, Settings

#: Cleaned HTML of fewer characters yields to plain text, where there is some.
LEAST_HTML = 30
#: Parsed headers that are remembered, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 256, 1_000


@lru_cache(64)
def _header_class(name: str) -> type:
    return HeaderRegistry()[name]


class _Registry(HeaderRegistry):
    """Makes a class a header name, not one each time that a header is read."""

    def __getitem__(self, name: str) -> type:
        return _header_class(name.lower())


_EACH_TIME = email.policy.EmailPolicy(header_factory=_Registry())
_remembered = lru_cache(REMEMBERED)(_EACH_TIME.header_fetch_parse)


class _Policy(email.policy.EmailPolicy):
    """The default policy, which parses a header whenever it is asked for; the last few wordings are remembered."""

    def header_fetch_parse(self, name: str, value: Any) -> Any:
        short = type(value) is str and len(value) <= LONGEST_REMEMBERED
        return (_remembered if short else _EACH_TIME.header_fetch_parse)(name, value)


POLICY = _Policy()


def header(msg: Message, name: str) -> str:
    """The header's text; where it is malformed, as it stands in the file."""
    try:
        value = msg.get(name, "")
        return "" if value is None else str(value)
    except (AttributeError, IndexError, TypeError, ValueError):
        return next((str(v) for k, v in msg.raw_items() if k.lower() == name.lower()), "")


def decode_words(raw: str, joint: str) -> str:
    """Encoded words decoded, unknown character sets as UTF-8, pieces joined."""
    out = []
    for piece, charset in email.header.decode_header(raw):
        if isinstance(piece, bytes):
            try:
                piece = piece.decode(charset or "utf-8", "ignore")
            except LookupError:
                piece = piece.decode("utf-8", "ignore")
        out.append(piece)
    return joint.join(out)


def part_text(part: Message) -> str:
    data = part.get_payload(decode=True)
    if not data:
        return ""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "ignore")
    except LookupError:
        return data.decode("utf-8", "ignore")


def date_of(raw: str) -> tuple[datetime | None, int | None]:
    """In UTC, and how many minutes the sender's clock was ahead of it (null where the date doesn't say; it is taken
    as UTC then).  A date that can't be read is null."""
    try:
        d = parsedate_to_datetime(raw)
    except (ValueError, TypeError, IndexError):
        return None, None
    ahead = d.utcoffset()
    return (d.replace(tzinfo=UTC), None) if ahead is None else (d.astimezone(UTC), int(ahead.total_seconds() // 60))


Part = tuple[Message, str]


def parts_of(msg: Message) -> list[Part]:
    """The parts of a message, itself included, with their content types."""
    return [(p, p.get_content_type()) for p in msg.walk()]


def body_of(parts: list[Part], s: Settings = SETTINGS) -> str:
    plain = "\n".join(t for p, kind in parts if kind == "text/plain" and not p.is_multipart() and (t := part_text(p)))
    html = next((t for p, kind in parts if kind == "text/html" and (t := part_text(p))), "")
    cleaned = html_to_text(html)
    body = cleaned if cleaned and (not plain or len(cleaned.strip()) >= LEAST_HTML) else plain
    return without_quotes(body, s)


def attachments_of(parts: list[Part], s: Settings = SETTINGS) -> list[dict[str, Any]]:
    """Parts whose disposition says attachment or inline; those that are too large without their text."""
    found = []
    for part, kind in parts:
        if part.is_multipart():
            continue
        disposition = str(part.get("Content-Disposition", "") or "")
        if not any(x in disposition.lower() for x in ("attachment", "inline")):
            continue
        name = part.get_filename()
        name = decode_words(name, "") if name else ""
        stated = str(part.get("Content-Length", "") or "").strip()
        size = int(stated) if stated.isdigit() else 0
        data = part.get_payload(decode=True) if size <= s.largest_attachment else None
        size = size or len(data or b"")
        text = attachment_text(data, kind, name, largest=s.largest_attachment) if data and size <= s.largest_attachment else None
        found.append({"filename": name, "content_type": kind or "", "content_disposition": disposition, "size": size, "extracted_text": text or None})
    return found


def parse_message(content: bytes, s: Settings = SETTINGS) -> dict[str, Any]:
    """The record of one message; ``parse_error`` says why where there is none."""
    try:
        msg = email.message_from_bytes(content, policy=POLICY)
        subject = header(msg, "Subject")
        raw = header(msg, "Date")
        parts = parts_of(msg)
        date, ahead = date_of(raw) if raw else (None, None)
        return {
            "subject": decode_words(subject, " ") if subject else "",
            "from": header(msg, "From"),
            "to": header(msg, "To"),
            "cc": header(msg, "Cc"),
            "bcc": header(msg, "Bcc"),
            "date": date,
            "date_offset": ahead,
            "date_raw": raw,
            "message_id": header(msg, "Message-ID"),
            "body": body_of(parts, s),
            "attachments": attachments_of(parts, s),
            "in_reply_to": header(msg, "In-Reply-To"),
            "references": header(msg, "References"),
            "parse_error": None,
        }
    except Exception as e:  # one bad message must not end a task
        return {"attachments": [], "parse_error": f"{type(e).__name__}: {e}"[:500]}
