"""Removal of quoted replies: rules over lines, used inside Arrow UDFs."""

from __future__ import annotations

import re

from postlake.params import SETTINGS, Settings

_INTRO = re.compile(r"(?i)^\s*(on\b.{0,200}\bwrote:|le\b.{0,200}\ba écrit\s*:|am\b.{0,200}\bschrieb.{0,80}:|el\b.{0,200}\bescribió:)\s*$")
_RULE = re.compile(r"(?i)^\s*-{2,}\s*(original message|forwarded message|ursprüngliche nachricht|message d'origine|mensaje original)\s*-{2,}\s*$")
_HEADER = re.compile(r"(?i)^\s*\**from:\**\s+\S.*$")
_HEADER_NEXT = re.compile(r"(?i)^\s*\**(sent|date|to|cc|subject):")


def has_markers(text: str) -> bool:
    low = text.lower()
    return ">" in text or "wrote:" in low or "original message" in low or "-----" in text or "\nfrom:" in low


def should_strip(text: str, s: Settings = SETTINGS) -> bool:
    return s.quotes and len(text) <= s.quote_chars and text.count("\n") < s.quote_lines and has_markers(text)


def without_quotes(text: str, s: Settings = SETTINGS) -> str:
    """The text before the first reply intro, original-message rule or quoted header, without lines that begin
    with ``>``.  Text that would be empty then, or is too long, stays as it is; each line is matched within
    a bounded number of characters, so the work is bounded by lines."""
    if not text or not should_strip(text, s):
        return text
    lines = text.split("\n")
    end = len(lines)
    for i, line in enumerate(lines):
        two = line + " " + lines[i + 1].strip() if i + 1 < len(lines) and len(line) < 120 else line
        header = _HEADER.match(line) and any(_HEADER_NEXT.match(x) for x in lines[i + 1 : i + 4])
        if _INTRO.match(line) or (_INTRO.match(two) and re.match(r"(?i)\s*(on|le|am|el)\b", line)) or _RULE.match(line) or (header and i):
            end = i
            break
    kept = "\n".join(x for x in lines[:end] if not x.lstrip().startswith(">")).strip()
    return kept or text
