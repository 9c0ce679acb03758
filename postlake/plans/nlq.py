"""Questions in words to filters: a pluggable parser, its output coerced strictly."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.params import parse_date_or_none

Parser = Callable[[str], dict[str, Any] | None]
TEXTS = ("from_addr", "to_addr", "subject", "subject_like", "attachment_name")


def json_object(text: str | None) -> dict[str, Any] | None:
    """The object from the first ``{`` to the last ``}``, if that is one."""
    found = re.search(r"\{.*\}", text or "", re.S)
    if not found:
        return None
    try:
        value = json.loads(found.group())
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _text(value: Any) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def _flag(value: Any) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "yes": True, "false": False, "no": False}.get(value.strip().lower()) if isinstance(value, str) else None


def coerce(raw: dict[str, Any] | None, original: str) -> dict[str, Any] | None:
    """Known fields only; texts trimmed, what isn't one of the field's type is none."""
    if raw is None:
        return None
    out: dict[str, Any] = {k: _text(raw.get(k)) for k in TEXTS}
    out |= {k: parse_date_or_none(_text(raw.get(k))) for k in ("date_after", "date_before")}
    out["has_attachments"] = _flag(raw.get("has_attachments"))
    kind = _text(raw.get("attachment_type"))
    out["attachment_type"] = kind.lower().lstrip(".") or None if kind else None
    out["semantic_query"] = _text(raw.get("semantic_query")) or original
    return out


def rule_parser(question: str) -> dict[str, Any] | None:
    """``from:``, ``to:``, ``subject:``, ``after:``, ``before:``, ``has:attachment`` and ``type:`` words; the rest
    is what is searched for.  None where there is no such word."""
    names = {"from": "from_addr", "to": "to_addr", "subject": "subject_like", "after": "date_after", "before": "date_before", "type": "attachment_type", "name": "attachment_name"}
    found: dict[str, Any] = {}

    def take(m: re.Match) -> str:
        key, value = m.group(1).lower(), m.group(2).strip('"')
        if key == "has":
            found["has_attachments"] = True
        else:
            found[names[key]] = value
        return " "

    rest = re.sub(r'(?i)\b(from|to|subject|after|before|type|name|has):("[^"]*"|\S+)', take, question)
    found["semantic_query"] = " ".join(rest.split())
    return coerce(found, question) if len(found) > 1 else None


#: What each field of an answer holds.
FIELDS = {
    "semantic_query": "what the messages are about, in a few words, without the conditions below",
    "from_addr": "part of the sender's name or address",
    "to_addr": "part of a recipient's name or address",
    "subject": "the whole subject line, only if the question quotes it in full",
    "subject_like": "part of the subject line",
    "date_after": "first day, as YYYY-MM-DD",
    "date_before": "last day, as YYYY-MM-DD",
    "has_attachments": "true or false, if the question says whether files are attached",
    "attachment_type": "ending of the attached file's name, such as pdf",
    "attachment_name": "part of the attached file's name",
}


def prompt_for(question: str, today: date | None = None) -> str:
    """Asks a language model for the fields of a question as one JSON object."""
    day = today or date.today()
    lines = [f'  "{k}": {v}' for k, v in FIELDS.items()]
    return "\n".join(
        [
            "Someone searches a mail archive. Read the question and answer with one JSON object and nothing else.",
            "These are its fields; every one the question says nothing about is null:",
            *lines,
            f"Today is {day.isoformat()}, a {day:%A}. Turn days such as 'yesterday' or 'last month' into dates.",
            f"Question: {question}",
        ]
    )


def http_parser(url: str, model: str, prompt: Callable[[str], str] = prompt_for, timeout: float = 8.0) -> Parser:
    """A parser behind a local generation endpoint; none where it is away or answers with no object."""

    def parse(question: str) -> dict[str, Any] | None:
        body = json.dumps({"model": model, "prompt": prompt(question), "stream": False, "options": {"temperature": 0}}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                answer = json.loads(r.read())
        except (OSError, ValueError):
            return None
        return coerce(json_object(answer.get("response") if isinstance(answer, dict) else None), question)

    return parse


def json_object_column(text: str | Column) -> Column:
    """The outermost object in a text column, as text."""
    return F.nullif(F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"(?s)\{.*\}", 0), F.lit(""))


def coerced_columns(text: str | Column) -> dict[str, Column]:
    """The coercions over a column of JSON texts; numbers and other types that aren't text become null."""
    v = F.try_parse_json(json_object_column(text))
    get = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")))
    is_bool = F.schema_of_variant(F.try_variant_get(v, "$.has_attachments", "variant")) == "BOOLEAN"
    word = F.lower(get("has_attachments"))
    flag = F.when(is_bool, F.try_variant_get(v, "$.has_attachments", "boolean")).when(word.isin("true", "yes"), True).when(word.isin("false", "no"), False)
    return {k: get(k) for k in TEXTS} | {"has_attachments": flag, "attachment_type": F.nullif(F.regexp_replace(F.lower(get("attachment_type")), r"^\.+", ""), F.lit(""))}
