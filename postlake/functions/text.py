"""Text expressions: links, extensions, names, snippets, reply markers, footers.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.html import FOOTER_LEAST, FOOTER_MARKS, FOOTERS
from postlake.params import SETTINGS, Settings

NO_SUBJECT = "(no subject)"
#: White space at either end, as regular expressions see it.
_EDGE = r"^[\s]+|[\s]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(x) -> Column:
    return F.regexp_replace(_c(x), _EDGE, "")


def contains_like(column, value: str) -> Column:
    """Case-insensitive LIKE '%value%'; % and _ in the value are wildcards, a backslash is itself."""
    return _c(column).ilike("%" + value.replace("\\", "\\\\") + "%")


def message_id_of(x) -> Column:
    """Trimmed, without one pair of angle brackets; empty is null."""
    inner = strip(F.regexp_replace(strip(x), r"(?s)^<(.*)>$", "$1"))
    return F.nullif(inner, F.lit(""))


def percent_encode(x) -> Column:
    """Percent-encoding that leaves letters, digits, ``_.-~@/`` as they are."""
    out = F.url_encode(_c(x))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%40", "@"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def message_url(mid) -> Column:
    return F.concat(F.lit("message:"), percent_encode(F.concat(F.lit("<"), _c(mid), F.lit(">"))))


def link_label(subject) -> Column:
    bare = F.regexp_replace(F.coalesce(_c(subject), F.lit("")), r"[\[\]]", "")
    return F.coalesce(F.nullif(strip(F.regexp_replace(bare, r"\s+", " ")), F.lit("")), F.lit(NO_SUBJECT))


def link_fields(message_id="message_id", subject="subject", scheme: str | None = None) -> dict[str, Column]:
    """message_url, mid_url and markdown_link; all null where there is no message id."""
    mid = message_id_of(message_id)
    url, short = message_url(mid), F.concat(F.lit("mid:"), mid)
    target = F.when(short.rlike(r"[()]"), url).otherwise(short) if (scheme or SETTINGS.link_scheme) == "mid" else url
    return {"message_url": url, "mid_url": short, "markdown_link": F.concat(F.lit("["), link_label(subject), F.lit("]("), target, F.lit(")"))}


def base_name(path) -> Column:
    return F.regexp_extract(F.regexp_replace(_c(path), r"/+$", ""), r"[^/]*$", 0)


def file_extension(name) -> Column:
    """Last suffix of the file name in lower case, without its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+\.([^.]+)$", 1))


def meta_extension(name) -> Column:
    """What follows the last dot anywhere in the name, in lower case; null without a dot."""
    return F.when(F.contains(_c(name), F.lit(".")), F.lower(F.regexp_extract(_c(name), r"\.([^.]*)$", 1)))


def attachment_types(attachments, s: Settings = SETTINGS) -> Column:
    """First distinct extensions of the first attachments, joined with commas."""
    names = F.transform(F.slice(_c(attachments), 1, s.meta_attachments), lambda a: meta_extension(a["filename"]))
    return F.array_join(F.slice(F.array_distinct(F.filter(names, lambda e: e.isNotNull() & (e != ""))), 1, s.meta_extensions), ",")


def file_hash(path) -> Column:
    return F.md5(_c(path))


def short_hash(path) -> Column:
    return F.substring(file_hash(path), 1, 12)


def safe_name(name, fallback: str = "attachment") -> Column:
    """A name fit for a file: odd characters become ``_``, at most 200 characters."""
    kept = F.regexp_replace(strip(F.coalesce(_c(name), F.lit(""))), r"[^A-Za-z0-9._\- ]+", "_")
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(kept, r"\s+", " ")), 1, 200), F.lit("")), F.lit(fallback))


def move_prefix(path, old: str, new: str) -> Column:
    """The path under the new prefix where it lies under the old one (compared with a closing slash)."""
    o, n = old.rstrip("/") + "/", new.rstrip("/") + "/"
    return F.when(F.startswith(_c(path), F.lit(o)), F.concat(F.lit(n), F.substr(_c(path), F.lit(len(o) + 1))))


def snippet(preview, s: Settings = SETTINGS) -> Column:
    return F.substring(F.coalesce(_c(preview), F.lit("")), 1, s.snippet_chars)


def cut(x, n: int) -> Column:
    return F.substring(_c(x), 1, n)


def reply_markers(text) -> Column:
    t, low = _c(text), F.lower(_c(text))
    return F.contains(t, F.lit(">")) | F.contains(low, F.lit("wrote:")) | F.contains(low, F.lit("original message")) | F.contains(t, F.lit("-----")) | F.contains(low, F.lit("\nfrom:"))


def quotes_to_strip(text, s: Settings = SETTINGS) -> Column:
    """Whether quoted replies are looked for: enabled, not too long, and there is a marker."""
    lines = F.length(_c(text)) - F.length(F.replace(_c(text), F.lit("\n"), F.lit(""))) + 1
    return F.lit(s.quotes) & (F.length(_c(text)) <= s.quote_chars) & (lines <= s.quote_lines) & reply_markers(text)


def redundant_links(text) -> Column:
    """``[url](url)`` becomes ``url``."""
    return F.regexp_replace(_c(text), r"\[(?=https?://)([^\]]+)\]\(\1\)", "$1")


def squeeze_blank(text) -> Column:
    return strip(F.regexp_replace(_c(text), r"\n{3,}", "\n\n"))


def before_footer(text) -> Column:
    """As ``html.footer_cut``: the text before the first footer line that enough text precedes.

    The search begins behind that text, at the end of a line, so its first hit is the one wanted.
    """
    marks = "".join("\\" + c if c in "|*-[" else c for c in FOOTER_MARKS)
    line = rf"(?i)\n[{marks}]*(?:{'|'.join(FOOTERS)})"

    def cut_at(t: Column) -> Column:
        low = F.lower(t)
        # few texts have a marker at all, and a plain search tells so without the expression
        some = F.lit(False)
        for m in FOOTERS:
            some = some | F.contains(low, F.lit(m))
        at = F.when(some, F.regexp_instr(F.substr(t, F.lit(FOOTER_LEAST + 1)), F.lit(line)))
        return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_replace(F.substr(t, F.lit(1), at + FOOTER_LEAST - 1), r"\s+$", "")).otherwise(t)

    return bound(_c(text), cut_at)


def rerank_text(document, subject, preview, s: Settings = SETTINGS) -> Column:
    """The document, else subject and preview, else either; cut."""
    full = lambda x: F.nullif(strip(F.coalesce(_c(x), F.lit(""))), F.lit(""))
    both = F.nullif(F.concat_ws("\n", full(subject), full(preview)), F.lit(""))
    return cut(F.coalesce(full(document), both, F.lit("")), s.rerank_chars)


def display_date(column) -> Column:
    return F.coalesce(F.date_format(_c(column), "yyyy-MM-dd HH:mm"), F.lit("Unknown date"))


def account_pattern(account: str | None) -> str:
    """LIKE pattern of the inbox folder, of one account or of all."""
    return f"%{account.replace('@', '%40')}%/INBOX.mailbox/%" if account else "%/INBOX.mailbox/%"
