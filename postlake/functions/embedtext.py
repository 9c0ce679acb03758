"""The text that is embedded: subject, sender, body and what attachments say, within limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import cut, strip
from postlake.params import SETTINGS, Settings


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def embedding_text(subject, sender, body, attachments, s: Settings = SETTINGS) -> Column:
    """Lines: subject, sender, body (cut); with attachments ``Attachments:``, then each name and text.

    A text is cut with ``...``; the one that would exceed the total is cut to what is left of it (kept
    uncut where nothing is left) and ends the list, so later attachments lose even their names.
    ``attachments`` is an array of structs with filename and extracted_text.
    """
    full = lambda x: F.coalesce(_c(x), F.lit(""))
    base = F.array(full(subject), full(sender), cut(full(body), s.embed_chars))
    begun = F.when(F.size(_c(attachments)) > 0, F.array_append(base, F.lit("Attachments:"))).otherwise(base)
    start = F.struct(begun.alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("over"))

    def add(state: Column, a: Column) -> Column:
        text = a["extracted_text"]
        short = F.when(F.length(text) > s.embed_attachment_chars, F.concat(cut(text, s.embed_attachment_chars), F.lit("..."))).otherwise(text)
        named = F.array_append(state["parts"], F.coalesce(a["filename"], F.lit("Unknown")))
        rest = F.lit(s.embed_chars) - state["used"]
        last = F.when(rest > 0, F.concat(F.substr(short, F.lit(1), rest), F.lit("..."))).otherwise(short)
        bare = F.struct(named.alias("parts"), state["used"].alias("used"), F.lit(False).alias("over"))
        closed = F.struct(F.array_append(named, last).alias("parts"), state["used"].alias("used"), F.lit(True).alias("over"))
        more = F.struct(F.array_append(named, short).alias("parts"), (state["used"] + F.length(short)).alias("used"), F.lit(False).alias("over"))
        new = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, bare).when(state["used"] + F.length(short) > s.embed_chars, closed).otherwise(more)
        return F.when(state["over"], state).otherwise(new)

    pairs = F.transform(_c(attachments), lambda a: F.struct(a["filename"].alias("filename"), a["extracted_text"].alias("extracted_text")))
    state = F.aggregate(F.coalesce(pairs, F.expr("cast(array() as array<struct<filename:string,extracted_text:string>>)")), start, add)
    return strip(F.array_join(state["parts"], "\n"))


def fallback_document(subject, body, attachments) -> Column:
    """The stored document where no text is given: subject, the body's first 1,000 characters, up to five names."""
    names = F.filter(F.transform(_c(attachments), lambda a: a["filename"]), lambda n: F.coalesce(n, F.lit("")) != "")
    more = F.when(F.size(names) > 5, F.concat(F.lit(" (+"), (F.size(names) - 5).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    listed = F.when(F.size(names) > 0, F.concat(F.lit("Attachments: "), F.array_join(F.slice(names, 1, 5), ", "), more))
    return F.concat_ws("\n", F.coalesce(_c(subject), F.lit("")), cut(F.coalesce(_c(body), F.lit("")), 1000), listed)
