"""HTML bodies to plain text, on the standard library's parser; used inside Arrow UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Subtrees without text, elements that never close, hidden styles and classes, the longest link kept,
# what begins a footer line (after marks of quoting and lists), and the shortest text before it.
DROPPED = frozenset({"style", "script", "head", "meta", "link", "title", "noscript"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HIDDEN_STYLES = {"display": "none", "visibility": "hidden"}
HIDDEN_CLASSES = ("preheader", "preview-text", "hidden", "screen-reader")
LONGEST_LINK = 150
FOOTERS = ("unsubscribe", "update your preferences", "you are receiving this email because", "manage your subscription")
FOOTER_MARKS = " \t\r\f\v>|*-["
FOOTER_LEAST = 200

_BLOCKS = frozenset({"address", "article", "aside", "blockquote", "center", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "header", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "tfoot", "thead", "tr", "ul"})
_HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
#: Elements that an opening tag of the same kind closes.
_SELF_CLOSING = {"li": {"ul", "ol"}, "p": set(), "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}


def hidden(attributes: dict[str, str | None]) -> bool:
    """Whether the style's last word on display or visibility, or a class, hides the element."""
    declared = {}
    for declaration in (attributes.get("style") or "").lower().split(";"):
        name, _, value = declaration.partition(":")
        declared[name.strip()] = value.replace("!", " ").split()[:1]
    if any(declared.get(name) == [value] for name, value in HIDDEN_STYLES.items()):
        return True
    classes = (attributes.get("class") or "").lower()
    return any(mark in classes for mark in HIDDEN_CLASSES)


class _Writer(HTMLParser):
    """Writes text as it reads: one open element a stack entry, hidden subtrees skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[list] = []  # name, hidden, href, place in out
        self.hidden = 0
        self.pre = 0
        self.lists: list[list] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _SELF_CLOSING:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._close(i)
                    break
                if self.stack[i][0] in _SELF_CLOSING[tag] or (tag == "p" and self.stack[i][0] in _BLOCKS):
                    break
        a = dict(attrs)
        hide = tag in DROPPED or hidden(a)
        if tag in VOID:
            if not hide and not self.hidden:
                self._void(tag, a)
            return
        self.stack.append([tag, hide, None, len(self.out)])
        if hide:
            self.hidden += 1
        if self.hidden:
            return
        if tag == "a":
            href = a.get("href") or ""
            if href and len(href) <= LONGEST_LINK:
                self.stack[-1][2] = href
        elif tag in _HEADINGS:
            self._line(2)
            self.out.append(_HEADINGS[tag])
        elif tag in ("ul", "ol"):
            self._line(1)
            self.lists.append([tag, 0])
        elif tag == "li":
            self._line(1)
            depth = max(0, len(self.lists) - 1)
            if self.lists:
                self.lists[-1][1] += 1
            self.out.append("  " * (depth + 1) + (f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "* "))
        elif tag in ("td", "th"):
            if self.out and not self._text().endswith("\n"):
                self.out.append(" | ")
        elif tag in _BLOCKS:
            self._line(1)
            self.pre += tag == "pre"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self.pre:
            data = re.sub(r"[ \t\r\n\f]+", " ", data)
            if self._text().endswith(("\n", " ")) or not self.out:
                data = data.lstrip(" ")
        if data:
            self.out.append(data)

    def _void(self, tag: str, a: dict) -> None:
        if tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self._line(1)
            self.out.append("* * *\n")
        elif tag == "img":
            self.out.append((a.get("alt") or "").strip())

    def _close(self, i: int) -> None:
        """Close the element at ``i`` and those left open inside it."""
        while len(self.stack) > i:
            tag, hid, href, place = self.stack.pop()
            if hid:
                self.hidden -= 1
                continue
            if self.hidden:
                continue
            if tag == "a" and href:
                inner = "".join(self.out[place:])
                if inner.strip():
                    del self.out[place:]
                    lead = inner[: len(inner) - len(inner.lstrip())]
                    self.out.append(lead + (href if inner.strip() == href else f"[{inner.strip()}]({href})"))
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self._line(1)
            elif tag in _HEADINGS or tag == "li" or tag in _BLOCKS:
                self._line(1)
                self.pre -= tag == "pre"

    def _text(self) -> str:
        return next((x for x in reversed(self.out) if x), "")

    def _line(self, n: int) -> None:
        """End the current line; n - 1 empty lines follow where there is text before."""
        while self.out and not self.out[-1]:
            self.out.pop()
        if self.out:
            tail = self._text()
            stripped = tail.rstrip(" ")
            if stripped != tail:
                self.out[-1] = stripped
            have = len(stripped) - len(stripped.rstrip("\n"))
            self.out.append("\n" * max(0, n - have))


def footer_cut(text: str) -> str:
    """The text before the first line that a footer begins with and at least ``FOOTER_LEAST`` characters precede."""
    at = text.find("\n", FOOTER_LEAST)
    while at >= 0:
        end = text.find("\n", at + 1)
        line = text[at + 1 : end if end >= 0 else len(text)]
        if line.lstrip(FOOTER_MARKS).lower().startswith(FOOTERS):
            return text[:at].rstrip()
        at = end
    return text


def plain_text(html: str) -> str:
    """Only the text of the markup, a line a piece."""
    pieces: list[str] = []
    p = HTMLParser()
    p.handle_data = pieces.append  # type: ignore[method-assign]
    p.feed(html)
    p.close()
    return "\n".join(pieces).strip()


def formatted_text(html: str) -> str:
    w = _Writer()
    w.feed(html)
    w.close()
    w._close(0)
    lines = [line.rstrip(" \t") for line in "".join(w.out).split("\n")]
    kept = footer_cut("\n".join(lines)).split("\n")
    # of several empty lines one stays
    return "\n".join(line for i, line in enumerate(kept) if line or not i or kept[i - 1]).strip()


#: Ways to read markup, best first.
READERS = [formatted_text, plain_text]


def html_to_text(html: str | None) -> str:
    """Readable text: no hidden parts, images as their alternative text, links as ``[text](url)`` unless they are
    long, footers cut, at most one empty line in a row.  Never raises: what one reader can't parse goes to the
    next, and at last stays as it is."""
    for reader in READERS if html else ():
        try:
            return reader(html)
        except Exception:  # whatever is wrong with the markup, the message has other fields
            continue
    return html or ""
