"""Text of attachments: Office Open XML by zip and XML, plain text and CSV, PDF; readers are pluggable."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

from postlake.functions.pdf import pdf_text
from postlake.params import SETTINGS

Extractor = Callable[[bytes], str | None]

# Name spaces of Office Open XML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (kind, part name)."""
    folder, _, name = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    found = {}
    for r in root if root is not None else ():
        path: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for step in r.get("Target", "").strip("/").split("/"):
            path = path[:-1] if step == ".." else [*path, step]
        found[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], "/".join(path))
    return found


def _word_text(p) -> str:
    out = []
    for e in p.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def docx(data: bytes) -> str | None:
    """Paragraphs of the body that aren't blank, then table rows, cells joined with `` | ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(W + "body")
    lines = [t for p in body.findall(W + "p") if (t := _word_text(p)).strip()]
    for row in (r for t in body.findall(W + "tbl") for r in t.findall(W + "tr")):
        cells = ["\n".join(_word_text(p) for p in c.findall(W + "p")).strip() for c in row.findall(W + "tc")]
        if any(cells):
            lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines) or None


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx(data: bytes) -> str | None:
    """``Sheet: name`` and its rows, cells joined with `` | ``; sheets apart by an empty line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared_xml = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in shared_xml.findall(S + "si")] if shared_xml is not None else []
        targets = _targets(z, "xl/workbook.xml")
        blocks = []
        for sheet in _xml(z, "xl/workbook.xml").iter(S + "sheet"):
            root = _xml(z, targets.get(sheet.get(R + "id"), ("", ""))[1])
            rows = []
            for row in root.iter(S + "row") if root is not None else ():
                cells: list[str] = []
                for c in row.findall(S + "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    kind, v = c.get("t"), c.find(S + "v")
                    text = v.text or "" if v is not None else ""
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(S + "t"))
                    elif kind == "b":
                        text = "True" if text == "1" else "False"
                    cells.append(text)
                if line := " | ".join(cells).strip():
                    rows.append(line)
            if rows:
                blocks.append("\n".join([f"Sheet: {sheet.get('name')}", *rows]))
    return "\n\n".join(blocks) or None


def _shapes(root) -> list[str]:
    out = []
    for body in root.iter(P + "txBody"):
        text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in body.findall(A + "p")).strip()
        if text:
            out.append(text)
    return out


def pptx(data: bytes) -> str | None:
    """``Slide k:``, the text of its shapes and its notes; slides apart by an empty line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = _targets(z, "ppt/presentation.xml")
        blocks = []
        for k, slide in enumerate(_xml(z, "ppt/presentation.xml").iter(P + "sldId"), 1):
            part = targets[slide.get(R + "id")][1]
            lines = _shapes(_xml(z, part))
            notes = next((p for kind, p in _targets(z, part).values() if kind == "notesSlide"), None)
            for sp in _xml(z, notes).iter(P + "sp") if notes else ():
                ph = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                if ph is not None and ph.get("type") == "body" and (text := "\n".join(_shapes(sp))):
                    lines.append(f"Notes: {text}")
            if lines:
                blocks.append("\n".join([f"Slide {k}:", *lines]))
    return "\n\n".join(blocks) or None


def text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def pdf(data: bytes) -> str | None:
    """Pages joined by line ends, by a PDF library where one is installed, else by our own reader."""
    try:
        import pdfplumber
    except ImportError:
        return pdf_text(data)
    with pdfplumber.open(io.BytesIO(data)) as f:
        return "\n".join(t for page in f.pages if (t := page.extract_text())) or None


# Kinds, in order of precedence, with the endings and the words in a type (whole types begin with =)
# that speak for them.
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "pdf": (("pdf",), ("pdf",)),
    "docx": (("docx", "docm"), ("wordprocessingml", "=application/msword", "=application/vnd.ms-word.document.macroenabled.12", "=application/vnd.ms-word.template.macroenabled.12")),
    "xlsx": (("xlsx", "xlsm"), ("spreadsheetml", "excel")),
    "pptx": (("pptx", "pptm", "ppsx", "ppsm"), ("presentationml", "powerpoint")),
    "text": (("txt", "csv"), ("text/plain", "text/csv")),
}
ENDINGS = {ending: kind for kind, (endings, _) in KINDS.items() for ending in endings}
PRECEDENCE = list(KINDS)


def kind_of(content_type: str, filename: str) -> str | None:
    """The kind of highest precedence that the type or the name's ending speaks for."""
    stated = (content_type or "").lower()
    said = {kind for kind, (_, words) in KINDS.items() for w in words if (stated == w[1:] if w[0] == "=" else w in stated)}
    said.add(ENDINGS.get((filename or "").lower().rpartition(".")[2] if "." in (filename or "") else ""))
    return min(said - {None}, key=PRECEDENCE.index, default=None)


EXTRACTORS: dict[str, Extractor] = {"pdf": pdf, "docx": docx, "xlsx": xlsx, "pptx": pptx, "text": text}


def attachment_text(data: bytes | None, content_type: str, filename: str, extractors: dict[str, Extractor] | None = None, largest: int = SETTINGS.largest_attachment) -> str | None:
    """Text of an attachment; null where it is empty, too large, of no known kind or can't be read."""
    kind = kind_of(content_type, filename)
    if not data or len(data) > largest or kind is None or (kind in ("docx", "xlsx", "pptx") and data[:2] != b"PK"):
        return None
    try:
        return (extractors or EXTRACTORS)[kind](data)
    except Exception:
        return None
