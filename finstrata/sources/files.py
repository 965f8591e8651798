"""Report files to documents with ordered sections.

``read_reports`` reads files as binary rows and parses each in an Arrow batch.  Office and HTML files need only the
standard library; PDF and recognition need optional packages and say so when they are missing.  Broken files give a
row with ``error`` and no sections, so one bad file fails no job.
"""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..schemas import DOCUMENT
from .detect import SUFFIXES

_MAX_TITLE, _STOPS = 120, ".!?:,;"


def is_title(text: str) -> bool:
    """The rule of :func:`finstrata.operators.text.looks_like_title` for one string."""
    s = text.strip()
    return 0 < len(s) <= _MAX_TITLE and not any(c in s for c in "\n" + _STOPS)


def table_text(rows: list[list[str]]) -> str:
    return " | ".join(" | ".join(r) for r in rows)


def _section(kind: str, text: str, rows: list[list[str]] | None = None, page: int = 1, top: float | None = None, bottom: float | None = None) -> dict:
    return {"page": page, "block_type": kind, "text": text, "cell_rows": rows or [], "y_top": top, "y_bottom": bottom}


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables in document order.

    An element that is never closed ends with its parent, so what follows in the parent belongs to it too, as in the
    tree that the standard parser's events describe.
    """

    HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
    TEXTS = HEADINGS | {"p", "li"}
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict | None]] = []
        self.blocks: list[dict] = []

    def handle_starttag(self, tag: str, attrs: object) -> None:
        node = None
        inside = any(t == "table" for t, _ in self.stack)
        if tag in self.TEXTS and not inside:
            node = {"kind": tag, "parts": []}
            self.blocks.append(node)
        elif tag == "table":
            node = {"kind": "table", "rows": [], "nested": inside}
            if not inside:
                self.blocks.append(node)
        elif tag == "tr" and inside:
            node = {"kind": "tr", "cells": []}
            for t, n in self.stack:
                if t == "table":
                    n["rows"].append(node["cells"])
        elif tag in ("td", "th") and inside:
            node = {"kind": "cell", "parts": []}
            for t, n in self.stack:
                if t == "tr":
                    n["cells"].append(node["parts"])
        if tag not in self.VOID:
            self.stack.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not any(t in ("script", "style") for t, _ in self.stack):
            for _, n in self.stack:
                if n and "parts" in n:
                    n["parts"].append(text)


def parse_html(content: bytes) -> list[dict]:
    """Sections of an HTML file: headings are titles, and so are short unpunctuated texts; nothing is taken from inside tables but their cells."""
    p = _Blocks()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    out = []
    for b in p.blocks:
        if b["kind"] == "table":
            rows = [cells for cells in ([" ".join(c) for c in r] for r in b["rows"]) if any(cells)]
            if rows:
                out.append(_section("table", table_text(rows), rows))
        elif text := " ".join(b["parts"]):
            out.append(_section("title" if b["kind"] in _Blocks.HEADINGS or is_title(text) else "paragraph", text))
    return out


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def parse_docx(content: bytes) -> list[dict]:
    """Sections of a Word file in body order: paragraphs that aren't blank, and all tables; merged cells repeat their text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _tag(e) == "body")

    def paragraph(e: ElementTree.Element) -> str:
        parts = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n", "cr": lambda x: "\n", "noBreakHyphen": lambda x: "-"}
        return "".join(parts[_tag(x)](x) for x in e.iter() if _tag(x) in parts)

    out = []
    for e in body:
        if _tag(e) == "p":
            if text := paragraph(e).strip():
                out.append(_section("title" if is_title(text) else "paragraph", text))
        elif _tag(e) == "tbl":
            rows: list[list[str]] = []
            for tr in (x for x in e if _tag(x) == "tr"):
                cells: list[str] = []
                for tc in (x for x in tr if _tag(x) == "tc"):
                    marks = {_tag(x): next((v for k, v in x.attrib.items() if k.endswith("val")), "") for props in tc if _tag(props) == "tcPr" for x in props}
                    text = "\n".join(paragraph(x) for x in tc if _tag(x) == "p").strip()
                    if marks.get("vMerge", "restart") != "restart" and rows and len(cells) < len(rows[-1]):
                        text = rows[-1][len(cells)]  # goes on from the cell above
                    cells += [text] * int(marks.get("gridSpan") or 1)
                rows.append(cells)
            out.append(_section("table", table_text(rows), rows))
    return out


def parse_xlsx(content: bytes) -> list[dict]:
    """Sections of a workbook: a title with the name of each sheet, and a table of its rows that aren't empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        links = {}
        if "xl/_rels/workbook.xml.rels" in names:
            links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [s for s in book.iter() if _tag(s) == "sheet"]
        since = datetime(1904, 1, 1) if any(x.get("date1904") in ("1", "true") for x in book.iter() if _tag(x) == "workbookPr") else _EPOCH
        dated = _dated_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else {}
        for i, s in enumerate(sheets, 1):
            title = s.get("name", "")
            out.append(_section("title", title))
            target = next((links[v] for k, v in s.attrib.items() if k.endswith("}id") and v in links), f"worksheets/sheet{i}.xml")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(path)).iter() if _tag(r) == "row"):
                cells: list[str] = []
                for c in (x for x in row if _tag(x) == "c"):
                    at = _column(c.get("r", ""), len(cells))
                    cells += [""] * (at - len(cells)) + [_cell(c, shared, dated, since)]
                if any(cells):
                    rows.append(cells)
            width = max(map(len, rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in rows]
            if rows:
                out.append(_section("table", table_text(rows), rows))
    return out


def _column(ref: str, default: int) -> int:
    n = 0
    for ch in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1 if n else default


_EPOCH = datetime(1899, 12, 30)
# The numbers of the built-in formats of dates and times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _dated_styles(content: bytes) -> dict[int, str]:
    """date or duration for the cell styles whose number format shows one."""
    root = ElementTree.fromstring(content)
    codes = {int(f.get("numFmtId", -1)): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
    out = {}
    for xfs in (x for x in root if _tag(x) == "cellXfs"):
        for i, xf in enumerate(xfs):
            number = int(xf.get("numFmtId", 0))
            code = codes.get(number, "")
            plain = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
            if number == 46 or re.search(r"\[(?:h+|m+|s+)\]", plain):
                out[i] = "duration"
            elif number in _DATE_FORMATS and not code or re.search("[dmhys]", plain.partition(";")[0]):
                out[i] = "date"
    return out


def _moment(days: float, kind: str, since: datetime) -> str:
    """The text of a date, a time of day or a duration that is stored as a number of days."""
    if kind == "duration":
        return str(timedelta(days=days))
    part = timedelta(milliseconds=round(days % 1 * 86_400_000))
    if 0 <= days < 1 and part < timedelta(days=1):
        return str((datetime.min + part).time())
    early = since == _EPOCH and 0 < days < 60  # the calendar there has a 29 February 1900
    return str(since + timedelta(days=math.floor(days) + early) + part)


def _cell(c: ElementTree.Element, shared: list[str], dated: dict[int, str], since: datetime) -> str:
    """The text of a cell's value: numbers with a point or exponent as floats, dates as dates, truth values as True and False."""
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter() if _tag(t) == "t").strip()
    value = next((v.text or "" for v in c if _tag(v) == "v"), "")
    if kind == "s" and value:
        return shared[int(value)].strip()
    if kind == "b" and value:
        return "True" if value == "1" else "False"
    if kind == "d" and value:
        return str(datetime.fromisoformat(value))
    if kind != "n" or not value.strip():
        return value.strip()
    try:
        number = float(value) if set(value) & set(".eE") else int(value)
        style = dated.get(int(c.get("s", 0)))
        return _moment(number, style, since) if style else str(number)
    except (ValueError, OverflowError):
        return value.strip()


def parse_pdf_text(content: bytes) -> list[dict]:
    """Sections of a PDF with text: blocks outside tables, then the tables, page by page.  Needs PyMuPDF."""
    import fitz

    out = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            height = page.rect.height
            tables = page.find_tables().tables
            areas = [fitz.Rect(t.bbox) for t in tables]
            for x0, y0, x1, y1, text, *_ in sorted(page.get_text("blocks"), key=lambda b: (b[1], b[0])):
                text = text.strip()
                if not text or any(fitz.Rect(x0, y0, x1, y1).intersects(a) for a in areas):
                    continue
                kind = "header" if y0 < 0.05 * height else "footer" if y1 > 0.95 * height else "title" if is_title(text) else "paragraph"
                out.append(_section(kind, text, None, number, round(y0 / height, 4), round(y1 / height, 4)))
            for t in tables:
                rows = [[(c or "").strip() for c in r] for r in t.extract()]
                out.append(_section("table", table_text(rows), rows, number, round(t.bbox[1] / height, 4), round(t.bbox[3] / height, 4)))
    return out


def parse_pdf_scan(content: bytes, recognize: Callable[[bytes], list[str]] | None = None, settings: Settings = Settings()) -> list[dict]:  # noqa: B008
    """One paragraph per page with recognised text.  ``recognize`` gives the pages' texts; else PyMuPDF and pytesseract are needed."""
    if recognize:
        texts = recognize(content)
    else:
        import fitz
        import pytesseract
        from PIL import Image, ImageOps

        language = settings.ocr_language if "eng" in settings.ocr_language else f"{settings.ocr_language}+eng"
        texts = []
        with fitz.open(stream=content, filetype="pdf") as doc:
            for page in doc:
                pix = page.get_pixmap(dpi=settings.ocr_dpi)
                image = ImageOps.autocontrast(Image.frombytes("RGB", (pix.width, pix.height), pix.samples).convert("L"))
                texts.append(pytesseract.image_to_string(image, lang=language, config=f"--oem {settings.ocr_oem} --psm {settings.ocr_psm}"))
    return [_section("paragraph", t.strip(), None, i) for i, t in enumerate(texts, 1) if t.strip()]


PARSERS: dict[str, Callable[[bytes], list[dict]]] = {"html": parse_html, "docx": parse_docx, "xlsx": parse_xlsx, "pdf_text": parse_pdf_text, "pdf_scan": parse_pdf_scan}


def register_parser(kind: str, parser: Callable[[bytes], list[dict]]) -> None:
    """Add or replace the parser of a document type."""
    PARSERS[kind] = parser


def parse_document(name: str, content: bytes, recognize: Callable[[bytes], list[str]] | None = None, settings: Settings = Settings()) -> dict:  # noqa: B008
    """The document of one file; ValueError for other kinds of file."""
    base = name.replace("\\", "/").rpartition("/")[2]
    ext = "." + base.rpartition(".")[2].lower() if "." in base.strip(".") else ""
    kind = SUFFIXES.get(ext)
    if kind is None:
        raise ValueError(f"unsupported file: {base}")
    if kind == "pdf":
        kind = pdf_kind(content, settings.pdf_sample_pages, settings.pdf_least_chars)
    scan = kind == "pdf_scan" and PARSERS[kind] is parse_pdf_scan
    sections = parse_pdf_scan(content, recognize, settings) if scan else PARSERS[kind](content)
    for i, s in enumerate(sections):
        s["section_idx"] = i
    return {"filename": base, "document_type": kind, "sections": sections, "raw_text": "\n".join(s["text"] for s in sections), "metadata": {}}


def pdf_kind(content: bytes, sample_pages: int = 3, least_chars: int = 50) -> str:
    """pdf_text or pdf_scan, by the text of the first pages.  Needs PyMuPDF."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        n = min(sample_pages, doc.page_count)
        chars = sum(len(doc[i].get_text().strip()) for i in range(n))
    return "pdf_text" if n and chars / n >= least_chars else "pdf_scan"


def parse_files(files: DataFrame, recognize: Callable[[bytes], list[str]] | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(path, error, and the columns of a document) of ``files`` (path, content)."""
    fields = list(DOCUMENT)
    schema = "path string, error string, " + ", ".join(f"{name} {kind}" for name, kind in DOCUMENT.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append({"path": path, "error": None, **parse_document(path, bytes(content), recognize, settings)})
                except Exception as e:  # noqa: BLE001 - the row carries it
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:500], **dict.fromkeys(fields)})
            yield pd.DataFrame(rows, columns=["path", "error", *fields])

    return files.select("path", "content").mapInPandas(run, schema)


def read_reports(spark: SparkSession, path: str, recognize: Callable[[bytes], list[str]] | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The documents of all files under ``path``."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), recognize, settings)


def sections_of(documents: DataFrame, key: str = "path") -> DataFrame:
    """One row per section of parsed documents."""
    return documents.select(key, F.explode("sections").alias("s")).select(key, "s.*")
